"""Secret scans: fixed patterns, and a battery of randomness tests.

DataFrame functions only. Strings that look encoded are tested for randomness
in their inferred encoding: chi-squared uniformity over the alphabet, a runs
test about the alphabet's middle, and lag-one serial correlation. Passing them
says little of a short string. So what a string must disprove is that it is
text-like: its symbols collide and its classes of characters change as those of
names and words do, by an amount that grows with its length. False discoveries
are controlled over these p-values by a step-up over all candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from requill.llm.common import cut

#: The base patterns, by kind in the order of ties.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
#: Candidates of the method: long runs of characters that encodings use; "=" only pads their end, so a name before it is apart.
ENCODED = r"[A-Za-z0-9+/_-]{20,}+=*+"
#: Alphabets by encoding, in the order of their symbols' values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32 lower": "abcdefghijklmnopqrstuvwxyz234567",
    "base36 lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: What text-like strings of each encoding are taken to do: the chance that two symbols agree, that three do, and that a symbol is of another class than the one before it.
#: English letters agree with a chance of 0.066; the rest allows for digits, capitals and words run together.
TEXT = {"hex": (0.11, 0.015, 0.25), "base32": (0.055, 0.0042, 0.15), "base36": (0.055, 0.0042, 0.15), "base32 lower": (0.055, 0.0042, 0.15), "base36 lower": (0.055, 0.0042, 0.15), "base64": (0.048, 0.0033, 0.42)}
CLASSES = "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"
#: Strings that the battery finds less random than this are passed over.
REJECTED = 0.01
#: Steps of -log10 of a p-value, and how many of them are told apart.
STEP, STEPS = 0.1, 120
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Characters of a piece of text that places are looked up in.
PIECE = 4096


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: its lambda variable is bound by a one-element transform."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, combine) -> Column:
    """The array of ``combine`` (sum or maximum of non-negative ints) over each prefix.

    By blocks of about the root of the length: an array that grows by one copies
    itself, so its length must stay small.
    """
    zero = F.lit(0)

    def folded(part: Column, start: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            return let(combine(acc["at"], x), lambda y: F.struct(y.alias("at"), F.concat(acc["out"], F.array(y)).alias("out")))

        return F.aggregate(part, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), add, lambda acc: acc["out"])

    def blocked(s: Column) -> Column:
        v, width = s["v"], s["width"]
        blocks = F.sequence(zero, F.greatest(F.ceil(F.size(v) / width).cast("int") - 1, zero))
        part = lambda b: F.slice(v, b * width + 1, width)
        totals = F.transform(blocks, lambda b: F.aggregate(part(b), zero, combine))
        return let(folded(totals, zero), lambda t: F.flatten(F.transform(blocks, lambda b: folded(part(b), F.when(b > 0, F.get(t, b - 1)).otherwise(zero)))))

    return let(values, lambda v: let(F.struct(v.alias("v"), F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int").alias("width")), blocked))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, kind, end, value): leftmost non-overlapping matches; code points, end exclusive.

    The pieces between matches and the matches alternate, so running sums of
    their lengths give the places.
    """

    def placed(s: Column) -> Column:
        gap = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(s))
        ends = running(F.zip_with(gap, s, lambda g, h: g + F.length(h)), lambda a, b: a + b)
        return F.zip_with(ends, s, lambda e, h: F.struct((e - F.length(h)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), e.alias("end"), h.alias("value")))

    # Most texts have no match; they are looked through once.
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(F.array().cast(SPANS))


def base_matches(text: Column) -> Column:
    """Matches of the three base patterns by start, then kind; short ones dropped."""
    assign = F.filter(matches(text, ASSIGN, "assign"), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 8)
    return F.array_sort(F.concat(assign, matches(text, ACCESS, "access"), matches(text, HEX, "hex")))


def outside(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that no base span contains, in one pass over both by their start."""
    item = lambda m, own: F.struct(m["start"].alias("start"), own.alias("own"), m["kind"].alias("kind"), m["end"].alias("end"), m["value"].alias("value"))

    def kept(both: Column) -> Column:
        reach = running(F.transform(both, lambda m: F.when(m["own"], 0).otherwise(m["end"])), lambda a, b: F.greatest(a, b))
        pairs = F.filter(F.arrays_zip(both.alias("m"), reach.alias("reach")), lambda x: x["m"]["own"] & (x["reach"] < x["m"]["end"]))
        return F.transform(pairs, lambda x: F.struct(*(x["m"][k].alias(k) for k in ("start", "kind", "end", "value"))))

    both = F.array_sort(F.concat(F.transform(base, lambda m: item(m, F.lit(False))), F.transform(spans, lambda m: item(m, F.lit(True)))))
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), let(both, kept)).otherwise(spans)


def encoding_of(value: Column) -> Column:
    """The narrowest encoding a string may be in, or null: letters alone are words, and digits alone numbers."""
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return (
        F.when(~mixed, F.lit(None).cast("string"))
        .when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(value.rlike("^[A-Z2-7]+=*$"), "base32")
        .when(value.rlike("^[A-Z0-9]+=*$"), "base36")
        .when(value.rlike("^[a-z2-7]+=*$"), "base32 lower")
        .when(value.rlike("^[a-z0-9]+=*$"), "base36 lower")
        .when(value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("^[A-Za-z0-9+/_-]+=*$"), "base64")
    )


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution: to about 1e-5 near the middle (a fixed rational approximation), by a continued fraction beyond 2."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) / 2.5066282746
    t = 1 / (1 + 0.33267 * x)
    near = density * (0.4361836 * t - 0.1201676 * t * t + 0.9372980 * t * t * t)
    far = density / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65)))))
    upper = F.when(x < 2, near).otherwise(far)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _battery(value: Column, encoding: Column) -> Column:
    """(p, q) of a string: p of "random in this encoding", the smallest of three tests, allowing for their number; q of "text-like"."""
    by_encoding = lambda table: F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), encoding)
    plain = F.when(encoding == "hex", F.lower(value)).otherwise(F.translate(value, "-_=", "+/"))
    total = lambda array, f: F.aggregate(array, F.lit(0.0), lambda a, x: a + f(x))
    pairs = lambda v, n, f: F.zip_with(F.slice(v, F.lit(1), n - 1), F.slice(v, F.lit(2), n - 1), f)
    text = [by_encoding({k: float(v[i]) for k, v in TEXT.items()}) for i in range(3)]

    def coded(s: Column) -> Column:
        symbols = F.split(s["alphabet"], "")
        n = F.length(s["plain"])
        # How many pairs of symbols agree: chi-squared is a linear function of it.
        collisions = total(symbols, lambda c: F.when(c == "", 0.0).otherwise(let(n - F.length(F.replace(s["plain"], c, F.lit(""))), lambda k: k * (k - 1.0) / 2)))
        values = F.transform(F.filter(F.split(s["plain"], ""), lambda c: c != ""), lambda c: F.instr(s["alphabet"], c) - 1)
        changes = F.size(F.regexp_extract_all(s["plain"], F.lit(CLASSES), F.lit(0))) - 1.0
        return F.struct(values.alias("v"), F.length(s["alphabet"]).alias("size"), collisions.alias("collisions"), changes.alias("changes"))

    def counted(s: Column) -> Column:
        v, size = s["v"], s["size"]
        high = F.transform(v, lambda x: (2 * x >= size).cast("int"))
        return F.struct(v.alias("v"), size.alias("size"), F.size(v).alias("n"), s["collisions"].alias("collisions"), s["changes"].alias("changes"), high.alias("high"), (total(v, lambda x: x) / F.size(v)).alias("mean"))

    def measured(s: Column) -> Column:
        v, n, mean = s["v"], s["n"], s["mean"]
        ups = F.aggregate(s["high"], F.lit(0), lambda a, x: a + x)
        runs = F.aggregate(pairs(s["high"], n, lambda a, b: F.abs(a - b)), F.lit(1), lambda a, x: a + x)
        expected = 2.0 * ups * (n - ups) / n + 1
        variance = total(v, lambda x: (x - mean) * (x - mean))
        product = total(pairs(v, n, lambda a, b: (a - mean) * (b - mean)), lambda x: x)
        kept = [s[k].alias(k) for k in ("collisions", "changes")]
        return F.struct(n.cast("double").alias("n"), (1.0 / s["size"]).alias("share"), *kept, runs.alias("runs"), expected.alias("expected"), variance.alias("variance"), product.alias("product"))

    def scored(s: Column) -> Column:
        n, share, expected = s["n"], s["share"], s["expected"]
        two, three = n * (n - 1) / 2, n * (n - 1) * (n - 2) / 6
        # Exact moments of the collisions of random symbols, matched by Wilson and Hilferty's cube root: expected counts below 1 do no harm.
        var = two * share * (1 - share)
        skew = (var * (1 - 2 * share) + 6 * three * share * share * (1 - share)) / F.pow(var, F.lit(1.5))
        off = (s["collisions"] - 0.5 - two * share) / F.sqrt(var)
        z_chi = 6 / skew * (F.pow(F.greatest(skew * off / 2 + 1, F.lit(0.0)), F.lit(1 / 3)) - 1) + skew / 6
        spread = (expected - 1) * (expected - 2) / (n - 1)
        z_runs = F.when(spread > 0, F.abs(s["runs"] - expected) / F.sqrt(spread)).otherwise(9.0)
        z_serial = F.when(s["variance"] > 0, F.abs(s["product"] / s["variance"] * F.sqrt(n))).otherwise(9.0)
        agree, thrice, change = text
        text_var = two * agree * (1 - agree) + 6 * three * (thrice - agree * agree)
        fewer = (two * agree - s["collisions"] - 0.5) / F.sqrt(text_var)
        more = (s["changes"] - 0.5 - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
        return F.struct(z_chi.alias("chi"), z_runs.alias("runs"), z_serial.alias("serial"), ((fewer + more) / 2**0.5).alias("text"))

    def combined(z: Column) -> Column:
        least = F.least(F.lit(1.0), _tail(z["chi"]), 2 * _tail(z["runs"]), 2 * _tail(z["serial"]))
        return F.struct((1 - F.pow(1 - least, F.lit(3.0))).alias("p"), _tail(z["text"]).alias("q"))

    step = F.struct(plain.alias("plain"), by_encoding(ALPHABETS).alias("alphabet"))
    for use in (coded, counted, measured, scored):
        step = let(step, use)
    return let(step, combined)


def scanned(documents: DataFrame) -> DataFrame:
    """All input columns under ``row``, base matches, and candidates (start, kind, end, p, bin) of every text."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("row"))
    # Several lambdas read the text's spans: they are bound, not computed anew by each.
    found = let(F.struct(base_matches(text).alias("base"), matches(text, ENCODED, "random").alias("long")), lambda s: F.struct(s["base"].alias("base"), outside(s["long"], s["base"]).alias("long")))

    def tested(m: Column) -> Column:
        return let(_battery(m["value"], m["encoding"]), lambda r: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), r["p"].alias("p"), F.least(F.floor(-F.log10(F.greatest(r["q"], F.lit(1e-300))) / STEP), F.lit(STEPS)).cast("int").alias("bin")))

    named = lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), m["value"].alias("value"), encoding_of(m["value"]).alias("encoding"))
    result = let(found, lambda s: F.struct(F.transform(s["base"], lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"))).alias("base"), F.transform(F.filter(F.transform(s["long"], named), lambda m: m["encoding"].isNotNull()), tested).alias("tests")))
    return rows.select("row", result.alias("s")).select("row", "s.base", "s.tests")


def threshold(tests: DataFrame, level: float) -> int:
    """The least bin of -log10 q that counts as a discovery: Benjamini and Hochberg's step-up over all candidates, by bins.

    A string's q is the chance that a text-like one looks as random, so q at
    most level * discoveries / candidates keeps the expected share of false ones
    below ``level``, in small tables too. At most STEPS + 1 counts reach the driver.
    """
    counts = tests.select(F.explode("tests.bin").alias("bin")).groupBy("bin").count().collect()
    table = {r["bin"]: r["count"] for r in counts}
    m = sum(table.values())
    for low in range(STEPS + 1):
        passed = sum(n for b, n in table.items() if b >= low)
        if passed and m * 10 ** (-low * STEP) <= level * passed:
            return low
    return STEPS + 1


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _decided(tests: DataFrame, level: float) -> DataFrame:
    least = threshold(tests, level)
    passed = F.filter("tests", lambda t: (t["bin"] >= least) & (t["p"] >= REJECTED))
    more = F.transform(passed, lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))
    return tests.select("row", "base", F.array_sort(F.concat("base", more)).alias("found"))


def find_secrets(documents: DataFrame, level: float = 0.05) -> DataFrame:
    """Secrets of every text: ``row`` (all input columns), base and found spans.

    ``base`` holds the matches of the fixed patterns and ``found`` these and the
    strings that pass the randomness tests and are discoveries at ``level``,
    both as arrays of (start, kind, end) in this order; code points, end
    exclusive. A null text is empty and has none. One row per input row; extra
    columns stay inside ``row``, whatever their names. The texts are scanned
    twice, for the threshold and for the result; nothing is shuffled but
    counts. Work grows with a text's length, and with its matches times the
    square root of their number.
    """
    return _decided(scanned(documents), level)


def secret_report(documents: DataFrame, level: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every row; see ``find_secrets``. Texts are scanned once."""
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    tests = cut(scanned(documents.select("doc_id", "text")).select(F.struct("row.doc_id").alias("row"), "base", "tests"))
    return _decided(tests, level).select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        count("base", "assign").alias("n_assign"),
        count("base", "access").alias("n_access"),
        count("base", "hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        count("found", "random").alias("n_random"),
    )


def redact(documents: DataFrame, mark: str = "[SECRET]", level: float = 0.05) -> DataFrame:
    """The input with each found span of ``text`` (overlapping ones as one) replaced by ``mark``; a null text stays null."""
    found = find_secrets(documents, level)
    text = F.col("row.text")

    def masked(s: Column) -> Column:
        spans, pieces = s["spans"], s["pieces"]
        # A span that begins before an earlier one ends continues it; others close a gap that begins where the last one ended.
        reach = running(F.transform(spans, lambda m: m["end"]), lambda a, b: F.greatest(a, b))
        before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(spans) - 1))
        gaps = F.zip_with(before, spans, lambda a, m: F.when(m["start"] >= a, F.struct(a.alias("a"), m["start"].alias("b"))))
        last = F.struct(F.element_at(reach, -1).alias("a"), F.lit(None).cast("int").alias("b"))

        def between(g: Column) -> Column:
            first = F.floor(g["a"] / PIECE).cast("int")
            count = F.coalesce(F.floor(g["b"] / PIECE).cast("int") - first + 1, F.greatest(F.size(pieces) - first, F.lit(0)))
            return F.substring(F.array_join(F.slice(pieces, first + 1, count), ""), g["a"] - first * PIECE + 1, F.coalesce(g["b"] - g["a"], F.lit(2**31 - 1)))

        return let(F.concat(F.filter(gaps, lambda g: g.isNotNull()), F.array(last)), lambda all_gaps: F.array_join(F.transform(all_gaps, between), mark))

    parts = F.struct(F.col("found").alias("spans"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"))
    clean = F.when(F.size("found") > 0, let(parts, masked)).otherwise(text)
    return found.select(*(clean.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in documents.columns))
