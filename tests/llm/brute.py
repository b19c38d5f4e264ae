"""Plain-Python versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def secrets(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def random_spans(texts, alphabets, text_like, encoding_of, level=0.05):
    """The method's spans (start, end) of each text, by plain formulas."""
    tail = lambda z: math.erfc(z / 2**0.5) / 2
    found = []
    for k, text in enumerate(texts):
        base = secrets(text)
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}=*", text or ""):
            encoding = None if any(a <= m.start() and m.end() <= b for _, a, b in base) else encoding_of(m[0])
            if encoding is None:
                continue
            plain = m[0].lower() if encoding == "hex" else m[0].replace("-", "+").replace("_", "/").replace("=", "")
            v, size = [alphabets[encoding].index(c) for c in plain], len(alphabets[encoding])
            n, share = len(v), 1 / size
            two, three = n * (n - 1) / 2, n * (n - 1) * (n - 2) / 6
            same = sum(x * (x - 1) / 2 for x in Counter(v).values())
            var = two * share * (1 - share)
            skew = (var * (1 - 2 * share) + 6 * three * share**2 * (1 - share)) / var**1.5
            chi = 6 / skew * (max(skew * (same - 0.5 - two * share) / var**0.5 / 2 + 1, 0) ** (1 / 3) - 1) + skew / 6
            high = [2 * x >= size for x in v]
            expected = 2 * sum(high) * (n - sum(high)) / n + 1
            spread = (expected - 1) * (expected - 2) / (n - 1)
            runs = abs(1 + sum(a != b for a, b in zip(high, high[1:])) - expected) / spread**0.5 if spread > 0 else 9
            mean = sum(v) / n
            square = sum((x - mean) ** 2 for x in v)
            serial = abs(sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / square * n**0.5) if square else 9
            least = min(1, tail(chi), 2 * tail(runs), 2 * tail(serial))
            agree, thrice, change = text_like[encoding]
            changes = len(re.findall("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", plain)) - 1
            fewer = (two * agree - same - 0.5) / (two * agree * (1 - agree) + 6 * three * (thrice - agree**2)) ** 0.5
            more = (changes - 0.5 - (n - 1) * change) / ((n - 1) * change * (1 - change)) ** 0.5
            found.append((k, m.start(), m.end(), 1 - (1 - least) ** 3, tail((fewer + more) / 2**0.5)))
    bins = [min(120, int(-math.log10(max(f[4], 1e-300)) / 0.1)) if f[4] < 1 else 0 for f in found]
    low = next((b for b in range(121) if sum(x >= b for x in bins) and len(bins) * 10 ** (-b * 0.1) <= level * sum(x >= b for x in bins)), 121)
    out = [[] for _ in texts]
    for f, b in zip(found, bins):
        if b >= low and f[3] >= 0.01:
            out[f[0]].append((f[1], f[2]))
    return out


def near(rows, size, percent):
    """{id: (set size, component)} for unique ids."""
    sets = {}
    for i, text in rows:
        words = WORD.findall(lower(text or ""))
        sets[i] = frozenset(tuple(words[j : j + size]) for j in range(len(words) - size + 1)) or (frozenset([tuple(words)]) if words else frozenset())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def contamination(rows, items, window):
    owners = {}
    for item, text in items:
        if item is None:
            continue
        words = BENCH_WORD.findall(lower(text or ""))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            owners.setdefault(tuple(words[i : i + size]), set()).add(item)
    out = []
    for i, text in rows:
        words = BENCH_WORD.findall(lower(text or ""))
        hit, found = set(), set()
        for size in {len(k) for k in owners}:
            for j in range(len(words) - size + 1):
                if o := owners.get(tuple(words[j : j + size])):
                    found |= o
                    hit |= set(range(j, j + size))
        out.append((i, len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def repeats(rows, window):
    words = [(i, WORD.findall(text or "")) for i, text in rows]
    count = Counter(tuple(w[j : j + window]) for _, w in words for j in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = {k for j in range(len(w) - window + 1) if count[tuple(w[j : j + window])] > 1 for k in range(j, j + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), sha(kept)))
    return out


def rule_measures(text):
    text = text or ""
    words = WORD.findall(text)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def url(text, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", text or "", re.S)
    if not m:
        return "", "", None, "allow"
    host, path = lower(m[1]), m[2]
    fits = [(len(r), r.index("/"), v, r) for v, r in rules if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    best = max(fits) if fits else (None, None, "allow", None)
    return host, path, best[3], best[2]
