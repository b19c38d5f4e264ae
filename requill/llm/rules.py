"""Quality rules combined by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation
over the counts of vote patterns estimates how accurate each rule is, and a
document's posterior probability of good quality decides.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from requill.llm.common import beside, cut

SYMBOLS = b"#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_distinct_words", "n_plain_words")


def measures(text: bytes) -> tuple[int, ...]:
    words = text.split()
    n = len(words)
    chars = len(text.decode()) - (len(text) - sum(map(len, words)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(set(windows)) < len(windows):
        times, reach = Counter(windows), 0  # reach: the words before it are counted or not covered
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeat += i + 3 - max(i, reach)
                reach = i + 3
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    plain = sum(w.rstrip(b".,;:!?").decode().isalpha() for w in words)
    return n, chars, symbols, dup, repeat, len(lines), upper, len(set(words)), plain


def features(documents: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``carry``) and measures of every document; a null text has none of anything."""
    return beside(documents, lambda texts: [measures(t) for t in texts], ", ".join(f"{k} long" for k in FEATURES), carry)


def rule_votes() -> dict[str, Column]:
    """Each rule as a vote over the measures: clear cases vote, the middle ground abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def low_is_good(x: Column, good: float, bad: float) -> Column:
        return F.when(x <= good, 1).when(x > bad, -1).otherwise(0)

    def high_is_good(x: Column, good: float, bad: float) -> Column:
        return F.when(x >= good, 1).when(x < bad, -1).otherwise(0)

    lines = F.greatest(F.col("n_lines"), F.lit(1))
    word_length = F.col("word_chars") / n
    return {
        "length": F.when(F.col("n_words") < 50, -1).otherwise(0),
        "word_length": F.when(word_length.between(3.0, 10.0), 1).when(~word_length.between(2.5, 14.0), -1).otherwise(0),
        "symbols": low_is_good(F.col("n_symbols") / n, 0.05, 0.3),
        "duplicate_lines": F.when(F.col("n_dup_lines") / lines <= 0.1, 1).when((F.col("n_dup_lines") > 2) & (F.col("n_dup_lines") / lines > 0.3), -1).otherwise(0),
        "repeats": low_is_good(F.col("n_repeat_words") / n, 0.15, 0.4),
        "upper_case": low_is_good(F.col("n_upper_words") / n, 0.1, 0.4),
        "plain_words": high_is_good(F.col("n_plain_words") / n, 0.8, 0.6),
        "variety": high_is_good(F.col("n_distinct_words") / F.sqrt(n), 4.0, 1.5),
    }


class LabelModel:
    """Two classes; given the class, rules vote independently.

    Each rule has an accuracy in each class: how often it votes bad, abstains
    and votes good on bad and on good documents. A rule that seldom fires says
    much when it does, and little when it doesn't.
    """

    #: Votes each rule is taken to have cast in each class before any are seen, by vote -1, 0, 1.
    BAD, GOOD = (3.0, 3.0, 4.0), (0.1, 2.9, 7.0)

    def __init__(self, rules: int, prior: float = 0.85) -> None:
        self.prior = prior
        self.bad = [[x / sum(self.BAD) for x in self.BAD] for _ in range(rules)]
        self.good = [[x / sum(self.GOOD) for x in self.GOOD] for _ in range(rules)]

    def weights(self) -> list[list[float]]:
        """By rule, what a vote of -1, 0 or 1 adds to the log-odds of good quality; a good vote never counts against."""
        out = []
        for g, b in zip(self.good, self.bad, strict=True):
            low, mid, high = (math.log(x / y) for x, y in zip(g, b, strict=True))
            out.append([min(low, 0.0), mid, max(high, 0.0)])
        return out

    def posterior(self, votes: tuple[int, ...], weights: list[list[float]] | None = None) -> float:
        """Probability of good quality given the votes."""
        odds = math.log(self.prior / (1 - self.prior)) + sum(w[v + 1] for v, w in zip(votes, weights or self.weights(), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))

    def fit(self, patterns: dict[tuple[int, ...], int], rounds: int = 200) -> LabelModel:
        total = sum(patterns.values())
        for _ in range(rounds):
            weights, before = self.weights(), self.prior
            p = {v: self.posterior(v, weights) for v in patterns}
            self.prior = min(0.98, max(0.5, (sum(n * p[v] for v, n in patterns.items()) + 8.5) / (total + 10)))
            for j in range(len(self.bad)):
                good, bad = list(self.GOOD), list(self.BAD)
                for v, n in patterns.items():
                    good[v[j] + 1] += n * p[v]
                    bad[v[j] + 1] += n * (1 - p[v])
                self.good[j], self.bad[j] = [x / sum(good) for x in good], [x / sum(bad) for x in bad]
            if abs(self.prior - before) < 1e-7:
                break
        return self


def voted(documents: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``features`` and the votes of all rules."""
    return features(documents, carry).withColumn("votes", F.array(*rule_votes().values()).cast("array<tinyint>"))


def fitted(votes: DataFrame) -> LabelModel:
    """The model of the votes that documents got."""
    patterns = {tuple(r.votes): r["count"] for r in votes.groupBy("votes").count().collect()}
    model = LabelModel(len(rule_votes()))
    return model.fit(patterns) if patterns else model


def judged(measured: DataFrame, model: LabelModel, threshold: float) -> DataFrame:
    """``row``, measures, base_failed, kept and p_quality of what ``voted`` gives; see ``quality``."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for j, (low, mid, high) in enumerate(model.weights()):
        vote = F.col("votes")[j]
        odds = odds + F.when(vote < 0, low).when(vote > 0, high).otherwise(mid)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    p = 1 / (1 + F.exp(-odds))
    return measured.select("row", *FEATURES, base_failed.alias("base_failed"), (~base_failed & (p >= threshold)).alias("kept"), p.alias("p_quality"))


def quality(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Measures, base rule and weakly supervised verdict of every document.

    One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed (under 50 words, or over half of the words in
    repeated 3-word windows), kept (not base_failed and a posterior of at least
    ``threshold``) and p_quality. Null or empty texts have no words and fail.
    Repeated rows stay, a null doc_id stays null, extra columns are ignored, an
    empty table gives no rows. Only the counts of vote patterns (at most 3 to
    the number of rules) reach the driver; each document is read once.
    """
    measured = cut(voted(documents, ["doc_id"]))
    return judged(measured, fitted(measured), threshold).select(F.col("row.doc_id").cast("long").alias("doc_id"), *FEATURES[:5], "base_failed", "kept", "p_quality")


def kept_documents(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that ``quality`` keeps, as they are, whatever their ids.

    They are measured twice, for the model and for their verdicts: measures
    kept beside whole rows would be one more copy of all texts on disk.
    """
    return judged(voted(documents), fitted(voted(documents, ["doc_id"])), threshold).where("kept").select("row.*")
