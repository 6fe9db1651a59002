"""Quality rules by weak supervision: rules vote good, bad or abstain, and expectation-maximisation weighs them.

Everything on the rows is DataFrame functions. One pass counts each whole text and writes the counts and votes; the votes'
patterns, at most 3 ** (number of rules) rows whatever the input, are counted and brought to the driver, where EM estimates how
often each rule gives each vote for good and for bad documents (abstaining says nothing). The posterior is then a sum of
logarithms by column, and replaces filtering by all rules at once: one doubtful vote doesn't reject.

Defined results. Null text has no words: base_failed, not kept. Rows with a null doc_id and repeated rows are judged like
others. Texts are read whole, whatever their length. Without rows there is nothing to estimate, and no row to judge. Only doc_id
and text are read, so that no other column's name can clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import stage

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATS = 20, 30
KEPT_FROM = 0.5
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeat_words(word_list: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the list. Windows are compared by a 64-bit hash."""

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
        return F.when(F.size(h) < WINDOW, F.lit(0)).otherwise(_let(windows, of_windows))

    def of_windows(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_let(F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted))

    def of_sorted(s: Column) -> Column:
        same = lambda x, i, by: F.coalesce(F.get(s, i + by)["h"] == x["h"], F.lit(False))
        return _let(F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"])), covered)

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    return F.coalesce(_let(F.transform(word_list, lambda w: F.xxhash64(w)), of_hashes), F.lit(0)).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    facts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
        _without(text, WHITE).cast("long").alias("word_chars"),
        (F.char_length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        (F.char_length(text) - _without(text, _CAPITALS)).cast("long").alias("n_capitals"),
        (F.char_length(text) - _without(text, "!?")).cast("long").alias("n_marks"),
    )
    return facts.select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_capitals", "n_marks")


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1)).cast("byte")


def rules() -> dict[str, Column]:
    """Name and vote: 1 good, 0 bad, null abstains."""
    per_word = _share("n_symbols", "n_words")
    length = _share("word_chars", "n_words")
    dup, again = _share("n_dup_lines", "n_lines"), _share("n_repeat_words", "n_words")
    capitals, marks = _share("n_capitals", "word_chars"), _share("n_marks", "n_words")
    return {
        "length": _vote(F.col("n_words") >= 60, F.col("n_words") < LEAST_WORDS),
        "word_length": _vote(length.between(2.5, 9), (length < 1.5) | (length > 12)),
        "symbols": _vote(per_word < 0.02, per_word > 0.1),
        "repeated_lines": _vote(dup < 0.05, dup > 0.3),
        "repeated_words": _vote(again < 0.05, again > 0.2),
        "capitals": _vote(capitals < 0.15, capitals > 0.4),
        "marks": _vote(marks < 0.1, marks > 0.3),
    }


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 200, tolerance: float = 1e-9) -> tuple[float, list[tuple[float, float]]]:
    """EM over vote patterns and their numbers of rows: prior log-odds of good, and each rule's log-odds for a good and a bad vote.

    It starts from the reading that a document with any bad vote is probably bad. Counts are smoothed by one vote.
    """
    k = len(patterns[0][0]) if patterns else 0
    total = sum(n for _, n in patterns)
    if not total:
        return 0.0, [(0.0, 0.0)] * k
    good = [0.1 if 0 in votes else 0.95 for votes, _ in patterns]
    prior, odds = 0.0, [(0.0, 0.0)] * k
    for _ in range(rounds):
        mass = sum(p * n for p, (_, n) in zip(good, patterns))
        share = (mass + 1) / (total + 2)
        prior = math.log(share / (1 - share))
        odds = []
        for r in range(k):
            table = [[1.0, 1.0], [1.0, 1.0]]  # [class][vote]
            for p, (votes, n) in zip(good, patterns):
                if votes[r] is not None:
                    table[1][votes[r]] += p * n
                    table[0][votes[r]] += (1 - p) * n
            yes, no = table[1][1] / sum(table[1]), table[0][1] / sum(table[0])
            odds.append((math.log(yes / no), math.log((1 - yes) / (1 - no))))
        new = []
        for votes, _ in patterns:
            z = prior + sum(o[0] if v else o[1] for v, o in zip(votes, odds) if v is not None)
            new.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
        moved = max(abs(a - b) for a, b in zip(good, new))
        good = new
        if moved < tolerance:
            break
    return prior, odds


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, posterior and kept for every row of ``docs``."""
    names = list(rules())
    voted = stage(counted(docs).withColumns({f"vote_{k}": v for k, v in rules().items()}), "rules-votes")
    votes = [f"vote_{k}" for k in names]
    patterns = [(tuple(r[v] for v in votes), r["n"]) for r in voted.groupBy(*votes).agg(F.count("*").alias("n")).orderBy(*votes).collect()]  # at most 3 ** rules rows
    prior, odds = estimate(patterns)
    z = F.lit(prior)
    for v, (good, bad) in zip(votes, odds):
        z = z + F.when(F.col(v) == 1, F.lit(good)).when(F.col(v) == 0, F.lit(bad)).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))
    posterior = 1 / (1 + F.exp(-z))
    return voted.withColumn("base_failed", failed).withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEPT_FROM))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
