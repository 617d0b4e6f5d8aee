"""Quality rules with risk-controlled cutoffs.

Each rule is a ratio of a text's counts; a text is dropped where a ratio is over its rule's cutoff.  For
every stratum the cutoffs of all rules are tightened together along a path of steps, each the next stricter
cutoff of one rule.  Before a step is taken, the share of labelled good texts (the holdout) that break any
cutoff set so far, this one included (texts of the same words are one trial, however many documents have
them), has to have an exact binomial (Clopper-Pearson) upper bound within
`alpha`, at the level `delta` over the number of strata.  The first step that fails ends the path.  Testing
in a fixed sequence needs no correction for its length, and Bonferroni over the strata covers the rest: with
probability 1 - `delta` no stratum loses more than `alpha` of its good texts to the rules.

The order of a path must not hang on the holdout, so it comes from the other texts alone: a step's share
of all texts that aren't in the holdout, less what the labelled bad texts account for, is about what it
takes from good ones; steps come in that order, and of one rule from loose to strict.  A stratum with too
few labelled good texts to pass its first step (ln(strata / delta) / -ln(1 - alpha) of them, if none breaks
it) has no cutoffs and only the base rules; `report` says which those are.

Spark counts the texts at each step; cutoffs are a table of a row for each stratum, joined to the texts.

Cases: a null or empty text has no words, so it fails the base rules; a null stratum is a stratum of its
own; a label without a document counts nothing; several labels of one document count as good if all are
good, and as bad otherwise; repeated rows give repeated results; empty tables give empty ones, and no
labels no cutoffs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import blocks, rolling, span_hashes, stored, text_bytes, word_spans

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rules: numerator and denominator.  A rule is broken above its cutoff.
RULES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_per_word": ("n_dup_lines", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
}
GRID = {
    "symbols_per_word": [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0],
    "dup_lines_per_word": [0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1],
    "repeat_share": [0.02, 0.05, 0.1, 0.2, 0.3, 0.4],
    "chars_per_word": [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
}
#: The share of a stratum's good texts that the rules may reject, and the probability that some stratum loses more.
ALPHA, DELTA = 0.03, 0.05
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _segments(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over the runs between the bounds."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def count_block(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of RULES for each text, and `same`, a hash of its words."""
    data, offsets = text_bytes(texts)
    docs = len(texts)
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    begins_char = ((data & 0xC0) != 0x80) if len(data) else np.zeros(0, dtype=bool)
    letters = np.concatenate(([0], np.cumsum(begins_char)))
    out = {
        "n_words": np.diff(first),
        "word_chars": _segments(letters[ends] - letters[starts], first),
        "n_symbols": _segments(SYMBOLS[data], offsets),
    }
    words_doc = np.repeat(np.arange(docs), np.diff(first))
    # Lines: each is the bytes between newlines; those with a word, equal to an earlier one of the text.
    newline = np.flatnonzero(data == 0x0A)
    doc_of = np.searchsorted(offsets, newline, side="right") - 1
    line_starts = np.concatenate((offsets[:-1], newline + 1))
    line_doc = np.concatenate((np.arange(docs), doc_of))
    order = np.lexsort((line_starts, line_doc))
    line_starts, line_doc = line_starts[order], line_doc[order]
    line_ends = np.append(line_starts[1:] - 1, offsets[-1])
    last = np.append(line_doc[1:] != line_doc[:-1], True)
    line_ends[last] = offsets[1:][line_doc[last]]
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_doc = line_starts[with_word], line_ends[with_word], line_doc[with_word]
    keys = span_hashes(data, line_starts, line_ends) ^ (line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, kept = np.unique(keys, return_index=True)
    out["n_dup_lines"] = np.bincount(line_doc, minlength=docs) - np.bincount(line_doc[kept], minlength=docs)
    # Three-word windows found twice or more in their text.
    repeat = np.zeros(len(hashes), dtype=bool)
    windows = rolling(hashes, 3)
    inside = np.flatnonzero(words_doc[: len(windows)] == words_doc[2 : 2 + len(windows)]) if len(windows) else np.zeros(0, dtype=np.int64)
    keys = windows[inside] ^ (words_doc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = inside[twice]
    for k in range(3):
        repeat[at + k] = True
    out["n_repeat_words"] = _segments(repeat, first)
    out["same"] = np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes()) for a, b in zip(first.tolist(), first[1:].tolist())], dtype=np.uint64).view(np.int64)
    return {k: v.astype(np.int64) for k, v in out.items()}


def with_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the counts of every text and `same`, one row for each row of `docs`."""

    def run(batches):
        for block in blocks(batches, "text"):
            counts = count_block(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("stratum"), *[pa.array(counts[c]) for c in (*COUNTS, "same")]], names=["doc_id", "stratum", *COUNTS, "same"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, stratum string, " + ", ".join(f"{c} long" for c in (*COUNTS, "same")))


def upper_bound(failed: int, tried: int, level: float) -> float:
    """Clopper-Pearson: the largest rate at which `failed` or fewer of `tried` have the probability `level`."""
    if failed >= tried:
        return 1.0
    terms = np.arange(failed + 1)
    choose = np.array([math.lgamma(tried + 1) - math.lgamma(k + 1) - math.lgamma(tried - k + 1) for k in terms])

    def below(p: float) -> float:
        logs = choose + terms * math.log(p) + (tried - terms) * math.log1p(-p)
        most = logs.max()
        return most + math.log(np.exp(logs - most).sum())

    low, high = failed / tried, 1.0 - 1e-12
    low = max(low, 1e-15)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) > math.log(level) else (low, middle)
    return high


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def ratio(rule: str) -> F.Column:
    top, bottom = RULES[rule]
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def good_ids(labels: DataFrame) -> DataFrame:
    """The ids of documents whose labels all say good and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).where("good").select("doc_id")


def bad_ids(labels: DataFrame) -> DataFrame:
    """The ids of documents that have labels, not all of them good."""
    return labels.select("doc_id").distinct().join(good_ids(labels), "doc_id", "left_anti")


#: All cutoffs of all rules, of each rule from loose to strict: rule, and its cutoff.
STEPS = [(rule, c) for rule, grid in GRID.items() for c in sorted(grid, reverse=True)]


def over(rule: str, cutoff: float) -> F.Column:
    return ratio(rule) > F.lit(cutoff)


def order(n_all: float, all_over: list[float], n_bad: float, bad_over: list[float], bad_share: float) -> list[int]:
    """The steps in the order of about how much they take from good texts, of one rule from loose to strict."""
    bad = [x / n_bad if n_bad else 0.0 for x in bad_over]
    cost, highest = [], {rule: 0.0 for rule in RULES}
    for (rule, _), x, b in zip(STEPS, all_over, bad):
        highest[rule] = max(highest[rule], x / max(n_all, 1.0) - bad_share * b)
        cost.append(highest[rule])
    return sorted(range(len(STEPS)), key=lambda i: (cost[i], i))


def paths(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum and path (the numbers of STEPS in order) of every stratum, from the texts that aren't in the holdout."""
    marked = counted.where(~base_failed()).join(good_ids(labels).withColumn("good", F.lit(1)), "doc_id", "left").join(bad_ids(labels).withColumn("bad", F.lit(1)), "doc_id", "left")
    sums = [
        F.count_if(F.col("good").isNull()).alias("n_all"), F.count("bad").alias("n_bad"), F.count("good").alias("n_good"),
        F.array(*[F.count_if(F.col("good").isNull() & over(*x)) for x in STEPS]).alias("all_over"),
        F.array(*[F.count_if(F.col("bad").isNotNull() & over(*x)) for x in STEPS]).alias("bad_over"),
    ]

    def run(batches):
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                labelled = r["n_good"] + r["n_bad"]
                found.append(order(r["n_all"], r["all_over"], r["n_bad"], r["bad_over"], r["n_bad"] / labelled if labelled else 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("stratum"), pa.array(found, pa.list_(pa.int32()))], names=["stratum", "path"])

    return marked.groupBy("stratum").agg(*sums).mapInArrow(run, "stratum string, path array<int>")


def passed(n: int, broken: list[int], level: float, alpha: float) -> int:
    """How many steps of a path pass; `broken` has the texts that each step is the first to reject."""
    total = 0
    for i, more in enumerate(broken):
        total += more
        if upper_bound(total, n, level) > alpha:
            return i
    return len(broken)


def report(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row for each stratum with labelled good texts: stratum, n_good, n_steps (0: too few texts to certify any), n_rejected and a cutoff for each rule, null where it has none."""
    found = stored(paths(counted, labels))
    # A text that several documents have is one trial: its copies break the same rules.
    held = counted.where(~base_failed()).join(good_ids(labels), "doc_id", "left_semi").dropDuplicates(["stratum", "same"])
    # The place in its stratum's path of the first step that rejects a text.
    named = found.select(F.col("stratum").alias("of"), "path")
    first = F.array_min(F.array_compact(F.array(*[F.when(over(*x), F.array_position("path", F.lit(i)) - 1) for i, x in enumerate(STEPS)])))
    levels = held.join(named, F.col("stratum").eqNullSafe(F.col("of"))).select("stratum", "path", F.coalesce(first, F.lit(len(STEPS))).cast("int").alias("level"))
    by_level = levels.groupBy("stratum", "path").agg(F.count("*").alias("n_good"), F.array(*[F.count_if(F.col("level") == i) for i in range(len(STEPS))]).alias("broken"))
    by_level = stored(by_level)
    level = delta / max(1, by_level.count())

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                n = passed(r["n_good"], r["broken"], level, alpha)
                chosen = dict(STEPS[i] for i in r["path"][:n])  # the strictest of a rule comes last
                rows.append({"stratum": r["stratum"], "n_good": r["n_good"], "n_steps": n, "n_rejected": sum(r["broken"][:n]), **{x: chosen.get(x) for x in RULES}})
            if rows:
                kinds = [("stratum", pa.string()), ("n_good", pa.int64()), ("n_steps", pa.int32()), ("n_rejected", pa.int64()), *[(x, pa.float64()) for x in RULES]]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return by_level.mapInArrow(run, "stratum string, n_good long, n_steps int, n_rejected long, " + ", ".join(f"{x} double" for x in RULES))


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of every text, base_failed, the first rule that it breaks, and kept."""
    counted = stored(with_counts(docs, id_col, text_col, stratum))
    chosen = stored(report(counted, labels, alpha, delta)).select(F.col("stratum").alias("of"), *[F.col(x).alias(f"most_{x}") for x in RULES])
    rows = counted.join(chosen, F.col("stratum").eqNullSafe(F.col("of")), "left")
    broken = [F.when(ratio(x) > F.col(f"most_{x}"), F.lit(x)) for x in RULES]
    out = rows.select("doc_id", "stratum", *COUNTS, base_failed().alias("base_failed"), F.coalesce(*broken).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
