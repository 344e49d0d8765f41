"""Quality rules as a short-circuit cascade.

A rule is a native predicate on the text that is true for a document to reject.
On a sample each rule's cost (seconds that evaluating it adds to a job that reads
the sample) and selectivity (share of the rows left by the rules before it that it
rejects) are measured; the cascade then tests the rules in order of rejection per
cost inside one ``CASE WHEN``, which
stops at the first rule that rejects. A document is kept when no rule rejects
it, so the order changes the work and never the verdict.

Defined results: null text counts as empty (no words, hence rejected); each row
is judged by its own text, so repeated rows and ties need no order; an empty
table gives an empty table and the rules keep their given order; other columns
pass through, and the verdict column is named by the caller.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, indices, let, materialize, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8  # words in the windows that count as repeats
SAMPLE_ROWS = 2000  # expected rows of the sample that costs are measured on
RUNS = 3  # timed jobs of each rule
LEAST_SECONDS = 1e-4  # taken where a rule's jobs are no slower than reading


def word_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("bigint")


def symbol_count(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    return let(lines_with_words(text),
               lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def repeated_words(words: Column) -> Column:
    """Words inside a window of :data:`WINDOW` words that occurs at least twice.

    Window hashes decide cheaply that a text repeats none (equal windows have
    equal hashes); only other texts compare the windows themselves.
    """

    def any_repeat(w: Column) -> Column:
        return let(F.transform(indices(F.size(w) - (WINDOW - 1)),
                               lambda i: F.xxhash64(F.slice(w, i, WINDOW))),
                   lambda h: F.size(F.array_distinct(h)) < F.size(h))

    def covered(w: Column) -> Column:
        windows = F.array_sort(F.transform(indices(F.size(w) - (WINDOW - 1)), lambda i: F.struct(
            F.array_join(F.slice(w, i, WINDOW), " ").alias("k"), i.alias("i"))))
        at = let(windows, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, j: F.coalesce(
                (F.get(s, j - 1)["k"] == x["k"]), F.lit(False)) | F.coalesce(
                F.get(s, j + 1)["k"] == x["k"], F.lit(False))),
            lambda x: x["i"])))
        return let(at, lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(
                F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))),
            F.lit(0).cast("bigint"), lambda a, x: a + x))

    return F.when(any_repeat(words), covered(words)).otherwise(F.lit(0).cast("bigint"))


@dataclass(frozen=True)
class Rule:
    """``rejects(text)`` is true for a document to reject (never null)."""

    name: str
    rejects: Callable[[Column], Column]


# Fixed values of the base verdict, then of the further rules (generous enough
# for clean prose: a fifth of all words symbols, most lines copies, or words of
# one letter or over 25 on average).
BASE_RULES = (
    Rule("few_words", lambda t: let(words_of(t), lambda w: F.size(w) < 20)),
    Rule("repeated_words", lambda t: let(
        words_of(t), lambda w: 100 * repeated_words(w) > 30 * F.size(w))),
)
FURTHER_RULES = (
    Rule("symbols", lambda t: let(words_of(t), lambda w: 5 * symbol_count(t) > F.size(w))),
    Rule("duplicate_lines", lambda t: let(
        lines_with_words(t), lambda x: 2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x))),
    Rule("word_length", lambda t: let(words_of(t), lambda w: (
        (word_chars(w) < 2 * F.size(w)) | (word_chars(w) > 25 * F.size(w))))),
)
RULES = BASE_RULES + FURTHER_RULES


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text",
                sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """``(rule, seconds, rejected share)`` by rejection per second, best first.

    The sample is a Bernoulli sample of about ``sample_rows`` rows, written once. A
    rule's cost is the least time of :data:`RUNS` small jobs that evaluate it, after
    one that compiles it, less that of jobs that only read the sample. Its share is
    what it rejects of the rows that the rules before it leave, taken from one count
    of the sample by which rules reject a row. Only counts reach the driver.
    """
    n = docs.count()
    if n == 0:
        return [(r, 0.0, 0.0) for r in rules]
    sample = materialize(docs.select(text_or_empty(text_col).alias("t")).sample(
        fraction=min(1.0, sample_rows / n), seed=42), "quality-sample")

    def seconds(count: Column) -> float:
        times = []
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            sample.agg(count).head()
            times.append(time.perf_counter() - began)
        return min(times[1:])

    hits = [r.rejects(F.col("t")) for r in rules]
    reading = seconds(F.sum(F.octet_length("t")))
    cost = [max(seconds(F.count_if(h)) - reading, LEAST_SECONDS) for h in hits]
    by_rules = sample.select(F.array(*hits).alias("hit")).groupBy("hit").agg(F.count(F.lit(1)).alias("n"))
    left = [(r["hit"], r["n"]) for r in by_rules.collect()]  # at most a row per sampled text
    total = max(sum(n for _, n in left), 1)
    out, open_ = [], list(range(len(rules)))
    while open_:
        rejected = {k: sum(n for hit, n in left if hit[k]) / total for k in open_}
        k = max(open_, key=lambda k: (rejected[k] / cost[k], -cost[k], -k))
        out.append((rules[k], cost[k], rejected[k]))
        open_.remove(k)
        left = [(hit, n) for hit, n in left if not hit[k]]
    return out


def cascade(text: Column, ordered: Sequence[Rule]) -> Column:
    """True when no rule rejects; rules after the first rejection are not run."""
    verdict = F.lit(None)
    for k, r in enumerate(ordered):
        verdict = F.when(r.rejects(text), False) if k == 0 else verdict.when(r.rejects(text), False)
    return verdict.otherwise(True) if ordered else F.lit(True)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text",
          kept_col: str = "kept", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the boolean verdict ``kept_col`` of the ordered cascade."""
    ordered = [r for r, _, _ in order_rules(docs, rules, text_col, sample_rows)]
    return docs.withColumn(kept_col, cascade(text_or_empty(text_col), ordered))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text",
              sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the cascade keeps, with their columns."""
    ordered = [r for r, _, _ in order_rules(docs, rules, text_col, sample_rows)]
    return docs.filter(cascade(text_or_empty(text_col), ordered))


def measures(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row the base measures, ``base_failed`` and the cascade's ``kept``.

    Base measures are wanted for every row, so the further rules reuse them;
    the cascade's order still decides which of those are tested.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    ordered = [r for r, _, _ in order_rules(d, FURTHER_RULES)]
    m = let(words_of(F.col("text")), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), word_chars(w).alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    d = d.select("doc_id", "text", m.alias("m"), symbol_count(F.col("text")).alias("n_symbols"),
                 duplicate_lines(F.col("text")).alias("n_dup_lines"))
    d = d.select("doc_id", "text", "m.*", "n_symbols", "n_dup_lines")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"),
                    F.when(failed, False).otherwise(cascade(F.col("text"), ordered)).alias("kept"))
