"""Quality rules as a short-circuit cascade of native expressions.

Each rule is one Boolean column expression.  On a bounded sample every rule is run alone, which gives its cost (seconds beyond
reading the sample) and its selectivity (share that it rejects).  Rules are then ordered by rejection per cost and chained in one
CASE expression: a document that a rule rejects is not shown to the rules behind it.  The order changes the cost, not the
verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmine.llm.storage import written

#: Rows of the sample on which rules are measured.
SAMPLE_ROWS = 4000
SPACE = " \t\n\x0b\x0c\r"
SHORT_WORDS = 20
REPEAT_PERCENT = 30
REPEAT_WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``rejects`` may use the columns of ``statistics`` and ``text_``, the text without nulls."""

    name: str
    rejects: str


RULES = (
    Rule("symbols", "n_symbols * 20 > word_chars"),
    Rule("repeated_lines", "n_dup_lines * 2 > n_lines"),
    Rule("exclamations", "(length(text_) - length(replace(text_, '!', ''))) * 20 > word_chars"),
    Rule("capitals", "length(regexp_replace(text_, '[^A-Z]+', '')) * 3 > word_chars"),
)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text_``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines``, ``n_repeat_words``.

    A null text counts as an empty one, with zeros everywhere.  Each step is a projection of its own, so arrays that several expressions
    read are made once.  Windows are compared by hash first; only texts in which a hash repeats compare the words themselves.
    """
    w = REPEAT_WINDOW
    d = docs.withColumn("text_", F.coalesce(F.col(text).cast("string"), F.lit("")))
    trimmed = F.btrim("text_", F.lit(SPACE))
    d = d.withColumn("words_", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    d = d.withColumn("lines_", F.filter(F.split("text_", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    places = F.expr(f"if(size(words_) > {w}, sequence(0, size(words_) - {w}), cast(array() as array<int>))")
    d = d.withColumn("windows_", F.transform(places, lambda i: F.xxhash64(F.slice("words_", i + 1, w))))
    d = d.select(*docs.columns, "text_", "words_",
                 F.size("words_").cast("long").alias("n_words"), F.length(F.array_join("words_", "")).cast("long").alias("word_chars"),
                 F.length(F.regexp_replace("text_", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                 F.size("lines_").cast("long").alias("n_lines"),
                 (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
                 (F.size("windows_") > F.size(F.array_distinct("windows_"))).alias("again_"))
    spelled = F.transform(places, lambda i: F.struct(F.array_join(F.slice("words_", i + 1, w), " ").alias("s"), i.alias("i")))
    d = d.withColumn("sorted_", F.when(F.col("again_"), F.sort_array(spelled)))
    d = d.withColumn("met_", F.expr("filter(sorted_, (x, k) -> (k > 0 and get(sorted_, k - 1).s = x.s)"
                                    " or (k < size(sorted_) - 1 and get(sorted_, k + 1).s = x.s))"))
    d = d.withColumn("starts_", F.sort_array(F.transform("met_", lambda x: x["i"])))
    # Words from one start to the next, at most a window, and a whole window after the last.
    covered = F.expr(f"aggregate(transform(starts_, (x, k) -> if(k = size(starts_) - 1, {w}, least({w}, get(starts_, k + 1) - x))),"
                     " 0L, (a, x) -> a + x)")
    kept = [*docs.columns, "text_", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    # A filter on the verdict would be pushed down with all these expressions copied into it; a row number stops it here.
    return d.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.monotonically_increasing_id().alias("row_"))


def base_failed() -> Column:
    return F.expr(f"n_words < {SHORT_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")


def measured(sample: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """Each rule with its cost in seconds on the sample and the share of rows that it rejects, best first."""
    def timed(column: Column) -> tuple[float, float]:
        best, share = float("inf"), 0.0
        for _ in range(2):  # the first run also compiles the expression
            start = time.monotonic()
            share = sample.agg(F.avg(F.coalesce(column, F.lit(False)).cast("double"))).first()[0] or 0.0
            best = min(best, time.monotonic() - start)
        return best, share

    reading = timed(F.octet_length("text_") < 0)[0]
    found = []
    for rule in rules:
        cost, share = timed(F.expr(rule.rejects))
        found.append((rule, max(cost - reading, 1e-3), share))
    return sorted(found, key=lambda r: (-r[2] / r[1], r[0].name))


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    first, *rest = rules
    column = F.when(F.expr(first.rejects), first.name)
    for rule in rest:
        column = column.when(F.expr(rule.rejects), rule.name)
    return column


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``rejected_by`` (a rule that rejects it, null if none or if the base failed) and ``kept``.

    Null and empty texts have no words and fail the base.  Rows are judged one by one: ties and repeated rows play no part; columns of
    ``docs`` that are called like a result are replaced.  An empty table gives no rows.
    """
    made = ("text_", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept",
            "row_", "words_", "lines_", "windows_", "again_", "sorted_", "met_", "starts_")
    docs = docs.select(*[c for c in docs.columns if c == text or c not in made])
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = written(statistics(docs.sample(share, seed=5).select(text), text), "rule-sample")
    order = [r[0] for r in measured(sample, rules)]
    found = statistics(docs, text).withColumn("base_failed", base_failed())
    found = found.withColumn("rejected_by", F.when(~F.col("base_failed"), cascade(order)))
    return found.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull() & (F.col("row_") >= 0)).drop("text_", "row_")
