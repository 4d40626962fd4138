"""Quality rules as a short-circuit cascade, ordered by measured rejection per cost.

Words are runs of anything but space and the control characters 9 to 13. A null text is an
empty text; a document without words has zeros everywhere and fails the base rule. Rows are
judged one by one: null or repeated doc_ids, further columns and ties change nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

SPACE = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
# At most so many rows are timed.
SAMPLE_ROWS = 1000


@dataclass(frozen=True)
class Rule:
    """A named condition that rejects a row."""

    name: str
    rejects: Callable[[], Column]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often lambdas read it."""
    return F.transform(F.array(value), use)[0]


def occurrences(text: Column, characters: str) -> Column:
    """How many characters of the text are among the given ones."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def filled_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0)


def repeated_words(ws: Column) -> Column:
    """Words covered by three-word windows that occur at least twice.

    Windows are told apart by 64-bit hashes. Sorted by hash and place, a repeated window has
    an equal neighbour; each of the repeated places, in order, adds what the one before it
    left uncovered.
    """

    def windows(w: Column) -> Column:
        every = F.transform(
            w,
            lambda x, i: F.struct(
                F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")
            ),
        )
        return F.sort_array(F.slice(every, 1, F.greatest(F.size(w) - 2, F.lit(0))))

    def repeated(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h),
        )
        return F.sort_array(F.transform(twice, lambda x: x.i))

    def covered(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct(
                (acc.n + F.least(F.lit(3), i - acc.last)).alias("n"), i.alias("last")
            ),
            lambda acc: acc.n,
        )

    return bound(ws, lambda w: bound(windows(w), lambda s: covered(repeated(s))))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text and the numbers the base rule and the digest need."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = text.select("doc_id", "text", words(F.col("text")).alias("words"))
    return split.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        occurrences(F.col("text"), SYMBOLS).alias("n_symbols"),
        bound(
            filled_lines(F.col("text")), lambda x: F.size(x) - F.size(F.array_distinct(x))
        ).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def standard_rules() -> list[Rule]:
    """Rules on what ``measured`` returns; each looks at the text itself where it must."""
    text = F.col("text")
    n = F.col("n_words")
    line_count = F.size(F.filter(F.split(text, "\n"), lambda x: x != ""))
    return [
        Rule("symbols", lambda: F.col("n_symbols") * 10 > n),
        Rule(
            "word_length",
            lambda: (F.col("word_chars") * 2 < n * 5) | (F.col("word_chars") > n * 15),
        ),
        Rule("repeated_lines", lambda: F.col("n_dup_lines") * 10 > line_count * 6),
        Rule("capitals", lambda: occurrences(text, CAPITALS) * 2 > F.col("word_chars")),
        Rule("exclamations", lambda: occurrences(text, "!") * 5 > n),
        Rule("digits", lambda: occurrences(text, DIGITS) * 5 > F.col("word_chars")),
        Rule(
            "ellipses",
            lambda: F.regexp_count(text, F.lit(r"(?m)(\.\.\.|…)$")) * 10 > line_count * 3,
        ),
        Rule("bullets", lambda: F.regexp_count(text, F.lit(r"(?m)^[ \t]*[-•*] ")) * 10 > line_count * 9),
    ]


def ordered_by_worth(
    docs: DataFrame,
    rules: Sequence[Rule],
    prepare: Callable[[DataFrame], DataFrame] = measured,
    sample_rows: int = SAMPLE_ROWS,
) -> list[Rule]:
    """The rules by rejection per second, as found on a sample of at most ``sample_rows``.

    The sample is taken by a hash of doc_id, out of a fraction expected to hold twice as many
    rows, and prepared like the rest. Only the order, hence the time, depends on it: a
    document is rejected if any rule rejects it. An empty sample keeps the given order.
    """
    share = min(1.0, 2.0 * sample_rows / max(docs.count(), 1))
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    few = docs.select("doc_id", "text").filter(key < int(share * 1_000_000)).limit(sample_rows)
    sample = written(prepare(few), "rule-sample")

    def seconds(condition: Column) -> tuple[float, int]:
        started = time.perf_counter()
        hits = sample.agg(F.sum(F.when(condition, 1).otherwise(0))).first()[0] or 0
        return time.perf_counter() - started, hits

    seconds(F.lit(False))
    floor = min(seconds(F.lit(False))[0] for _ in range(2))
    worth = {}
    for rule in rules:
        seconds(rule.rejects())  # compiles
        took, hits = seconds(rule.rejects())
        worth[rule.name] = hits / max(took - floor, 1e-4)
    return sorted(rules, key=lambda rule: -worth[rule.name])


def first_rejection(rules: Sequence[Rule], before: Column | None = None) -> Column:
    """Name of the first rule that rejects a row; the later ones are not evaluated."""
    cascade = F if before is None else F.when(before, F.lit("base"))
    for rule in rules:
        cascade = cascade.when(rule.rejects(), F.lit(rule.name))
    return cascade.otherwise(F.lit(None).cast("string")) if cascade is not F else F.lit(None)


def judged(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The measures, ``base_failed`` and ``kept`` of every row."""
    numbers = measured(docs)
    order = ordered_by_worth(docs, rules or standard_rules())
    verdict = first_rejection(order, F.col("base_failed"))
    return (
        numbers.withColumn("base_failed", base_failed())
        .withColumn("kept", verdict.isNull())
        .drop("text")
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: NOT regexp_full_match(x, '[ \t\x0B\f\r]*')) AS ls,
    list_filter(string_split(t, chr(10)), lambda x: x <> '') AS ne
  FROM d
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), c AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g
), p AS (
  SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM c WHERE n > 1
), r AS (
  SELECT rid, CAST(sum(least(3, i - coalesce(before, i - 3))) AS BIGINT) AS n_repeat_words
  FROM p GROUP BY rid
), m AS (
  SELECT doc_id, t, len(ne) AS n_lines, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(r.n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words
    OR word_chars * 2 < n_words * 5 OR word_chars > n_words * 15
    OR n_dup_lines * 10 > n_lines * 6
    OR length(regexp_replace(t, '[^A-Z]', '', 'g')) * 2 > word_chars
    OR length(regexp_replace(t, '[^!]', '', 'g')) * 5 > n_words
    OR length(regexp_replace(t, '[^0-9]', '', 'g')) * 5 > word_chars
    OR len(regexp_extract_all(t, '(?m)(\.\.\.|…)$')) * 10 > n_lines * 3
    OR len(regexp_extract_all(t, '(?m)^[ \t]*[-•*] ')) * 10 > n_lines * 9) AS kept
FROM b
"""
