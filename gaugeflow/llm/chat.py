"""Chat formatting, read back by a deterministic parser until it gives the turns again.

A turn is an opening mark, a space, its text, a space, a closing mark; a role without marks
of its own goes into a unit before the text unit. A control string inside a text gets a
backslash behind its bracket, one more if it has some already, so that every text has exactly
one escaped form and taking one backslash away restores it. The parser cuts the output at the
control strings, hence no text may hold one.

Null texts and roles are empty texts and roles, null conversations form one conversation, and
turns go by turn (nulls first), role, text, so repeated rows have a defined order. An empty
table gives no conversation. Only doc columns conv_id, turn, role, text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import bound

# Fixed marks of the template: role, opening, closing.
MARKS = {
    "user": ("[INST]", "[/INST]"),
    "assistant": ("<s>", "</s>"),
    "system": ("<<SYS>>", "<</SYS>>"),
}
ROLE_OPEN, ROLE_CLOSE, TEXT_OPEN, TEXT_CLOSE = "<role>", "</role>", "<text>", "</text>"
CONTROL = r"\[/?INST\]|</?(?:s|role|text)>|<</?SYS>>"
SQUARE, ANGLE = r"/?INST\]", r"(?:/?(?:s|role|text)>|</?SYS>>)"
PLACE = rf"(?<=\[)(?=\\*{SQUARE})|(?<=<)(?=\\*{ANGLE})"
ESCAPED = rf"(?<=\[)\\(?=\\*{SQUARE})|(?<=<)\\(?=\\*{ANGLE})"

PLANTED = [
    (-7, 0, "user", "</s>[INST] ok [/INST]"),
    (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(PLACE), F.lit("\\\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit(""))


def render(role: Column, text: Column) -> Column:
    """One turn as text; ``role`` and ``text`` hold no control string."""
    out = F.when(F.lit(False), F.lit(""))
    for name, (opening, closing) in MARKS.items():
        out = out.when(role == name, F.concat(F.lit(f"{opening} "), text, F.lit(f" {closing}")))
    return out.otherwise(
        F.concat(
            F.lit(f"{ROLE_OPEN} "), role, F.lit(f" {ROLE_CLOSE}{TEXT_OPEN} "), text, F.lit(f" {TEXT_CLOSE}")
        )
    )


def parse(formatted: Column) -> Column:
    """The turns of an output as (role, text); null if it does not follow the grammar.

    Control strings and the pieces between them alternate. Every second control string opens
    a unit whose content is the next piece; the pieces between units must be empty.
    """

    def content(piece: Column) -> Column:
        return unescape(F.substring(piece, F.lit(2), F.length(piece) - 2))

    def units(parts: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor(F.size(parts.marks) / 2).cast("int") - 1),
            lambda k: F.struct(
                F.get(parts.marks, 2 * k).alias("mark"),
                F.get(parts.pieces, 2 * k + 1).alias("piece"),
                (F.get(parts.pieces, 2 * k) == "").alias("tight"),
            ),
        )

    def turns(found: Column) -> Column:
        def turn(unit: Column, k: Column) -> Column:
            role = F.when(unit.mark == TEXT_OPEN, content(F.get(found, k - 1).piece))
            for name, (opening, _) in MARKS.items():
                role = role.when(unit.mark == opening, F.lit(name))
            return F.struct(
                unit.mark.alias("mark"), role.alias("role"), content(unit.piece).alias("text")
            )

        return F.when(
            F.forall(found, lambda unit: unit.tight),
            F.transform(
                F.filter(F.transform(found, turn), lambda t: t.mark != ROLE_OPEN),
                lambda t: F.struct(t.role.alias("role"), t.text.alias("text")),
            ),
        )

    parts = F.struct(
        F.split(formatted, CONTROL, -1).alias("pieces"),
        F.regexp_extract_all(formatted, F.lit(CONTROL), F.lit(0)).alias("marks"),
    )
    return bound(
        parts,
        lambda cut: F.when(
            (F.size(cut.marks) > 0) & (F.size(cut.marks) % 2 == 0), bound(units(cut), turns)
        ),
    )


def formatted_turns(rows: DataFrame) -> DataFrame:
    """Every turn rendered; those that a trial parse does not give back are escaped."""
    clean = rows.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    plain = render(F.col("role"), F.col("text"))
    source = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
    trial = clean.withColumn("plain", plain).withColumn(
        "same", F.coalesce(parse(F.col("plain")) == source, F.lit(False))
    )
    return trial.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(F.col("same"), F.col("plain"))
        .otherwise(render(escape(F.col("role")), escape(F.col("text"))))
        .alias("rendered"),
        (~F.col("same")).alias("escaped"),
    )


def conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: formatted text, loss mask, the turns read back from it.

    The loss mask is the spans (start from 0, length, in code points) of assistant texts as
    they stand in the formatted text. A conversation is one string by nature, so it is put
    together in one task; turns are rendered, tried and escaped before, wherever they lie.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    opening, closing = (len(mark) + 1 for mark in MARKS["assistant"])
    before = F.sum(F.length("rendered")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    turns = formatted_turns(rows).withColumn("start", F.coalesce(before, F.lit(0)))
    whole = (
        turns.groupBy("conv_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("turn", "role", "text", "start", "rendered"))
            ).alias("turns"),
            F.count(F.when(F.col("escaped"), 1)).alias("n_escaped"),
        )
        .select(
            "conv_id",
            "n_escaped",
            F.array_join("turns.rendered", "").alias("formatted"),
            F.transform(
                F.filter("turns", lambda t: t.role == "assistant"),
                lambda t: F.struct(
                    (t.start + opening).alias("start"),
                    (F.length(t.rendered) - (opening + closing)).alias("length"),
                ),
            ).alias("loss_mask"),
            F.transform(
                "turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))
            ).alias("source"),
        )
    )
    return whole.withColumn("recovered", parse(F.col("formatted"))).select(
        "conv_id",
        "formatted",
        "loss_mask",
        "recovered",
        "n_escaped",
        F.coalesce(F.col("recovered") == F.col("source"), F.lit(False)).alias("identical"),
    )


def under_mask(formatted: Column, loss_mask: Column) -> Column:
    """The text under the loss mask: its spans cut out of the output, unescaped, nothing between."""
    spans = F.transform(
        loss_mask, lambda m: unescape(F.substring(formatted, m.start.cast("int") + 1, m.length.cast("int")))
    )
    return F.array_join(spans, "")


def digest(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The contract's digest of all conversations and a planted one."""
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return read_back(conversations(rows.select("conv_id", "turn", "role", "text").unionByName(planted)))


def read_back(out: DataFrame) -> DataFrame:
    """The digest of formatted conversations, taken from their output and its loss mask."""
    loss = under_mask(F.col("formatted"), F.col("loss_mask"))
    return out.select(
        "conv_id",
        F.size("recovered").cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(
                F.transform(
                    "recovered", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))
                ),
                "",
            ),
            256,
        ).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                   (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *,
    regexp_replace(regexp_replace(text, '(\[)(\\*/?INST\])', '\1\\\2', 'g'),
      '(<)(\\*(?:/?(?:s|role|text)>|</?SYS>>))', '\1\\\2', 'g') AS et,
    regexp_replace(regexp_replace(role, '(\[)(\\*/?INST\])', '\1\\\2', 'g'),
      '(<)(\\*(?:/?(?:s|role|text)>|</?SYS>>))', '\1\\\2', 'g') AS er
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
    AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
    FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(et) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
    WHEN 'system' THEN 17 ELSE length(er) + 30 END) AS BIGINT) AS formatted_chars,
  true AS identical
FROM e GROUP BY conv_id
"""
