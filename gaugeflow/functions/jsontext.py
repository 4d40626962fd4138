"""Strict reading of JSON text and null-omitting writing of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# JSON has neither NaN nor single-quoted strings.
_STRICT = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}


# Fixed value: what JSON counts as white space between tokens.
BLANKS = " \t\r\n"


def parse_marked(text: Column, ddl: str) -> Column:
    """Parse a text as one JSON document of the given type, with a closing mark behind it.

    The parser stops at the end of the first document. Here the text is a member of an
    object that goes on with ``mark``: when anything trails the document, the mark is not
    reached. The result has the fields ``body`` and ``mark``; see ``is_whole``.
    """
    closing = F.concat(F.lit(',"mark":'), F.xxhash64(text).cast("string"), F.lit("}"))
    return F.from_json(
        F.concat(F.lit('{"body":'), text, closing), f"body {ddl}, mark bigint", _STRICT
    )


def is_whole(parsed: Column, text: Column) -> Column:
    """Whether a marked parse took the whole text for one document."""
    return F.coalesce(parsed["mark"] == F.xxhash64(text), F.lit(False))


def parse_document(text: Column, ddl: str) -> Column:
    """The document a text consists of; NULL unless it is exactly one of the given type."""
    parsed = parse_marked(text, ddl)
    return F.when(is_whole(parsed, text), parsed["body"])


def parse_object(
    df: DataFrame, text: str, names: list[str], when: Column | None = None
) -> DataFrame:
    """Add the named members of a JSON object as variants, and ``_whole``.

    Each member becomes a column ``_<name>``: SQL NULL if absent, a variant of type VOID if
    it is a JSON null. Names match in any letter case, and a repeated name means its last
    value. ``_whole`` is false for texts that are not one JSON object. Rows that spell all
    names as given are read in a single pass; only the others are searched by case.
    """
    body = F.col(text)
    fields = ", ".join(f"`{n}`: variant" for n in names)
    parsed = parse_marked(body, f"struct<{fields}>")
    df = df.withColumn("_parsed", parsed if when is None else F.when(when, parsed))
    found = [F.col("_parsed")["body"][n] for n in names]
    df = df.withColumns(
        {
            "_whole": is_whole(F.col("_parsed"), body) & F.col("_parsed.body").isNotNull(),
            **{f"_{n}": value for n, value in zip(names, found)},
        }
    )
    partial = F.greatest(*[F.col(f"_{n}").isNull() for n in names])
    df = df.withColumn(
        "_others",
        F.when(F.col("_whole") & partial, parse_document(body, "map<string,variant>")),
    )
    return df.withColumns(
        {
            f"_{n}": F.coalesce(
                F.col(f"_{n}"),
                F.when(F.col("_others").isNotNull(), member(F.col("_others"), n)),
            )
            for n in names
        }
    ).drop("_parsed", "_others")


def member(obj: Column, name: str) -> Column:
    """Value of an object member whatever its letter case; the last one wins.

    ``obj`` is a ``map<string,variant>``. SQL NULL means the member is absent, a JSON null
    is a variant of type VOID.
    """
    found = F.filter(F.map_entries(obj), lambda e: F.lower(e["key"]) == name.lower())
    return F.try_element_at(found, F.lit(-1))["value"]


def exact_member(value: Column, name: str, kind: str = "variant") -> Column:
    """Value of an object member by exact name, from a variant."""
    return F.try_variant_get(value, f"$.{name}", kind)


def json_kind(value: Column) -> Column:
    """JSON type name of a variant: Undefined, Null, Object, Array, String, Number, True, False."""
    shape = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), "Undefined")
        .when(shape == "VOID", "Null")
        .when(shape.startswith("OBJECT"), "Object")
        .when(shape.startswith("ARRAY"), "Array")
        .when(shape == "STRING", "String")
        .when(shape == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string")))
        .otherwise("Number")
    )


def string_of(value: Column) -> Column:
    """The text of a JSON string; NULL for any other JSON type."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def is_string_or_null(value: Column) -> Column:
    """Whether a string property can take the value: a string, a null or nothing."""
    return value.isNull() | F.schema_of_variant(value).isin("STRING", "VOID")


def int_of(value: Column) -> Column:
    """A JSON number written as an integer that fits 32 bits; NULL otherwise."""
    return F.when(
        F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "int")
    )


def bool_of(value: Column) -> Column:
    """A JSON true or false; NULL otherwise."""
    return F.when(
        F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean")
    )


def double_of(value: Column) -> Column:
    """Any JSON number as a double; NULL otherwise."""
    shape = F.schema_of_variant(value)
    return F.when(
        shape.isin("BIGINT", "DOUBLE") | shape.startswith("DECIMAL"),
        F.try_variant_get(value, "$", "double"),
    )


def compact(value: Column) -> Column:
    """JSON text of a struct without its null members."""
    return F.to_json(value)
