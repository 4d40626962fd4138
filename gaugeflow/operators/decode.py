"""Strict decoding of reading messages: a typed reading, or the reason it is none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow import vocab
from gaugeflow.functions import instants, jsontext, labels

# The instant of a message that names none: the serialiser's default.
_NO_INSTANT = "0001-01-01T00:00:00+00:00"

# A message as producers write it.
_PLAIN = (
    "struct<type: string, name: variant, payload: struct<co2: int, pm25: int, humidity: int, "
    "energy: double, motionDetected: boolean>, collectedAt: string>"
)
# Value column of a reading and the payload field it comes from.
_PAYLOAD_FIELDS = {
    "co2": "co2",
    "pm25": "pm25",
    "humidity": "humidity",
    "energy_kwh": "energy",
    "motion_detected": "motionDetected",
}

# How each value column is read from a variant.
_TYPED = {
    "co2": jsontext.int_of,
    "pm25": jsontext.int_of,
    "humidity": jsontext.int_of,
    "energy_kwh": jsontext.double_of,
    "motion_detected": jsontext.bool_of,
}

DECODED_COLUMNS = [
    "name",
    "sensor_type",
    "collected_at",
    "co2",
    "pm25",
    "humidity",
    "energy_kwh",
    "motion_detected",
    "error_detail",
]


def decode_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Add the reading each message carries and, where it carries none, ``error_detail``.

    The checks run in a fixed order and the first that fails names the reason: empty body,
    not JSON, JSON null, blank name, unknown type, payload not an object, the fields of the
    type. A failure is permanent: it depends on nothing but the bytes.

    Decoding is narrow, a few expressions per row. A message spelt as producers spell it is
    read in one typed parse; only one that does not pass there is looked at member by
    member, for its reason or its unusual but valid spelling. That close reading is the last
    branch of one expression, so ordinary messages pay nothing for it. ``inline`` keeps Spark
    from repeating the work in later filters.
    """
    staged = _read_plain(messages.withColumn("_text", F.col(value).cast("string")))
    plain = F.struct(
        *[F.col(f"_p.{field}").alias(field) for field in DECODED_COLUMNS[:-1]],
        F.lit(None).cast("string").alias("error_detail"),
    )
    result = F.when(F.col("_plain"), plain).otherwise(_read_closely(F.col("_text")))
    return staged.select(*messages.columns, F.inline(F.array(result)))


def split_decoded(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings on one side, rejected messages on the other; together every input row."""
    rejected = F.col("error_detail").isNotNull()
    return (
        decoded.filter(~rejected).drop("error_detail"),
        decoded.filter(rejected).drop(*[c for c in DECODED_COLUMNS if c != "error_detail"]),
    )


def _read_plain(df: DataFrame) -> DataFrame:
    """Typed parse of the whole message: ``_p`` and whether it settles the row, ``_plain``.

    A typed field is NULL unless the JSON value has exactly its type, so non-null fields are
    valid ones. The name is probed as a variant, because text would also take a number.
    """
    text = F.col("_text")
    parsed = jsontext.parse_marked(text, _PLAIN)
    df = df.withColumn("_parsed", F.when(F.is_valid_utf8(text), parsed))
    df = df.withColumns(
        {
            "_whole": jsontext.is_whole(F.col("_parsed"), text),
            "_name": jsontext.string_of(F.col("_parsed.body.name")),
            "_type": F.col("_parsed.body.type"),
            "_at": instants.parse_wire_instant(F.col("_parsed.body.collectedAt")),
            "_values": F.col("_parsed.body.payload"),
        }
    )
    fields = {c: F.col(f"_values.{f}") for c, f in _PAYLOAD_FIELDS.items()}
    # Exactly four envelope names, in any spelling: none is repeated in another letter case.
    named = F.regexp_count(text, F.lit(r'(?i)"(?:type|name|payload|collectedAt)"\s*:'))
    settled = (
        F.col("_whole")
        & (named == 4)
        & ~_is_blank(F.col("_name"))
        & labels.is_sensor_type(F.col("_type"))
        & F.col("_at").isNotNull()
        & _missing_fields(F.col("_type"), fields).isNull()
    )
    return df.withColumns(
        {
            "_plain": F.coalesce(settled, F.lit(False)),
            "_p": _reading(F.col("_name"), F.col("_type"), F.col("_at"), fields),
        }
    ).drop("_parsed", "_whole", "_name", "_type", "_at", "_values")


def _read_closely(text: Column) -> Column:
    """A message read member by member: a reading or an ``error_detail``."""

    def whole(parsed: Column) -> Column:
        return F.when(jsontext.is_whole(parsed, text), parsed["body"])

    def members(doc: Column) -> Column:
        names = ("name", "type", "payload", "collectedAt")
        return F.struct(
            doc.isNotNull().alias("found"), *[jsontext.member(doc, name).alias(name) for name in names]
        )

    def reading(m: Column) -> Column:
        kind = jsontext.string_of(m["type"])
        fields = {
            c: read(jsontext.exact_member(m["payload"], _PAYLOAD_FIELDS[c]))
            for c, read in _TYPED.items()
        }
        at = F.when(m["collectedAt"].isNull(), instants.instant(_NO_INSTANT)).otherwise(
            instants.parse_wire_instant(jsontext.string_of(m["collectedAt"]))
        )
        return _reading(jsontext.string_of(m["name"]), kind, at, fields)

    def settled(m: Column, c: Column) -> Column:
        return _bound(
            _first_failure(text, m, c),
            lambda error: F.struct(
                *[F.when(error.isNull(), c[field]).alias(field) for field in DECODED_COLUMNS[:-1]],
                error.alias("error_detail"),
            ),
        )

    parsed = jsontext.parse_marked(text, "map<string,variant>")
    return _bound(
        _bound(F.when(F.is_valid_utf8(text), parsed), whole),
        lambda doc: _bound(members(doc), lambda m: _bound(reading(m), lambda c: settled(m, c))),
    )


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, and only where the result is asked for."""
    return F.transform(F.array(value), use)[0]


def _reading(name: Column, kind: Column, at: Column, fields: dict[str, Column]) -> Column:
    """A reading with the value columns its type has; the others are NULL."""
    owner = {m.column: m.sensor_type for m in vocab.METRICS.values()}
    return F.struct(
        name.alias("name"),
        kind.alias("sensor_type"),
        at.alias("collected_at"),
        *[F.when(kind == owner[c], fields[c]).alias(c) for c in _PAYLOAD_FIELDS],
    )


def _first_failure(text: Column, m: Column, c: Column) -> Column:
    """The reason why members ``m``, read as ``c``, are no reading; NULL if they are one."""
    kind, payload_kind = c["sensor_type"], jsontext.json_kind(m["payload"])
    # A member of the wrong JSON type is a parse failure, whatever the other members say.
    mistyped = (
        ~jsontext.is_string_or_null(m["name"])
        | ~jsontext.is_string_or_null(m["type"])
        | c["collected_at"].isNull()
    )
    return (
        F.when(text.isNull() | (text == ""), vocab.BODY_EMPTY)
        .when(F.btrim(text, F.lit(jsontext.BLANKS)) == "null", vocab.BODY_NULL)
        .when(~m["found"] | mistyped, vocab.BODY_NOT_JSON)
        .when(_is_blank(c["name"]), vocab.NO_NAME)
        .when(
            ~labels.is_sensor_type(kind),
            F.format_string(vocab.UNKNOWN_TYPE, F.coalesce(kind, F.lit(""))),
        )
        .when(payload_kind != "Object", F.format_string(vocab.PAYLOAD_KIND, payload_kind))
        .otherwise(_missing_fields(kind, {column: c[column] for column in _PAYLOAD_FIELDS}))
    )


def _missing_fields(kind: Column, fields: dict[str, Column]) -> Column:
    """The complaint about absent or mistyped fields of a type; NULL if there is none."""
    air = fields["co2"].isNull() | fields["pm25"].isNull() | fields["humidity"].isNull()
    return (
        F.when((kind == vocab.AIR_QUALITY) & air, vocab.AIR_FIELDS)
        .when((kind == vocab.MOTION) & fields["motion_detected"].isNull(), vocab.MOTION_FIELD)
        .when((kind == vocab.ENERGY) & fields["energy_kwh"].isNull(), vocab.ENERGY_FIELD)
    )


def _is_blank(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[\s\p{Z}]*$"), F.lit(True))
