"""Landed poll responses: what each one was, and the readings inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow import vocab
from gaugeflow.functions import instants, jsontext


_MEMBERS = ("type", "name", "payload", "collectedAt")


def classify_polls(
    polls: DataFrame,
    fallback_s: float = vocab.RATE_LIMIT_FALLBACK_S,
    interval_s: float = vocab.POLL_INTERVAL_S,
) -> DataFrame:
    """Add ``outcome`` and ``next_delay_s`` to every landed response.

    Outcomes: success, rate_limited, server_error, unexpected, corrupted, malformed, empty.
    Only a rate limit changes the delay to the next poll. One bad reading makes its whole
    poll malformed.
    """
    return resolve_polls(polls, fallback_s, interval_s).drop("_readings")


def explode_readings(polls: DataFrame) -> DataFrame:
    """One row per reading of every successful poll, in body order (``position``).

    A recognised type selects the payload shape and a missing field counts as zero or false;
    any other type keeps its payload as JSON text in ``payload.rawJson``. ``collected_at``
    is the instant in the body, else the moment the poll was fetched.
    """
    return resolved_readings(resolve_polls(polls))


def resolved_readings(resolved: DataFrame) -> DataFrame:
    """The rows of ``explode_readings`` from polls that are resolved already."""
    gone = ("body", "status", "retry_after_s", "outcome", "next_delay_s", "_readings")
    kept = [c for c in resolved.columns if c not in gone]
    usable = F.when(F.col("outcome") == "success", F.col("_readings"))
    # The outer form and the filter behind it: a filter in front would resolve bodies twice.
    exploded = resolved.select(
        *kept, F.posexplode_outer(usable).alias("position", "_reading")
    ).filter(F.col("position").isNotNull())
    return exploded.select(
        *kept,
        "position",
        F.col("_reading.type").alias("type"),
        F.col("_reading.name").alias("name"),
        F.col("_reading.payload").alias("payload"),
        F.coalesce("_reading.collected_at", "fetched_at").alias("collected_at"),
    )


def to_messages(readings: DataFrame) -> DataFrame:
    """Readings as keyed messages: ``key`` is ``type:name``, ``value`` is compact JSON."""
    headers = F.array(
        *[
            F.struct(F.lit(k).alias("key"), F.lit(v).cast("binary").alias("value"))
            for k, v in vocab.MESSAGE_HEADERS.items()
        ]
    )
    value = F.struct(
        "type", "name", "payload", instants.wire_instant(F.col("collected_at")).alias("collectedAt")
    )
    key = F.concat(F.coalesce("type", F.lit("")), F.lit(":"), F.coalesce("name", F.lit("")))
    return readings.withColumns(
        {
            "key": key.cast("binary"),
            "value": jsontext.compact(value).cast("binary"),
            "headers": headers,
        }
    )


def resolve_polls(
    polls: DataFrame,
    fallback_s: float = vocab.RATE_LIMIT_FALLBACK_S,
    interval_s: float = vocab.POLL_INTERVAL_S,
) -> DataFrame:
    """Polls with their ``outcome``, ``next_delay_s`` and resolved ``_readings``.

    The readings are resolved inside the row, in three passes over the list, so that each
    pass refers to what the one before it found and nothing is shuffled.
    """
    body = F.col("body")
    trimmed = F.btrim(body, F.lit(jsontext.BLANKS))
    ok = F.col("status") == 200
    members = ", ".join(f"`{name}`: variant" for name in _MEMBERS)
    staged = polls.withColumn(
        "_list", F.when(ok, jsontext.parse_document(body, f"array<struct<{members}>>"))
    )
    staged = staged.withColumn(
        "_probed",
        F.when(_spelt_as_expected(staged), F.transform("_list", _probe)).when(
            F.col("_list").isNotNull(), _respelt(body)
        ),
    )
    staged = staged.withColumn("_read", F.transform("_probed", _read))
    staged = staged.withColumn("_readings", F.transform("_read", _finish))
    error = F.when(
        ok & F.col("_list").isNull() & trimmed.startswith("{"),
        jsontext.string_of(
            jsontext.member(jsontext.parse_document(body, "map<string,variant>"), "error")
        ),
    )
    sound = F.forall("_readings", lambda r: F.coalesce(r["sound"], F.lit(False)))
    outcome = (
        F.when(F.col("status") == 429, "rate_limited")
        .when(F.col("status") >= 500, "server_error")
        .when(F.col("status") != 200, "unexpected")
        .when((trimmed == "null") | (F.size("_list") == 0), "empty")
        .when(F.coalesce(sound, F.lit(False)), "success")
        .when(error == vocab.CORRUPTED_BODY, "corrupted")
        .otherwise("malformed")
    )
    delay = F.when(
        F.col("outcome") == "rate_limited", F.coalesce("retry_after_s", F.lit(fallback_s))
    ).otherwise(F.lit(interval_s))
    return (
        staged.withColumn("outcome", outcome)
        .withColumn("next_delay_s", delay.cast("double"))
        .drop("_list", "_probed", "_read")
    )


def _spelt_as_expected(polls: DataFrame) -> Column:
    """Whether no member can hide behind another letter case."""
    timed = F.contains(F.lower("body"), F.lit('"collectedat"'))
    return ~F.exists(
        "_list",
        lambda e: e["type"].isNull()
        | e["name"].isNull()
        | e["payload"].isNull()
        | (timed & e["collectedAt"].isNull()),
    )


def _respelt(body: Column) -> Column:
    """The probed list with members found in any letter case."""
    elements = jsontext.parse_document(body, "array<map<string,variant>>")
    found = F.transform(
        elements,
        lambda e: F.when(
            e.isNotNull(),
            F.struct(*[jsontext.member(e, name).alias(name) for name in _MEMBERS]),
        ),
    )
    return F.transform(found, _probe)


def _probe(e: Column) -> Column:
    """An element's members and the JSON shape of each; NULL for a null element."""
    return F.when(
        e.isNotNull(),
        F.struct(
            *[e[name].alias(name) for name in _MEMBERS],
            *[F.schema_of_variant(e[name]).alias(f"{name}_shape") for name in _MEMBERS],
        ),
    )


def _read(e: Column) -> Column:
    """The texts of an element, and the payload members its type selects."""
    type_, name, payload, at = (e[m] for m in _MEMBERS)

    def text(value: Column, shape: Column) -> Column:
        return F.when(shape == "STRING", F.try_variant_get(value, "$", "string"))

    def fits_text(shape: Column) -> Column:
        return shape.isNull() | shape.isin("STRING", "VOID")

    # An absent text member keeps its initial value, the empty text.
    kind = F.when(type_.isNull(), F.lit("")).otherwise(text(type_, e["type_shape"]))
    is_object = F.coalesce(e["payload_shape"].startswith("OBJECT"), F.lit(False))
    return F.struct(
        kind.alias("type"),
        F.when(name.isNull(), F.lit("")).otherwise(text(name, e["name_shape"])).alias("name"),
        payload.alias("payload"),
        F.when(payload.isNull(), "absent")
        .when(e["payload_shape"] == "VOID", "null")
        .when(is_object, "object")
        .otherwise("other")
        .alias("shape"),
        instants.parse_wire_instant(text(at, e["collectedAt_shape"])).alias("at"),
        (
            e.isNotNull()
            & fits_text(e["type_shape"])
            & fits_text(e["name_shape"])
            & (at.isNull() | (e["collectedAt_shape"] == "STRING"))
        ).alias("fits"),
        at.isNotNull().alias("timed"),
    )


def _finish(r: Column) -> Column:
    """A resolved reading; ``sound`` is false where the serialiser would give up."""
    payload, kind = r["payload"], r["type"]
    known = F.coalesce(kind.isin(*vocab.SENSOR_TYPES), F.lit(False))
    typed = r["shape"] == "object"

    def of(sensor_type: str, value: Column) -> Column:
        return F.when(typed & (kind == sensor_type), value)

    ints = {f: _lenient_int(payload, f) for f in ("co2", "pm25", "humidity")}
    # Anything a typed payload cannot be read into spoils the poll; unknown types never do.
    spoilt = known & (
        (r["shape"] == "other")
        | F.coalesce(of(vocab.AIR_QUALITY, F.greatest(*[v.isNull() for v in ints.values()])), F.lit(False))
        | F.coalesce(of(vocab.MOTION, _lenient_bool(payload).isNull()), F.lit(False))
        | F.coalesce(of(vocab.ENERGY, _lenient_double(payload).isNull()), F.lit(False))
    )
    raw = F.when(r["shape"] == "absent", F.lit("")).when(~known, F.to_json(payload))
    values = F.struct(
        *[of(vocab.AIR_QUALITY, value).alias(f) for f, value in ints.items()],
        of(vocab.MOTION, _lenient_bool(payload)).alias("motionDetected"),
        of(vocab.ENERGY, _lenient_double(payload)).alias("energy"),
        raw.alias("rawJson"),
    )
    return F.struct(
        (r["fits"] & ~spoilt & (~r["timed"] | r["at"].isNotNull())).alias("sound"),
        kind.alias("type"),
        r["name"].alias("name"),
        F.when(r["shape"] != "null", values).alias("payload"),
        r["at"].alias("collected_at"),
    )


def _any_case(payload: Column, name: str) -> Column:
    """A payload member, by exact name first."""
    by_case = jsontext.member(F.try_variant_get(payload, "$", "map<string,variant>"), name)
    return F.coalesce(jsontext.exact_member(payload, name), by_case)


def _lenient_int(payload: Column, name: str) -> Column:
    """Zero if absent; a 32-bit integer, also one in quotes; NULL for anything else."""
    value = _any_case(payload, name)
    quoted = jsontext.string_of(value)
    return F.coalesce(
        jsontext.int_of(jsontext.exact_member(payload, name)),
        F.when(value.isNull(), F.lit(0))
        .when(quoted.rlike(r"^-?(0|[1-9]\d*)$"), quoted.try_cast("int"))
        .otherwise(jsontext.int_of(value)),
    )


def _lenient_bool(payload: Column) -> Column:
    """False if absent; a JSON boolean; NULL for anything else."""
    value = _any_case(payload, "motionDetected")
    return F.coalesce(
        jsontext.bool_of(jsontext.exact_member(payload, "motionDetected")),
        F.when(value.isNull(), F.lit(False)).otherwise(jsontext.bool_of(value)),
    )


def _lenient_double(payload: Column) -> Column:
    """Zero if absent; a number, also one in quotes; NULL for anything else."""
    value = _any_case(payload, "energy")
    quoted = jsontext.string_of(value)
    return F.coalesce(
        jsontext.double_of(jsontext.exact_member(payload, "energy")),
        F.when(value.isNull(), F.lit(0.0))
        .when(
            quoted.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"), quoted.try_cast("double")
        )
        .otherwise(jsontext.double_of(value)),
    )
