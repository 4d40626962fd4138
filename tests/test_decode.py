import pytest
from pyspark.sql import functions as F

from gaugeflow import vocab
from gaugeflow.functions import labels
from gaugeflow.operators.decode import decode_messages, split_decoded

from samples import utc, wire

GOOD = [
    (
        wire("energy", "Kitchen", '{"energy":369.62}'),
        ("Kitchen", "energy", None, None, None, 369.62, None),
    ),
    (
        wire("air_quality", "Office", '{"co2":415,"pm25":7,"humidity":44}'),
        ("Office", "air_quality", 415, 7, 44, None, None),
    ),
    (
        wire("motion", "Garage", '{"motionDetected":true}'),
        ("Garage", "motion", None, None, None, None, True),
    ),
    # Members in another letter case, unknown members, whole-number energy, repeated members.
    (
        '{"TYPE":"energy","Name":"A","x":[1],"payload":{"energy":5},"CollectedAt":"2026-09-03T10:00:00Z"}',
        ("A", "energy", None, None, None, 5.0, None),
    ),
    (
        '{"type":"energy","name":"A","name":"B","payload":{"energy":1,"energy":2},"collectedAt":"2026-09-03T10:00:00Z"}',
        ("B", "energy", None, None, None, 2.0, None),
    ),
    # A member repeated in two letter cases: the last counts.
    (
        '{"type":"energy","name":"A","NAME":"B","payload":{"energy":1},"collectedAt":"2026-09-03T10:00:00Z"}',
        ("B", "energy", None, None, None, 1.0, None),
    ),
    (
        '{"type":"energy","NAME":"B","name":"A","payload":{"energy":1},"collectedAt":"2026-09-03T10:00:00Z"}',
        ("A", "energy", None, None, None, 1.0, None),
    ),
    # The name is not trimmed; fields of other types are ignored.
    (
        wire("motion", " Hall ", '{"motionDetected":false,"co2":9}'),
        (" Hall ", "motion", None, None, None, None, False),
    ),
    ("  " + wire("energy", "A", '{"energy":1e3}') + "\n", ("A", "energy", None, None, None, 1000.0, None)),
]

JSON = vocab.BODY_NOT_JSON
BAD = [
    ("", vocab.BODY_EMPTY),
    ("{ not json", JSON),
    ('{"type":"energy"', JSON),
    ("null", vocab.BODY_NULL),
    ("\n\t null\r\n", vocab.BODY_NULL),
    ("\u00a0null", JSON),
    ("[]", JSON),
    ("42", JSON),
    ("   ", JSON),
    (wire("energy", "A", '{"energy":1}') + " x", JSON),
    (wire("energy", "A", '{"energy":1}') * 2, JSON),
    (wire("energy", "A", '{"energy":1}') + ',"mark":1}', JSON),
    (wire("energy", "A", '{"energy":NaN}'), JSON),
    (wire("energy", "A", '{"energy":1}').replace('"', "'"), JSON),
    (wire("energy", "A", '{"energy":1}').encode() + b"\xff", JSON),
    ('{"type":"energy","name":42,"payload":{"energy":1},"collectedAt":"2026-09-03T10:00:00Z"}', JSON),
    ('{"type":7,"name":"A","payload":{"energy":1},"collectedAt":"2026-09-03T10:00:00Z"}', JSON),
    *[
        (wire("energy", "A", '{"energy":1}', text), JSON)
        for text in (
            "noon", "", "2026-09-03T10:00:00+15:00", "0000-09-03T10:00:00Z", "2026-13-03T10:00:00Z",
            "2026-09-03T24:00:00Z", "2026-09-03 10:00:00Z", "2026-09-03Z", "2026-09-03T10Z",
        )
    ],
    ('{"type":"energy","name":"A","payload":{"energy":1},"collectedAt":1700000000}', JSON),
    ('{"type":"energy","name":"A","payload":{"energy":1},"collectedAt":null}', JSON),
    ('{"type":"energy","payload":{"energy":1},"collectedAt":"2026-09-03T10:00:00Z"}', vocab.NO_NAME),
    (wire("energy", "", '{"energy":1}'), vocab.NO_NAME),
    (wire("energy", "  ", '{"energy":1}'), vocab.NO_NAME),
    (wire("temperature", "A", '{"energy":1}'), "Unrecognised sensor type 'temperature'."),
    (wire("AirQuality", "A", "{}"), "Unrecognised sensor type 'AirQuality'."),
    ('{"name":"A","payload":{},"collectedAt":"2026-09-03T10:00:00Z"}', "Unrecognised sensor type ''."),
    (wire("energy", "A", "[1]"), "The payload is Array, expected an object."),
    (wire("energy", "A", '"x"'), "The payload is String, expected an object."),
    (wire("energy", "A", "1"), "The payload is Number, expected an object."),
    (wire("energy", "A", "true"), "The payload is True, expected an object."),
    (wire("energy", "A", "null"), "The payload is Null, expected an object."),
    (
        '{"type":"energy","name":"A","collectedAt":"2026-09-03T10:00:00Z"}',
        "The payload is Undefined, expected an object.",
    ),
    (wire("air_quality", "A", '{"co2":1,"pm25":2}'), vocab.AIR_FIELDS),
    (wire("air_quality", "A", '{"co2":"1","pm25":2,"humidity":3}'), vocab.AIR_FIELDS),
    (wire("air_quality", "A", '{"co2":1.0,"pm25":2,"humidity":3}'), vocab.AIR_FIELDS),
    (wire("air_quality", "A", '{"co2":4e2,"pm25":2,"humidity":3}'), vocab.AIR_FIELDS),
    (wire("air_quality", "A", '{"co2":3000000000,"pm25":2,"humidity":3}'), vocab.AIR_FIELDS),
    (wire("air_quality", "A", '{"CO2":1,"pm25":2,"humidity":3}'), vocab.AIR_FIELDS),
    (wire("motion", "A", '{"motionDetected":"true"}'), vocab.MOTION_FIELD),
    (wire("motion", "A", '{"motionDetected":1}'), vocab.MOTION_FIELD),
    (wire("energy", "A", '{"energy":"1"}'), vocab.ENERGY_FIELD),
    (wire("energy", "A", '{"energy":"NaN"}'), vocab.ENERGY_FIELD),
    (wire("energy", "A", "{}"), vocab.ENERGY_FIELD),
]


def test_good_messages(spark, feed):
    good, bad = split_decoded(decode_messages(feed(*[b for b, _ in GOOD])))
    rows = good.orderBy("offset").select(
        "name", "sensor_type", "co2", "pm25", "humidity", "energy_kwh", "motion_detected"
    )
    assert [tuple(r) for r in rows.collect()] == [expected for _, expected in GOOD]
    assert bad.count() == 0


def test_bad_messages_name_the_first_reason(spark, feed):
    good, bad = split_decoded(decode_messages(feed(*[b for b, _ in BAD])))
    assert good.count() == 0
    found = [r[0] for r in bad.orderBy("offset").select("error_detail").collect()]
    assert found == [reason for _, reason in BAD]


def test_rejected_messages_keep_their_bytes(spark, feed):
    body = b'{"type":"energy"\xff\x00'
    _, bad = split_decoded(decode_messages(feed(body)))
    assert bytes(bad.first()["value"]) == body


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-09-03T12:00:00+02:00", "2026-09-03T10:00:00"),
        ("2026-09-03T12:00:00-05:00", "2026-09-03T17:00:00"),
        ("2026-09-03T10:00:00.0000001Z", "2026-09-03T10:00:00"),
        ("2026-09-03T10:00:00.1234569+00:00", "2026-09-03T10:00:00.123456"),
        ("2026-09-03T10:00", "2026-09-03T10:00:00"),
        ("2026-09-03T10:00+03", "2026-09-03T07:00:00"),
        ("2026-09-03", "2026-09-03T00:00:00"),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_instants_are_utc_and_cut_to_micros(spark, feed, text, expected, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        good, _ = split_decoded(decode_messages(feed(wire("energy", "A", '{"energy":1}', text))))
        micros = good.select(F.unix_micros("collected_at")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert micros == int(utc(expected).timestamp() * 1_000_000)


def test_missing_instant_is_the_earliest_one(spark, feed):
    body = '{"type":"energy","name":"A","payload":{"energy":1}}'
    good, _ = split_decoded(decode_messages(feed(body)))
    assert good.select(F.col("collected_at").cast("string")).first()[0] == "0001-01-01 00:00:00"


def test_only_stored_spellings_are_types(spark):
    names = ["air_quality", "motion", "energy", "AirQuality", "Motion", "temperature", "", "1", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    known = [r[0] for r in df.select(labels.is_sensor_type(F.col("n"))).collect()]
    assert known == [True] * 3 + [False] * 6


def test_ordinary_messages_are_not_read_closely(spark, feed):
    """The close reading is a branch of one expression, not a column of every row."""
    plan = decode_messages(feed(wire("energy", "A", '{"energy":1}')))._jdf.queryExecution().optimizedPlan()
    close = [n for n in plan.toString().split("\n") if "variant>" in n or "map_entries" in n]
    assert len(close) == 1 and close[0].lstrip(" +-:").startswith("Generate")
