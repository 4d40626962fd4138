import json

from gaugeflow.schemas import POLL_RESPONSES
from gaugeflow.sources.polls import classify_polls, explode_readings, to_messages

from samples import at


def polls(spark, *rows):
    return spark.createDataFrame([(*r, at()) for r in rows], POLL_RESPONSES)


def outcomes(spark, *rows):
    found = classify_polls(polls(spark, *rows)).select("outcome", "next_delay_s").collect()
    return [tuple(r) for r in found]


GOOD = json.dumps(
    [
        {"type": "energy", "name": "Pump 3", "payload": {"energy": 12.5}},
        {"type": "motion", "name": "North gate", "payload": {"motionDetected": True}},
    ]
)


def test_outcomes(spark):
    assert outcomes(
        spark,
        (200, None, GOOD),
        (200, None, '{"error":"data corrupted"}'),
        (200, None, ' {"error":"data corrupted"}'),
        (200, None, '{"error":"other"}'),
        (200, None, '{"error":"data corrupted"} x'),
        (200, None, "[]"),
        (200, None, "null"),
        (200, None, "<html>busy</html>"),
        (200, None, "\r\n\tnull\n"),
        (200, None, "\n[ ]\t"),
        (200, None, '\n\t{"error":"data corrupted"}\r\n'),
        (200, None, GOOD + "x"),
        (429, 120.0, ""),
        (429, None, ""),
        (500, None, ""),
        (502, None, GOOD),
        (504, None, ""),
        (404, None, ""),
        (304, None, ""),
    ) == [
        ("success", 60.0),
        ("corrupted", 60.0),
        ("corrupted", 60.0),
        ("malformed", 60.0),
        ("malformed", 60.0),
        ("empty", 60.0),
        ("empty", 60.0),
        ("malformed", 60.0),
        ("empty", 60.0),
        ("empty", 60.0),
        ("corrupted", 60.0),
        ("malformed", 60.0),
        ("rate_limited", 120.0),
        ("rate_limited", 60.0),
        ("server_error", 60.0),
        ("server_error", 60.0),
        ("server_error", 60.0),
        ("unexpected", 60.0),
        ("unexpected", 60.0),
    ]


def one(**element):
    return json.dumps([element])


def test_bad_elements_spoil_the_poll(spark):
    bodies = [
        one(type="energy", name="A", payload={"energy": "x"}),
        one(type="energy", name="A", payload=[1]),
        one(type="energy", name="A", payload={"energy": None}),
        one(type="air_quality", name="A", payload={"co2": 7.5}),
        one(type="air_quality", name="A", payload={"co2": 3_000_000_000}),
        one(type="motion", name="A", payload={"motionDetected": "true"}),
        one(type=5, name="A", payload={}),
        one(type="energy", name="A", payload={"energy": 1}, collectedAt="noon"),
        "[null]",
        "[1]",
    ]
    found = outcomes(spark, *[(200, None, b) for b in bodies])
    assert [o for o, _ in found] == ["malformed"] * len(bodies)


def test_payloads_are_read_leniently(spark):
    body = json.dumps(
        [
            {"type": "air_quality", "name": "A", "payload": {"co2": "415", "PM25": 7}},
            {"type": "motion", "name": "B", "payload": {}},
            {"type": "energy", "name": "C", "payload": {"energy": "1.5"}, "collectedAt": "2026-05-04T09:00:00Z"},
            {"type": "energy", "name": "D", "payload": {}},
            {"TYPE": "energy", "Name": "E", "Payload": {"ENERGY": 2}},
            {"type": "temperature", "name": "F", "payload": {"celsius": 21}},
            {"type": "energy", "name": "G", "payload": None},
            {"type": "energy", "name": "H"},
        ]
    )
    rows = explode_readings(polls(spark, (200, None, body))).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(8))
    got = [tuple(r["payload"]) if r["payload"] else None for r in rows]
    assert got[0] == (415, 7, 0, None, None, None)
    assert got[1] == (None, None, None, False, None, None)
    assert got[2] == (None, None, None, None, 1.5, None)
    assert got[3] == (None, None, None, None, 0.0, None)
    assert got[4] == (None, None, None, None, 2.0, None)
    assert json.loads(got[5][5]) == {"celsius": 21}
    assert got[6] is None
    assert got[7] == (None, None, None, None, None, "")
    assert rows[2]["collected_at"] != rows[0]["collected_at"]


def test_failed_polls_have_no_readings(spark):
    rows = polls(spark, (200, None, "[]"), (500, None, GOOD), (429, None, GOOD))
    assert explode_readings(rows).count() == 0


def test_messages_are_keyed_compact_and_headed(spark):
    body = json.dumps(json.loads(GOOD) + [{"type": "temperature", "name": "F", "payload": {"c": 1}}])
    rows = to_messages(explode_readings(polls(spark, (200, None, body)))).orderBy("position").collect()
    assert [bytes(r["key"]).decode() for r in rows] == ["energy:Pump 3", "motion:North gate", "temperature:F"]
    assert bytes(rows[0]["value"]).decode() == (
        '{"type":"energy","name":"Pump 3","payload":{"energy":12.5},'
        '"collectedAt":"2026-05-04T10:00:00+00:00"}'
    )
    assert json.loads(bytes(rows[2]["value"]))["payload"] == {"rawJson": '{"c":1}'}
    assert [(h["key"], bytes(h["value"])) for h in rows[0]["headers"]] == [
        ("content-type", b"application/json"),
        ("schema-version", b"1"),
    ]
