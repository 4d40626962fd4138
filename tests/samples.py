"""Instants, readings and message bodies that the tests share."""

from datetime import datetime, timedelta, timezone


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


T0 = utc("2026-05-04T10:00:00")


def at(minutes: float = 0, **more) -> datetime:
    return T0 + timedelta(minutes=minutes, **more)


def energy(id, sensor_id, when, kwh):
    return dict(id=id, sensor_id=sensor_id, collected_at=when, sensor_type="energy", energy_kwh=kwh)


def motion(id, sensor_id, when, detected):
    return dict(
        id=id, sensor_id=sensor_id, collected_at=when, sensor_type="motion", motion_detected=detected
    )


def air(id, sensor_id, when, co2, pm25=5, humidity=40):
    return dict(
        id=id,
        sensor_id=sensor_id,
        collected_at=when,
        sensor_type="air_quality",
        co2=co2,
        pm25=pm25,
        humidity=humidity,
    )


def wire(kind, name, payload, when="2026-09-03T10:00:00+00:00"):
    return f'{{"type":"{kind}","name":"{name}","payload":{payload},"collectedAt":"{when}"}}'
