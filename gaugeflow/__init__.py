"""gaugeflow: sensor-readings analytics as Spark jobs.

Land poll responses, decode tagged JSON readings, append them once, announce what
changed, and answer listings, latest values, calendar buckets and status questions
over the stored table. Everything is DataFrame, SQL and Structured Streaming code.
"""

from gaugeflow.session import build_session, scratch_dir, tune

__all__ = ["build_session", "scratch_dir", "tune"]
