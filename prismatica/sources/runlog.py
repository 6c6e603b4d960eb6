"""Run log: one JSON record per event, appended to a folder."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "timestamp timestamp, event string, status string, details map<string,string>"


def append_event(spark: SparkSession, path: str, event: str, status: str = "success",
                 details: dict | None = None) -> DataFrame:
    """Append one event with the current UTC time; return it as a row."""
    facts = {str(k): None if v is None else str(v) for k, v in (details or {}).items()}
    row = spark.createDataFrame([(datetime.now(timezone.utc), str(event), str(status), facts)], SCHEMA)
    row.coalesce(1).write.mode("append").json(path)
    return row


def append_events(events: DataFrame, path: str) -> None:
    """Append many events at once, as a job that logs its own tasks does."""
    events.select("timestamp", "event", "status", "details").write.mode("append").json(path)


def recent_events(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """The last ``limit`` events, newest first. Malformed lines are skipped
    and a log that does not exist is empty."""
    try:
        log = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], SCHEMA)
    return log.filter("event is not null").orderBy(F.desc("timestamp"), "event").limit(limit)
