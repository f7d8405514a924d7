"""Streams: stateless redaction, and findings with optional suppression of repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.scanner import Scanner


def redact_stream(stream: DataFrame, scanner: Scanner, content_col: str = "text") -> DataFrame:
    """The stream with redacted_content; each row stands alone, so no state is kept."""
    return scanner.redact_untrusted(stream, content_col)


def finding_stream(stream: DataFrame, scanner: Scanner, path_col: str, content_col: str, baseline: DataFrame | None = None, event_time: str | None = None, repeat_within: str = "1 hour") -> DataFrame:
    """Findings of a stream; a static baseline is joined away, repeats within the watermark are dropped where there is an event time."""
    from pyspark.sql import functions as F

    from ..operators import detect

    rows = stream.withWatermark(event_time, repeat_within) if event_time else stream
    scanned = detect.scan(rows, scanner.rules, scanner.config, path_col, content_col)
    keep = [F.col(event_time)] if event_time else []
    found = scanned.select(*keep, F.explode("findings").alias("f")).select(*keep, "f.*")
    if baseline is not None:
        found = found.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return found.dropDuplicatesWithinWatermark(["fingerprint"]) if event_time else found
