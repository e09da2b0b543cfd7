"""The text functions on streams: maps need no state; lookalikes meet a static index or earlier rows of the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Unicode


def inspected_stream(stream: DataFrame, name_col: str, unicode: Unicode, policy: str = "OneScript") -> DataFrame:
    """The stream with lookalike_key, acceptable and level; stateless."""
    i = unicode.inspect(name_col, policy)
    return stream.withColumn("_i", i).select(*stream.columns, F.col("_i.key").alias("lookalike_key"), F.col("_i.acceptable").alias("acceptable"), F.col("_i.level").alias("level"))


def taken_stream(stream: DataFrame, index: DataFrame, name_col: str, unicode: Unicode) -> DataFrame:
    """Rows whose name looks like one in a static index; the index is joined on the key."""
    return stream.withColumn("lookalike_key", unicode.lookalike_key(name_col)).join(index.select("lookalike_key").distinct(), "lookalike_key", "left_semi")


def first_of_lookalikes(stream: DataFrame, name_col: str, time_col: str, delay: str, unicode: Unicode) -> DataFrame:
    """The first row of each key within the watermark's delay; state is bounded by the watermark."""
    return stream.withColumn("lookalike_key", unicode.lookalike_key(name_col)).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["lookalike_key"])


def _marked(stream: DataFrame, name_col: str, time_col: str, delay: str, unicode: Unicode, policy: str) -> DataFrame:
    return stream.withColumn("ok", unicode.acceptable(name_col, policy)).withWatermark(time_col, delay)


def _counts(marked: DataFrame, *groups) -> DataFrame:
    return marked.groupBy(*groups).agg(F.count(F.lit(1)).alias("names"), F.count_if(~F.col("ok")).alias("unacceptable"))


def unacceptable_by_window(stream: DataFrame, name_col: str, time_col: str, width: str, delay: str, unicode: Unicode, policy: str = "OneScript", slide: str | None = None) -> DataFrame:
    """window start and end, names, unacceptable: counts in event-time windows, tumbling or sliding, late rows up to the delay."""
    counts = _counts(_marked(stream, name_col, time_col, delay, unicode, policy), F.window(time_col, width, slide))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "names", "unacceptable")


def unacceptable_by_session(stream: DataFrame, key_col: str, name_col: str, time_col: str, gap: str, delay: str, unicode: Unicode, policy: str = "OneScript") -> DataFrame:
    """key, session start and end, names, unacceptable: counts in sessions of a key that end where it is silent for the gap."""
    counts = _counts(_marked(stream, name_col, time_col, delay, unicode, policy), F.session_window(time_col, gap), key_col)
    return counts.select(key_col, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "names", "unacceptable")
