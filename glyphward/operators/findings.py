"""Name inspection over tables: a row for each finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Unicode


def inspected(df: DataFrame, name_col: str, unicode: Unicode, policy: str = "OneScript") -> DataFrame:
    """df with the struct `inspection`: acceptable, findings, clean, key, level."""
    return df.withColumn("inspection", unicode.inspect(name_col, policy))


def findings(df: DataFrame, name_col: str, unicode: Unicode, policy: str = "OneScript") -> DataFrame:
    """df with finding_no (from 0), kind, position, length, text, message: a row for each finding, none for clean names."""
    rows = inspected(df, name_col, unicode, policy).select(*df.columns, F.posexplode("inspection.findings").alias("finding_no", "f"))
    return rows.select(*df.columns, "finding_no", "f.kind", "f.position", "f.length", "f.text", "f.message")
