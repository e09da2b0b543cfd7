"""Lookalike collisions over tables: an index of keys, lookups in it, and pairs that collide (our extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Unicode


def keyed(df: DataFrame, name_col: str, unicode: Unicode) -> DataFrame:
    """df with lookalike_key and unicode_version; a map, without a shuffle."""
    return df.withColumn("lookalike_key", unicode.lookalike_key(name_col)).withColumn("unicode_version", unicode.version())


def write_index(df: DataFrame, name_col: str, path: str, unicode: Unicode) -> None:
    """An index of names by key, partitioned by Unicode version: keys of different versions must not meet."""
    keyed(df, name_col, unicode).write.mode("overwrite").partitionBy("unicode_version").parquet(path)


def taken(new: DataFrame, index: DataFrame, name_col: str, unicode: Unicode) -> DataFrame:
    """Rows of new whose name looks like one in the index."""
    return keyed(new, name_col, unicode).join(index.where(F.col("unicode_version") == unicode.tables.version).select("lookalike_key").distinct(), "lookalike_key", "left_semi")


def free(new: DataFrame, index: DataFrame, name_col: str, unicode: Unicode) -> DataFrame:
    """Rows of new whose name looks like none in the index."""
    return keyed(new, name_col, unicode).join(index.where(F.col("unicode_version") == unicode.tables.version).select("lookalike_key").distinct(), "lookalike_key", "left_anti")


def states(new: DataFrame, index: DataFrame, name_col: str, unicode: Unicode) -> DataFrame:
    """new with its lookalike_key and a state, taken or free; each side's keys are made once."""
    known = index.where(F.col("unicode_version") == unicode.tables.version).select(F.col("lookalike_key").alias("_known")).distinct()
    rows = keyed(new, name_col, unicode).drop("unicode_version")
    return rows.join(known, F.col("lookalike_key") == F.col("_known"), "left").withColumn("state", F.when(F.col("_known").isNull(), "free").otherwise("taken")).drop("_known")


def collisions(df: DataFrame, name_col: str, unicode: Unicode) -> DataFrame:
    """lookalike_key, names (how many different ones), first_name, last_name for keys that several names share."""
    names = df.select(F.col(name_col).alias("name")).where("name IS NOT NULL").distinct().withColumn("lookalike_key", unicode.lookalike_key("name"))
    return names.groupBy("lookalike_key").agg(F.count(F.lit(1)).alias("names"), F.min("name").alias("first_name"), F.max("name").alias("last_name")).where("names > 1")


def classified(pairs: DataFrame, a: str, b: str, unicode: Unicode) -> DataFrame:
    """pairs with the class of each pair's confusability; meant for pairs that an equal key has brought together."""
    return pairs.withColumn("confusable_class", unicode.classify(a, b))
