"""What the operators share: reading tables, cutting lineage in shared storage, skew-safe join keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: what stands between space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch; texts may be long, so batches stay far below Spark's 10,000.
BATCH_ROWS = 128


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows in a session of their own, whose Arrow batches hold few rows; the caller's session keeps its settings."""
    spark = df.sparkSession
    inner = spark._jsparkSession.cloneSession()
    own = SparkSession(spark.sparkContext, inner)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(inner, df._jdf.logicalPlan()), own)


def few_rows(batches, rows: int = BATCH_ROWS):
    """The batches, cut into pieces of few rows, and memory given back in the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's own reader, so that any store Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return df["`" + name.replace("`", "``") + "`"]


def _shared_folder(spark: SparkSession) -> None:
    """Sees to a checkpoint folder that all executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="glyphward-")  # one machine: its folder is shared
        sc.setCheckpointDir(shared)


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the cluster's shared checkpoint folder, so that a lost executor costs nothing.

    Rows are dealt out to files of the advisory size first: few rows make few files, whatever made them.
    """
    _shared_folder(df.sparkSession)
    return df.hint("rebalance").checkpoint(eager=True)


def durable_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df, kept in the checkpoint folder as durable() does, dealt by key and sorted by key and order.

    Plans that group it by key, alone or with other rows, then neither deal nor sort it anew. Spark only remembers
    that of plans that aren't adaptive, so this one isn't; the caller's setting is put back.
    """
    spark, name = df.sparkSession, "spark.sql.adaptive.enabled"
    _shared_folder(spark)
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.repartition(shuffles(spark), key).sortWithinPartitions(key, *order).checkpoint(eager=True)
    finally:
        spark.conf.set(name, before)


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """df with a column that numbers its rows from 0 on in this order, which must tell all rows apart; no task sees all of them."""
    _shared_folder(df.sparkSession)
    ranges = df.repartitionByRange(shuffles(df.sparkSession), order).withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    counts = {r["_part"]: r["count"] for r in ranges.groupBy("_part").count().collect()}  # one row for each partition
    start, before = [], 0
    for part in range(max(counts, default=-1) + 1):
        start.append(before)
        before += counts.get(part, 0)
    first = F.element_at(F.array(*map(F.lit, start or [0])), F.col("_part") + 1).cast("long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranges.withColumn(name, first + place - 1).drop("_part")


def shuffles(spark: SparkSession) -> int:
    """The number of shuffle partitions, which the cluster sets in proportion to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids fall in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def pass_batches(rows, schema):
    """A pyarrow record batch of column lists under a pyarrow schema."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)


def give_back(collect: bool = True) -> None:
    """Returns memory that a Python worker no longer uses to the system; workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def training_texts(rows: DataFrame, most: int, chars: int) -> list:
    """Rows (doc_id, label, text) on the driver, from rows (doc_id, label, place, text) that are few already.

    For each label whole texts in the order of place, at most `most`, of at most `chars` characters in all; a text that
    doesn't fit any more is passed over. Rows without label or text are left out; of an id that repeats the least text
    counts, and null ids are one id.
    """
    known = rows.where("label IS NOT NULL AND text IS NOT NULL")
    sizes = known.groupBy("doc_id", "label", "place").agg(F.max(F.length("text")).alias("chars")).collect()
    taken: dict = {}
    chosen = []
    for r in sorted(sizes, key=lambda r: (r["place"], r["doc_id"] or 0)):
        count, held = taken.get(r["label"], (0, 0))
        if count < most and held + r["chars"] <= chars:
            taken[r["label"]] = count + 1, held + r["chars"]
            chosen.append((r["doc_id"], r["label"]))
    if not chosen:
        return []
    kind = known.schema["label"].dataType.simpleString()
    ids = F.broadcast(rows.sparkSession.createDataFrame(chosen, f"doc_id long, label {kind}"))
    wanted = known.join(ids, known["doc_id"].eqNullSafe(ids["doc_id"]) & (known["label"] == ids["label"]), "left_semi")
    got = {(r["doc_id"], r["label"]): r for r in wanted.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()}
    return [got[key] for key in chosen]


class SeenTwice:
    """Whether a word was (probably) seen before: memos keep only such words, so rare ones take no memory."""

    def __init__(self, slots: int = 1 << 24):
        self.marks, self.mask = bytearray(slots), slots - 1

    def __call__(self, word: str) -> bool:
        at = hash(word) & self.mask
        if self.marks[at]:
            return True
        self.marks[at] = 1
        return False
