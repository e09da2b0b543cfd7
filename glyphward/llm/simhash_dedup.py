"""SimHash near-duplicates, linked by Golay-code fuzzy hashing.

A fingerprint has 64 bits, one for each bit that over half of the document's shingle hashes set. Its three
segments (22, 21 and 21 bits) are padded to Golay words. Fingerprints that differ in two bits or fewer agree
in one segment at least (pigeonhole), and in the next one their nearby codewords share an index; so each
fingerprint has keys of an exact segment and a codeword index, and what shares a key is verified.

Only distinct fingerprints are linked. A key that very many of them share is refined: of three pieces of the bits
outside its segment, two linked fingerprints agree in one. What very many share even then is split into chunks, and
each two chunks meet in a task of their own. A task passes on a spanning forest of its links: no pairs leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, durable, few_rows, small_batches
from .components import connected_components
from .golay import nearby

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: (shift, bits) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Fingerprints of one key that are compared in one piece.
CHUNK = 1024


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text; 0 if it has no words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, k = ends - size, min(width, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        total += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64), and the number of the fingerprint each belongs to."""
    cut = [(fps >> np.uint64(s) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    keys, owner = [], []
    for k in range(len(SEGMENTS)):
        codes, held = nearby(cut[(k + 1) % len(SEGMENTS)])
        at, column = np.nonzero(held)
        keys.append((k << 34) | (cut[k][at] << 12) | codes[at, column])
        owner.append(at)
    return np.concatenate(keys), np.concatenate(owner)


def forest(fps: np.ndarray, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among fps, as index pairs; with left, of those between left ones and the others."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= DISTANCE
    if left is not None:
        near &= left[:, None] != left[None, :]
    free, out = np.ones(len(fps), bool), []
    for root in range(len(fps)):
        if not free[root]:
            continue
        free[root] = False
        frontier = np.array([root])
        while len(frontier):
            found = near[frontier].any(axis=0) & free
            out += [(root, int(i)) for i in np.flatnonzero(found)]
            free &= ~found
            frontier = np.flatnonzero(found)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) for each row."""
    return printed(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))).select("doc_id", "fp")


def printed(rows: DataFrame) -> DataFrame:
    """rows (with a column text) and the fingerprint of each, fp."""
    names = [f.name for f in rows.schema if f.name != "text"]
    at, keep = rows.columns.index("text"), [rows.columns.index(n) for n in names]

    def run(batches):
        for batch in few_rows(batches):
            fp = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(fp, pa.int64())], names=[*names, "fp"])

    return small_batches(rows).mapInArrow(run, T.StructType([*(rows.schema[n] for n in names), T.StructField("fp", T.LongType())]))


def _finer(key: Column, fp: Column) -> Column:
    """Three keys, one of which two fingerprints of a key that are linked share: pieces of the bits outside the key's segment."""
    rest = F
    for k, (shift, bits) in enumerate(SEGMENTS):
        above = F.shiftleft(F.shiftrightunsigned(fp, shift + bits), shift) if shift + bits < 64 else F.lit(0).cast("long")
        rest = rest.when(F.shiftright(key, 34) == k, above.bitwiseOR(fp.bitwiseAND(F.lit((1 << shift) - 1))))
    pieces = (rest.bitwiseAND(F.lit(0x3FFF)), F.shiftright(rest, 14).bitwiseAND(F.lit(0x3FFF)), F.shiftright(rest, 28))
    return F.array(*(F.xxhash64(key, F.lit(j), p) for j, p in enumerate(pieces)))


def _met(keyed: DataFrame) -> DataFrame:
    """key, fp, n: the rows of keys that n > 1 fingerprints share."""
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.bitwise_not("key").alias("k"), "n")
    # dealt anew by its complement, so that a frequent key can be split
    return keyed.withColumn("k", F.bitwise_not("key")).join(shared.hint("merge"), "k").select("key", "fp", "n")


def _whole_groups(batches):
    """Sorted batches, cut so that rows of equal key, low and high come in one piece."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        last = [table.column(c)[-1].as_py() for c in ("key", "low", "high")]
        same = np.logical_and.reduce([table.column(c).to_numpy() == x for c, x in zip(("key", "low", "high"), last, strict=True)])
        cut = int(np.flatnonzero(same)[0])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


def links(distinct: DataFrame) -> DataFrame:
    """u, v: links of distinct fingerprints (column fp) within two bits, enough to connect all that are linked."""

    def spread(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            keys, owner = keys_of(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[owner])], names=["key", "fp"])

    def verify(batches):
        for table in _whole_groups(batches):
            key, low, high, chunk = (table.column(c).to_numpy() for c in ("key", "low", "high", "chunk"))
            fp = table.column("fp").to_numpy().view(np.uint64)
            start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))
            u, v = [], []
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=True):
                if b - a == 2:
                    if (low[a] == high[a] or chunk[a] != chunk[a + 1]) and int(fp[a] ^ fp[a + 1]).bit_count() <= DISTANCE:
                        u.append(fp[a])
                        v.append(fp[a + 1])
                elif b - a > 2:
                    for i, j in forest(fp[a:b], None if low[a] == high[a] else chunk[a:b] == low[a]):
                        u.append(fp[a + i])
                        v.append(fp[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (u, v)], names=["u", "v"])

    met = _met(distinct.select("fp").mapInArrow(spread, "key long, fp long"))
    finer = _met(met.where(F.col("n") > CHUNK).select(F.explode(_finer(F.col("key"), F.col("fp"))).alias("key"), "fp"))
    met = met.where(F.col("n") <= CHUNK).unionByName(finer)
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    met = met.select("key", "fp", F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("chunk"), chunks.alias("chunks"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "fp")
    return met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "fp").mapInArrow(verify, "u long, v long")


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fp, root (the lowest fingerprint that links reach), component_id for each row."""
    own = durable(fingerprints(docs, id_col, text_col))
    least = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(least))
    label = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    low = label.groupBy("root").agg(F.min("least").alias("component_id")).select(F.bitwise_not("root").alias("k"), "component_id")
    named = label.select("fp", "root", F.bitwise_not("root").alias("k")).join(low.hint("merge"), "k").select(F.bitwise_not("fp").alias("k"), "root", "component_id")
    return own.withColumn("k", F.bitwise_not("fp")).join(named.hint("merge"), "k").drop("k")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for each row.

    component_id is the smallest doc_id that links reach; null if no row of the component has an id. A null
    text has no words, so fingerprint zero, linked like any other. Repeated rows and null ids stay; an empty
    table gives an empty result; other columns are not read.
    """
    return _labelled(docs, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates, all columns as they are.

    Of a group the row of the smallest id stays, any id before none; of rows that share this id those with the lowest
    fingerprint; of these the one with the least text. Rows of one id whose texts aren't alike are in groups of
    their own, and one of each stays.
    """
    docs = small_batches(docs)
    found = durable(_labelled(docs, id_col, text_col).select("doc_id", "fp", "root"))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("b"))
    stay = durable(best.select("b.doc_id", "b.fp"))
    several = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("fp") != F.max("fp")).alias("several")).where("several").select("doc_id")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.struct(*(column(docs, c).alias(f"c{k}") for k, c in enumerate(docs.columns))).alias("row"))
    # Most ids have one fingerprint, known by now; only rows of others, and those without id, are printed once more.
    ids = stay.where("doc_id IS NOT NULL")
    plain = rows.join(ids.join(several, "doc_id", "left_anti").select("doc_id").hint("merge"), "doc_id", "left_semi").withColumn("fp", F.lit(None).cast("long"))
    odd = rows.join(several.join(ids, "doc_id", "left_semi").hint("merge"), "doc_id", "left_semi").unionByName(rows.where("doc_id IS NULL"))
    odd = printed(odd.withColumn("kept", F.col("text"))).withColumnRenamed("kept", "text")
    odd = odd.join(stay.withColumnsRenamed({"doc_id": "i", "fp": "f"}).hint("merge"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("fp") == F.col("f")), "left_semi")
    first = Window.partitionBy("doc_id", "fp").orderBy("text")
    kept = plain.unionByName(odd).withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return kept.select(*(F.col("row").getField(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))
