"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words. Its documents get whole copies first, as many as its target holds of its size (at
most CAP); what is left of the target is a sample. A document's inclusion probability grows with the square root of
its size, up to certainty, and is scaled so that the sample's expected words are what is left. Documents are ranked by
random odds divided by inclusion odds, and taken in that order until the words are reached (to the nearest
document), so the size of the sample is fixed in words. The random number is a hash of id and text, so that reruns
agree.

No source is ordered in one task: two rounds of histograms over the rank (4096 bins, then 4096 within the bin where
the words run out) leave a sliver of each source to be ordered exactly; the outcome is one threshold for each source.
Nor are the sources: they are numbered by ranges of their names, and the level that fills their targets is found by
a few sums over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, numbered

WEIGHTS = (5, 2, 1)
CAP = 3
BINS = 4096
SEED = "mix"
#: Sources are few; up to so many their plan is broadcast, beyond it joined on a salted key.
MAX_BROADCAST = 50_000
SALTS = 64


def _uniform(doc_id: Column, text: Column) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a hash of id and text."""
    known = F.coalesce(F.md5(text.cast("binary")), F.lit("null"))
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"|{SEED}|"), known).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def allocate(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target, whole, rest from (source, source_size), one row for each source.

    Sources in code point order, null last, weigh `weights` in turn and share all words; a target stops at cap times
    the source's size and the excess goes to the others by weight, until none is above. The level of words a weight
    rises as sources fill up, so a few sums find it.
    """
    at = numbered(sizes, F.col("source").asc_nulls_last(), "at")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("at", F.lit(len(weights))) + 1).cast("int"))
    s = durable(at.select("source", "source_size", w.cast("long").alias("weight"), (F.col("source_size") * cap).alias("most")))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, F.lit(False)
    while True:
        held = s.agg(F.sum(F.when(full, F.col("most")).otherwise(0)).alias("words"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if not held["weight"]:
            level = float("inf")  # all are full
            break
        new = float(total - held["words"]) / held["weight"]
        if new == level:
            break
        level = new
        full = F.lit(level) * F.col("weight") > F.col("most")
    s = s.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("most").cast("double")).alias("target"))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(F.lit(0)).cast("long")
    s = s.withColumn("whole", whole)
    return s.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))


def importance(size: Column) -> Column:
    """What a document's inclusion probability is proportional to."""
    return F.ceil(F.sqrt(size)).cast("long")


def scales(thin: DataFrame, plan: DataFrame) -> DataFrame:
    """_s (the source), scale, certain: the inclusion probability is scale times the importance, and 1 where that is above `certain`.

    From the words of each importance, of which a source has few. Going down from the largest, those are certain that
    the scale would bring to 1 and more.
    """
    x = thin.where("size > 0").groupBy("source", importance(F.col("size")).alias("x")).agg(F.sum("size").alias("words"))
    x = x.join(plan.where("rest > 0").select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s"))).select("_s", "rest", "x", "words")
    down = Window.partitionBy("_s").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("_s").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("above", F.coalesce(F.sum("words").over(down), F.lit(0)))
    x = x.withColumn("within", F.sum(F.col("x").cast("decimal(19,0)") * F.col("words")).over(up))
    x = x.withColumn("scale", (F.col("rest") - F.col("above")) / F.col("within").cast("double"))
    return x.where(F.col("scale") * F.col("x") < 1).groupBy("_s").agg(F.max_by("scale", "x").alias("scale"), F.max("x").alias("certain"))


def _with_plan(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """rows with the columns of their source's plan; nulls match nulls, and no source's rows meet in one task."""
    key = lambda c: F.struct(c.isNull().alias("n"), F.coalesce(c, F.lit("")).alias("s"))
    r, p = rows.withColumn("_key", key(F.col("source"))), plan.withColumn("_key", key(F.col("source"))).drop("source")
    if small:
        return r.join(F.broadcast(p), "_key").drop("_key")
    r = r.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    p = p.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return r.join(p, ["_key", "_salt"]).drop("_key", "_salt")


class Mix:
    """The plan of a mix over rows (doc_id, source, size, u), and the decisions it means for each row."""

    def __init__(self, thin: DataFrame, weights=WEIGHTS, cap: int = CAP):
        sizes = thin.groupBy("source").agg(F.sum("size").alias("source_size"))
        plan = allocate(sizes, weights, cap)
        plan = durable(plan.join(scales(thin, plan), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))
        self.small = plan.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
        open_ = plan.where("scale IS NOT NULL")  # sources of whose target something is left
        ranked = self._ranked(thin.where("size > 0"), open_)
        first = durable(self._edge(ranked.withColumn("before", F.lit(0).cast("long")), _first_bin(), open_.select("source")).withColumnRenamed("bin", "bin1"))
        inside = _with_plan(ranked, first, self.small).where(_first_bin() == F.col("bin1"))
        second = durable(self._edge(inside, _second_bin(), first.select("source", "bin1")).withColumnRenamed("bin", "bin2"))
        last = _with_plan(ranked, second, self.small).where((_first_bin() == F.col("bin1")) & (_second_bin() == F.col("bin2")))
        alike = last.groupBy("source", "rank", "doc_id", "size").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        run = Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
        taken = alike.withColumn("upto", F.sum("words").over(run) + F.col("before")).where(F.col("upto") - F.col("words") / 2 <= F.col("rest"))
        limits = taken.groupBy("source").agg(F.max(_place()).alias("limit")).withColumnRenamed("source", "_s")
        bounds = second.join(limits, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "before").withColumnRenamed("source", "_s")
        #: One row for each source: its plan, and the threshold up to which documents get one more copy.
        self.bounds = durable(plan.join(bounds, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))

    def _ranked(self, rows: DataFrame, plan: DataFrame) -> DataFrame:
        out = _with_plan(rows, plan, self.small)
        x, u = importance(F.col("size")), F.col("u")
        chance = F.when(x > F.col("certain"), 1.0).otherwise(F.col("scale") * x)
        up, down = u * (1 - chance), (1 - u) * chance
        return out.withColumn("rank", up / (up + down))

    @staticmethod
    def _edge(rows: DataFrame, bins: Column, known: DataFrame) -> DataFrame:
        """The first bin of each source in which the words run out, and the words before it."""
        hist = rows.groupBy("source", bins.alias("bin")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("start"))
        w = Window.partitionBy("source").orderBy("bin")
        over = hist.withColumn("upto", F.sum("words").over(w) + F.col("start")).where(F.col("upto") > F.col("rest"))
        edges = over.groupBy("source").agg(F.min(F.struct(F.col("bin"), (F.col("upto") - F.col("words")).alias("before"))).alias("e")).select(F.col("source").alias("_s"), F.col("e.bin").alias("bin"), F.col("e.before").alias("before"))
        return known.join(edges, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")

    def decide(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, source, size, u and others) with source_size, target and copies."""
        out = self._ranked(rows, self.bounds)
        within = (_second_bin() < F.col("bin2")) | ((_second_bin() == F.col("bin2")) & F.coalesce(_place() <= F.col("limit"), F.lit(False)))
        extra = (_first_bin() < F.col("bin1")) | ((_first_bin() == F.col("bin1")) & within)
        return out.select(*rows.columns, "source_size", "target", (F.col("whole") + F.when(extra, 1).otherwise(0)).alias("copies"))


def _first_bin() -> Column:
    return F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)).cast("int")


def _second_bin() -> Column:
    return F.least(F.floor((F.col("rank") * BINS - _first_bin()) * BINS), F.lit(BINS - 1)).cast("int")


def _place() -> Column:
    """What orders the documents of a source."""
    return F.struct(F.col("rank"), F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("id"), F.col("size"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[Column, ...]:
    text = docs[text_col].cast("string")
    words, doc_id = F.regexp_count(text, F.lit(WORD)), docs[id_col].cast("long")
    return doc_id.alias("doc_id"), docs[source_col].cast("string").alias("source"), F.coalesce(words, F.lit(0)).cast("long").alias("size"), _uniform(doc_id, text).alias("u")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for each row.

    size is the number of words (null text: 0), taken the words that the mix takes of the document, copies
    counted: at most cap times its size. A null source is a source of its own, after all others. Rows that repeat id
    and text are taken together; null ids are told apart by text. Empty tables give an empty result, and a source
    without words takes none. Other columns are not read.
    """
    thin = durable(docs.select(*_sized(docs, id_col, text_col, source_col)))
    return Mix(thin, weights, cap).decide(thin).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies, all columns as they are.

    Rows without words have nothing to take and go.
    """
    keys = _sized(docs, id_col, text_col, source_col)
    plan = Mix(durable(docs.select(*keys)), weights, cap)
    rows = plan.decide(docs.select(*keys, F.struct(*docs.columns).alias("row")))
    copies = F.when(F.col("size") > 0, F.col("copies").cast("int")).otherwise(0)
    return rows.select("row", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))).alias("copy")).select("row.*")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, coalesce(md5(text), 'null') AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{",".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT]::BIGINT AS weight, source_size * {CAP} AS most FROM s),
f AS (SELECT *, (sum(source_size) OVER ())::BIGINT - (sum(most) OVER o)::BIGINT + most AS left_words, (sum(weight) OVER ())::BIGINT - (sum(weight) OVER o)::BIGINT + weight AS left_weight, row_number() OVER o AS pos
      FROM w WINDOW o AS (ORDER BY most::DOUBLE / weight, source NULLS LAST)),
g AS (SELECT *, left_words::DOUBLE / left_weight AS level FROM f),
h AS (SELECT *, (SELECT min(pos) FROM g WHERE level * weight <= most) AS k, (SELECT arg_min(level, pos) FROM g WHERE level * weight <= most) AS lv FROM g),
t AS (SELECT source, source_size, CASE WHEN k IS NULL OR pos < k THEN most::DOUBLE ELSE least(lv * weight, most::DOUBLE) END AS target FROM h),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {CAP}) ELSE 0 END::BIGINT AS whole FROM t),
q AS (SELECT *, greatest(0.0::DOUBLE, target - whole * source_size) AS rest FROM p),
x AS (SELECT d.source, ceil(sqrt(size))::BIGINT AS x, sum(size)::BIGINT AS words, any_value(rest) AS rest FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source WHERE size > 0 AND rest > 0 GROUP BY ALL),
y AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS above,
        sum(x::HUGEINT * words) OVER (PARTITION BY source ORDER BY x ROWS UNBOUNDED PRECEDING) AS within FROM x),
z AS (SELECT *, (rest - above) / within::DOUBLE AS scale FROM y),
c AS (SELECT source, arg_max(scale, x) AS scale, max(x) AS certain FROM z WHERE scale * x < 1 GROUP BY source),
u AS (SELECT d.doc_id, d.source, d.size, source_size, target, whole, rest, CASE WHEN ceil(sqrt(size))::BIGINT > certain THEN 1.0::DOUBLE ELSE scale * ceil(sqrt(size))::BIGINT END AS chance,
        (('0x' || md5(coalesce(d.doc_id::VARCHAR, 'null') || '|{SEED}|' || digest)[1:13])::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source),
r AS (SELECT *, u * (1 - chance) / (u * (1 - chance) + (1 - u) * chance) AS rank FROM u),
a AS (SELECT source, rank, doc_id, size, sum(size)::BIGINT AS words, any_value(rest) AS rest FROM r WHERE size > 0 AND chance IS NOT NULL GROUP BY source, rank, doc_id, size),
b AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto FROM a)
SELECT r.doc_id, r.size, source_size, target, (whole * r.size + CASE WHEN upto - words / 2.0::DOUBLE <= b.rest THEN r.size ELSE 0 END)::BIGINT AS taken
FROM r LEFT JOIN b ON r.source IS NOT DISTINCT FROM b.source AND r.rank = b.rank AND r.doc_id IS NOT DISTINCT FROM b.doc_id AND r.size = b.size"""
