"""Plans over code points: explode, broadcast join with the dimension tables, aggregate.

These answer questions about whole columns and are a second, independent way to the per-string results of the
kernels. Where order doesn't count, characters of a string are reduced to distinct ones before they are exploded;
histograms count within each string first, so a long text gives few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import Unicode, tables_of
from ..functions.script_sets import WORDS, ScriptSets
from ..plans.dims import dim_confusable, dim_cp, dim_decomp, dim_set
from ..unicode_tables import UnicodeTables


def code_points(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos (from 0), ch, cp, utf16 (position in UTF-16 units) for each character; an empty text has no rows."""
    chars = df.select(F.col(id_col).alias("id"), F.posexplode(F.filter(F.split(text_col, ""), lambda c: c != "")).alias("pos", "ch")).withColumn("cp", F.ascii("ch"))
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return chars.withColumn("utf16", F.coalesce(F.sum(F.when(F.col("cp") > 0xFFFF, 2).otherwise(1)).over(before), F.lit(0)).cast("int"))


def distinct_points(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, cp: the distinct characters of each text."""
    return df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.filter(F.split(text_col, ""), lambda c: c != ""))).alias("ch")).select("id", F.ascii("ch").alias("cp"))


def text_of(cp: Column) -> Column:
    """The character of a code point; chr() would take it modulo 256."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def script_histogram(df: DataFrame, text_col: str, unicode: Unicode) -> DataFrame:
    """script, characters: how many characters of each script the column holds; counted within each text first."""
    counts = df.select(F.explode(unicode.script_counts(text_col)).alias("c"))
    return counts.groupBy(F.col("c.script").alias("script")).agg(F.sum("c.n").alias("characters"))


def properties(points: DataFrame, tables: UnicodeTables | None = None) -> DataFrame:
    """points (with cp) and the properties of each code point."""
    spark = points.sparkSession
    t = tables or tables_of(spark)
    joined = points.join(F.broadcast(dim_cp(spark, t)), "cp", "left").fillna({"script": "Zzzz", "script_ix": t.script_ix["Zzzz"], "id_type": 1, "allowed": False, "ignorable": False, "ccc": 0})
    return joined


def profile_of(df: DataFrame, id_col: str, text_col: str, tables: UnicodeTables | None = None, profile: DataFrame | None = None) -> DataFrame:
    """id, resolved (script set), allowed, level, systems for each row, by one aggregation.

    An empty text resolves to all scripts, is allowed and ASCII only. profile: a DataFrame of admitted code
    points (cp) in place of the General Security Profile. id must be unique.
    """
    spark = df.sparkSession
    t = tables or tables_of(spark)
    sets, ops = dim_set(spark, t), ScriptSets(t)
    zzzz = F.struct(*(F.lit(0).cast("long") if k else F.lit(1 << t.script_ix["Zzzz"]).cast("long") for k in range(4)))
    p = properties(distinct_points(df, id_col, text_col), t).join(F.broadcast(sets), "set_id", "left")
    known = F.col("set_id").isNotNull()
    p = p.select("id", "cp", "digit_zero", F.col("allowed"), *(F.when(known, F.col(w)).otherwise(zzzz[f"col{k + 1}"]).alias(w) for k, w in enumerate(WORDS)), F.coalesce("has_latin", F.lit(False)).alias("has_latin"))
    if profile is not None:
        p = p.join(F.broadcast(profile.select("cp", F.lit(True).alias("_in")).distinct()), "cp", "left").withColumn("allowed", F.coalesce("_in", F.lit(False)))
    agg = p.groupBy("id").agg(
        F.struct(*(F.bit_and(w).alias(w) for w in WORDS)).alias("resolved"),
        F.struct(*(F.bit_and(F.when(~F.col("has_latin"), F.col(w))).alias(w) for w in WORDS)).alias("rest"),
        F.bool_and("allowed").alias("allowed"),
        (F.max("cp") <= 0x7F).alias("ascii"),
        F.array_sort(F.collect_set("digit_zero")).alias("systems"),
    )
    out = df.select(F.col(id_col).alias("id")).join(agg, "id", "left")
    everything = ops.all()
    resolved = F.coalesce("resolved", everything)
    rest = F.when(F.col("rest.w0").isNull(), everything).otherwise(F.col("rest"))
    level = (
        F.when(~F.coalesce("allowed", F.lit(True)), 6)
        .when(F.coalesce("ascii", F.lit(True)), 1)
        .when(~ops.is_empty(resolved), 2)
        .when(ops.intersects(rest, ops.of("Jpan", "Kore", "Hanb")), 3)
        .when(ops.intersects(rest, ops.remove(ops.remove(ops.recommended(), "Cyrl"), "Grek")), 4)
        .otherwise(5)
    )
    return out.select("id", resolved.alias("resolved"), F.coalesce("allowed", F.lit(True)).alias("allowed"), level.alias("level"), F.coalesce("systems", F.array().cast("array<int>")).alias("systems"))


def decomposed(df: DataFrame, id_col: str, text_col: str, tables: UnicodeTables | None = None, form: str = "nfd") -> DataFrame:
    """id, text: NFD or NFKD by joins and one sort of each run of marks. Hangul syllables are taken apart by arithmetic."""
    spark = df.sparkSession
    t = tables or tables_of(spark)
    cp = F.col("cp")
    s = cp - 0xAC00
    hangul = F.concat(text_of(0x1100 + F.floor(s / 588)), text_of(0x1161 + F.floor(s % 588 / 28)), F.when(s % 28 != 0, text_of(0x11A7 + s % 28)).otherwise(""))
    points = code_points(df, id_col, text_col).join(F.broadcast(dim_decomp(spark, t).select("cp", F.col(form).alias("to"))), "cp", "left")
    to = F.when(cp.between(0xAC00, 0xD7A3), hangul).otherwise(F.coalesce("to", "ch"))
    flat = points.select("id", "pos", F.posexplode(F.filter(F.split(to, ""), lambda c: c != "")).alias("sub", "ch")).withColumn("cp", F.ascii("ch"))
    classes = spark.createDataFrame(sorted(t.ccc.items()), "cp int, ccc int")
    flat = flat.join(F.broadcast(classes), "cp", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    order = Window.partitionBy("id").orderBy("pos", "sub")
    flat = flat.withColumn("segment", F.sum((F.col("ccc") == 0).cast("int")).over(order))
    joined = flat.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("segment", "ccc", "pos", "sub", "ch"))).alias("all"))
    joined = joined.select("id", F.array_join(F.transform("all", lambda x: x["ch"]), "").alias("t"))
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).join(joined, "id", "left").select("id", F.when(F.col("_text").isNotNull(), F.coalesce("t", F.lit(""))).alias("text"))


def skeletons(df: DataFrame, id_col: str, text_col: str, tables: UnicodeTables | None = None) -> DataFrame:
    """id, text: skeletons by joins; the second way to the skeleton kernel."""
    spark = df.sparkSession
    t = tables or tables_of(spark)
    points = code_points(decomposed(df, id_col, text_col, t), "id", "text")
    ignorable = spark.createDataFrame([(cp,) for cp in sorted(t.ignorable)], "cp int")
    mapped = points.join(F.broadcast(ignorable), "cp", "left_anti").join(F.broadcast(dim_confusable(spark, t)), "cp", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("target", "ch").alias("to")))).alias("all"))
    mapped = mapped.select("id", F.array_join(F.transform("all", lambda x: x["to"]), "").alias("text"))
    every = df.select(F.col(id_col).alias("id"), F.col(text_col).isNotNull().alias("_has")).join(mapped, "id", "left").select("id", F.when(F.col("_has"), F.coalesce("text", F.lit(""))).alias("text"))
    return decomposed(every, "id", "text", t)
