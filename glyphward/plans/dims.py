"""Unicode properties as dimension tables, for joins on dense code point keys.

dim_cp holds every code point with a property other than the default; a left join's missing rows are
unassigned: script Zzzz, type Not_Character, not allowed. Its size is fixed by Unicode (under 300,000 rows),
not by the data, so joins with it may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.kernels import tables_of
from ..unicode_tables import RECOMMENDED_SCRIPTS, TYPE_BIT, UnicodeTables


def _words(mask: int) -> list[int]:
    return [w - (1 << 64) if w >> 63 else w for w in (mask >> 64 * k & (1 << 64) - 1 for k in range(4))]


def dim_script(spark: SparkSession, tables: UnicodeTables | None = None) -> DataFrame:
    t = tables or tables_of(spark)
    rows = [(t.script_ix[c], c, t.script_names[c], c in RECOMMENDED_SCRIPTS) for c in t.codes]
    return spark.createDataFrame(rows, "ix int, code string, name string, recommended boolean")


#: What dim_cp has made, by application and table set: it doesn't depend on data, so each application makes it once.
_made: dict[str, dict[int, tuple[UnicodeTables, DataFrame]]] = {}


def dim_cp(spark: SparkSession, tables: UnicodeTables | None = None) -> DataFrame:
    """cp, script, script_ix, set_id, id_type, allowed, ignorable, ccc, digit_zero; cached."""
    t, app = tables or tables_of(spark), spark.sparkContext.applicationId
    if app not in _made:
        _made.clear()
    made = _made.setdefault(app, {})
    if id(t) not in made:
        made[id(t)] = t, _dim_cp(spark, t).cache()
    return made[id(t)][1]


def _dim_cp(spark: SparkSession, t: UnicodeTables) -> DataFrame:
    """Runs of equal script and type are expanded in Spark; exceptions by code point are joined to them."""
    sets = {t.augmented(0x41): 0}
    starts = sorted({*t.script.starts, *t.types.starts, *(x for cp in t.extensions for x in (cp, cp + 1))})
    runs = []
    for a, b in zip(starts, [*starts[1:], 0x110000], strict=True):
        script, kind = t.script[a], t.types[a]
        if script != "Zzzz" or kind != TYPE_BIT["Not_Character"]:
            mask = t.augmented(a)
            runs.append((a, b - 1, script, t.script_ix[script], sets.setdefault(mask, len(sets)), kind, t.allowed(a)))
    exceptions = [(cp, cp in t.ignorable, t.ccc.get(cp, 0), t.zeros.get(cp)) for cp in sorted({*t.ignorable, *t.ccc, *t.zeros})]
    base = spark.createDataFrame(runs, "first int, last int, script string, script_ix int, set_id int, id_type int, allowed boolean").selectExpr("explode(sequence(first, last)) AS cp", "script", "script_ix", "set_id", "id_type", "allowed")
    other = spark.createDataFrame(exceptions, "cp int, ignorable boolean, ccc int, digit_zero int")
    unknown = t.script_ix["Zzzz"]
    zzzz = sets.setdefault(1 << unknown, len(sets))
    return base.join(other, "cp", "full_outer").selectExpr(
        "cp", "coalesce(script, 'Zzzz') AS script", f"coalesce(script_ix, {unknown}) AS script_ix", f"coalesce(set_id, {zzzz}) AS set_id", f"coalesce(id_type, {TYPE_BIT['Not_Character']}) AS id_type",
        "coalesce(allowed, false) AS allowed", "coalesce(ignorable, false) AS ignorable", "coalesce(ccc, 0) AS ccc", "digit_zero",
    )


def dim_set(spark: SparkSession, tables: UnicodeTables | None = None) -> DataFrame:
    """set_id, w0..w3, is_all, has_latin: the augmented script sets that dim_cp refers to."""
    t = tables or tables_of(spark)
    sets = {t.augmented(0x41): 0}
    for a in sorted({*t.script.starts, *t.types.starts, *(x for cp in t.extensions for x in (cp, cp + 1))}):
        if a < 0x110000 and (t.script[a] != "Zzzz" or t.types[a] != TYPE_BIT["Not_Character"]):
            sets.setdefault(t.augmented(a), len(sets))
    sets.setdefault(1 << t.script_ix["Zzzz"], len(sets))
    latin = 1 << t.script_ix["Latn"]
    rows = [(i, *_words(m), m == t.all_scripts, bool(m & latin)) for m, i in sets.items()]
    return spark.createDataFrame(rows, "set_id int, w0 long, w1 long, w2 long, w3 long, is_all boolean, has_latin boolean")


def dim_confusable(spark: SparkSession, tables: UnicodeTables | None = None) -> DataFrame:
    t = tables or tables_of(spark)
    return spark.createDataFrame(sorted(t.confusables.items()), "cp int, target string")


def dim_decomp(spark: SparkSession, tables: UnicodeTables | None = None) -> DataFrame:
    """cp, nfd, nfkd: full decompositions but those of Hangul syllables, which are arithmetic."""
    t = tables or tables_of(spark)
    rows = [(cp, t.nfd.get(cp, chr(cp)), t.nfkd.get(cp, t.nfd.get(cp, chr(cp)))) for cp in sorted({*t.nfd, *t.nfkd})]
    return spark.createDataFrame(rows, "cp int, nfd string, nfkd string")


def dim_compose(spark: SparkSession, tables: UnicodeTables | None = None) -> DataFrame:
    t = tables or tables_of(spark)
    return spark.createDataFrame([(a, b, c) for (a, b), c in sorted(t.pairs.items())], "first int, second int, composite int")


def meta(spark: SparkSession, tables: UnicodeTables | None = None) -> DataFrame:
    return spark.createDataFrame([((tables or tables_of(spark)).version,)], "unicode_version string")


DIMS = {"dim_script": dim_script, "dim_cp": dim_cp, "dim_set": dim_set, "dim_confusable": dim_confusable, "dim_decomp": dim_decomp, "dim_compose": dim_compose, "meta": meta}


def write_dims(spark: SparkSession, directory: str, tables: UnicodeTables | None = None) -> None:
    """All dimension tables as Parquet below a directory."""
    for name, make in DIMS.items():
        make(spark, tables).write.mode("overwrite").parquet(f"{directory}/{name}")
