"""Columns, plans and SQL against the functions; relational plans against kernels; sources; streams."""

import random

import pytest
from glyphward.functions.kernels import Unicode, register, tables_of
from glyphward.functions.script_sets import ScriptSets
from glyphward.operators import codepoints, findings, lookalikes
from glyphward.plans import dims
from glyphward.sources import ucd
from glyphward.streaming import names as streams
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def u(spark):
    return Unicode(spark)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(39)
    pool = [chr(c) for c in [*range(0x61, 0x7B), 0x30, 0x31, 0xE9, 0x301, 0x327, 0x430, 0x440, 0x3B1, 0x661, 0x967, 0x30A2, 0x3042, 0x6771, 0xAC01, 0x1100, 0x1161, 0x200D, 0x2603, 0xFB01, 0xFF10, 0x1D5C9, 0x10400, 0x20, 0x2D]]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(400)] + [(1000, None), (1001, "")]
    return spark.createDataFrame(rows, "id long, t string").cache()


def collected(df):
    return {r["id"]: r["x"] for r in df.collect()}


def test_columns_are_the_functions(texts, u):
    f = u.functions
    for name, call in {"nfc": f.nfc, "nfkd": f.nfkd, "skeleton": f.skeleton, "lookalike_key": f.lookalike_key, "restriction_level": f.level, "single_script": f.single_script, "all_allowed": f.all_allowed, "number_systems": f.number_systems}.items():
        got = collected(texts.select("id", getattr(u, name)("t").alias("x")))
        assert got == {r["id"]: None if r["t"] is None else call(r["t"]) for r in texts.collect()}, name


def test_struct_columns(texts, u):
    f = u.functions
    got = collected(texts.select("id", u.inspect("t", "Relaxed").alias("x")))
    for r in texts.collect():
        assert (got[r["id"]] and got[r["id"]].asDict(True)) == (None if r["t"] is None else f.inspect(r["t"], "Relaxed"))
    got = collected(texts.select("id", u.check("t", "SingleScript").alias("x")))
    assert got[1000] is None and all(got[r["id"]].asDict(True) == f.check(r["t"], 2) for r in texts.collect() if r["t"] is not None)
    with pytest.raises(ValueError):
        u.inspect("t", "Strict")
    with pytest.raises(ValueError):
        u.check("t", 0)


def test_relational_plans_agree_with_kernels(texts, u):
    t = u.tables
    for form in ("nfd", "nfkd"):
        assert collected(codepoints.decomposed(texts, "id", "t", t, form).withColumnRenamed("text", "x")) == collected(texts.select("id", getattr(u, form)("t").alias("x")))
    assert collected(codepoints.skeletons(texts, "id", "t", t).withColumnRenamed("text", "x")) == collected(texts.select("id", u.skeleton("t").alias("x")))
    named = texts.where("t IS NOT NULL")
    sets = ScriptSets(t)
    p = codepoints.profile_of(named, "id", "t", t).select("id", F.struct("level", "allowed", "systems", sets.codes(F.col("resolved")).alias("codes")).alias("x"))
    k = named.select("id", F.struct(u.restriction_level("t").alias("level"), u.all_allowed("t").alias("allowed"), u.number_systems("t").alias("systems"), u.resolved_scripts("t").alias("codes")).alias("x"))
    assert collected(p) == collected(k)


def test_positions_and_characters(spark):
    df = spark.createDataFrame([(1, "a\U0001d5c9b☃")], "id long, t string")
    rows = codepoints.code_points(df, "id", "t").orderBy("pos").collect()
    assert [(r["cp"], r["utf16"]) for r in rows] == [(0x61, 0), (0x1D5C9, 1), (0x62, 3), (0x2603, 4)]
    assert [r["c"] for r in spark.createDataFrame([(x,) for x in (0x41, 0x435, 0x1D5C9)], "cp int").select(codepoints.text_of(F.col("cp")).alias("c")).collect()] == ["A", "е", "\U0001d5c9"]


def test_script_sets(spark, u):
    s = ScriptSets(u.tables)
    a, b = s.of("Latn", "Jpan"), s.of("Cyrl")
    row = spark.range(1).select(
        s.to_string(s.all()).alias("all"), s.to_string(s.empty()).alias("none"), s.to_string(s.add(a, "Cyrl")).alias("added"), s.to_string(s.remove(a, "Latn")).alias("removed"), s.to_string(s.union(a, b)).alias("union"),
        s.contains(a, "Jpan").alias("has"), s.contains(a, "Cyrl").alias("hasnt"), s.intersects(a, b).alias("meets"), s.is_subset(s.empty(), b).alias("sub"), s.is_all(a).alias("isall"), s.count(s.all()).alias("n"), (a == s.of("Jpan", "Latn")).alias("eq"),
    ).first()
    assert tuple(row) == ("ALL", "{}", "{Cyrl, Latn, Jpan}", "{Jpan}", "{Cyrl, Latn, Jpan}", True, False, False, True, False, len(u.tables.codes), True)
    with pytest.raises(ValueError):
        s.of("Xxxx")


def test_lookalike_operators(spark, u, tmp_path):
    old = spark.createDataFrame([("paypal", 1), ("modern", 2), ("paypal", 3), (None, 4)], "name string, n int")
    lookalikes.write_index(old, "name", str(tmp_path / "index"), u)
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() == 4
    new = spark.createDataFrame([("pаypal",), ("rnodern",), ("other",), (None,)], "name string")
    assert {r["name"] for r in lookalikes.taken(new, index, "name", u).collect()} == {"pаypal", "rnodern"}
    assert {r["name"] for r in lookalikes.free(new, index, "name", u).collect()} == {"other", None}
    c = lookalikes.collisions(old.select("name").unionByName(new), "name", u).collect()
    assert sorted((r["lookalike_key"], r["names"]) for r in c) == [("paypal", 2), ("rnodern", 2)]
    rows = findings.findings(spark.createDataFrame([(1, "vеlvet"), (2, "fine"), (3, None)], "id int, name string"), "name", u).collect()
    assert [(r["id"], r["kind"], r["position"]) for r in rows] == [(1, "MixedScripts", 1)]


def test_sql(spark, u):
    register(spark, u)
    row = spark.sql("SELECT skeleton('1ove'), nfkc('ﬁ'), restriction_level('aアー'), confusable_class('ǉeto', 'ljeto'), acceptable_name('røyke', 'Ascii'), script_of(1072), skeleton(NULL)").first()
    assert tuple(row) == ("love", "fi", 3, "SingleScript", False, "Cyrl", None)
    rows = spark.sql("SELECT f.kind, f.position FROM (SELECT 'a1١' AS n) x, LATERAL name_findings(x.n, 'OneScript') f").collect()
    assert [tuple(r) for r in rows] == [("MixedScripts", 2), ("MixedDigits", 2)]


def test_dims(spark, tmp_path):
    t = tables_of(spark)
    cps = dims.dim_cp(spark, t)
    assert cps.count() == cps.select("cp").distinct().count() < 400_000
    assert cps.where("allowed <> (id_type <> 0 AND (id_type & ~3072) = 0)").count() == 0
    assert cps.where("digit_zero IS NOT NULL").groupBy("digit_zero").count().where("count <> 10").count() == 0
    assert dims.dim_confusable(spark, t).count() == len(t.confusables)
    assert dims.dim_compose(spark, t).groupBy("first", "second").count().where("count > 1").count() == 0
    dims.write_dims(spark, str(tmp_path), t)
    assert spark.read.parquet(str(tmp_path / "meta")).first()["unicode_version"] == t.version


UCD = {
    "UnicodeData": "0041;LATIN CAPITAL LETTER A;Lu;0;L;;;;;N;;;;0061;\n0061;LATIN SMALL LETTER A;Ll;0;L;;;;;N;;;0041;;0041\n00B2;SUPERSCRIPT TWO;No;0;EN;<super> 0032;;2;2;N;;;;;\n0301;COMBINING ACUTE ACCENT;Mn;230;NSM;;;;;N;;;;;\n00E1;A WITH ACUTE;Ll;0;L;0061 0301;;;;N;;;;;\n"
    + "".join(f"{0x30 + i:04X};DIGIT;Nd;0;EN;;{i};{i};{i};N;;;;;\n" for i in range(10)),
    "Scripts": "# Scripts-17.0.0.txt\n0041          ; Latin # L& A\n0061 ; Latin\n00E1 ; Latin\n0030..0039 ; Common\n0301 ; Inherited\n0430 ; Cyrillic\n",
    "ScriptExtensions": "# ScriptExtensions-17.0.0.txt\n0301 ; Cyrl Latn\n",
    "PropertyValueAliases": "# PropertyValueAliases-17.0.0.txt\nsc ; Latn ; Latin\nsc ; Cyrl ; Cyrillic\nsc ; Zyyy ; Common\nsc ; Zinh ; Inherited ; Qaai\nsc ; Zzzz ; Unknown\ngc ; L ; Letter\n"
    + "".join(f"sc ; {c} ; Name_{c}\n" for c in ("Grek", "Arab", "Armn", "Beng", "Deva", "Ethi", "Geor", "Gujr", "Guru", "Hang", "Hani", "Hebr", "Hira", "Kana", "Knda", "Khmr", "Laoo", "Mlym", "Mymr", "Orya", "Sinh", "Taml", "Telu", "Thaa", "Thai", "Tibt")),
    "IdentifierType": "# IdentifierType-17.0.0.txt\n0030..0039 ; Recommended\n0041 ; Recommended\n0061 ; Recommended\n00E1 ; Recommended\n0301 ; Technical Uncommon_Use\n",
    "IdentifierStatus": "# IdentifierStatus-17.0.0.txt\n0030..0039 ; Allowed\n0041 ; Allowed\n0061 ; Allowed\n00E1 ; Allowed\n",
    "DerivedCoreProperties": "# DerivedCoreProperties-17.0.0.txt\n00AD ; Default_Ignorable_Code_Point # Cf\n0041 ; Alphabetic\n",
    "DerivedNormalizationProps": "# DerivedNormalizationProps-17.0.0.txt\n0340 ; Full_Composition_Exclusion\n",
    "confusables": "﻿# confusables.txt\n# Version: 17.0.0\n0430 ;\t0061 ;\tMA\t# x\n0030 ;\t004F ;\tMA\n",
}


def write_ucd(path, **changes):
    extra = "".join(f"{0xE000 + i:04X} ; Name_{c}\n" for i, c in enumerate(("Grek", "Arab", "Armn", "Beng", "Deva", "Ethi", "Geor", "Gujr", "Guru", "Hang", "Hani", "Hebr", "Hira", "Kana", "Knda", "Khmr", "Laoo", "Mlym", "Mymr", "Orya", "Sinh", "Taml", "Telu", "Thaa", "Thai", "Tibt")))
    for name, text in (UCD | {"Scripts": UCD["Scripts"] + extra} | changes).items():
        (path / f"{name}.txt").write_text(text, encoding="utf-8")
    return str(path)


def test_ucd_directory(spark, tmp_path):
    t = ucd.load(spark, write_ucd(tmp_path))
    f = Unicode(spark, t).functions
    assert t.version == "17.0.0" and t.script[0x430] == "Cyrl" and t.extensions_of(0x301) == {"Cyrl", "Latn"}
    assert f.nfc("a\u0301") == "\xe1" and f.nfkd("\xb2\xe1") == "2a\u0301" and f.skeleton("\u0430\u00ad0") == "aO" and f.digit_value(0x37) == 7
    assert t.type_names(t.types[0x301]) == ["Technical", "Uncommon_Use"] and not t.allowed(0x301) and t.allowed(0x61)


def test_ucd_integrity(spark, tmp_path):
    for name, change in {"versions": {"Scripts": UCD["Scripts"].replace("17.0.0", "16.0.0")}, "status": {"IdentifierStatus": "# IdentifierStatus-17.0.0.txt\n0041 ; Allowed\n"}, "twice": {"confusables": UCD["confusables"] + "0430 ; 0062 ; MA\n"}}.items():
        (tmp_path / name).mkdir()
        with pytest.raises(ValueError):
            ucd.load(spark, write_ucd(tmp_path / name, **change))


def test_ucd_status_within_a_run(spark, tmp_path):
    """A code point inside a run of equal type that the status file leaves out."""
    with pytest.raises(ValueError, match="U\\+0033"):
        ucd.load(spark, write_ucd(tmp_path, IdentifierStatus=UCD["IdentifierStatus"].replace("0030..0039", "0030..0032 ; Allowed\n0034..0039")))


def test_ucd_files_of_all_tables(spark, u):
    """The whole tables, written as data files and read again."""
    files = ucd.lines_of(u.tables)
    again = ucd.load_lines(lambda name: spark.createDataFrame([(x,) for x in files[name]], "value string"))
    for name in ("version", "script_names", "codes", "extensions", "ignorable", "nfd", "nfkd", "pairs", "ccc", "zeros", "confusables"):
        assert getattr(again, name) == getattr(u.tables, name), name
    assert [list(x.ranges()) for x in (again.script, again.types)] == [list(x.ranges()) for x in (u.tables.script, u.tables.types)]


def test_run_length_encoding(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (5, "b"), (6, "a")], "cp int, value string")
    assert sorted(tuple(r) for r in ucd.run_length_encode(rows).collect()) == [(1, 2, "a"), (3, 3, "b"), (5, 5, "b"), (6, 6, "a")]


def test_streams(spark, u, tmp_path):
    rows = [("paypal", "2024-01-01 00:00:00"), ("pаypal", "2024-01-01 00:00:10"), ("other", "2024-01-01 00:01:10")]
    spark.createDataFrame(rows, "name string, at string").selectExpr("name", "timestamp(at) AS at").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("name string, at timestamp").parquet(str(tmp_path / "in"))

    def run(stream, name, mode="append"):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted((r["name"], r["acceptable"]) for r in run(streams.inspected_stream(read(), "name", u), "s1")) == [("other", True), ("paypal", True), ("pаypal", False)]
    index = lookalikes.keyed(spark.createDataFrame([("paypal",)], "name string"), "name", u)
    assert len(run(streams.taken_stream(read(), index, "name", u), "s2")) == 2
    assert len(run(streams.first_of_lookalikes(read(), "name", "at", "1 hour", u), "s3")) == 2
    windows = run(streams.unacceptable_by_window(read(), "name", "at", "1 minute", "10 seconds", u), "s4", "complete")
    assert sorted((r["names"], r["unacceptable"]) for r in windows) == [(1, 0), (2, 1)]
