"""The registered queries over the TPC-H-like tables and documents, each with DuckDB SQL for the same rows.

Test names are made from customers by one SQL text that both engines run: plain ASCII, Cyrillic lookalikes, a
foreign digit, an invisible joiner, a character that is not allowed, a ligature, an accent, all Cyrillic.
"""

from __future__ import annotations

import itertools
import tempfile
import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.kernels import Unicode, known_policy, permitted_level, register, tables_of
from .functions.script_sets import ScriptSets
from .functions.text import valid_code_point
from .operators import codepoints, findings, lookalikes
from .plans import dims
from .sources import ucd
from .streaming import names as streams

_ZWJ, _ARABIC_ONE, _LIGATURE = "‍", "١", "ﬁ"
_CYRILLIC_O, _CYRILLIC_E = "о", "е"
_COPE = "соре"

NAMES = f"""
SELECT c_custkey AS id, c_custkey % 8 AS kind, replace(c_name, '#', '') AS plain,
  CASE c_custkey % 8
    WHEN 0 THEN replace(c_name, '#', '')
    WHEN 1 THEN translate(replace(c_name, '#', ''), 'oe', '{_CYRILLIC_O}{_CYRILLIC_E}')
    WHEN 2 THEN concat(replace(c_name, '#', '_'), '{_ARABIC_ONE}')
    WHEN 3 THEN replace(replace(c_name, '#', ''), 'Cust', 'Cust{_ZWJ}')
    WHEN 4 THEN c_name
    WHEN 5 THEN concat('{_LIGATURE}', replace(c_name, '#', ''))
    WHEN 6 THEN concat(replace(c_name, '#', '-'), 'é')
    ELSE replace(c_name, 'Customer#', '{_COPE}')
  END AS name
FROM customer"""

#: The skeleton of a name of NAMES in SQL: letters of its ASCII form that have prototypes, by kind.
_SKELETON = f"""CASE kind
  WHEN 2 THEN concat(translate(replace(replace(name, '{_ARABIC_ONE}', ''), 'm', 'rn'), '01', 'Ol'), 'l')
  WHEN 4 THEN translate(replace(name, 'm', 'rn'), '01', 'Ol')
  WHEN 5 THEN concat('fi', translate(replace(plain, 'm', 'rn'), '01', 'Ol'))
  WHEN 6 THEN concat(translate(replace(replace(name, 'é', ''), 'm', 'rn'), '01', 'Ol'), 'é')
  WHEN 7 THEN concat('cope', translate(replace(name, '{_COPE}', ''), '01', 'Ol'))
  ELSE translate(replace(plain, 'm', 'rn'), '01', 'Ol') END"""
_LEVEL = "CASE kind WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 6 WHEN 4 THEN 6 WHEN 5 THEN 6 ELSE 2 END"
_ACCENTED = "À-ÅÇ-ÏÑ-ÖÙ-Ýà-åç-ïñ-öù-ýÿ"
#: ASCII code points with a prototype.
_ASCII_PROTOTYPES = {34: "''", 37: "º/₀", 48: "O", 49: "l", 73: "l", 96: "'", 109: "rn", 124: "l"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, plain, name for each customer."""
    view = f"customer_{abs(hash(sf_dir))}"
    _table(spark, sf_dir, "customer").select("c_custkey", "c_name").createOrReplaceTempView(view)
    return spark.sql(NAMES.replace("FROM customer", f"FROM {view}"))


_units: dict[str, Unicode] = {}


def unicode(spark: SparkSession) -> Unicode:
    """One table set for each application."""
    app = spark.sparkContext.applicationId
    if app not in _units:
        _units.clear()
        _units[app] = Unicode(spark)
    return _units[app]


QUERIES, ORACLES = {}, {}


def _every_code_point(spark: SparkSession) -> DataFrame:
    return spark.range(0x110000).select(F.col("id").cast("int").alias("cp"))


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _with_names(select: str) -> str:
    return f"WITH n AS ({NAMES}) {select}"


@query("SELECT doc_id, md5(nfc_normalize(replace(text, 'é', 'é'))) AS digest FROM documents")
def nfc_documents(spark, sf_dir):
    text = F.replace("text", F.lit("é"), F.lit("é"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(unicode(spark).nfc(text).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, (length(text) + length(regexp_replace(text, '[^{_ACCENTED}]', '', 'g')))::BIGINT AS nfd_chars FROM documents")
def nfd_lengths(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(unicode(spark).nfd("text")).cast("long").alias("nfd_chars"))


@query(_with_names(f"SELECT id, replace(replace(replace(name, '{_LIGATURE}', 'fi'), 'é', 'é'), '{_ZWJ}', '{_ZWJ}') AS folded FROM n"))
def nfkd_names(spark, sf_dir):
    return names(spark, sf_dir).select("id", unicode(spark).nfkd("name").alias("folded"))


@query(_with_names(f"SELECT id, replace(name, '{_LIGATURE}', 'fi') AS clean FROM n"))
def nfkc_clean_names(spark, sf_dir):
    return names(spark, sf_dir).select("id", unicode(spark).clean("name").alias("clean"))


@query(_with_names("SELECT id, coalesce(length(regexp_replace(nfd, '[^́]', '', 'g')), 0)::INT AS marks, CASE WHEN nfd LIKE '%́%' THEN 230 ELSE 0 END::INT AS highest FROM (SELECT id, replace(name, 'é', 'é') AS nfd FROM n)"))
def combining_classes(spark, sf_dir):
    """Marks of each name's canonical decomposition and the highest combining class, by code point rows."""
    nfd = names(spark, sf_dir).select("id", unicode(spark).nfd("name").alias("nfd"))
    points = codepoints.properties(codepoints.code_points(nfd, "id", "nfd"), tables_of(spark))
    return points.groupBy("id").agg(F.count_if(F.col("ccc") > 0).cast("int").alias("marks"), F.max("ccc").alias("highest"))


@query(_with_names(f"SELECT id, {_SKELETON} AS skeleton FROM n"))
def skeleton_names(spark, sf_dir):
    return names(spark, sf_dir).select("id", unicode(spark).skeleton("name").alias("skeleton"))


@query(_with_names(f"SELECT id, {_SKELETON} AS skeleton FROM n"))
def skeleton_names_relational(spark, sf_dir):
    """The same by code point rows and joins: an independent second way."""
    return codepoints.skeletons(names(spark, sf_dir), "id", "name", tables_of(spark)).select("id", F.col("text").alias("skeleton"))


@query(_with_names(f"SELECT id, {_SKELETON} AS lookalike_key FROM n"))
def lookalike_keys(spark, sf_dir):
    return names(spark, sf_dir).select("id", unicode(spark).lookalike_key("name").alias("lookalike_key"))


_SPOOFED = f"""
WITH base AS (SELECT n_name AS name FROM nation), spoofed AS (
  SELECT name FROM base UNION ALL SELECT translate(name, 'AO', 'АО') FROM base UNION ALL SELECT replace(name, 'I', 'l') FROM base)
"""


@query(f"{_SPOOFED} SELECT translate(n_name, 'I01', 'lOl') AS lookalike_key, 3::BIGINT AS names, least(n_name, translate(n_name, 'AO', 'АО'), replace(n_name, 'I', 'l')) AS first_name, greatest(n_name, translate(n_name, 'AO', 'АО'), replace(n_name, 'I', 'l')) AS last_name FROM nation")
def lookalike_collisions(spark, sf_dir):
    """Nation names that collide with their homoglyph spellings once lookalikes are folded."""
    base = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    spoofed = base.unionByName(base.select(F.translate("name", "AO", "АО").alias("name"))).unionByName(base.select(F.replace("name", F.lit("I"), F.lit("l")).alias("name")))
    return lookalikes.collisions(spoofed, "name", unicode(spark))


@query(_with_names("SELECT id, (kind IN (0, 1, 3)) AS confusable, (kind IN (0, 1, 3)) AS lookalike FROM n"))
def confusable_pairs(spark, sf_dir):
    """Each name against its plain spelling: equal skeletons, equal keys."""
    u = unicode(spark)
    return names(spark, sf_dir).select("id", u.are_confusable("name", "plain").alias("confusable"), u.lookalikes("name", "plain").alias("lookalike"))


_PAIRS = (
    ("desparejado", "ԁеѕрагејаԁо", "WholeScript"),
    ("desparejado", "desparejado", "SingleScript"),
    ("paypal", "pаypal", "MixedScript"),
    ("ǉeto", "ljeto", "SingleScript"),
    ("scope", "scopes", "NotConfusable"),
    ("", "", "SingleScript"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _PAIRS) + ") v(a, b, confusable_class)")
def classify_pairs(spark, sf_dir):
    pairs = spark.createDataFrame([p[:2] for p in _PAIRS], "a string, b string")
    return lookalikes.classified(pairs, "a", "b", unicode(spark))


@query("SELECT range::INT AS cp, CASE range " + " ".join(f"WHEN {cp} THEN '{to.replace(chr(39), chr(39) * 2)}'" for cp, to in _ASCII_PROTOTYPES.items()) + " END AS prototype FROM range(128)")
def ascii_prototypes(spark, sf_dir):
    return _every_code_point(spark).where("cp < 128").select("cp", unicode(spark).prototype("cp").alias("prototype"))


@query(None)
def prototype_lookup(spark, sf_dir):
    return _every_code_point(spark).select("cp", unicode(spark).prototype("cp").alias("prototype"))


# The ranges of Default_Ignorable_Code_Point.
_IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)


@query(f"SELECT range::INT AS cp, ({' OR '.join(f'range BETWEEN {a} AND {b}' for a, b in _IGNORABLE)}) AS ignorable FROM range({0x110000})")
def default_ignorables(spark, sf_dir):
    return _every_code_point(spark).select("cp", unicode(spark).default_ignorable("cp").alias("ignorable"))


@query("SELECT CASE WHEN ch BETWEEN 'A' AND 'Z' OR ch BETWEEN 'a' AND 'z' OR (ch BETWEEN 'À' AND 'ÿ' AND ch NOT IN ('×', '÷')) THEN 'Latn' ELSE 'Zyyy' END AS script, count(*)::BIGINT AS characters FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1")
def script_histogram(spark, sf_dir):
    return codepoints.script_histogram(_table(spark, sf_dir, "documents"), "text", unicode(spark))


@query(_with_names("SELECT id, CASE kind WHEN 1 THEN '' WHEN 2 THEN '' WHEN 7 THEN 'Cyrl' ELSE 'Latn' END AS scripts, kind NOT IN (1, 2) AS single FROM n"))
def resolved_scripts(spark, sf_dir):
    u = unicode(spark)
    return names(spark, sf_dir).select("id", F.array_join(u.resolved_scripts("name"), " ").alias("scripts"), u.single_script("name").alias("single"))


@query(_with_names("SELECT id, kind NOT IN (3, 4, 5) AS allowed FROM n"))
def allowed_names(spark, sf_dir):
    return names(spark, sf_dir).select("id", unicode(spark).all_allowed("name").alias("allowed"))


_TYPE_SQL = "CASE WHEN range BETWEEN 48 AND 57 OR range BETWEEN 65 AND 90 OR range = 95 OR range BETWEEN 97 AND 122 THEN 2048 WHEN range IN (39, 45, 46, 58) THEN 1024 WHEN range BETWEEN 0 AND 8 OR range BETWEEN 14 AND 31 OR range = 127 THEN 1 ELSE 16 END"


def _types(spark, cps):
    u = unicode(spark)
    cps = cps.withColumn("id_type", u.identifier_type("cp"))
    return cps.select("cp", "id_type", u.allowed("cp").alias("allowed"), F.array_join(u.type_names(F.col("id_type")), " ").alias("types"))


@query(f"SELECT range::INT AS cp, ({_TYPE_SQL})::INT AS id_type, {_TYPE_SQL} >= 1024 AS allowed, CASE {_TYPE_SQL} WHEN 2048 THEN 'Recommended' WHEN 1024 THEN 'Inclusion' WHEN 16 THEN 'Not_XID' ELSE 'Not_Character' END AS types FROM range(128)")
def ascii_types(spark, sf_dir):
    return _types(spark, _every_code_point(spark).where("cp < 128"))


@query(None)
def identifier_types(spark, sf_dir):
    return _types(spark, _every_code_point(spark))


@query(_with_names(f"SELECT id, ({_LEVEL})::INT AS level FROM n"))
def restriction_levels(spark, sf_dir):
    return names(spark, sf_dir).select("id", unicode(spark).restriction_level("name").alias("level"))


@query(_with_names(f"SELECT id, ({_LEVEL})::INT AS level, kind NOT IN (3, 4, 5) AS allowed, CASE kind WHEN 2 THEN '48,1632' ELSE '48' END AS systems, CASE kind WHEN 1 THEN '{{}}' WHEN 2 THEN '{{}}' WHEN 7 THEN '{{Cyrl}}' ELSE '{{Latn}}' END AS scripts FROM n"))
def name_profiles_relational(spark, sf_dir):
    """Level, status, number systems and resolved scripts by one aggregation over code point rows."""
    t = tables_of(spark)
    p = codepoints.profile_of(names(spark, sf_dir), "id", "name", t)
    return p.select("id", F.col("level").cast("int").alias("level"), "allowed", F.array_join(F.col("systems").cast("array<string>"), ",").alias("systems"), ScriptSets(t).to_string(F.col("resolved")).alias("scripts"))


@query(_with_names("SELECT id, CASE kind WHEN 2 THEN '48,1632' ELSE '48' END AS systems, kind = 2 AS mixed FROM n"))
def number_systems(spark, sf_dir):
    u = unicode(spark)
    return names(spark, sf_dir).select("id", F.array_join(u.number_systems("name").cast("array<string>"), ",").alias("systems"), u.mixed_numbers("name").alias("mixed"))


def _zeros() -> list[int]:
    """The zeros of all decimal digits: those that Python knows, and those that Unicode 16 added."""
    added = (0x10D40, 0x116D0, 0x116DA, 0x11BF0, 0x16130, 0x16D70, 0x1CCF0, 0x1E5F1)
    return sorted({*added, *(cp for cp in range(0x110000) if unicodedata.category(chr(cp)) == "Nd" and unicodedata.decimal(chr(cp)) == 0)})


@query("SELECT (z + i)::INT AS cp, i::INT AS value FROM (SELECT unnest([" + ", ".join(map(str, _zeros())) + "]) AS z), (SELECT range AS i FROM range(10))")
def digit_values(spark, sf_dir):
    return _every_code_point(spark).select("cp", unicode(spark).digit_value("cp").alias("value")).where("value IS NOT NULL")


@query(_with_names(f"SELECT id, CASE kind WHEN 1 THEN 2 WHEN 2 THEN 6 WHEN 3 THEN 3 WHEN 4 THEN 3 WHEN 5 THEN 1 ELSE 0 END::INT AS problems, CASE kind WHEN 5 THEN 1 ELSE {_LEVEL} END::INT AS level, kind IN (0, 6, 7) AS accepted, replace(name, '{_LIGATURE}', 'fi') AS normalized, {_SKELETON} AS skeleton FROM n"))
def identifier_checks(spark, sf_dir):
    """Checks against level 3, Highly Restrictive."""
    c = names(spark, sf_dir).select("id", unicode(spark).check("name", 3).alias("c"))
    return c.select("id", "c.problems", "c.level", "c.accepted", "c.normalized", "c.skeleton")


#: A profile that admits ASCII letters, digits and the number sign only.
PLAIN_PROFILE = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x23]


@query(_with_names("SELECT id, CASE WHEN kind IN (0, 4) THEN 1 ELSE 6 END::INT AS level FROM n"))
def custom_profile_levels(spark, sf_dir):
    """Levels under a profile."""
    return names(spark, sf_dir).select("id", unicode(spark).restriction_level("name", PLAIN_PROFILE).alias("level"))


@query(_with_names(f"SELECT id, CASE WHEN kind IN (0, 4) THEN 0 WHEN kind = 5 THEN 1 WHEN kind = 2 THEN 7 ELSE 3 END::INT AS problems, CASE WHEN kind IN (0, 4, 5) THEN 1 ELSE 6 END::INT AS level, kind IN (0, 4) AS accepted, replace(name, '{_LIGATURE}', 'fi') AS normalized, CASE kind WHEN 2 THEN '48,1632' ELSE '48' END AS systems FROM n"))
def custom_profile_checks(spark, sf_dir):
    """Checks against level 3 under the same profile."""
    c = names(spark, sf_dir).select("id", unicode(spark).check("name", 3, PLAIN_PROFILE).alias("c"))
    return c.select("id", "c.problems", "c.level", "c.accepted", "c.normalized", F.array_join(F.col("c.number_systems").cast("array<string>"), ",").alias("systems"))


_MIXED = "WHEN 1 THEN ['MixedScripts@4+1', 'MixedScripts@6+1'] WHEN 2 THEN ['MixedScripts@18+1', 'MixedDigits@18+1'] WHEN 3 THEN ['Invisible@4+1'] WHEN 4 THEN ['NotAllowed@8+1'] WHEN 5 THEN ['CompatibilityForm@0+1']"


@query(_with_names(f"SELECT id, pos::INT AS finding_no, f AS finding FROM (SELECT id, CASE kind {_MIXED} END AS fs FROM n), LATERAL (SELECT unnest(fs) AS f, unnest(range(len(fs))) AS pos)"))
def name_findings(spark, sf_dir):
    """What is wrong with each name under the policy OneScript: kind, position and length."""
    found = findings.findings(names(spark, sf_dir).select("id", "name"), "name", unicode(spark))
    return found.select("id", "finding_no", F.concat("kind", F.lit("@"), "position", F.lit("+"), "length").alias("finding"))


_MESSAGES = f"""CASE kind WHEN 2 THEN '''{_ARABIC_ONE}'' (U+0661, Arabic) at position 18 is a digit 1 from a different number system than the ''0'' digits before it' WHEN 3 THEN 'An invisible character (U+200D, Inherited) at position 4'
  WHEN 4 THEN '''#'' (U+0023, Common) at position 8 is not allowed in a name' ELSE '''{_LIGATURE}'' (U+FB01, Latin) at position 0 is a compatibility form of ''fi''' END"""


@query(_with_names(f"SELECT id, {_MESSAGES} AS message FROM n WHERE kind NOT IN (0, 1, 6, 7)"))
def finding_messages(spark, sf_dir):
    """Messages about the names of every kind; under Anything, four kinds have none."""
    return findings.findings(names(spark, sf_dir).select("id", "name"), "name", unicode(spark), "Anything").select("id", "message")


_NOT_ASCII = f"""
SELECT id, k - 1 AS position, printf('''%s'' (U+%04X, %s) at position %d is not ASCII', c, unicode(c), CASE kind WHEN 2 THEN 'Arabic' WHEN 6 THEN 'Latin' ELSE 'Cyrillic' END, k - 1) AS message
FROM (SELECT id, kind, unnest(string_split(name, '')) AS c, unnest(range(1, length(name) + 1)) AS k FROM n WHERE kind IN (1, 2, 6, 7)) WHERE unicode(c) > 127
UNION ALL SELECT id, CASE kind WHEN 2 THEN 18 WHEN 3 THEN 4 WHEN 4 THEN 8 ELSE 0 END, {_MESSAGES} FROM n WHERE kind IN (2, 3, 4, 5)"""


@query(_with_names(f"SELECT id, position::INT AS position, message FROM ({_NOT_ASCII})"))
def not_ascii_messages(spark, sf_dir):
    """Everything that the policy Ascii finds, in names of every kind."""
    return findings.findings(names(spark, sf_dir).select("id", "name"), "name", unicode(spark), "Ascii").select("id", "position", "message")


@query(_with_names("SELECT id, kind = 0 AS ascii, kind IN (0, 6, 7) AS one_script, kind IN (0, 6, 7) AS relaxed, kind IN (0, 1, 6, 7) AS anything FROM n"))
def acceptable_by_policy(spark, sf_dir):
    u = unicode(spark)
    found = names(spark, sf_dir).select("id", u.acceptable_by_policy("name").alias("by"))
    return found.select("id", *(F.col(f"by.{p}").alias(a) for p, a in (("Ascii", "ascii"), ("OneScript", "one_script"), ("Relaxed", "relaxed"), ("Anything", "anything"))))


@query(_with_names("SELECT id, 'taken' AS state FROM n WHERE kind IN (0, 1, 3) UNION ALL SELECT id, 'free' AS state FROM n WHERE kind NOT IN (0, 1, 3)"))
def names_taken_and_free(spark, sf_dir):
    """Names looked up in an index of the plain spellings."""
    u, n = unicode(spark), names(spark, sf_dir)
    index = lookalikes.keyed(n.select("plain"), "plain", u)
    return lookalikes.states(n.select("id", "name"), index, "name", u).select("id", "state")


@query(_with_names("SELECT id, kind IN (0, 1, 3) AS taken FROM n"))
def names_by_semi_and_anti_join(spark, sf_dir):
    u, n = unicode(spark), names(spark, sf_dir)
    index, new = lookalikes.keyed(n.select("plain"), "plain", u), n.select("id", "name")
    return lookalikes.taken(new, index, "name", u).select("id", F.lit(True).alias("taken")).unionByName(lookalikes.free(new, index, "name", u).select("id", F.lit(False).alias("taken")))


@query("SELECT * FROM (VALUES ('Latn,Cyrl', '{Cyrl, Latn}', 2, '{Cyrl}', '{Cyrl, Grek, Latn}', true, false), ('Cyrl', '{Cyrl}', 1, '{Cyrl}', '{Cyrl, Grek}', true, true), ('', '{}', 0, '{}', '{Cyrl, Grek}', false, true)) v(codes, shown, n, common, together, meets, within)")
def script_set_algebra(spark, sf_dir):
    """Sets against {Cyrl, Grek}: intersection, union, overlap and inclusion."""
    s = ScriptSets(tables_of(spark))
    other, rows = s.of("Cyrl", "Grek"), []
    for codes in (("Latn", "Cyrl"), ("Cyrl",), ()):
        a = s.of(*codes)
        rows.append(spark.range(1).select(F.lit(",".join(codes)).alias("codes"), s.to_string(a).alias("shown"), s.count(a).cast("int").alias("n"), s.to_string(s.intersect(a, other)).alias("common"), s.to_string(s.union(a, other)).alias("together"), s.intersects(a, other).alias("meets"), s.is_subset(a, other).alias("within")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT * FROM (VALUES ('Latn', 'Latn'), ('Latin', 'Latn'), ('Old_Italic', 'Ital'), ('Japanese', 'Jpan'), ('Zzzz', 'Zzzz'), ('Xxxx', NULL), ('Undefined', NULL), ('', NULL), ('latin', NULL)) v(given, code)")
def script_codes(spark, sf_dir):
    given = spark.createDataFrame([(x,) for x in ("Latn", "Latin", "Old_Italic", "Japanese", "Zzzz", "Xxxx", "Undefined", "", "latin")], "given string")
    return given.select("given", unicode(spark).parse_script("given").alias("code"))


@query("SELECT * FROM (VALUES (97, 'Latn', 'Latn', 'Latn'), (12540, 'Zyyy', 'Hira Kana', 'Hira Kana Jpan'), (26481, 'Hani', 'Hani', 'Hani Hanb Jpan Kore'), (12363, 'Hira', 'Hira', 'Hira Jpan'), (44032, 'Hang', 'Hang', 'Hang Kore'), (12549, 'Bopo', 'Bopo', 'Bopo Hanb'), (888, 'Zzzz', 'Zzzz', 'Zzzz')) v(cp, script, extensions, augmented)")
def script_properties(spark, sf_dir):
    u = unicode(spark)
    cps = spark.createDataFrame([(x,) for x in (97, 12540, 26481, 12363, 44032, 12549, 888)], "cp int")
    return cps.select("cp", u.script_of("cp").alias("script"), F.array_join(u.extensions_of("cp"), " ").alias("extensions"), F.array_join(u.augmented_of("cp"), " ").alias("augmented"))


@query("SELECT '16.0.0' AS unicode_version, 174 AS scripts, 30 AS recommended, 6355 AS confusables, 961 AS composites")
def unicode_tables(spark, sf_dir):
    """The version of the tables in use (that of Spark's ICU) and the size of some."""
    t = tables_of(spark)
    scripts, confusables, composites = (d(spark, t) for d in (dims.dim_script, dims.dim_confusable, dims.dim_compose))
    counts = scripts.agg(F.count(F.lit(1)).cast("int").alias("scripts"), F.count_if("recommended").cast("int").alias("recommended"))
    counts = counts.crossJoin(confusables.agg(F.count(F.lit(1)).cast("int").alias("confusables"))).crossJoin(composites.agg(F.count(F.lit(1)).cast("int").alias("composites")))
    return counts.select(unicode(spark).version().alias("unicode_version"), "*")


@query(_with_names(f"SELECT id, ({_LEVEL})::INT AS level, CASE WHEN kind IN (1, 2) THEN 2 ELSE 1 END::BIGINT AS findings FROM n WHERE kind BETWEEN 1 AND 5"))
def sql_surface(spark, sf_dir):
    """The registered SQL functions and the table function, from SQL: names with findings."""
    register(spark, unicode(spark))
    names(spark, sf_dir).createOrReplaceTempView("glyphward_names")
    return spark.sql("SELECT n.id, max(restriction_level(n.name)) AS level, count(f.kind) AS findings FROM glyphward_names n, LATERAL name_findings(n.name, 'OneScript') f GROUP BY n.id")


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows, *columns: str) -> str:
    """SELECT of literal rows; strings are quoted, None is NULL, other values are written as they are."""
    cell = lambda v: "NULL" if v is None else _text(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(cell, r))})" for r in rows) + f") v({', '.join(columns)})"


# Texts that exercise normalization: starters, some of them composites, before marks in every order; jamo; compatibility forms.
_STARTERS = ("a", "q", "\u01fa", "\u1ead", "\uac00", "\u1100", "\u304b", "\u0915", "\u0f71", "\u1e9b", "")
_MARKS = ("\u0301", "\u0323", "\u0327", "\u0345", "\u1161", "\u11a8", "\u3099", "\u093c", "\u0f72")
_FORMS = ["".join(x) for x in itertools.product(_STARTERS, _MARKS, _MARKS)] + ["\u1112\u1161\u11ab\u1100\u1173\u11af", "\ud55c\uae00", "\ufb01\uff21\uff11", "\u00b2\u2075\u2163", "\U0001d5c9\U0001d5ba\U0001d5d2", "\ufdfa", "\u2126\u212b", "\U0001d15e\U0001d165", "\u0344", "\u0958\u0f43"]


@query(_values([(i, *(unicodedata.normalize(f, t) for f in ("NFD", "NFC", "NFKD", "NFKC"))) for i, t in enumerate(_FORMS)], "id", "nfd", "nfc", "nfkd", "nfkc"))
def normalization_forms(spark, sf_dir):
    """All four forms of texts with Hangul, reordered marks, blocked composition, exclusions; Python's own forms are the reference."""
    u, rows = unicode(spark), spark.createDataFrame(list(enumerate(_FORMS)), "id int, t string")
    return rows.select("id", u.nfd("t").alias("nfd"), u.nfc("t").alias("nfc"), u.nfkd("t").alias("nfkd"), u.nfkc("t").alias("nfkc"))


# Syllables of many scripts; a customer's name in many scripts is made of three of these.
_SCRIPTS = (("Latn", "abc"), ("Cyrl", "жук"), ("Grek", "γδε"), ("Hani", "東京"), ("Hira", "ひら"), ("Kana", "カナ"), ("Hang", "한글"), ("Deva", "अमत"), ("Arab", "محد"), ("Thai", "กขค"), ("Hebr", "שלם"), ("Armn", "աբգ"), (None, "42"), (None, "_"))
_pick = lambda by: f"CASE CAST(floor(c_custkey / {by}) AS BIGINT) % {len(_SCRIPTS)} " + " ".join(f"WHEN {k} THEN '{x}'" for k, (_, x) in enumerate(_SCRIPTS)) + " END"
MIXES = f"SELECT c_custkey AS id, concat({_pick(1)}, {_pick(len(_SCRIPTS))}, {_pick(3)}) AS name FROM customer"


def mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name: names in up to three scripts for each customer."""
    view = f"customer_{abs(hash(sf_dir))}"
    _table(spark, sf_dir, "customer").select("c_custkey", "c_name").createOrReplaceTempView(view)
    return spark.sql(MIXES.replace("FROM customer", f"FROM {view}"))


# The scripts of a name by DuckDB's own script classes, apart from all tables here.
_HAS = {"latn": "Latin", "cyrl": "Cyrillic", "grek": "Greek", "hani": "Han", "hira": "Hiragana", "kana": "Katakana", "hang": "Hangul", "deva": "Devanagari", "arab": "Arabic", "thai": "Thai", "hebr": "Hebrew", "armn": "Armenian"}
_LONE = "(cyrl + grek + deva + arab + thai + hebr + armn)"
_JAPANESE, _KOREAN = "(hang = 0)", "(hira + kana = 0)"
_IN_SCRIPTS = f"""WITH m AS ({MIXES}), h AS (SELECT *, {", ".join(f"regexp_matches(name, '\\p{{{x}}}')::INT AS {c}" for c, x in _HAS.items())}, NOT regexp_matches(name, '[^\\x00-\\x7F]') AS plain FROM m),
s AS (SELECT *, hani + hira + kana + hang AS asian, ({_JAPANESE} OR {_KOREAN}) AS fits FROM h),
r AS (SELECT *, CASE WHEN latn + {_LONE} > 1 OR (latn + {_LONE} = 1 AND asian > 0) OR NOT fits THEN '' WHEN latn + {_LONE} + asian = 0 THEN '*'
  {" ".join(f"WHEN {c} = 1 AND asian = 0 THEN '{c[0].upper() + c[1:]}'" for c in _HAS if c not in ("hani", "hira", "kana", "hang"))}
  WHEN asian = 1 THEN CASE WHEN hani = 1 THEN 'Hani Hanb Jpan Kore' WHEN hira = 1 THEN 'Hira Jpan' WHEN kana = 1 THEN 'Kana Jpan' ELSE 'Hang Kore' END WHEN hang = 0 THEN 'Jpan' ELSE 'Kore' END AS scripts FROM s)
SELECT id, scripts, CASE WHEN plain THEN 1 WHEN scripts <> '' THEN 2 WHEN {_LONE} = 0 AND asian > 0 AND fits THEN 3 WHEN {_LONE} = 1 AND asian = 0 AND cyrl + grek = 0 THEN 4 ELSE 5 END::INT AS level FROM r"""


@query(_IN_SCRIPTS)
def names_in_many_scripts(spark, sf_dir):
    """Resolved scripts (* for all) and levels of names in up to three scripts."""
    u = unicode(spark)
    found = mixes(spark, sf_dir).select("id", u.resolved_scripts("name").alias("codes"), u.restriction_level("name").alias("level"))
    return found.select("id", F.when(F.size("codes") > 100, "*").otherwise(F.array_join("codes", " ")).alias("scripts"), "level")


@query(_IN_SCRIPTS)
def names_in_many_scripts_relational(spark, sf_dir):
    """The same by code point rows, joins and one aggregation."""
    t = tables_of(spark)
    sets = ScriptSets(t)
    p = codepoints.profile_of(mixes(spark, sf_dir), "id", "name", t)
    return p.select("id", F.when(sets.is_all(F.col("resolved")), "*").otherwise(F.array_join(sets.codes(F.col("resolved")), " ")).alias("scripts"), F.col("level").cast("int").alias("level"))


# Letters that a name in another script ends with: character, script, what it looks like.
_GUESTS = (("x", "Latin", None), ("а", "Cyrillic", "a"), ("ж", "Cyrillic", None), ("ο", "Greek", "o"), ("γ", "Greek", "y"))
_HOSTS = (("brunt", "Latin"), ("бгджз", "Cyrillic"), ("δζθλξ", "Greek"))
GUESTS = f"""SELECT c_custkey AS id, CASE c_custkey % 3 {" ".join(f"WHEN {k} THEN '{x}'" for k, (x, _) in enumerate(_HOSTS))} END AS host,
  CASE CAST(floor(c_custkey / 3) AS BIGINT) % 5 {" ".join(f"WHEN {k} THEN '{x}'" for k, (x, _, _) in enumerate(_GUESTS))} END AS g1,
  CASE CAST(floor(c_custkey / 15) AS BIGINT) % 5 {" ".join(f"WHEN {k} THEN '{x}'" for k, (x, _, _) in enumerate(_GUESTS))} END AS g2 FROM customer"""


@query(f"""WITH g AS ({GUESTS}), host AS ({_values(_HOSTS, "host", "main")}), guest AS ({_values(_GUESTS, "c", "script", "alike")}),
p AS (SELECT id, host, g1 AS c, 5 AS position FROM g UNION ALL SELECT id, host, g2, 6 FROM g)
SELECT id, position::INT AS position, printf('''%s'' (U+%04X, %s) at position %d is %s among %s letters', c, unicode(c), script, position, script, main) || CASE WHEN alike IS NULL THEN '' ELSE ' and looks like ''' || alike || '''' END AS message
FROM p JOIN host USING (host) JOIN guest USING (c) WHERE script <> main""")
def mixed_script_messages(spark, sf_dir):
    """Letters among those of another script, with what they look like."""
    view = f"customer_{abs(hash(sf_dir))}"
    _table(spark, sf_dir, "customer").select("c_custkey", "c_name").createOrReplaceTempView(view)
    rows = spark.sql(GUESTS.replace("FROM customer", f"FROM {view}")).select("id", F.concat("host", "g1", "g2").alias("name"))
    return findings.findings(rows, "name", unicode(spark)).select("id", "position", "message")


# Names on the edges of the rules (ties in the vote, a vote for Common, the whole name as one finding, digits of several systems, astral characters), and what is found.
_EDGES = (
    ("яﬁ", "OneScript", 0, 2, "The name mixes Cyrillic, Latin, which the OneScript policy does not allow"),
    ("яﬁ", "OneScript", 1, 1, "'ﬁ' (U+FB01, Latin) at position 1 is a compatibility form of 'fi'"),
    ("яーー", "OneScript", 0, 1, "'я' (U+044F, Cyrillic) at position 0 is Cyrillic among Common letters"),
    ("яーー", "OneScript", 1, 1, "'ー' (U+30FC, Common) at position 1 is Common among Common letters"),
    ("яーー", "OneScript", 2, 1, "'ー' (U+30FC, Common) at position 2 is Common among Common letters"),
    ("東京ひя", "OneScript", 2, 1, "'ひ' (U+3072, Hiragana) at position 2 is Hiragana among Han letters"),
    ("東京ひя", "OneScript", 3, 1, "'я' (U+044F, Cyrillic) at position 3 is Cyrillic among Han letters"),
    ("k\U0001d5c9☃", "Anything", 1, 2, "'\U0001d5c9' (U+1D5C9, Common) at position 1 is a compatibility form of 'p'"),
    ("k\U0001d5c9☃", "Anything", 3, 1, "'☃' (U+2603, Common) at position 3 is not allowed in a name"),
    ("１٢3", "Anything", 0, 1, "'１' (U+FF11, Common) at position 0 is a compatibility form of '1'"),
    ("１٢3", "Anything", 1, 1, "'٢' (U+0662, Arabic) at position 1 is a digit 2 from a different number system than the '０' digits before it"),
    ("１٢3", "Anything", 2, 1, "'3' (U+0033, Common) at position 2 is a digit 3 from a different number system than the '０' digits before it"),
    ("rivéτ", "Ascii", 3, 1, "'é' (U+00E9, Latin) at position 3 is not ASCII"),
    ("rivéτ", "Ascii", 4, 1, "'τ' (U+03C4, Greek) at position 4 is not ASCII"),
)


@query(_values(_EDGES, "name", "policy", "position", "length", "message"))
def findings_on_edges(spark, sf_dir):
    out = None
    for policy in sorted({e[1] for e in _EDGES}):
        rows = spark.createDataFrame([(n,) for n in sorted({e[0] for e in _EDGES if e[1] == policy})], "name string")
        some = findings.findings(rows, "name", unicode(spark), policy).select("name", F.lit(policy).alias("policy"), "position", "length", "message")
        out = some if out is None else out.unionByName(some)
    return out


_NAMED = (("Latn", "Latin"), ("Ital", "Old_Italic"), ("Hanb", "Han_With_Bopomofo"), ("Zzzz", "Unknown"), ("Zinh", "Inherited"), ("Nkoo", "Nko"))


@query(_values(_NAMED, "code", "name"))
def script_names(spark, sf_dir):
    """Names of scripts given by code, and codes given by name."""
    u = unicode(spark)
    return spark.createDataFrame([(u.script_code(n), u.script_name(c)) for c, n in _NAMED], "code string, name string")


_ASKED = (("script", "Latin", True), ("script", "Undefined", False), ("script", "", False), ("code point", "0", True), ("code point", "1114111", True), ("code point", "1114112", False), ("code point", "-1", False), ("level", "6", True), ("level", "7", False), ("policy", "Relaxed", True), ("policy", "Strict", False), ("profile", "128512", True), ("profile", "-5", False))


@query(_values(_ASKED, "kind", "given", "accepted"))
def validation(spark, sf_dir):
    """Constants that are checked where a plan is built."""
    u = unicode(spark)
    checks = {"script": u.script_code, "code point": lambda x: valid_code_point(int(x)), "level": lambda x: permitted_level(int(x)), "policy": known_policy, "profile": lambda x: u.restriction_level(F.lit("a"), [int(x)])}
    rows = []
    for kind, given, _ in _ASKED:
        try:
            checks[kind](given)
            rows.append((kind, given, True))
        except ValueError:
            rows.append((kind, given, False))
    return spark.createDataFrame(rows, "kind string, given string, accepted boolean")


@query(_values([("Latn,Cyrl", True, "{Cyrl, Grek, Latn}", False, False, True, True), ("Cyrl", False, "{Cyrl, Grek}", False, False, False, False), ("", False, "{Grek}", False, True, False, False), ("*", True, "ALL", True, False, False, False)], "codes", "has_latin", "with_greek", "everything", "nothing", "same", "same_hash"))
def script_set_members(spark, sf_dir):
    """Members, additions, the set of all, equality and hashes; same tells whether a set is that of Cyrillic and Latin."""
    s = ScriptSets(tables_of(spark))
    sets, other, rows = (("Latn,Cyrl", s.of("Latn", "Cyrl")), ("Cyrl", s.of("Cyrl")), ("", s.empty()), ("*", s.all())), s.add(s.of("Cyrl"), "Latn"), None
    for codes, a in sets:
        row = spark.range(1).select(
            F.lit(codes).alias("codes"), s.contains(a, "Latn").alias("has_latin"), s.to_string(s.add(a, "Grek")).alias("with_greek"), s.is_all(a).alias("everything"), s.is_empty(a).alias("nothing"),
            s.equal(a, other).alias("same"), (s.hash_of(a) == s.hash_of(other)).alias("same_hash"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


# Data files


def _lines(spark: SparkSession, lines) -> DataFrame:
    return spark.createDataFrame([(x,) for x in lines], "value string")


_SAMPLE = ("# Sample-16.0.0.txt", "", "0041..005A ; Alpha ; first # L& [26]", "00AA         ; Beta\t;second  # comment ; not a field", "# only a comment", "1F600..1F64F;Gamma", "E000 ; 0061 0301 ; MA")


@query(_values([(65, 90, "Alpha", "first"), (170, 170, "Beta", "second"), (128512, 128591, "Gamma", None), (57344, 57344, "0061 0301", "MA")], "first", "last", "value", "more"))
def data_file_fields(spark, sf_dir):
    """Ranges and fields of a data file's lines."""
    rows = ucd.ranges(_lines(spark, _SAMPLE))
    return rows.select("first", "last", F.get("f", F.lit(0)).alias("value"), F.get("f", F.lit(1)).alias("more"))


@query(_values([("0041", 65, "65"), (" 10FFFF ", 1114111, "1114111"), ("0061 0301", -1, "97 769"), ("1F468  200D 1F469", -1, "128104 8205 128105"), ("", -1, "")], "given", "one", "list"))
def data_file_numbers(spark, sf_dir):
    """Hexadecimal code points, single (-1 where it isn't one) and in lists."""
    given = spark.createDataFrame([("0041",), (" 10FFFF ",), ("0061 0301",), ("1F468  200D 1F469",), ("",)], "given string")
    one = F.when(F.trim("given").rlike("^[0-9A-F]+$"), ucd.parse_hex(F.col("given"))).otherwise(-1)
    return given.select("given", one.alias("one"), F.array_join(ucd.parse_hex_list(F.col("given")).cast("array<string>"), " ").alias("list"))


@query(_values([("by name", "16.0.0"), ("by line", "17.1.2"), ("none", None)], "header", "version"))
def data_file_versions(spark, sf_dir):
    heads = {"by name": ["# Scripts-16.0.0.txt", "# Date"], "by line": ["# confusables.txt", "# Version: 17.1.2"], "none": ["0041 ; Latin"]}
    return spark.createDataFrame([(n, ucd.version_of(_lines(spark, x))) for n, x in heads.items()], "header string, version string")


_SIZES = (("script_names", 174), ("scripts", 1708), ("extensions", 670), ("types", 2415), ("ignorable", 4174), ("nfd", 2081), ("nfkd", 3848), ("pairs", 961), ("ccc", 934), ("zeros", 760), ("confusables", 6355))


@query(_values([(n, k, True) for n, k in _SIZES], "property", "entries", "same"))
def data_files_round_trip(spark, sf_dir):
    """All tables, written as the lines of data files, read and checked again."""
    t = tables_of(spark)
    files = ucd.lines_of(t)
    again = ucd.load_lines(lambda name: _lines(spark, files[name]))
    parts = lambda x: {"scripts": list(x.script.ranges()), "types": list(x.types.ranges())} | {n: getattr(x, n) for n, _ in _SIZES if n not in ("scripts", "types")}
    one, other = parts(t), parts(again)
    return spark.createDataFrame([(n, len(other[n]), one[n] == other[n]) for n, _ in _SIZES], "property string, entries int, same boolean")


def _broken() -> dict[str, tuple[str, list[str]]]:
    return {
        "prototype given twice": ("confusables", ["# confusables-16.0.0.txt", "0430 ; 0061 ; MA", "0430 ; 0062 ; MA"]),
        "status left out within a run": ("IdentifierStatus", ["# IdentifierStatus-16.0.0.txt", "0030..0038 ; Allowed"]),
        "another version": ("ScriptExtensions", ["# ScriptExtensions-15.0.0.txt"]),
        "ranges that overlap": ("Scripts", ["# Scripts-16.0.0.txt", "0041..0050 ; Latin", "0045 ; Greek"]),
        "pair composed twice": ("UnicodeData", ["00C0;A;Lu;0;L;0041 0300;;;;N;;;;;", "00C1;B;Lu;0;L;0041 0300;;;;N;;;;;"]),
    }


@query(_values([("as it is", True), *((n, False) for n in _broken())], "files", "accepted"))
def data_file_integrity(spark, sf_dir):
    """What the reader of data files refuses."""
    files, rows = ucd.lines_of(tables_of(spark)), []
    for name, (file, lines) in {"as it is": ("confusables", files["confusables"]), **_broken()}.items():
        changed = files | {file: lines}
        try:
            ucd.load_lines(lambda n, changed=changed: _lines(spark, changed[n]))
            rows.append((name, True))
        except ValueError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "files string, accepted boolean")


@query("SELECT v AS value, min(cp)::INT AS first, max(cp)::INT AS last FROM (SELECT p_partkey AS cp, p_size AS v, p_partkey - row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS g FROM part) GROUP BY v, g")
def runs_of_equal_values(spark, sf_dir):
    """Run-length encoding, over parts by size."""
    return ucd.run_length_encode(_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("cp"), F.col("p_size").alias("value"))).select("value", "first", "last")


# Sinks and streams


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below the cluster's checkpoint folder, or on this machine where it is one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or tempfile.gettempdir()}/glyphward-{name}-{uuid.uuid4().hex}"


@query(_values([("dim_script", 174), ("dim_confusable", 6355), ("dim_compose", 961), ("meta", 1)], "name", "entries"))
def dimension_tables_written(spark, sf_dir):
    """The dimension tables as Parquet, read again."""
    folder = _scratch(spark, "dims")
    dims.write_dims(spark, folder, tables_of(spark))
    rows = None
    for name in ("dim_script", "dim_confusable", "dim_compose", "meta"):
        one = spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).cast("int").alias("entries")).select(F.lit(name).alias("name"), "entries")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(_with_names("SELECT id, kind IN (0, 1, 3) AS taken FROM n"))
def names_in_a_written_index(spark, sf_dir):
    """Names looked up in an index that was written as Parquet, partitioned by Unicode version."""
    u, n, folder = unicode(spark), names(spark, sf_dir), _scratch(spark, "index")
    lookalikes.write_index(n.select("plain"), "plain", folder, u)
    return lookalikes.states(n.select("id", "name"), spark.read.parquet(folder), "name", u).select("id", (F.col("state") == "taken").alias("taken"))


_EVENT_NAME = f"CASE user_id % 3 WHEN 0 THEN event_type WHEN 1 THEN replace(event_type, 'e', '{_CYRILLIC_E}') ELSE concat(event_type, '#') END"
_BAD_EVENT = "(user_id % 3 = 2 OR (user_id % 3 = 1 AND event_type LIKE '%e%'))"


def _event_names(events: DataFrame) -> DataFrame:
    return events.select("user_id", F.col("ts").cast("timestamp").alias("at"), F.expr(_EVENT_NAME).alias("name"))


def _streamed(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """What a stream of the events gives once all of them have come."""
    path, name = f"{sf_dir}/events.parquet", f"glyphward_{uuid.uuid4().hex}"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern may name a file or a folder
    running = make(_event_names(events)).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _scratch(spark, "stream")).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)


def _as_seconds(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


@query(f"SELECT epoch(time_bucket(INTERVAL '6 hours', ts))::BIGINT AS start, epoch(time_bucket(INTERVAL '6 hours', ts))::BIGINT + 21600 AS \"end\", count(*) AS names, count(*) FILTER ({_BAD_EVENT}) AS unacceptable FROM events GROUP BY 1, 2")
def stream_in_tumbling_windows(spark, sf_dir):
    return _as_seconds(_streamed(spark, sf_dir, lambda s: streams.unacceptable_by_window(s, "name", "at", "6 hours", "1 day", unicode(spark))))


@query(f"SELECT b - o AS start, b - o + 43200 AS \"end\", count(*) AS names, count(*) FILTER ({_BAD_EVENT}) AS unacceptable FROM (SELECT *, epoch(time_bucket(INTERVAL '6 hours', ts))::BIGINT AS b FROM events), (SELECT unnest([0, 21600]) AS o) GROUP BY 1, 2")
def stream_in_sliding_windows(spark, sf_dir):
    return _as_seconds(_streamed(spark, sf_dir, lambda s: streams.unacceptable_by_window(s, "name", "at", "12 hours", "1 day", unicode(spark), slide="6 hours")))


@query(f"""WITH e AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 43200000000)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, epoch_us(min(ts)) // 1000000 AS start, (epoch_us(max(ts)) + 43200000000) // 1000000 AS "end", count(*) AS names, count(*) FILTER ({_BAD_EVENT}) AS unacceptable FROM g GROUP BY user_id, session""")
def stream_in_sessions(spark, sf_dir):
    return _as_seconds(_streamed(spark, sf_dir, lambda s: streams.unacceptable_by_session(s, "user_id", "name", "at", "12 hours", "1 day", unicode(spark))))


@query(f"SELECT count(*) AS names, count(*) FILTER ({_BAD_EVENT}) AS unacceptable FROM events")
def stream_inspected(spark, sf_dir):
    """Every event's name inspected as it comes."""
    u = unicode(spark)
    return _streamed(spark, sf_dir, lambda s: streams.inspected_stream(s, "name", u).agg(F.count(F.lit(1)).alias("names"), F.count_if(~F.col("acceptable")).alias("unacceptable")))
