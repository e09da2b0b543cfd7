"""Tables from a directory of Unicode data files, read by Spark so that any store will do.

With the files of a newer Unicode version than Spark's ICU has, every function follows that version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..unicode_tables import TYPE_BIT, Runs, UnicodeTables

FILES = ("UnicodeData", "Scripts", "ScriptExtensions", "PropertyValueAliases", "IdentifierType", "IdentifierStatus", "DerivedCoreProperties", "DerivedNormalizationProps", "confusables")


def parse_hex(c: Column) -> Column:
    return F.conv(F.trim(c), 16, 10).cast("int")


def parse_hex_list(c: Column) -> Column:
    """Code points separated by spaces, as an array of int."""
    return F.transform(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))


def fields(lines: DataFrame) -> DataFrame:
    """f, the fields of lines (column value): comments cut off, split at semicolons, trimmed; empty lines left out."""
    line = F.trim(F.regexp_replace(F.col("value"), "#.*$", ""))
    return lines.select(line.alias("line")).where("line <> ''").select(F.transform(F.split("line", ";"), lambda x: F.trim(F.regexp_replace(x, "\t", " "))).alias("f"))


def ranges(lines: DataFrame) -> DataFrame:
    """first, last, f: lines that begin with a code point or a range of them, and the fields after it."""
    ends = F.split(F.col("f")[0], r"\.\.")
    return fields(lines).select(parse_hex(ends[0]).alias("first"), parse_hex(F.coalesce(F.get(ends, F.lit(1)), ends[0])).alias("last"), F.slice("f", 2, 100).alias("f"))


def version_of(lines: DataFrame) -> str | None:
    """The version in a file's header, from its name (`# Scripts-17.0.0.txt`) or a version line."""
    found = lines.limit(30).select(F.regexp_extract("value", r"^# *(?:\w+-|Version: *)(\d+\.\d+\.\d+)", 1).alias("v")).where("v <> ''").first()
    return found["v"] if found else None


def run_length_encode(points: DataFrame) -> DataFrame:
    """first, last, value from (cp, value): maximal runs of neighbours with equal values, as gaps and islands."""
    by_value = Window.partitionBy("value").orderBy("cp")
    island = points.withColumn("island", F.col("cp") - F.row_number().over(by_value))
    return island.groupBy("value", "island").agg(F.min("cp").alias("first"), F.max("cp").alias("last")).select("first", "last", "value")


def load(spark: SparkSession, directory: str) -> UnicodeTables:
    """The tables of a directory; ValueError where files disagree in version or break what the tables promise."""
    return load_lines(lambda name: spark.read.text(f"{directory}/{name}.txt"))


def load_lines(lines: Callable[[str], DataFrame]) -> UnicodeTables:
    """The tables of files given by their lines: the name of a file, without its ending, to a DataFrame (value)."""
    versions = {n: version_of(lines(n)) for n in FILES if n != "UnicodeData"}
    if len(set(filter(None, versions.values()))) != 1:
        raise ValueError(f"files of different versions: {versions}")
    rows = lambda name: [(r["first"], r["last"], list(r["f"])) for r in ranges(lines(name)).collect()]
    aliases = {f[1]: f[2] for f in (list(r["f"]) for r in fields(lines("PropertyValueAliases")).collect()) if f[0] == "sc"}
    codes = {n: c for c, n in aliases.items()}
    script = Runs([(a, b, codes[f[0]]) for a, b, f in rows("Scripts")], "Zzzz")
    used = {v for _, _, v in script.ranges()}
    extensions = {cp: frozenset(f[0].split()) for a, b, f in rows("ScriptExtensions") for cp in range(a, b + 1)}
    by_name = {n.lower(): bit for n, bit in TYPE_BIT.items()}
    types = Runs([(a, b, sum(by_name[t.lower()] for t in f[0].split())) for a, b, f in rows("IdentifierType")], TYPE_BIT["Not_Character"])
    having = lambda name, value: {cp for a, b, f in rows(name) if f[0] == value for cp in range(a, b + 1)}
    ignorable = frozenset(having("DerivedCoreProperties", "Default_Ignorable_Code_Point"))
    ccc, zeros, nfd, nfkd, pairs = characters(lines("UnicodeData"), having("DerivedNormalizationProps", "Full_Composition_Exclusion"))
    tables = UnicodeTables(next(filter(None, versions.values())), {c: n for c, n in aliases.items() if c in used}, script, extensions, types, ignorable, nfd, nfkd, pairs, ccc, zeros, prototypes(lines("confusables")))
    listed = having("IdentifierStatus", "Allowed")
    typed = {cp for a, b, _ in types.ranges() if tables.allowed(a) for cp in range(a, b + 1)}
    if listed != typed:
        raise ValueError(f"identifier status and type disagree on U+{min(listed ^ typed):04X}")
    return tables


def characters(lines: DataFrame, excluded: set[int]):
    """ccc, zeros, nfd, nfkd, pairs from UnicodeData's lines and the code points that no composition makes."""
    ccc, raw, folded, zeros = {}, {}, {}, {}
    for r in lines.where("value <> ''").select(F.split("value", ";").alias("f")).collect():
        f = r["f"]
        cp = int(f[0], 16)
        if int(f[3]):
            ccc[cp] = int(f[3])
        if f[2] == "Nd":
            zeros[cp] = cp - int(f[6])
        if f[5]:
            parts = f[5].split()
            (folded if parts[0].startswith("<") else raw)[cp] = [int(x, 16) for x in parts if not x.startswith("<")]

    def full(cp: int, compatibility: bool) -> str:
        parts = raw.get(cp) or (folded.get(cp) if compatibility else None)
        return "".join(full(x, compatibility) for x in parts) if parts else chr(cp)

    nfd = {cp: full(cp, False) for cp in raw}
    nfkd = {cp: s for cp in {*raw, *folded} if (s := full(cp, True)) != nfd.get(cp)}
    pairs = {}
    for cp, parts in raw.items():
        if len(parts) == 2 and cp not in excluded:
            if tuple(parts) in pairs:
                raise ValueError(f"two composites of one pair: U+{cp:04X}")
            pairs[tuple(parts)] = cp
    return ccc, zeros, nfd, nfkd, pairs


def prototypes(lines: DataFrame) -> dict[int, str]:
    out: dict[int, str] = {}
    for r in fields(lines).select(parse_hex(F.col("f")[0]).alias("cp"), parse_hex_list(F.col("f")[1]).alias("to")).where("cp IS NOT NULL").collect():
        if r["cp"] in out:
            raise ValueError(f"two prototypes of U+{r['cp']:04X}")
        out[r["cp"]] = "".join(map(chr, r["to"]))
    return out


def lines_of(t: UnicodeTables) -> dict[str, list[str]]:
    """The data files that hold a table set, line by line; load_lines() gives the same tables."""
    span = lambda a, b: f"{a:04X}" if a == b else f"{a:04X}..{b:04X}"
    spell = lambda s: " ".join(f"{ord(c):04X}" for c in s)
    composed = {cp: chr(a) + chr(b) for (a, b), cp in t.pairs.items()}
    characters = []
    for cp in sorted({*t.ccc, *t.zeros, *t.nfd, *t.nfkd}):
        digit = str(cp - t.zeros[cp]) if cp in t.zeros else ""
        mapping = spell(composed.get(cp, t.nfd[cp])) if cp in t.nfd else f"<compat> {spell(t.nfkd[cp])}" if cp in t.nfkd else ""
        characters.append(f"{cp:04X};NAME;{'Nd' if digit else 'So'};{t.ccc.get(cp, 0)};L;{mapping};{digit};{digit};{digit};N;;;;;")
    admitted = [(a, b) for a, b, _ in t.types.ranges() if t.allowed(a)]
    found = {
        "Scripts": [f"{span(a, b)} ; {t.script_names[c]}" for a, b, c in t.script.ranges() if c != "Zzzz"],
        "ScriptExtensions": [f"{cp:04X} ; {' '.join(sorted(codes))}" for cp, codes in sorted(t.extensions.items())],
        "PropertyValueAliases": [f"sc ; {c} ; {n}" for c, n in t.script_names.items()],
        "IdentifierType": [f"{span(a, b)} ; {' '.join(t.type_names(mask))}" for a, b, mask in t.types.ranges() if mask != TYPE_BIT["Not_Character"]],
        "IdentifierStatus": [f"{span(a, b)} ; Allowed" for a, b in admitted],
        "DerivedCoreProperties": [f"{cp:04X} ; Default_Ignorable_Code_Point" for cp in sorted(t.ignorable)],
        "DerivedNormalizationProps": [f"{cp:04X} ; Full_Composition_Exclusion" for cp in sorted(set(t.nfd) - set(composed))],
        "confusables": [f"{cp:04X} ;\t{spell(to)} ;\tMA" for cp, to in sorted(t.confusables.items())],
    }
    return {"UnicodeData": characters} | {n: [f"# {n}-{t.version}.txt", *x] for n, x in found.items()}
