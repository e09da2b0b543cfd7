"""Script sets as columns: a struct of four longs, bit i standing for script number i; algebra stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..unicode_tables import UnicodeTables

WORDS = ("w0", "w1", "w2", "w3")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def literal(mask: int) -> Column:
    return F.struct(*(F.lit(_signed(mask >> 64 * k & (1 << 64) - 1)).cast("long").alias(w) for k, w in enumerate(WORDS)))


def _each(call) -> Column:
    return F.struct(*(call(w).alias(w) for w in WORDS))


class ScriptSets:
    """Constants and operations of script sets under one table set."""

    def __init__(self, tables: UnicodeTables):
        self.tables = tables

    def empty(self) -> Column:
        return literal(0)

    def all(self) -> Column:
        return literal(self.tables.all_scripts)

    def recommended(self) -> Column:
        return literal(self.tables.recommended)

    def of(self, *codes: str) -> Column:
        unknown = [c for c in codes if c not in self.tables.script_ix]
        if unknown:
            raise ValueError(f"not scripts: {unknown}")
        return literal(self.tables.mask(codes))

    def is_empty(self, s: Column) -> Column:
        return self.count(s) == 0

    def is_all(self, s: Column) -> Column:
        return s == self.all()

    def equal(self, a: Column, b: Column) -> Column:
        return a == b

    def hash_of(self, s: Column) -> Column:
        """A number that equal sets share."""
        return F.xxhash64(*(s[w] for w in WORDS))

    def count(self, s: Column) -> Column:
        return sum((F.bit_count(s[w]) for w in WORDS[1:]), F.bit_count(s[WORDS[0]]))

    def contains(self, s: Column, code: str) -> Column:
        return ~self.is_empty(self.intersect(s, self.of(code)))

    def add(self, s: Column, code: str) -> Column:
        return self.union(s, self.of(code))

    def remove(self, s: Column, code: str) -> Column:
        return self.minus(s, self.of(code))

    def intersect(self, a: Column, b: Column) -> Column:
        return _each(lambda w: a[w].bitwiseAND(b[w]))

    def union(self, a: Column, b: Column) -> Column:
        return _each(lambda w: a[w].bitwiseOR(b[w]))

    def minus(self, a: Column, b: Column) -> Column:
        return _each(lambda w: a[w].bitwiseAND(F.bitwise_not(b[w])))

    def intersects(self, a: Column, b: Column) -> Column:
        return ~self.is_empty(self.intersect(a, b))

    def is_subset(self, a: Column, b: Column) -> Column:
        return self.is_empty(self.minus(a, b))

    def codes(self, s: Column) -> Column:
        """Codes in script order."""
        known = F.split(F.lit("," + ",".join(self.tables.codes)), ",")
        bit = lambda i: F.getbit(F.element_at(F.array(*(s[w] for w in WORDS)), (F.floor(i / 64) + 1).cast("int")), (i % 64).cast("int")) == 1
        return F.transform(F.filter(F.sequence(F.lit(1), F.lit(len(self.tables.codes))), bit), lambda i: F.element_at(known, (i + 1).cast("int")))

    def to_string(self, s: Column) -> Column:
        """ALL, {} or {Latn, Cyrl}."""
        return F.when(self.is_all(s), "ALL").otherwise(F.concat(F.lit("{"), F.array_join(self.codes(s), ", "), F.lit("}")))

    def intersect_all(self, s: Column) -> Column:
        """Aggregate: what all rows' sets have in common."""
        return _each(lambda w: F.bit_and(s[w]))
