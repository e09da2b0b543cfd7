"""Point queries over all 1,114,112 code points, against the tables."""

import unicodedata

from glyphward import queries as own
from glyphward.functions.kernels import tables_of


def rows(spark, name):
    return own.QUERIES[name](spark, "")


def test_every_code_point(spark):
    t = tables_of(spark)
    got = rows(spark, "prototype_lookup")
    assert got.count() == 0x110000
    assert {r["cp"] for r in got.where("prototype IS NOT NULL").collect()} == set(t.confusables)
    ignorable = {r["cp"] for r in rows(spark, "default_ignorables").where("ignorable").collect()}
    assert {0xAD, 0x200D, 0x2060, 0xFE0F, 0xFEFF, 0xE0001, 0xE0FFF} <= ignorable and not ignorable & set(range(0x21, 0x7F))
    types = rows(spark, "identifier_types")
    assert types.count() == 0x110000 and types.where("allowed <> (id_type <> 0 AND (id_type & ~3072) = 0)").count() == 0
    digits = {r["cp"]: r["value"] for r in rows(spark, "digit_values").collect()}
    known = {c: unicodedata.decimal(chr(c)) for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd"}
    assert known.items() <= digits.items() and all(set(range(c - v, c - v + 10)) <= digits.keys() for c, v in digits.items())
