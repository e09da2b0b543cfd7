"""Queries over names read every customer: against the functions of one string, kind by kind."""

import os

import pytest
from glyphward import queries as own

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def named(spark):
    rows = own.names(spark, SF_DIR).collect()
    assert {r["kind"] for r in rows} == set(range(8))
    return rows


def test_names_of_every_kind(spark, named):
    f = own.unicode(spark).functions
    for name in ("skeleton_names", "skeleton_names_relational"):
        got = sorted(tuple(r) for r in own.QUERIES[name](spark, SF_DIR).collect())
        assert got == sorted((r["id"], f.skeleton(r["name"])) for r in named), name
    got = dict(tuple(r) for r in own.QUERIES["custom_profile_levels"](spark, SF_DIR).collect())
    assert {i: level == 1 for i, level in got.items()} == {r["id"]: r["name"].isascii() and r["name"].replace("#", "").isalnum() for r in named}


def test_messages_of_every_kind(spark, named):
    f = own.unicode(spark).functions
    for name, policy in (("finding_messages", "Anything"), ("not_ascii_messages", "Ascii")):
        got = sorted((r["id"], r["message"]) for r in own.QUERIES[name](spark, SF_DIR).collect())
        assert got == sorted((r["id"], x["message"]) for r in named for x in f.inspect(r["name"], policy)["findings"])
    bad = {r["id"] for r in own.QUERIES["acceptable_by_policy"](spark, SF_DIR).collect() if not r["anything"]}
    assert {r["id"] for r in own.QUERIES["finding_messages"](spark, SF_DIR).collect()} == bad


def test_names_in_many_scripts_have_all_levels(spark):
    rows = own.names_in_many_scripts(spark, SF_DIR).collect()
    assert {r["level"] for r in rows} == {1, 2, 3, 4, 5} and {r["scripts"] for r in rows} >= {"", "Arab", "Deva", "Grek", "Jpan"}
