"""The functions over whole batches against those of one string."""

import random

import pyarrow as pa
import pytest
from glyphward.functions import batches
from glyphward.functions.kernels import tables_of
from glyphward.functions.text import TextFunctions


@pytest.fixture(scope="module")
def both(spark):
    one = TextFunctions(tables_of(spark))
    return one, batches.BatchFunctions(one)


def texts(seed, n=3000):
    rng = random.Random(seed)
    pool = [*range(0x61, 0x67), 0x30, 0x31, 0x6D, 0x49, 0xE9, 0x301, 0x323, 0x327, 0x345, 0x430, 0x44F, 0x3B1, 0x661, 0x967, 0x30A2, 0x30FC, 0x3042, 0x6771, 0xAC00, 0xAC01, 0x1100, 0x1161, 0x11A8, 0x3105, 0x905, 0x627, 0x200D, 0x34F, 0xFE0F, 0xAD, 0x2603, 0xFB01, 0xFF10, 0xFDFA, 0x1D5C9, 0x10400, 0x20, 0x2D, 0x13A0, 0x378, 0xE000, 0x10FFFF, 0x1D15E, 0xF71, 0xF72, 0x1E9B, 0x212B]
    rows = ["".join(map(chr, (rng.choice(pool) for _ in range(rng.randint(0, 8))))) for _ in range(n)]
    everything = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows += ["".join(rng.choice(everything) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return [None, "", *rows, None, "", "abc", "a" * 5000 + "é" * 5000]


CALLS = {
    "nfd": lambda f, s: f.nfd(s), "nfc": lambda f, s: f.nfc(s), "nfkd": lambda f, s: f.nfkd(s), "nfkc": lambda f, s: f.nfkc(s), "skeleton": lambda f, s: f.skeleton(s), "lookalike_key": lambda f, s: f.lookalike_key(s),
    "resolved_scripts": lambda f, s: f.tables.set_codes(f.resolved(s)), "single_script": lambda f, s: f.single_script(s), "restriction_level": lambda f, s: f.level(s), "number_systems": lambda f, s: f.number_systems(s), "mixed_numbers": lambda f, s: f.mixed_numbers(s),
}


@pytest.mark.parametrize("name", CALLS)
def test_strings(both, name):
    one, whole = both
    rows = texts(1)
    array = pa.array([*rows, "x"]).slice(0, len(rows))
    assert getattr(whole, name)(array).to_pylist() == [None if s is None else CALLS[name](one, s) for s in rows]
    assert getattr(whole, name)(array.slice(7, 20)).to_pylist() == [None if s is None else CALLS[name](one, s) for s in rows[7:27]]
    for few in ([], [None], [""], ["ab", None, "", "b"]):
        assert getattr(whole, name)(pa.array(few, pa.string())).to_pylist() == [None if s is None else CALLS[name](one, s) for s in few]


@pytest.mark.parametrize("policy", ["Ascii", "OneScript", "Relaxed", "Anything"])
def test_inspections(both, policy):
    one, whole = both
    rows = texts(2, 1200)
    found = whole.inspect(pa.array(rows), policy).to_pylist()
    assert found == [None if s is None else one.inspect(s, policy) for s in rows]
    assert whole.acceptable(pa.array(rows), policy).to_pylist() == [x and x["acceptable"] for x in found]
    assert [x and x[policy] for x in whole.acceptable_by_policy(pa.array(rows)).to_pylist()] == [x and x["acceptable"] for x in found]


def test_checks_under_profiles(both):
    one, whole = both
    rows, wide = texts(3, 1200), frozenset(cp for cp in range(0x110000) if cp == 0x303C or cp == 0x2603 or cp < 0x500)
    for permitted, profile in ((3, None), (1, wide), (5, wide)):
        assert whole.check(pa.array(rows), permitted, profile).to_pylist() == [None if s is None else one.check(s, permitted, profile and profile.__contains__) for s in rows]
    assert whole.restriction_level(pa.array(rows), wide).to_pylist() == [None if s is None else one.level(s, wide.__contains__) for s in rows]


def test_script_counts(both):
    one, whole = both
    for s, found in zip(texts(4, 300), whole.script_counts(pa.array(texts(4, 300))).to_pylist(), strict=True):
        counts = {}
        for ch in s or "":
            counts[one.tables.script[ord(ch)]] = counts.get(one.tables.script[ord(ch)], 0) + 1
        assert found is None if s is None else {x["script"]: x["n"] for x in found} == counts


def test_pieces(monkeypatch):
    monkeypatch.setattr(batches, "PIECE", 10)
    rows = ["abc", "é" * 30, None, "", "x" * 4, "y" * 4, "z" * 4]
    parts = list(batches.pieces(pa.array(["head", *rows], pa.large_string()).slice(1)))
    assert [x for p in parts for x in p.to_pylist()] == rows and len(parts) == 4


def test_more_sets_than_a_word_has_bits(both):
    """A batch in which every script occurs."""
    one, whole = both
    every = [chr(a) for a, _, code in one.tables.script.ranges() if code != "Zzzz" and not 0xD800 <= a < 0xE000]
    rows = [*every, "".join(every), None, "", *(x + y for x, y in zip(every, every[1:]))]
    assert len({int(whole.set[ord(c)]) for c in every}) > 64
    wide = frozenset(range(0x110000))
    assert whole.restriction_level(pa.array(rows), wide).to_pylist() == [None if s is None else one.level(s, wide.__contains__) for s in rows]
    assert whole.resolved_scripts(pa.array(rows)).to_pylist() == [None if s is None else one.tables.set_codes(one.resolved(s)) for s in rows]
