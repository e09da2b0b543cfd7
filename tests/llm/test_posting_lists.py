import numpy as np
from glyphward.llm import posting_lists

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, every=50):
    """Every query row against every other row, vectors scaled by powers of two."""
    ok = [(i, posting_lists.scaled_rows(np.array(v, float)[None])[0]) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for at, (i, q) in enumerate(ok):
        if i % every == 0:
            scored = sorted((-(q @ v) / np.linalg.norm(q) / np.linalg.norm(v), j) for n, (j, v) in enumerate(ok) if n != at)
            out.setdefault(i, []).append([(j, -s) for s, j in scored[:k]])
    return out


def run(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema).withColumnRenamed("label", "score")
    got = {}
    for r in posting_lists.nearest(df, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def same(got, expected):
    """Answers of one query row each, in order; of an id that repeats, the same lines in any order."""
    assert got.keys() == expected.keys()
    for q, answers in expected.items():
        want = sorted((n + 1, j, round(s, 12)) for a in answers for n, (j, s) in enumerate(a))
        assert sorted((n, j, round(s, 12)) for n, j, s in got[q]) == want


def test_odd_rows_and_exact_when_all_lists_are_probed(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-9, 10, size=8)], 0) for i in range(400)]
    rows = [r if any(r[1]) else (r[0], [1.0] * 8, 0) for r in rows]
    rows += [(1000 + i, rows[3][1], 0) for i in range(30)] + [(50 * i, rows[100][1], 0) for i in range(50, 60)] + [(50, [9.0] * 8, 0), rows[60], rows[100]]
    rows += [(2000, None, 0), (2050, [], 0), (2100, [0.0] * 8, 0), (2150, [float("nan")] * 8, 0), (2200, [float("inf")] + [1.0] * 7, 0), (None, [1.0] * 8, None), (2250, [None] + [1.0] * 7, 0), (2300, [1.0], 0)]
    same(run(spark, rows, probe_ratio=1e9), brute([r for r in rows if r[0] != 2300]))


def test_tiny_and_huge_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(300)]
    rows += [(300 + 50 * n, [float(x * scale) for x in rng.normal(size=8)], 0) for n, scale in enumerate((1e-200, 1e200, 1e-300, 1e307, 1.0))]
    got = run(spark, rows, "vec_id long, embedding array<double>, label int", probe_ratio=1e9)
    assert len(got) == 11
    same(got, brute(rows))


def test_names_that_fail_to_tell_vectors_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    good = posting_lists._name
    monkeypatch.setattr(posting_lists, "_name", lambda seed: good(seed) if seed else [F.lit(1).cast("long").alias("a"), F.hash("v").cast("long").bitwiseAND(7).alias("b")])
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4)], 0) for i in range(120)]
    same(run(spark, rows, probe_ratio=1e9), brute([(i, np.float32(v).astype(float).tolist(), n) for i, v, n in rows]))


def test_recall(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=64)], 0) for i in range(6000)]
    expected, got = brute(rows), run(spark, rows)
    hits = sum(len({j for j, _ in expected[q][0]} & {j for _, j, _ in got[q]}) for q in expected)
    assert hits >= 0.9 * sum(len(a[0]) for a in expected.values())


def test_few_and_no_rows(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0, 2.0], 0)]) == {}
    assert [j for _, j, _ in run(spark, [(0, [1.0, 0.0], 0), (7, [0.0, 1.0], 0), (3, [1.0, 1.0], 0)])[0]] == [3, 7]


def test_many_centroids_are_fitted_level_by_level():
    rng = np.random.default_rng(9)
    unit = posting_lists.unit_rows(rng.normal(size=(4000, 8)))
    index = posting_lists.fit(unit, 4000, 8)
    assert 400 < len(index.centroids) <= 600 and index.graph.max() < len(index.centroids)
    ids, far = index.search(unit[:200], 12)
    best = index.distances(unit[:200]).min(axis=1)
    assert (far[:, 0] <= best + 1e-3).mean() > 0.95
