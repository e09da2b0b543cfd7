import random

import numpy as np
import xxhash
from glyphward.llm import golay, simhash_dedup
from glyphward.llm.components import connected_components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    groups = {}
    for x, (i, _) in enumerate(fps):
        groups.setdefault(find(x), []).append(i)
    return sorted(((i, f"{fp:016x}", min((j for j in groups[find(x)] if j is not None), default=None)) for x, (i, fp) in enumerate(fps)), key=repr)


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randint(0, 40))
    texts = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(60)]
    for _ in range(140):
        w = rng.choice(texts).split()
        if w:
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += ["", None, "  \t", "One", "one", "ONE two", "É é É", "x" * 50_000, " ".join(["a"] * 20_000), texts[0], texts[0]]
    return [*enumerate(texts), (None, texts[3]), (0, texts[0]), (None, "lone words of no id at all")]


def test_against_brute_force(spark, docs):
    rows = corpus()
    out = simhash_dedup.near_duplicates(docs(rows))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain_components(rows)
    assert len({r[2] for r in plain_components(rows)}) < len(rows) - 10


def test_chunks_give_the_same(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CHUNK", 3)
    rows = corpus()
    assert sorted((tuple(r) for r in simhash_dedup.near_duplicates(docs(rows)).collect()), key=repr) == plain_components(rows)


def test_one_of_each_group_stays(spark, docs):
    rows = [*corpus(), (3, "another text of an id that repeats, unlike its first one"), (3, "another text of an id that repeats, unlike its first one"), (None, "lone words of no id at all"), (None, "LONE words of no id at all")]
    kept = [(r["doc_id"], r["text"]) for r in simhash_dedup.keep_one(docs(rows)).collect()]
    labels = [(i, plain_fingerprint(t), t) for i, t in rows]
    root = list(range(len(labels)))
    changed = True
    while changed:
        changed = False
        for a in range(len(labels)):
            for b in range(len(labels)):
                if root[b] < root[a] and (labels[a][1] ^ labels[b][1]).bit_count() <= 2:
                    root[a], changed = root[b], True
    signed = lambda fp: fp - (1 << 64) if fp >> 63 else fp
    best = {}
    for x, (i, fp, t) in enumerate(labels):
        key = (i is None, i or 0, signed(fp), t is not None, t or "")
        if root[x] not in best or key < best[root[x]][0]:
            best[root[x]] = (key, (i, t))
    assert sorted(kept, key=repr) == sorted((r for _, r in best.values()), key=repr)
    assert simhash_dedup.keep_one(docs([])).collect() == []


def test_finer_keys_keep_all_links(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    rows = []
    for n, (shift, bits) in enumerate(simhash_dedup.SEGMENTS):
        for _ in range(200):
            fp = int(rng.integers(0, 1 << 64, dtype=np.uint64))
            other = fp
            for b in rng.choice([b for b in range(64) if not shift <= b < shift + bits], 2, replace=False):
                other ^= 1 << int(b)
            rows.append([n << 34 | 5, *(int(np.uint64(x).view(np.int64)) for x in (fp, other))])
    df = spark.createDataFrame(rows, "key long, a long, b long")
    shared = F.arrays_overlap(simhash_dedup._finer(F.col("key"), F.col("a")), simhash_dedup._finer(F.col("key"), F.col("b")))
    assert df.where(~shared).count() == 0


def test_empty_table(spark, docs):
    assert simhash_dedup.near_duplicates(docs([])).collect() == []


def test_golay_words_within_two_bits_share_an_index():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 500)
    codes, held = golay.nearby(words)
    assert set(held.sum(axis=1)) <= {1, 6}
    for flips in (1, 2):
        other = words.copy()
        for i in range(len(other)):
            for b in rng.choice(23, flips, replace=False):
                other[i] ^= 1 << int(b)
        codes2, held2 = golay.nearby(other)
        assert all(set(codes[i][held[i]]) & set(codes2[i][held2[i]]) for i in range(len(words)))


def test_components_of_a_path_a_star_and_loops(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 200)] + [(7, 7), (300, None), (40, 0), (40, 0)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 200)}
