import hashlib
import random
import re

import numpy as np
from glyphward.llm import recompression, substring_dedup


def plain(rows, window=20):
    """Every window against all earlier starts."""
    docs = [(i if i is not None else 1 << 63, i, [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]) for i, t in rows]
    first = {}
    for key, _, words in docs:
        for p in range(len(words) - window + 1):
            w = tuple(words[p : p + window])
            first[w] = min(first.get(w, (key, p)), (key, p))
    out = []
    for key, i, words in docs:
        gone = set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] < (key, p):
                gone.update(range(p, p + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "日本", "a"]
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared = [some(rng.randint(15, 60)) for _ in range(6)]
    texts = []
    for _ in range(n):
        words = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            words += rng.choice(shared)[rng.randint(0, 8) :] + some(rng.randint(0, 30))
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    texts += ["", None, "   ", " ".join(["a"] * 300), " ".join(["a", "b"] * 200), " ".join(some(30_000)), texts[5], texts[5], texts[9] + " tail"]
    return [*enumerate(texts)]


def digests(df, *args, **options):
    got = substring_dedup.deduplicate(df, *args, digest=True, **options)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_against_brute_force(spark, docs):
    rows = corpus()
    rows += [(None, rows[7][1]), (3, rows[3][1]), (None, " ".join(map(str, range(50)))), (130, rows[5][1]), (130, rows[5][1]), (130, rows[9][1])]
    assert digests(docs(rows)) == plain(rows)


def test_small_chunks_other_windows_and_a_tree(spark, docs):
    rows = corpus(2, 60)
    for window, fan in ((5, 2), (20, 3), (50, 4096)):
        assert digests(docs(rows), window, chunk_bytes=3000, fan=fan) == plain(rows, window)


def test_colliding_hashes_are_found_and_replaced(spark, docs, monkeypatch):
    rows = corpus(4, 50)
    found = []
    real = substring_dedup.differing_runs
    monkeypatch.setattr(substring_dedup, "differing_runs", lambda *args: found.append(real(*args)) or found[-1])
    assert digests(docs(rows), chunk_bytes=4000, word_bits=(1, 2, 64)) == plain(rows)
    assert found[0] > 0 and found[-1] == 0


def test_an_id_with_several_texts_and_rows_that_repeat(spark, docs):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(7, passage), (7, passage), (7, passage), (7, passage + " x"), (7, "y " + passage), (3, passage + " z"), (9, passage)] * 2
    assert digests(docs(rows).repartition(5), chunk_bytes=200) == plain(rows)


def test_columns_with_clashing_names(spark):
    names = ["chunk", "id", "z", "row", "block", "kept", "none", "c0", "to", "n_words", "a.b", "__id"]
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage, *[f"{n}{i}" for n in names]) for i in range(3)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = substring_dedup.deduplicate(df)
    assert got.columns == ["doc_id", "text", *(n for n in names if n != "n_words"), "n_words", "n_removed"]
    for r in got.collect():
        i = r["doc_id"]
        assert r["text"] == (passage if i == 0 else "") and all(r[n] == f"{n}{i}" for n in names if n != "n_words")


def test_long_words_are_digested():
    """Words of 2,048 bytes whose polynomial hashes agree for every odd base, and differ."""
    one, other = b"a", b"b"
    for _ in range(11):
        one, other = one + other, other + one
    data = np.frombuffer(one + b" " + other, np.uint8)
    h, _ = recompression.words_of(data, np.array([0, len(data)]))
    assert h[0] != h[1]


def test_texts_and_columns_stay(spark, docs):
    rows = corpus(3, 40)
    df = docs(rows)
    got = substring_dedup.deduplicate(df)
    assert got.columns == [*df.columns, "n_words", "n_removed"]
    texts = dict(rows)
    for r in got.collect():
        if r["n_removed"]:
            assert len(r["text"].split()) == r["n_words"] - r["n_removed"]
        else:
            assert r["text"] == texts[r["doc_id"]]


def test_empty_table(spark, docs):
    assert substring_dedup.deduplicate(docs([]), digest=True).collect() == []


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    for alphabet in (1, 2, 3, 50, 5000):
        words = recompression.mix(rng.integers(0, alphabet, 4000).astype(np.uint64))
        words[2000:2600] = words[100:700]
        doc = np.repeat(np.arange(40), 100)
        inside, name, start = recompression.anchors(words, doc, 20)
        seen = {}
        for p in np.flatnonzero(inside):
            at = (int(name[p]), int(p - start[p]))
            assert seen.setdefault(words[p : p + 20].tobytes(), at) == at
