import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from glyphward.llm import media_sequences, source_mix
from pyspark.sql import functions as F


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        source = rng.choice(["big"] * 6 + ["s1", "s2", "tiny", "z", None])
        rows.append((i, " ".join(["w"] * int(rng.expovariate(1 / 40))), source))
    return rows + [(2000, None, "s1"), (2001, "", "s2"), (2002, "one two", "lonely"), (2003, "w " * 30_000, "big"), (None, "a b c", "s1"), (5, rows[5][1], rows[5][2]), (2004, None, "empty")]


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while True:
        left, w = total - sum(target.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            open_.discard(s)


def test_mix(spark, docs):
    rows = corpus()
    df = docs(rows, "doc_id long, text string, source string")
    got = source_mix.mix(df).collect()
    again = source_mix.mix(df.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    sizes, source = Counter(), {}
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    target = plain_targets(sizes)
    taken, seen = Counter(), defaultdict(list)
    for i, t, s in rows:
        seen[i, len((t or "").split())].append(s)
    for r in got:
        s = seen[r["doc_id"], r["size"]][0]
        source[s] = r["target"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 * (1 + target[s])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    largest = {s: max(len((t or "").split()) for _, t, x in rows if x == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in sizes)


def test_salted_plan_gives_the_same(spark, docs, monkeypatch):
    df = docs(corpus(2), "doc_id long, text string, source string")
    broadcast = sorted(map(repr, source_mix.mix(df).collect()))
    monkeypatch.setattr(source_mix, "MAX_BROADCAST", 1)
    assert sorted(map(repr, source_mix.mix(df).collect())) == broadcast


def test_mixed_documents(spark, docs):
    rows = corpus(3)
    df = docs(rows, "doc_id long, text string, source string")
    want = {(r["doc_id"], r["size"]): r["taken"] for r in source_mix.mix(df).collect() if r["doc_id"] not in (None, 5)}
    out = source_mix.mixed(df)
    assert out.columns == df.columns
    got = Counter((r["doc_id"], len(r["text"].split())) for r in out.collect())
    assert all(got[i, n] * n == t for (i, n), t in want.items())


def test_inclusion_grows_with_importance(spark, docs):
    """Of documents of 9 and of 900 words (importance 3 and 30) the shares taken are the inclusion probabilities, solved by bisection."""
    rng = random.Random(12)
    sizes = {(s, i): rng.choice([9] * 30 + [900]) for s in "ab" for i in range(3000)}
    rows = [(k, " ".join(["w"] * n), s) for k, ((s, i), n) in enumerate(sizes.items())]
    got = source_mix.mix(docs(rows, "doc_id long, text string, source string")).collect()
    by = {k: s for k, _, s in rows}
    for source in "ab":
        mine = [r for r in got if by[r["doc_id"]] == source]
        whole = int(mine[0]["target"] // mine[0]["source_size"])
        rest = mine[0]["target"] - whole * mine[0]["source_size"]
        low, high = 0.0, 1.0
        for _ in range(60):
            c = (low + high) / 2
            low, high = (c, high) if sum(min(1, c * r["size"] ** 0.5) * r["size"] for r in mine) < rest else (low, c)
        for size in (9, 900):
            some = [r for r in mine if r["size"] == size]
            share = sum(r["taken"] > whole * size for r in some) / len(some)
            assert abs(share - min(1, low * size**0.5)) < (0.03 if size == 9 else 0.08), (source, size, share, low)


def test_sources_are_numbered_over_many_tasks(spark):
    from glyphward.llm.common import numbered

    names = [None, "", "é", "z", "Z", "日本", *(f"s{i}" for i in range(200))]
    random.Random(3).shuffle(names)
    df = spark.createDataFrame([(n,) for n in names], "source string").repartition(6)
    got = {r["source"]: r["at"] for r in numbered(df, F.col("source").asc_nulls_last(), "at").collect()}
    assert got == {n: k for k, n in enumerate(sorted(names, key=lambda n: (n is None, (n or "").encode())))}


def test_a_third_of_rows_without_id(spark, docs):
    rows = [(None, f"some text number {i}", "a") for i in range(300)] + [(i, f"w{i} " * 5, "b") for i in range(600)]
    got = source_mix.mix(docs(rows, "doc_id long, text string, source string")).collect()
    for source, ids in (("a", [None]), ("b", range(600))):
        mine = [r for r in got if (r["doc_id"] is None) == (source == "a")]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 5


def test_mix_of_nothing(spark, docs):
    assert source_mix.mix(docs([], "doc_id long, text string, source string")).collect() == []
    assert source_mix.mix(docs([(1, None, None)], "doc_id long, text string, source string")).first()["taken"] == 0


def test_media_of_documents(spark, docs):
    texts = ["plain", "", None, "<b>&amp; é 漢</p><img src=x>", "x" * 192, "y" * 193, "z" * 200_000, "a\x00b\r\n", "plain", "\u0085 tail  "]
    rows = [*enumerate(texts), (None, "plain"), (0, "plain")]
    got = media_sequences.document_media(docs(rows)).collect()
    assert len(got) == len(rows)
    texts_of = defaultdict(list)
    for i, t in rows:
        texts_of[i].append(t)
    for r in got:
        data = (texts_of[r["doc_id"]][0] or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        stored = b"P5\n192 %d\n255\n" % (len(payload) // 192) + payload
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), sha(stored)) and r["feature"] == media_sequences.features(payload)
    assert media_sequences.document_media(docs([])).collect() == []


def test_segments_keep_order_and_captions():
    page = '<h1>Top</h1><p>a &lt; b</p><figure><img src="sha256:AB"><img src="sha256:cd"><figcaption>both <i>here</i></figcaption></figure>text<img src="sha256:ef" alt="alone"/><img src="http://x/y.png"><script>no</script> end'
    got = [(s["position"], s["kind"], s["text"] or s["digest"], s["caption"]) for s in media_sequences.parse(page)]
    assert got == [(0, "text", "Top", None), (1, "text", "a < b", None), (2, "media", "ab", "both here"), (3, "media", "cd", "both here"), (4, "text", "text", None), (5, "media", "ef", "alone"), (6, "text", " end", None)]
    assert media_sequences.parse(None) == media_sequences.parse("") == []


def test_interleaved_pages_and_their_store(spark):
    a, b = media_sequences.padded(b"first"), media_sequences.padded(b"second")
    digest = lambda x: hashlib.sha256(x).hexdigest()
    pages = spark.createDataFrame([(1, f'x<img src="sha256:{digest(a)}" alt="one">y<img src="sha256:{digest(b)}">'), (2, f'<img src="sha256:{digest(a)}"><img src="sha256:00ff">'), (3, None)], "id int, html string")
    store = media_sequences.media_store(spark.createDataFrame([(a,), (b,), (a,), (None,)], "payload binary"), keep_bytes=True)
    assert store.count() == 2 and all(media_sequences.read_back(bytes(r["stored"])) in (a, b) for r in store.collect())
    refs = media_sequences.resolve(media_sequences.references(media_sequences.sequences(pages, "id", "html")), store)
    got = sorted((r["id"], r["position"], r["caption"], r["payload_sha256"]) for r in refs.select("id", "position", F.coalesce("caption", F.lit("")).alias("caption"), F.coalesce("payload_sha256", F.lit("")).alias("payload_sha256")).collect())
    assert got == [(1, 1, "one", digest(a)), (1, 3, "", digest(b)), (2, 0, "", digest(a)), (2, 1, "", "")]


def test_features_of_all_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 192 * 40, dtype=np.uint8).tobytes()
    text = media_sequences.features(data)
    x = np.frombuffer(data, np.uint8).astype(float)
    assert f"mean={x.mean():.4f};sd={x.std():.4f};step={np.abs(np.diff(x)).mean():.4f}" in text and text.startswith("h=40;")
