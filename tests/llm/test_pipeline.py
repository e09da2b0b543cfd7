"""The pipeline's stages on a small corpus, against what plain Python says of each stage's own input."""

import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from glyphward.llm import simhash_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(11)
    stems = {"aa": "lor ipsu dol sita amet conse".split(), "bb": "zwei drein vierz funf sechs sieb".split()}
    rows = []
    passage = " ".join(rng.choice(stems["aa"]) + rng.choice(stems["aa"]) for _ in range(50))
    for i in range(150):
        lang = rng.choice("ab") * 2
        text = " ".join(rng.choice(stems[lang]) + rng.choice(stems[lang]) + rng.choice(stems[lang]) for _ in range(rng.randint(10, 90)))
        if lang == "aa" and i % 5 == 0:
            text += " " + passage
        rows.append((i, text, lang, rng.choice(["s1", "s2", "s3", None])))
    rows += [(500 + i, rows[i * 3][1], rows[i * 3][2], "s1") for i in range(30)]
    rows += [(600, None, "aa", "s1"), (601, "12345 !!", None, "s2"), (602, "lorlordol ipsusitaamet", None, "s2"), (None, "zweidreinvierz allein", "bb", "s3"), (603, rows[0][1] + " ", "aa", "s1")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written and read again, as the pipeline's contract has it."""
    root = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(root / "documents.parquet"))
    frames = [spark.read.parquet(str(root / "documents.parquet"))]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], str(root)).write.parquet(str(root / str(k)))
        frames.append(spark.read.parquet(str(root / str(k))))
    return str(root), frames


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "substring_dedup", "source_mix", "piece_codec"]
    assert all(f.columns == COLUMNS for f in stages[1][:-1])


def test_language_stage(stages):
    before, after = (stages[1][k].collect() for k in (0, 1))
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {600, 601}
    assert all(r["lang"] in ("aa", "bb") for r in after)


def test_near_duplicate_stage(stages):
    before, after = (stages[1][k].collect() for k in (1, 2))
    prints = [(r["doc_id"], simhash_dedup.fingerprint(r["text"])) for r in before if r["doc_id"] is not None]
    group = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            low = min(group[j] for j, b in prints if (a ^ b).bit_count() <= 2)
            if low < group[i]:
                group[i], changed = low, True
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted(set(group.values()))
    assert [r["text"] for r in after if r["doc_id"] is None] == ["zweidreinvierz allein"]


def test_substring_stage(stages):
    before, after = ({r["doc_id"]: r for r in stages[1][k].collect()} for k in (2, 3))
    assert before.keys() == after.keys()
    first = {}
    key = lambda i: 1 << 62 if i is None else i
    split = {i: r["text"].split() for i, r in before.items()}
    for i, w in split.items():
        for p in range(len(w) - 19):
            t = tuple(w[p : p + 20])
            first[t] = min(first.get(t, (key(i), p)), (key(i), p))
    cut = 0
    for i, w in split.items():
        gone = {q for p in range(len(w) - 19) if first[tuple(w[p : p + 20])] < (key(i), p) for q in range(p, p + 20)}
        cut += bool(gone)
        assert after[i]["text"] == (" ".join(x for q, x in enumerate(w) if q not in gone) if gone else before[i]["text"])
        assert after[i]["n_chars"] == len(after[i]["text"])
    assert cut > 5


def test_mix_stage(stages):
    before, after = (stages[1][k].collect() for k in (3, 4))
    copies, words = Counter(r["doc_id"] for r in after), {r["doc_id"]: len(r["text"].split()) for r in before}
    assert max(copies.values()) <= 3 and copies.keys() <= words.keys()
    assert abs(sum(copies[i] * n for i, n in words.items()) - sum(words.values())) <= 4 * max(words.values())


def test_encoding_stage_and_run(spark, stages):
    root, frames = stages
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = Counter((r["doc_id"], tuple(library.encode(r["text"]))) for r in frames[4].collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in frames[5].collect()) == texts
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, root).collect()) == texts


def test_empty_and_unlabelled_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert got.columns == ["doc_id", "ids", "decoded"] and got.collect() == []
    rows = [(i, f"some words of text number {i} and no more", None, None, 0) for i in range(20)] + [(30, None, None, "a", 0), (None, "12 !", None, "b", 4)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "bare" / "documents.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "bare")).collect()} <= set(range(20))


def test_the_session_keeps_its_settings(spark, stages):
    root, _ = stages
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    corpus_pipeline.run(spark, root).count()
    assert [spark.conf.get(n) for n in names] == before
