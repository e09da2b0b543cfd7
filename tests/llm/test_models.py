import math
import random
import zlib

import numpy as np
from glyphward.llm import language_id, toxicity

STEMS = {"aa": "lor ipsu dol sita amet conse".split(), "bb": "zwei drein vierz funf sechs sieb".split(), "cc": "ouai reau elle queo menta tionne".split()}


def words(rng, lang, n):
    return [rng.choice(STEMS[lang]) + rng.choice(STEMS[lang]) for _ in range(n)]


def labelled(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(STEMS))
        rows.append((i, " ".join(words(rng, lang, rng.randint(5, 60))), lang))
    return rows


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def test_language_id_is_accurate_and_total(spark, docs):
    rows = labelled() + [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !!", "aa"), (903, "x" * 30_000, None), (904, " ".join(words(random.Random(2), "bb", 20_000)), None), (None, "lorlor ipsudol", "aa"), (3, "lorlor", "aa"), (905, "漢字仮名漢字", None)]
    df = docs(rows, "doc_id long, text string, lang string")
    got = language_id.identify(df, language_id.train(df)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    held = [(r, lang) for i, _, lang in rows[:240] if (r := by[i])["held_out"]]
    assert len(held) > 30 and sum(r["lang_pred"] == lang for r, lang in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (r["doc_id"] is not None and fold(r["doc_id"]) == 2) for r in got)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (900, 901, 902))
    assert by[904]["lang_pred"] == "bb" and not by[904]["rejected"] and by[905]["lang_pred"] in STEMS and by[905]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_that_are_kept(spark, docs):
    rows = labelled(120) + [(900, None, "aa"), (901, "漢字仮名漢字 漢字", None), (902, "lorlor ipsudol sitaamet", None)]
    df = docs(rows, "doc_id long, text string, lang string")
    kept = language_id.keep_accepted(df, language_id.train(df))
    assert kept.columns == df.columns
    got = {r["doc_id"]: r["lang"] for r in kept.collect()}
    assert got == {i: lang for i, _, lang in rows[:120]} | {902: "aa"}


def test_kneser_ney_against_plain_python():
    """Interpolated Kneser-Ney by dictionaries of strings, for one language."""
    rng = random.Random(4)
    from collections import Counter, defaultdict

    counts = Counter(words(rng, "aa", 60))
    n = language_id.ORDER
    grams = [Counter() for _ in range(n + 1)]
    for w, times in counts.items():
        s = " " * (n - 1) + w + " "
        for i in range(n - 1, len(s)):
            grams[n][s[i - n + 1 : i + 1]] += times
    for k in range(n - 1, 0, -1):
        longer = set()
        for w in counts:
            s = " " * (n - 1) + w + " "
            longer |= {s[i - k : i + 1] for i in range(n - 1, len(s))}
        for g in longer:
            grams[k][g[1:]] += 1
    tables = []
    for k in range(1, n + 1):
        once, twice = sum(c == 1 for c in grams[k].values()), sum(c == 2 for c in grams[k].values())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        total, kinds = defaultdict(float), Counter()
        for g, c in grams[k].items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        tables.append((grams[k], discount, total, kinds))

    def bits(word):
        s, out = " " * (n - 1) + word + " ", 0.0
        for i in range(n - 1, len(s)):
            p = language_id.FLAT
            for k, (g, discount, total, kinds) in enumerate(tables, 1):
                gram = s[i - k + 1 : i + 1]
                context = gram[:-1]
                if context in total:
                    p = max(g[gram] - discount, 0) / total[context] + discount * kinds[context] / total[context] * p
            out -= math.log2(p)
        return out

    model = language_id.Model(["aa"], [language_id.Language.fit(counts)])
    some = ["lorlor", "ipsuamet", "xyz", "é", "", "sitadol"]
    assert np.allclose(model.word_bits(some)[:, 0], [bits(w) for w in some])


def test_without_rows_or_labels(spark, docs):
    schema = "doc_id long, text string, lang string"
    df = docs(labelled(60), schema)
    assert language_id.identify(df.limit(0), language_id.train(df)).collect() == []
    empty = docs([], schema)
    assert language_id.identify(empty, language_id.train(empty)).collect() == []
    assert language_id.keep_accepted(empty, language_id.train(empty)).collect() == []
    bare = docs([(1, "some words", None), (2, None, None), (3, "12", None), (None, "more", None)], schema)
    got = language_id.identify(bare, language_id.train(bare)).collect()
    assert [(r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in sorted(got, key=lambda r: r["doc_id"] or 9)] == [(1, "und", 0.0, False), (2, "und", 0.0, True), (3, "und", 0.0, True), (None, "und", 0.0, False)]
    assert {r["doc_id"] for r in language_id.keep_accepted(bare, language_id.train(bare)).collect()} == {1, None}


def test_pieces_groups_and_small_memos_change_nothing(monkeypatch):
    rows = labelled(90)
    model = language_id.fit([t for _, t, _ in rows], [n for _, _, n in rows])
    rng = random.Random(6)
    long = "".join(rng.choice("lorem ipsu dolé漢").replace(" ", "x") for _ in range(5000))
    some = ["lorlor", "", long, "zweidrein", "x"]
    whole, texts = model.word_bits(some), [" ".join(some), "lorlor " * 300, ""]
    found = model.scorer()(texts)
    monkeypatch.setattr(language_id, "PIECE", 64)
    monkeypatch.setattr(language_id, "GROUP", 2)
    monkeypatch.setattr(language_id, "MEMO_CELLS", 6)
    model._groups = None
    assert np.allclose(model.word_bits(some), whole)
    score = model.scorer()
    for _ in range(3):
        for (e, letter, chars), (e2, letter2, chars2) in zip(found, score(texts), strict=True):
            assert (letter, chars) == (letter2, chars2) and (e is e2 is None or np.allclose(e, e2))


def test_texts_for_training_are_bounded_in_characters(spark):
    from glyphward.llm.common import training_texts

    rows = [(i, "a" if i % 2 else "b", i, "x" * 10) for i in range(20)] + [(100, "a", -1, "y" * 1000), (3, "a", 3, "w" * 9), (None, "a", 0, "z"), (None, "a", 0, "zz"), (7, None, 0, "z"), (8, "b", 0, None)]
    got = training_texts(spark.createDataFrame(rows, "doc_id long, label string, place long, text string"), 4, 36)
    assert [(r["doc_id"], r["text"]) for r in got if r["label"] == "a"] == [(None, "z"), (1, "x" * 10), (3, "w" * 9), (5, "x" * 10)]
    assert [r["doc_id"] for r in got if r["label"] == "b"] == [0, 2, 4]


BAD = ["wretched", "loathsome", "vilecreature"]


def toxic_corpus(n=1600, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = words(rng, "aa", rng.randint(30, 120))
        bad = rng.random() < 0.25
        if bad:
            for _ in range(max(2, len(w) // 25)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, docs):
    rows, labels = toxic_corpus()
    rows += [(5000, None), (5001, ""), (5002, "ok"), (5003, "a " * 20_000), (None, "wretched loathsome")]
    df = docs(rows)
    known = spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(df, toxicity.train(df, known)).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    hits = sum(r["predicted"] for r in held if truth[r["doc_id"]])
    assert hits >= 0.9 * sum(truth[r["doc_id"]] for r in held)
    assert sum(r["predicted"] for r in held if not truth[r["doc_id"]]) <= 0.03 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and fold(r["doc_id"]) == 2) for r in got)
    assert toxicity.score_documents(df.limit(0), toxicity.fit(["a"] * 4, [0, 1, 0, 1], [1.0] * 4)).collect() == []


def test_toxicity_scores_against_plain_python(spark, docs):
    """Each window compressed with either dictionary by the library, and the score's formula written out."""
    import zstandard as zs

    rows, labels = toxic_corpus(400, 5)
    rows += [(5000, None), (5001, ""), (5002, "ok"), (5003, "wretched " * 2000), (5004, "\u00c9t\u00c9 LOATHSOME \u2003 x")]
    model = toxicity.fit([t for _, t in rows[:400]], [y for _, y in labels], [1.0] * 400)
    made = [zs.ZstdCompressor(level=toxicity.LEVEL, dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.ordinary, model.toxic)]
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs(rows), model).collect()}
    for i, text in rows:
        words, saved, at = (text or "").lower().encode().split(), [], 0
        while words and (at == 0 or at + toxicity.WINDOW - toxicity.STRIDE < len(words)):
            window = toxicity.CARRIER + b"".join(b" " + w for w in words[at : at + 8]) + b" "
            lengths = [len(m.compress(window)) for m in made]
            saved.append(lengths[0] - lengths[1])
            at += toxicity.STRIDE
        if saved:
            top, n = sorted(saved)[::-1], len(saved)
            high, some = sum(1 for x in saved if x >= model.high), sum(1 for x in saved if x >= model.some)
            features = [top[0], top[1] if n > 1 else top[0], sum(top[:4]) / len(top[:4]), math.log(1 + high), high / n, some / n, math.log(1 + some) - math.log(1 + n) / 2, 1]
        else:
            features = [0] * 7 + [1]
        score = 1 / (1 + math.exp(-sum(a * b for a, b in zip(features, model.weights, strict=True))))
        assert math.isclose(got[i]["score"], score, abs_tol=1e-9) and got[i]["predicted"] == int(score >= 0.3)


def test_novel_runs_against_sets():
    ordinary, text = toxicity.plain("alpha beta gamma delta"), toxicity.plain("Alpha betahorrid omega it horrid")
    n = toxicity.GRAM
    grams = {ordinary[i : i + n] for i in range(len(ordinary) - n + 1)}
    new = [i for i in range(len(text) - n + 1) if b" " not in text[i + 1 : i + n - 1] and text[i : i + n] not in grams]
    runs = []
    for i in new:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    assert toxicity.novel_runs(text, np.unique(toxicity._grams(ordinary))) == [text[a : b + n] for a, b in runs]


def test_toxicity_without_labels_or_rows(spark, docs):
    rows = [(1, "some text"), (2, None), (None, "x")]
    for labels in ([], [(1, 0)], [(1, 1)], [(None, 1), (7, 1)]):
        got = toxicity.score_documents(docs(rows), toxicity.train(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
        assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)
