import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from glyphward.llm import piece_codec, token_counts
from tokenizers import Tokenizer

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def corpus():
    rng = random.Random(8)
    pool = ["the", " the", "é", "e\u0301", "\u6f22\u5b57", " ", "  ", "\n", "\t", "\r\n", "\x00", "\x1c", "\u00a0", "\u2581", "<|endoftext|>", "<s>", "it's", "'ll", "123", "\u0663", "!!", "abcdefgh", "\U0001f600", "Hello"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    return [*texts, "", None, " ", "a" * 30_000, " " * 3000, "word " * 5000, "x", "x", "\u2581", "<|endoftext|> <|endoftext|>"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_token_counts_are_the_librarys(spark, docs):
    rows = [*enumerate(corpus()), (None, "no id"), (0, "again")]
    library = Tokenizer.from_file(BYTE)
    expected = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in token_counts.count_tokens(docs(rows), BYTE).collect()), key=repr) == expected
    assert token_counts.count_tokens(docs([]), BYTE).collect() == []


def test_whole_tokens_are_single(spark):
    library, whole = Tokenizer.from_file(BYTE), sorted(token_counts.whole_tokens(BYTE))
    assert len(whole) > 40_000
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(1).sample(whole, 3000))


def test_pieces_are_the_librarys(spark, docs):
    rows = [*enumerate(corpus()), (None, "no id"), (0, "again")]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    expected = []
    for i, t in rows:
        ids = library.encode(t or "")
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted((tuple(r) for r in piece_codec.digest_documents(docs(rows), PIECE).collect()), key=repr) == sorted(expected, key=repr)
    for r in piece_codec.encode_documents(docs(rows[:60]), PIECE).collect():
        if r["doc_id"]:
            assert r["ids"] == library.encode(rows[r["doc_id"]][1] or "") and r["decoded"] == library.decode(r["ids"])
    assert piece_codec.digest_documents(docs([]), PIECE).collect() == []


def test_backtracking_is_plain_merging():
    c, rng = piece_codec.codec(PIECE), random.Random(2)
    known = sorted(c.ids)
    for _ in range(2000):
        text = "\u2581" + "".join(rng.choice(known) for _ in range(3)).replace("\u2581", "")
        assert c.backtrack(text) == c.merge(text)


def test_long_segments_block_by_block(monkeypatch):
    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECE), random.Random(6)
    monkeypatch.setattr(piece_codec, "BLOCK", 16)
    c = piece_codec.Codec(PIECE)
    known = [p.replace("\u2581", "") for p in rng.sample(sorted(c.ids), 400)]
    for _ in range(60):
        text = "".join(rng.choice(["a", "\u00e9", "\u6f22", *known]) for _ in range(rng.randint(1, 300)))
        for lead in ("", " ", "  ", "   ", " " * 9, "\u2581\u2581 "):
            assert c.encode(lead + text) == library.encode(lead + text), lead + text
    monkeypatch.setattr(piece_codec, "BLOCK", 1 << 14)
    long = "".join(rng.choice(known) for _ in range(60_000))
    for text in (long, "  " + long, "z" * 100_000):
        assert c.encode(text) == library.encode(text)


def test_a_long_segment_takes_little_memory():
    import tracemalloc

    c, rng = piece_codec.codec(PIECE), random.Random(7)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(1 << 20))
    c.segment_ids("\u2581" + text)  # fills the bounded memo of pairs
    tracemalloc.start()
    c.segment_ids("\u2581" + text)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 24 * len(text)


def test_other_settings_are_refused(tmp_path):
    import json

    with open(BYTE, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError):
            token_counts.vocabulary(str(path))


def test_decoding_ids(spark):
    c, library = piece_codec.codec(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(259, 32_000) for _ in range(rng.randint(0, 12))]
        assert c.decode(ids) == library.decode(ids)


def test_a_memo_that_overflows(monkeypatch):
    monkeypatch.setattr(piece_codec, "MEMO", 3)
    c = piece_codec.Codec(PIECE)
    for text in ("one two three four five six one two", "six five four three two one"):
        assert c.quick(text) == (",".join(map(str, c.encode(text))), text)
    monkeypatch.setattr(token_counts, "MEMO", 3)
    count, library = token_counts.counter(BYTE, token_counts.whole_tokens(BYTE)), Tokenizer.from_file(BYTE)
    for text in ("one two threeish fourfold fivesome sixth onex twoy", "sixth fivesome"):
        assert count(text) == len(library.encode(text).ids)


def test_crossing_pieces_are_refused(monkeypatch):
    class Odd(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "a\u2581b" if i == 500 else super().id_to_piece(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Odd)
    with pytest.raises(ValueError):
        piece_codec.Codec(PIECE)
