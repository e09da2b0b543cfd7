"""Token counts under a byte-level BPE, by the whole-token shortcut.

A vocabulary string that (a) is one pre-token of its own and (b) merges back to exactly one token costs
one token wherever it occurs as a pre-token. The set of these strings is proved once on the driver and
shipped (its size is bounded by the vocabulary). A document is split into pre-tokens, which are counted;
only pre-tokens outside the set are merged, with a bounded memo.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import few_rows, small_batches

#: The pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 512
MEMO = 400_000
#: Texts that a vocabulary must count as the library does before it is used at all.
PROBES = ("", " ", "Hello world's", "  two  spaces ", "tab\tand\nline\r\n  x", "\u00e9 e\u0301 \ufb01 \uff21 \u00a0x", "\u2581 a", "\u6f22\u5b57 \U0001f600", "a" * 40, "<|endoftext|> <s>a</s>", "0123456789 4,5", "\u200bx\x00y", "don't WE'LL")
#: Pre-tokens of so many bytes are merged by scanning.
SHORT = 40
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def byte_letters() -> dict[str, int]:
    """Letter -> byte, as byte-level vocabularies spell bytes: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks over byte strings, and the special strings that are tokens by themselves."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        self.tokens = [spell(t) for t in spec["model"]["vocab"] if all(c in letters for c in t)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(spell(a), spell(b)): r for r, (a, b) in enumerate(pairs)}
        special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)

    def merged(self, data: bytes) -> int:
        """The number of tokens of one pre-token: lowest rank first, leftmost among equals, by a heap."""
        parts = [data[i : i + 1] for i in range(len(data))]
        if len(parts) <= SHORT:
            return self._merged_short(parts)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        ranks = self.ranks
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = len(parts)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else len(parts)
            if j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, b""
            after[i] = after[j]
            left -= 1
            if after[i] < len(parts):
                before[after[i]] = i
                if (r := ranks.get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            if before[i] >= 0 and (r := ranks.get((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, before[i], parts[before[i]], parts[i]))
        return left

    def _merged_short(self, parts: list[bytes]) -> int:
        """As merged(); a scan for the lowest rank is faster than a heap for a few parts."""
        get, none = self.ranks.get, len(self.ranks)
        ranks = [get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
        return len(parts)

    def pieces(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens with their counts, and how many special strings stand in the text."""
        if self.special is None or not (found := len(self.special.findall(text))):
            return Counter(self.pattern.findall(text)), 0
        counts: Counter = Counter()
        for part in self.special.split(text):
            counts.update(self.pattern.findall(part))
        return counts, found


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file; ValueError if the file asks for another pattern, normalization or treatment of special strings."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        v = Vocabulary(json.load(f))
    library = Tokenizer.from_file(path)
    for text in PROBES:
        parts, n = v.pieces(text)
        if n + sum(times * v.merged(part.encode()) for part, times in parts.items()) != len(library.encode(text, add_special_tokens=False).ids):
            raise ValueError("not a byte-level vocabulary with the pattern that is counted here")
    return v


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings proved to encode alone as one token."""
    v, proved = vocabulary(path), set()
    for token in v.tokens:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if v.pattern.findall(text) == [text] and v.merged(token) == 1:
            proved.add(text)
    return frozenset(proved)


#: More tokens than any text has: marks words that can't be counted apart from their neighbours.
_TIED = 1 << 60


class _Words(dict):
    """Word -> tokens of the word with a space in front; a bounded memo.

    A single space between two characters that are no white space always starts a pre-token, so such words
    are counted apart. A word that is empty, or begins or ends with other white space, is tied to its neighbours.
    """

    def __init__(self, pieces):
        self.pieces = pieces
        self.older: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        if (n := self.older.get(word)) is None:
            n = _TIED if not word or word[0].isspace() or word[-1].isspace() else self.pieces(" " + word)
        if len(word) <= 64:
            if len(self) >= MEMO:  # the older half goes, words in use come back from it
                self.older = dict(self)
                self.clear()
            self[word] = n
        return n


def counter(path: str, whole: frozenset[str]):
    """text -> number of tokens."""
    v = vocabulary(path)

    def pieces(text: str) -> int:
        parts, n = v.pieces(text)
        return n + sum(times * (1 if part in whole else v.merged(part.encode())) for part, times in parts.items())

    words = _Words(pieces)

    def count(text: str) -> int:
        if v.special is None or not v.special.search(text):
            first, *rest = text.split(" ")
            if first and not first[-1].isspace():
                n = sum(map(words.__getitem__, rest))
                if n < _TIED:
                    return n + pieces(first)
        return pieces(text)

    return count


def count_tokens(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    A null text counts as empty: 0 bytes, 0 tokens. A null id stays null. Repeated rows stay repeated; an
    empty table gives an empty result; other columns are not read. Very long texts are counted whole.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocab_path))

    def run(batches):
        count = counter(vocab_path, shipped.value)
        for batch in few_rows(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [count(t) for t in texts]
            size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], schema=_OUT)

    docs = small_batches(docs)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
