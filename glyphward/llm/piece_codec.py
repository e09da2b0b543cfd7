"""Exact merge-type encoding with a SentencePiece BPE vocabulary, by backtracking, and decoding.

A sequence of pieces is the merge encoding of its text exactly if every two neighbours are the merge
encoding of their own concatenation. So the encoder takes the longest piece that an Aho-Corasick automaton
finds at a position, keeps it if re-merging it with the piece before leaves both as they are, else tries
the next shorter one, and steps back when none is left; a bitfield remembers positions that failed.

No piece has the space mark after another character, so merges never cross from a word into the mark of
the next: a text is encoded segment by segment (marks, then other characters), with a bounded memo. A long segment's
matches are found block by block as the encoder comes to them, so it costs some ten bytes a character.

Several marks before a word merge plainly, as pieces of marks share one score, up to the first place that no piece
crosses. Only where there is none within a segment is all of it merged plainly, at some 300 bytes a character.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import few_rows, small_batches

MARK = "▁"
MEMO = 300_000
LONGEST_MEMO = 64
#: Characters whose matches are held at a time.
BLOCK = 1 << 14
#: Texts that the codec must encode and decode as the library does before it is used at all.
PROBES = ("", " ", "Hello world", "  two  spaces ", "tab\tand\nline\r\n", "\u00e9 e\u0301 \ufb01 \uff21 \u00a0x", "\u2581 \u2581\u2581a", "\u6f22\u5b57 \U0001f600", "a" * 40, "<s> </s> <unk>", "0123 4,5", "\u200bx\x00y")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class Codec:
    """The library serves only to read the file's pieces and scores."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses from a word into the next space mark; segments can't be encoded apart")
        self.segment = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if MARK * 2 not in p and self.merge(p) == [p]:
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ids), default=1)
        self.fits: dict[tuple[str, str], bool] = {}
        self.memo = _Segments(self)
        if any((got := self.encode(t)) != sp.encode(t) or self.decode(got) != sp.decode(got) for t in PROBES):
            raise ValueError("not a merge-type model without normalization, as this codec has it")

    def merge(self, text: str) -> list[str]:
        """Plain merging: best score first, leftmost among equals."""
        parts, score = list(text), self.score
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, parts[i], parts[i + 1]) for i in range(n - 1) if (s := score.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, "", after[j]
            if (k := after[i]) < n:
                before[k] = i
                if (s := score.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (-s, i, parts[i], parts[k]))
            if (k := before[i]) >= 0 and (s := score.get(parts[k] + parts[i])) is not None:
                heapq.heappush(heap, (-s, k, parts[k], parts[i]))
        return [p for p in parts if p]

    def compatible(self, a: str, b: str) -> bool:
        if (ok := self.fits.get((a, b))) is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            ok = self.fits[a, b] = self.merge(a + b) == [a, b]
        return ok

    def _options(self, text: str, block: int) -> list[list[int]]:
        """Lengths of the pieces at each position of a block of the text, growing; one character always is one."""
        low = block * BLOCK
        high = min(len(text), low + BLOCK)
        lengths: list[list[int]] = [[1] for _ in range(high - low)]
        for end, size in self.automaton.iter(text) if high == len(text) and not low else self.automaton.iter(text, low, min(len(text), high + self.longest)):
            at = end - size + 1
            if size > 1 and at < high:
                lengths[at - low].append(size)
        return lengths

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a segment with at most one space mark in front."""
        if len(text) > BLOCK:
            out, at = [], 0
            for size in self._sizes(text):
                out.append(text[at : at + size])
                at += size
            return out
        # As _sizes() does, with all matches at hand.
        n, lengths = len(text), self._options(text, 0)
        dead = bytearray(n + 1)
        taken: list[str] = []
        choice: list[int] = []  # index of the option taken, one for each piece
        at, option = 0, len(lengths[0]) - 1 if n else -1
        while at < n:
            while option >= 0:
                end = at + lengths[at][option]
                if not dead[end] and (not taken or self.compatible(taken[-1], text[at:end])):
                    break
                option -= 1
            if option >= 0:
                taken.append(text[at:end])
                choice.append(option)
                at = end
                option = len(lengths[at]) - 1 if at < n else -1
                continue
            dead[at] = 1
            at -= len(taken.pop())
            option = choice.pop() - 1
        return taken

    def _sizes(self, text: str) -> array:
        """The lengths of the pieces of a long segment, whose matches are found block by block."""
        n = len(text)
        blocks: dict[int, list[list[int]]] = {}

        def lengths(at: int) -> list[int]:
            block = at // BLOCK
            if (known := blocks.get(block)) is None:
                if len(blocks) > 1:  # steps back seldom reach far
                    del blocks[min(blocks, key=lambda b: -abs(b - block))]
                known = blocks[block] = self._options(text, block)
            return known[at - block * BLOCK]

        dead = bytearray(n + 1)
        taken = array("H")
        choice = array("B")
        at, option = 0, len(lengths(0)) - 1 if n else -1
        while at < n:
            here = lengths(at)
            while option >= 0:
                end = at + here[option]
                if not dead[end] and (not taken or self.compatible(text[at - taken[-1] : at], text[at:end])):
                    break
                option -= 1
            if option >= 0:
                taken.append(here[option])
                choice.append(option)
                at = end
                option = len(lengths(at)) - 1 if at < n else -1
                continue
            dead[at] = 1
            at -= taken.pop()
            option = choice.pop() - 1
        return taken

    def _parts(self, segment: str):
        """The pieces of a segment."""
        if not segment.startswith(MARK * 2):
            return self.backtrack(segment) if len(segment) <= BLOCK else self._long_parts(segment)
        at = self._apart(segment)
        return itertools.chain(self.merge(segment[:at]), self._long_parts(segment[at:]))

    def _long_parts(self, text: str):
        at = 0
        for size in self._sizes(text):
            yield text[at : at + size]
            at += size

    def _apart(self, segment: str) -> int:
        """Behind the leading marks, the first place that no piece crosses; the segment's end if there is none."""
        first = len(segment) - len(segment.lstrip(MARK))
        if first == len(segment):
            return first
        reach = first + 1  # pieces that begin before a place reach so far
        for at in range(first, len(segment)):
            if at > first and reach <= at:
                return at
            for size in range(2, min(self.longest, len(segment) - at) + 1):
                if at + size > reach and segment[at : at + size] in self.ids:
                    reach = at + size
            if at == first:  # pieces that begin with marks
                for k in range(1, min(first, self.longest) + 1):
                    for size in range(k + 1, min(self.longest, len(segment) - first + k) + 1):
                        if first - k + size > reach and segment[first - k : first - k + size] in self.ids:
                            reach = first - k + size
        return len(segment)

    def segment_ids(self, segment: str) -> array | list[int]:
        out, ids = [] if len(segment) <= BLOCK else array("i"), self.ids
        for p in self._parts(segment):
            if (i := ids.get(p)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend([self.bytes[b] for b in p.encode()])
            else:
                out.append(self.unknown)
        return out

    def segments(self, text: str) -> list[str]:
        return self.segment.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in self.segment_ids(s)]

    def spelled(self, ids: list[int]) -> str:
        """The text of ids with every space mark as a space, the one in front too."""
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(bytes(run).decode("utf-8", "replace"))
                run.clear()
            if i >= 0 and i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.spelled(ids).removeprefix(" ")

    def quick(self, text: str) -> tuple[str, str]:
        """The ids, joined by commas, and the decoded text, by the memo."""
        # Without runs of spaces, segments are the words between spaces, each behind one mark.
        parts = text.split(" ") if text and MARK not in text else [""]
        if "" in parts:
            parts = [s if s.startswith(MARK * 2) else s.removeprefix(MARK) for s in self.segments(text)]
        ids = ",".join(map(self.memo.__getitem__, parts))
        odd = self.memo.odd
        decoded = "".join(odd.get(p) or _spaced(p) for p in parts).removeprefix(" ") if odd or MARK in text else text
        return ids, decoded

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and digests of the ids and of the decoded text."""
        ids, decoded = self.quick(text)
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _spaced(part: str) -> str:
    return (part if part.startswith(MARK * 2) else MARK + part).replace(MARK, " ")


class _Segments(dict):
    """Segment, without its mark if it has one only -> its ids; a bounded memo.

    Each new segment is decoded too; odd keeps what segments decode to that don't decode to themselves.
    """

    def __init__(self, codec: Codec):
        self.codec = codec
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def __missing__(self, part: str) -> str:
        if (known := self.older.get(part)) is None:
            got = self.codec.segment_ids(part if part.startswith(MARK * 2) else MARK + part)
            known = ",".join(map(str, got)) if len(got) <= BLOCK else ",".join(",".join(map(str, got[i : i + BLOCK])) for i in range(0, len(got), BLOCK))
            if (spelled := self.codec.spelled(got)) != _spaced(part):
                self.odd[part] = spelled
        if len(part) <= LONGEST_MEMO:
            if len(self) >= MEMO:  # the older half goes, segments in use come back from it
                self.older = dict(self)
                self.clear()
            self[part] = known
        return known


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec in each Python worker."""
    return Codec(path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (string) for each row.

    A null text is taken as empty: no ids, empty decoded text. Repeated rows stay; an empty table gives an
    empty result; other columns are not read.
    """

    def run(batches):
        c = codec(model_path)
        for batch in few_rows(batches):
            rows = [c.quick(t or "") for t in batch.column(1).to_pylist()]
            ids = [np.fromstring(i, np.int32, sep=",") if i else np.zeros(0, np.int32) for i, _ in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([d for _, d in rows], pa.string())], names=["doc_id", "ids", "decoded"])

    docs = small_batches(docs)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, but the ids and the decoded text leave the workers as SHA-256 digests."""

    def run(batches):
        c = codec(model_path)
        for batch in few_rows(batches):
            rows = [c.digest(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], _OUT[k + 1].type) for k in range(3))], schema=_OUT)

    docs = small_batches(docs)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
