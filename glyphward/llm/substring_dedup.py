"""Substring dedup: words covered by a window of WINDOW words that also starts earlier are removed.

Texts are dealt once into chunks, which stay in the checkpoint folder; every later step groups them where they
lie. A chunk is recompressed (recompression.py), and three rounds over all chunks follow:

1. Reveal. Each window has an anchor, the symbol that its words decide, and half of its words lie on one side of
   the anchor. An anchor's name with the hash of the words on that side is a key. Keys are dealt by themselves,
   a few bytes each; where one comes from several chunks, each of these is told, by a bit for each key it sent.
2. Match. Windows whose key is shared, or repeats in the chunk, are dealt by their anchor's name, with where they
   start and their hashes. All but the earliest of equal ones are duplicates of that one.
3. Verify. Adjoining duplicates of adjoining windows make one run. Each run's words are digested (256 bits) and
   compared with those that they are said to repeat, in the chunk that holds these. If any differ, hashes have
   collided, and all starts anew with another seed. Equal words always match, so what stays is exact.

A key or window that repeats within a chunk leaves the chunk once. Windows of very many chunks are merged in a
tree of FAN chunks each, so a passage that a third of all documents share never meets in one task. Equal runs of
one passage are one row before they are verified.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, column, durable, durable_by, few_rows, give_back, shuffles, small_batches
from .recompression import anchors, mix, window_hashes, words_of

WINDOW = 20
#: Bytes of text that a chunk aims at, and of all text for which there is a receiving group; a long document makes a chunk larger.
CHUNK_BYTES, GROUP_BYTES = 2 << 20, 20 << 20
#: Chunks whose windows are merged in one step.
FAN = 4096
_KEY, _HASH, _NAME = 5, 7, 5
_LAST_ID = (1 << 63) - 1
_HEAD = struct.Struct("<4I")
#: A run of n duplicate windows from `at` in document `doc` of a chunk, and where the same words start earlier.
MATCH = np.dtype([("chunk", "<i8"), ("doc", "<u4"), ("at", "<u4"), ("n", "<u4"), ("hchunk", "<i8"), ("hdoc", "<u4"), ("hat", "<u4")])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _low_bytes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _from_bytes(raw: bytes | memoryview, count: int, n: int) -> np.ndarray:
    wide = np.zeros((count, 8), np.uint8)
    wide[:, :n] = np.frombuffer(raw, np.uint8, count * n).reshape(count, n)
    return wide.view("<u8").ravel()


def _plain(z: bytes | None) -> bytes:
    """The words of a packed text, joined by one space."""
    import zstandard

    return b"" if z is None else b" ".join(zstandard.ZstdDecompressor().decompress(z).split())


def _ordered(t: pa.Table) -> tuple[pa.Table, list[int]]:
    """A chunk's rows in an order that is the same in all steps, and for each row the first one that is the same document."""
    ids, texts = t.column("id").to_pylist(), [z or b"" for z in t.column("z").to_pylist()]
    order = sorted(range(t.num_rows), key=lambda i: (ids[i], texts[i]))
    first = list(range(t.num_rows))
    for k in range(1, t.num_rows):
        if ids[order[k]] == ids[order[k - 1]] and texts[order[k]] == texts[order[k - 1]]:
            first[k] = first[k - 1]
    return t.take(pa.array(order, pa.int64())), first


def _slices(x: np.ndarray):
    """(value, begin, end) of each run of equal numbers, none of them negative."""
    cut = np.flatnonzero(np.diff(x, prepend=-1)).tolist()
    return ((int(x[a]), a, b) for a, b in zip(cut, [*cut[1:], len(x)][: len(cut)], strict=True))


def _steps(size: np.ndarray) -> np.ndarray:
    """0, 1, .. below each size, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


class Chunk:
    """The windows of a chunk's documents: document, start, anchor's name, distance to the anchor, hash, and key."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], window: int, seed: int, bits: int):
        words, doc = words_of(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), seed)
        words = words & np.uint64((1 << bits) - 1)
        inside, name, anchor = anchors(words, doc, window)
        p = np.flatnonzero(inside)
        half, s = window // 2, anchor[p]
        before = window_hashes(words, half)[np.maximum(s - half, 0)] if len(p) else np.zeros(0, np.uint64)
        after = window_hashes(words, window - half)
        after = after[np.minimum(s, len(after) - 1)] if len(p) else before
        self.ids, self.doc, self.name, self.rel = ids, doc[p], name[p], (p - s).astype(np.int64)
        self.at = p - np.searchsorted(doc, np.arange(len(ids)))[self.doc]
        self.hash = window_hashes(words, window)[p]
        side = s - p >= half
        key = mix(np.where(side, mix(self.name + before), mix(self.name * _ODD + after)))
        #: Distinct keys in order, each window's, and whether a key stands at several anchors of the chunk.
        self.keys, self.key = np.unique(key, return_inverse=True)
        places = np.unique(self.key.astype(np.int64) * max(1, len(words)) + s)
        self.shared = np.bincount(places // max(1, len(words)), minlength=len(self.keys)) > 1

    def receivers(self, n: int) -> np.ndarray:
        """The receiver of each key, in the order of keys."""
        return ((self.keys >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def key_blocks(chunk: Chunk, receivers: int):
    """(receiver, keys) for the chunk."""
    for receiver, a, b in _slices(chunk.receivers(receivers)):
        yield receiver, _low_bytes(chunk.keys[a:b], _KEY)


def shared_keys(blocks: list[bytes]) -> list[bytes | None]:
    """For each block of keys, a bit for each that another block has, too; None for no bit."""
    size = np.array([len(b) // _KEY for b in blocks], np.int64)
    keys = np.concatenate([_from_bytes(b, n, _KEY) for b, n in zip(blocks, size.tolist(), strict=True)])
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    shared = np.zeros(len(keys), bool)
    shared[order[1:][equal]] = shared[order[:-1][equal]] = True
    ends = np.cumsum(size)
    return [np.packbits(shared[e - n : e]).tobytes() if shared[e - n : e].any() else None for e, n in zip(ends.tolist(), size.tolist(), strict=True)]


def _pack(windows: dict[str, np.ndarray], local: np.ndarray) -> bytes:
    """A block of windows in the order of documents and starts, runs of one anchor as one row; and of matches found already."""
    name, rel, at = windows["name"], windows["rel"], windows["at"]
    new = np.ones(len(at), bool)
    other = (windows["chunk"][1:] != windows["chunk"][:-1]) | (windows["doc"][1:] != windows["doc"][:-1])
    new[1:] = other | (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1) | (rel[1:] != rel[:-1] + 1)
    row = np.flatnonzero(new)
    first = np.ones(len(row), bool)
    first[1:] = (windows["chunk"][row][1:] != windows["chunk"][row][:-1]) | (windows["doc"][row][1:] != windows["doc"][row][:-1])
    docs = np.flatnonzero(first)
    of = row[docs]
    return b"".join((
        _HEAD.pack(len(docs), len(row), len(at), len(local)),
        windows["id"][of].astype("<i8").tobytes(), windows["chunk"][of].astype("<i8").tobytes(), windows["doc"][of].astype("<u4").tobytes(), np.diff(np.append(docs, len(row))).astype("<u4").tobytes(),
        _low_bytes(name[row], _NAME), at[row].astype("<u4").tobytes(), rel[row].astype("<i4").tobytes(), np.diff(np.append(row, len(at))).astype("<u4").tobytes(),
        _low_bytes(windows["hash"], _HASH), local.tobytes(),
    ))


def _unpack(block: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    docs, rows, count, local = _HEAD.unpack_from(block)
    view, at = memoryview(block), _HEAD.size

    def take(kind, n: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(view, kind, n, at)
        at += x.nbytes
        return x

    ids, chunk, doc, many = take("<i8", docs), take("<i8", docs), take("<u4", docs), take("<u4", docs)
    name = _from_bytes(view[at:], rows, _NAME)
    at += rows * _NAME
    start, rel, size = take("<u4", rows), take("<i4", rows), take("<u4", rows).astype(np.int64)
    g = _from_bytes(view[at:], count, _HASH)
    at += count * _HASH
    step, of = _steps(size), np.repeat(np.repeat(np.arange(docs), many), size)
    spread = lambda x: np.repeat(x, size)
    return {"name": spread(name), "rel": spread(rel).astype(np.int64) + step, "at": spread(start).astype(np.int64) + step, "id": ids[of], "chunk": chunk[of], "doc": doc[of], "hash": g}, take(MATCH, local)


def _matches(later: dict[str, np.ndarray], head: dict[str, np.ndarray]) -> np.ndarray:
    """Matches of windows with the ones that they repeat, adjoining ones as runs."""
    order = np.lexsort((later["at"], later["doc"], later["chunk"]))
    a, b = ({k: v[order] for k, v in side.items()} for side in (later, head))
    new = np.ones(len(order), bool)
    differs = lambda x, step: x[1:] != x[:-1] + step
    new[1:] = differs(a["chunk"], 0) | differs(a["doc"], 0) | differs(a["at"], 1) | differs(b["chunk"], 0) | differs(b["doc"], 0) | differs(b["at"], 1)
    row = np.flatnonzero(new)
    out = np.zeros(len(row), MATCH)
    for to, x in (("chunk", a["chunk"]), ("doc", a["doc"]), ("at", a["at"]), ("hchunk", b["chunk"]), ("hdoc", b["doc"]), ("hat", b["at"])):
        out[to] = x[row]
    out["n"] = np.diff(np.append(row, len(order)))
    return out


def _earliest(windows: dict[str, np.ndarray], *same: str) -> tuple[np.ndarray, np.ndarray]:
    """Of windows equal in these columns: the earliest ones, and for each window the number of its earliest.

    The same start under an id that repeats is no earlier one, so of such windows each counts as earliest.
    """
    order = np.lexsort((windows["at"], windows["id"], *(windows[c] for c in same)))
    sorted_ = {c: windows[c][order] for c in (*same, "id", "at")}
    equal = np.ones(max(0, len(order) - 1), bool)
    for c in same:
        equal &= sorted_[c][1:] == sorted_[c][:-1]
    begins = np.concatenate(([True], ~equal)) if len(order) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0)) if len(order) else np.zeros(0, int)
    later = (sorted_["id"] != sorted_["id"][head]) | (sorted_["at"] != sorted_["at"][head])
    of = np.empty(len(order), np.int64)
    of[order] = np.where(later, order[head], order)
    return np.sort(order[~later]), of


def window_blocks(chunk: Chunk, number: int, masks: list[tuple[int, bytes]], groups: int):
    """(group, block) for the windows of a chunk whose keys are shared."""
    shared, to = chunk.shared.copy(), chunk.receivers(groups)
    for receiver, mask in masks:
        a, b = np.searchsorted(to, [receiver, receiver + 1])
        shared[a:b] |= np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a).astype(bool)
    p = np.flatnonzero(shared[chunk.key])
    if not len(p):
        return
    w = {"name": chunk.name[p], "rel": chunk.rel[p], "at": chunk.at[p], "id": chunk.ids[chunk.doc[p]], "doc": chunk.doc[p], "hash": chunk.hash[p], "chunk": np.full(len(p), number, np.int64)}
    stay, of = _earliest(w, "name", "rel", "hash")
    pick = lambda rows: {k: v[rows] for k, v in w.items()}
    later = np.flatnonzero(of != np.arange(len(p)))
    local = _matches(pick(later), pick(of[later]))
    w = pick(stay)
    to = (w["name"] >> np.uint64(8 * _NAME)).astype(np.int64) % groups
    order = np.argsort(to, kind="stable")
    w, to, local_to = {k: v[order] for k, v in w.items()}, to[order], local["doc"].astype(np.int64) % groups
    for r in np.union1d(np.unique(to), np.unique(local_to)).tolist():
        a, b = np.searchsorted(to, [r, r + 1])
        yield r, _pack({k: v[a:b] for k, v in w.items()}, local[local_to == r])


def merged(blocks: list[bytes], last: bool) -> tuple[np.ndarray, bytes | None]:
    """Matches among the windows of blocks, and the earliest of equal windows as one block, unless this is the last step."""
    parts, local = zip(*map(_unpack, blocks), strict=True)
    w = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    stay, of = _earliest(w, "hash", "name", "rel")
    later = np.flatnonzero(of != np.arange(len(of)))
    pick = lambda rows: {k: v[rows] for k, v in w.items()}
    found = np.concatenate((*local, _matches(pick(later), pick(of[later]))))
    if last:
        return found, None
    kept = pick(stay)
    order = np.lexsort((kept["at"], kept["doc"], kept["chunk"]))
    return found, _pack({k: v[order] for k, v in kept.items()}, np.zeros(0, MATCH))


def by_chunk(found: np.ndarray):
    """(chunk, matches) for each chunk that has matches."""
    found = found[np.argsort(found["chunk"], kind="stable")]
    for number, a, b in _slices(found["chunk"]):
        yield number, found[a:b].tobytes()


def runs_of(blocks: list[bytes], *along: str) -> np.ndarray:
    """A chunk's matches with adjoining and overlapping ones joined, of equal values in the columns `along`."""
    m = np.frombuffer(b"".join(blocks), MATCH)
    columns = {c: m[c].astype(np.int64) if c != "shift" else m["at"].astype(np.int64) - m["hat"] for c in along}
    order = np.lexsort((m["at"], *reversed(columns.values())))
    m, columns = m[order], {c: x[order] for c, x in columns.items()}
    other = np.ones(len(m), bool)
    other[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns.values()])
    # the furthest end so far among equals: ends grow with a large step from one to the next
    step, start = np.cumsum(other) * (np.int64(1) << 33), m["at"].astype(np.int64)
    far = np.maximum.accumulate(start + m["n"] + step) - step
    new = other.copy()
    new[1:] |= start[1:] > far[:-1]
    first = np.flatnonzero(new)
    out = m[first].copy()
    out["n"] = far[np.append(first[1:], len(m)) - 1] - start[first]
    return out


class Words:
    """The words of a document, as slices of its plain text."""

    def __init__(self, plain: bytes):
        self.plain = plain
        self.space = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)

    def digest(self, first: int, n: int) -> bytes:
        """Of n words from the first one on."""
        a = 0 if first == 0 else int(self.space[first - 1]) + 1
        b = int(self.space[first + n - 1]) if first + n - 1 < len(self.space) else len(self.plain)
        return hashlib.blake2b(self.plain[a:b], digest_size=32).digest()


def claims(texts: list[bytes | None], blocks: list[bytes], window: int) -> list[tuple[int, int, int, int, bytes]]:
    """(chunk, document, first word, words, digest) that the matches of a chunk say to stand elsewhere; equal ones once."""
    known: dict[int, Words] = {}
    out = set()
    for r in runs_of(blocks, "doc", "hchunk", "hdoc", "shift").tolist():
        _, doc, at, n, hchunk, hdoc, hat = r
        if doc not in known:
            known[doc] = Words(_plain(texts[doc]))
        out.add((hchunk, hdoc, hat, n + window - 1, known[doc].digest(at, n + window - 1)))
    return sorted(out)


def kept_words(text: str | None, spans: np.ndarray | None, window: int = WINDOW) -> tuple[int, list[bytes]]:
    """The number of words of a text, and those that no duplicate window covers; spans are first starts and numbers of starts."""
    words = (text or "").encode().split()
    if spans is None or not len(spans):
        return len(words), words
    change = np.zeros(len(words) + window + 1, np.int64)
    np.add.at(change, spans["at"].astype(np.int64), 1)
    np.add.at(change, spans["at"].astype(np.int64) + spans["n"] - 1 + window, -1)
    free = np.cumsum(change)[: len(words)] == 0
    return len(words), [words[i] for i in np.flatnonzero(free)]


def _rows(columns, kinds) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _columns(rows: list[tuple], n: int) -> list[list]:
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * n


def duplicate_runs(chunks: DataFrame, window: int, total: int, numbers: int, fan: int, seed: int, bits: int) -> DataFrame:
    """chunk, block: the matches of each chunk, kept in the checkpoint folder."""
    groups = max(4 * shuffles(chunks.sparkSession), -(-total // GROUP_BYTES))

    def load(t: pa.Table) -> Chunk:
        t, first = _ordered(t)
        texts = [_plain(z) if first[i] == i else b"" for i, z in enumerate(t.column("z").to_pylist())]
        return Chunk(t.column("id").to_numpy(), texts, window, seed, bits)

    number = lambda t: t.column("chunk")[0].as_py()
    kinds = {"to": pa.int64(), "chunk": pa.int64(), "block": pa.binary()}

    def send(t: pa.Table) -> pa.Table:
        sent = [(r, number(t), b) for r, b in key_blocks(load(t), groups)]
        give_back(False)
        return _rows(_columns(sent, 3), kinds)

    def reveal(t: pa.Table) -> pa.Table:
        found = shared_keys(t.column("block").to_pylist())
        rows = [(to, chunk, mask) for to, chunk, mask in zip(t.column("to").to_pylist(), t.column("chunk").to_pylist(), found, strict=True) if mask is not None]
        return _rows(_columns(rows, 3), kinds)

    def answer(t: pa.Table, masks: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _rows([[]] * 3, kinds)
        told = list(zip(masks.column("to").to_pylist(), masks.column("block").to_pylist(), strict=True))
        sent = [(to, number(t), b) for to, b in window_blocks(load(t), number(t), told, groups)]
        give_back(False)
        return _rows(_columns(sent, 3), kinds)

    def merge(last: bool):
        def run(t: pa.Table) -> pa.Table:
            found, rest = merged(t.column("block").to_pylist(), last)
            rows = [(-1, chunk, b) for chunk, b in by_chunk(found)]
            if rest is not None:
                rows.append((t.column("to")[0].as_py(), t.column("chunk")[0].as_py() // fan, rest))
            give_back(False)
            return _rows(_columns(rows, 3), kinds)

        return run

    schema = "to long, chunk long, block binary"
    masks = chunks.groupBy("chunk").applyInArrow(send, schema).groupBy("to").applyInArrow(reveal, schema)
    rows, matches = chunks.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInArrow(answer, schema), None
    while numbers > fan:
        step = durable(rows.groupBy("to", F.floor(F.col("chunk") / fan)).applyInArrow(merge(False), schema))
        rows, numbers = step.where("to >= 0"), -(-numbers // fan)
        matches = step.where("to < 0") if matches is None else matches.unionByName(step.where("to < 0"))
    last = rows.groupBy("to").applyInArrow(merge(True), schema)
    return durable((last if matches is None else matches.unionByName(last)).select("chunk", "block"))


def differing_runs(chunks: DataFrame, matches: DataFrame, window: int) -> int:
    """How many distinct runs differ in words from what they are said to repeat."""
    kinds = {"chunk": pa.int64(), "doc": pa.int64(), "first": pa.int64(), "n": pa.int64(), "digest": pa.binary()}

    def state(t: pa.Table, found: pa.Table) -> pa.Table:
        rows = claims(_ordered(t)[0].column("z").to_pylist(), found.column("block").to_pylist(), window) if t.num_rows and found.num_rows else []
        return _rows(_columns(rows, 5), kinds)

    def check(t: pa.Table, said: pa.Table) -> pa.Table:
        bad, known = 0, {}
        if said.num_rows:
            texts = _ordered(t)[0].column("z").to_pylist()
            for doc, first, n, digest in zip(*(said.column(k).to_pylist() for k in ("doc", "first", "n", "digest")), strict=True):
                if doc not in known:
                    known[doc] = Words(_plain(texts[doc]))
                bad += known[doc].digest(first, n) != digest
        return pa.table({"bad": pa.array([bad], pa.int64())})

    said = chunks.groupBy("chunk").cogroup(matches.groupBy("chunk")).applyInArrow(state, "chunk long, doc long, first long, n long, digest binary").distinct()
    return chunks.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(check, "bad long").agg(F.coalesce(F.sum("bad"), F.lit(0))).first()[0]


def deduplicate(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN, word_bits: tuple[int, ...] = (64,)) -> DataFrame:
    """docs without the words covered by a window that also starts earlier, and n_words and n_removed.

    The text of a row that loses words is the kept ones joined by one space; other texts and all other columns
    stay as they are. With digest: doc_id, n_words, n_removed, kept_sha256 only.

    Earlier means a smaller id, or an earlier start under the same id; null ids come last and count as one. Rows
    that repeat id and text are one document; of rows that repeat an id with other texts, the same start is no
    earlier one. A null text has no words and stays null. A text of fewer words than a window stays whole. An empty
    table gives an empty result. Columns of docs named n_words or n_removed are replaced; others may have any name.

    Results don't depend on chunk_bytes, fan and word_bits, the bits of a word's hash that the first attempts keep
    (the last one goes for all further attempts).
    """
    docs = small_batches(docs)
    others = [f.name for f in docs.schema if (f.name == id_col if digest else f.name not in (text_col, "n_words", "n_removed"))]
    text = docs[text_col].cast("string")
    id_ = F.coalesce(docs[id_col].cast("long"), F.lit(_LAST_ID))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    numbers = max(1, -(-total // chunk_bytes))
    # Copies of one row come from many tasks, so they don't meet in one chunk.
    place = F.pmod(F.xxhash64(id_, F.crc32(text.cast("binary")), F.spark_partition_id()), F.lit(numbers))
    rows = docs.select(place.alias("chunk"), id_.alias("id"), text.alias("z"), F.struct(F.lit(0).alias("none"), *(column(docs, c).alias(f"c{k}") for k, c in enumerate(others))).alias("row"))

    def pack(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in few_rows(batches):
            z = [None if t is None else squeeze(t.encode()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary()), batch.column(3)], names=["chunk", "id", "z", "row"])

    packed = T.StructType([T.StructField("z", T.BinaryType()) if f.name == "z" else f for f in rows.schema])
    chunks = durable_by(rows.mapInArrow(pack, packed), "chunk", "id", "z")
    attempt = 0
    while True:
        matches = duplicate_runs(chunks, window, total, numbers, fan, attempt, word_bits[min(attempt, len(word_bits) - 1)])
        if not differing_runs(chunks, matches, window):
            break
        attempt += 1

    def cut(t: pa.Table, found: pa.Table) -> pa.Table:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        t, first = _ordered(t)
        runs = runs_of(found.column("block").to_pylist(), "doc") if found.num_rows else np.zeros(0, MATCH)
        ends = np.searchsorted(runs["doc"], np.arange(t.num_rows + 1))
        kept, count, gone = [], [], []
        for i, z in enumerate(t.column("z").to_pylist() if t.num_rows else []):
            raw = None if z is None else open_(z).decode()
            n, words = kept_words(raw, runs[ends[first[i]] : ends[first[i] + 1]], window)
            count.append(n)
            gone.append(n - len(words))
            kept.append(hashlib.sha256(b" ".join(words)).hexdigest() if digest else raw if n == len(words) else b" ".join(words).decode())
        give_back(False)
        columns = {"row": t.column("row"), "n_words": pa.array(count, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.string())}
        return pa.table(columns)

    result = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    out = chunks.groupBy("chunk").cogroup(matches.groupBy("chunk")).applyInArrow(cut, result)
    named = {c: F.col("row").getField(f"c{k}") for k, c in enumerate(others)}
    if digest:
        return out.select(named[id_col].cast("long").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
    return out.select(*((F.col("kept") if c == text_col else named[c]).alias(c) for c in docs.columns if c not in ("n_words", "n_removed")), "n_words", "n_removed")


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p : p + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM win) WHERE n > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS i FROM dup),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN cov USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
