"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

zstandard trains both: one on ordinary text, one on what toxic text has and ordinary text lacks (the runs of
bytes in toxic documents whose GRAM-byte pieces stand nowhere in the ordinary sample). The toxic dictionary
is that content before the ordinary one's, so ordinary text compresses alike with either. A text is cut into
windows of a few words. Each window is compressed with either dictionary; the difference of the lengths tells
how much closer the window is to toxic text. Short windows would be stored raw, so each stands behind a
carrier that both dictionaries hold: then every byte saved shows.

Thresholds and weights are calibrated on training rows that the dictionaries have not seen. Quantiles of ordinary
windows' differences set what counts as a high one; sums over a text's windows go into a logistic model, whose
score is a calibrated probability. Of several sizes of the toxic dictionary the one with the least loss there stays.

Training reads a bounded sample: SAMPLE labelled rows of each class, by hash of the id, whole texts of TRAIN_CHARS
characters in all at most; scoring reads all.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, few_rows, small_batches, training_texts

#: Labelled rows of each class that training may read, and characters of their texts.
SAMPLE = 2500
TRAIN_CHARS = 16_000_000
#: Words of a window, and from one window to the next: each word is seen in several neighbourhoods.
WINDOW, STRIDE = 8, 3
LEVEL = 4
#: Sizes of the trained dictionaries (of the toxic one those tried), and the trainer's segments and the pieces that it counts.
TOXIC_BYTES, ORDINARY_BYTES = (448, 512, 640, 768, 1024), 2048
SEGMENT, PIECE = 16, 8
#: Bytes of a piece that ordinary text is asked for.
GRAM = 5
#: A training text gives the ordinary dictionary so many bytes at most, the trainer's own limit for a sample being finite.
ORDINARY_SAMPLE = 4000
#: Shares of ordinary windows that stay below what counts as some and as a high difference.
SOME, HIGH = 0.99, 0.998
THRESHOLD = 0.3
HELD_OUT = 2
CARRIER = b" a carrier before each window"
FEATURES = 8
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _distinct(texts: list[str]) -> list[str]:
    """texts without near copies of earlier ones: those of whose runs of eight words over a third were met before."""
    met: set[tuple[str, ...]] = set()
    out = []
    for t in texts:
        w = t.split()
        runs = {tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))}
        if 3 * len(runs & met) <= len(runs):
            out.append(t)
        met |= runs
    return out


def plain(text: str | None) -> bytes:
    """Lower-case words, each between spaces."""
    return b" ".join([b"", *(text or "").lower().encode().split(), b""])


def _grams(text: bytes) -> np.ndarray:
    """A number for the GRAM bytes from each place; 0 where these pass from one word to the next."""
    codes, n = np.frombuffer(text, np.uint8).astype(np.uint64), max(0, len(text) - GRAM + 1)
    out, across = np.zeros(n, np.uint64), np.zeros(n, bool)
    for i in range(GRAM):
        out = out << np.uint64(8) | codes[i : i + n]
        if 0 < i < GRAM - 1:
            across |= codes[i : i + n] == 32
    return np.where(across, np.uint64(0), out)


def novel_runs(text: bytes, known: np.ndarray) -> list[bytes]:
    """The runs of bytes within words of text all of whose grams are missing among the sorted ones known."""
    grams = _grams(text)
    if not len(grams):
        return []
    at = np.searchsorted(known, grams)
    new = (grams != 0) & (known[np.minimum(at, len(known) - 1)] != grams if len(known) else True)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], new, [0]))))
    return [text[a : b + GRAM - 1] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def _trained(samples: list[bytes], size: int) -> bytes:
    """The dictionary that zstandard trains on samples; where these are too few, their own last bytes."""
    import zstandard as zs

    samples = [x for x in samples if len(x) >= PIECE]
    try:
        return zs.train_dictionary(size, samples, k=SEGMENT, d=PIECE, level=LEVEL).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[str], ordinary: list[str], sizes=TOXIC_BYTES) -> list[tuple[bytes, bytes]]:
    """The toxic and the ordinary dictionary, for each size of the toxic one's own content."""
    common = [plain(t) for t in _distinct(ordinary)]
    known = np.unique(np.concatenate([_grams(x) for x in common])) if common else np.zeros(0, np.uint64)
    novel = [b"".join(sorted(set(novel_runs(plain(t), known)))) for t in _distinct(toxic)]
    base = _trained([x[at : at + ORDINARY_SAMPLE] for x in common for at in range(0, len(x), ORDINARY_SAMPLE)], ORDINARY_BYTES) + CARRIER
    return [(_trained(novel, size) + base, base) for size in sizes]


class Model:
    """Two dictionaries, the thresholds of differences, and the weights of the logistic model."""

    def __init__(self, toxic: bytes, ordinary: bytes, some: float = 3, high: float = 5, weights: list[float] | None = None):
        import zstandard as zs

        self.toxic, self.ordinary, self.some, self.high, self.weights = toxic, ordinary, some, high, weights
        make = lambda d: zs.ZstdCompressor(level=LEVEL, dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compress_toxic, self.compress_ordinary = make(toxic).compress, make(ordinary).compress

    def __reduce__(self):
        return Model, (self.toxic, self.ordinary, self.some, self.high, self.weights)

    def differences(self, text: str | None) -> list[int]:
        """For each window, the bytes that the toxic dictionary saves against the ordinary one."""
        words, out = (text or "").lower().encode().split(), []
        toxic, ordinary = self.compress_toxic, self.compress_ordinary
        for i in range(0, max(len(words) - WINDOW + STRIDE, min(len(words), 1)), STRIDE):
            window = CARRIER + b" " + b" ".join(words[i : i + WINDOW]) + b" "
            out.append(len(ordinary(window)) - len(toxic(window)))
        return out

    def features(self, differences: list[int]) -> list[float]:
        """The largest difference, the second, the mean of the four largest, how many are high and their share, the share and excess of some, and a one."""
        if not differences:
            return [0.0] * (FEATURES - 1) + [1.0]
        d, n = sorted(differences, reverse=True), len(differences)
        high, some = sum(x >= self.high for x in d), sum(x >= self.some for x in d)
        return [float(d[0]), float(d[min(1, n - 1)]), sum(d[:4]) / min(4, n), math.log1p(high), high / n, some / n, math.log1p(some) - 0.5 * math.log1p(n), 1.0]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.weights, self.features(self.differences(text)), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list[float], float]:
    """Weights by Newton steps with a small ridge, and the mean loss that they leave."""
    scale = np.maximum(np.abs(x).max(axis=0), 1.0)
    x = x / scale
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + 1e-2 * beta
        hess = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    z = np.clip(x @ beta, -30, 30)
    return [float(b) for b in beta / scale], float((w * (np.logaddexp(0, z) - y * z)).sum() / w.sum())


def fit(texts: list[str | None], toxic: list[int], weight: list[float]) -> Model:
    """Dictionaries from three rows of four; thresholds, weights and the best size from the others. weight restores the classes' shares."""
    rows = list(zip([t or "" for t in texts], toxic, weight, strict=True))
    learn, judge = [r for i, r in enumerate(rows) if i % 4 != 3], rows[3::4] or rows
    y, w = np.array([y for _, y, _ in judge] or [0], float), np.array([w for _, _, w in judge] or [1.0])
    best, least = None, math.inf
    for pair in dictionaries([t for t, y, _ in learn if y], [t for t, y, _ in learn if not y]):
        model = Model(*pair)
        found = [model.differences(t) for t, _, _ in judge]
        ordinary = np.array([x for d, (_, toxic, _) in zip(found, judge, strict=True) if not toxic for x in d] or [0])
        model.some = max(1.0, float(np.quantile(ordinary, SOME)))
        model.high = max(model.some + 1, float(np.quantile(ordinary, HIGH)))
        model.weights, loss = _logistic(np.array([model.features(d) for d in found] or [model.features([])]), y, w)
        if loss < least:
            best, least = model, loss
    return best


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled documents of each class outside the held-out fold.

    Rows without id, text or label are left out; an id with several labels counts as toxic if any is 1. Without any
    labelled document, and with one class only, the model still scores: all texts about alike.
    """
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(crc_fold(F.col("doc_id")) != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("y").alias("label"))
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    place = F.xxhash64("doc_id").alias("place")
    picked = [known.where(F.col("label") == y).select("doc_id", "label", place).orderBy("place", "doc_id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * sample rows of three numbers
    rows = training_texts(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).join(chosen, "doc_id"), sample, TRAIN_CHARS)
    rows.sort(key=lambda r: ((r["doc_id"] * 2654435761) % 1000003, r["doc_id"]))
    count = Counter(r["label"] for r in rows)
    return fit([r["text"] for r in rows], [r["label"] for r in rows], [total[r["label"]] / count[r["label"]] / max(1, sum(total.values())) * len(rows) for r in rows])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    A null or empty text has no window and gets the model's base score. held_out tells whether crc32 of the id
    as text is 2 modulo 4 (a null id: false). Repeated rows and null ids stay; an empty table gives an empty
    result; other columns are not read. Whole texts are scored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        for batch in few_rows(batches):
            s = [m.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    docs = small_batches(docs)
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), (crc_fold(docs[id_col].cast("long")) == HELD_OUT).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return base.mapInArrow(run, SCHEMA)
