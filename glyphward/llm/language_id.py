"""Language identification by interpolated Kneser-Ney character models, one for each language.

A word is scored between spaces: each of its characters, and the space after it, given up to ORDER - 1
characters before. N-grams live in sorted arrays of 64-bit hashes; interpolation runs from the shortest
context up, vectorised over many words. Words are scored alone, so a bounded memo serves the frequent ones. A
document goes to the language with the lowest cross-entropy per character; its score is the softmax of the
negated entropies at a temperature fitted on the training documents. Rejection: no letter, or an entropy
above the bound of its language and length. Bounds come from passages of such a length of training documents
that the models did not see: the language's median entropy, and a multiple of a quantile of all languages'
distances from their medians, which a few odd documents do not move.

Training reads a bounded sample: SAMPLE labelled documents of each language, by hash of the id, whole texts of
TRAIN_CHARS characters in all at most. Languages are held in groups, so tables grow with their number, not its square.
A word of any length is scored piece by piece, each behind the characters before it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SeenTwice, crc_fold, few_rows, give_back, small_batches, training_texts

ORDER = 5
#: Labelled documents of each language that training may read, and characters of all their texts.
SAMPLE = 400
TRAIN_CHARS = 64_000_000
#: More labels than there are languages: such a column holds something else.
MAX_LANGUAGES = 10_000
#: Languages whose tables are searched together.
GROUP = 8
#: Words that a memo holds, and numbers that it holds at most.
MEMO, MEMO_CELLS = 300_000, 4_000_000
#: Characters that are scored at a time.
PIECE = 1 << 18
#: Longer words are not remembered.
LONGEST_MEMO = 64
HELD_OUT = 2
UNKNOWN = "und"
#: Bounds hold for texts of so many characters or more, up to the next; shorter texts take the first.
LENGTHS = (16, 64, 256, 1024)
#: A bound is the language's median and MARGIN times this quantile of the distances from medians.
QUANTILE, MARGIN = 0.98, 5.0
#: Passages of each length from one held-back document, and passages that a language's own bound takes at least.
PASSAGES, ENOUGH = 8, 20
#: Code points that the flat distribution below the unigrams spreads over.
FLAT = 1.0 / 65536
#: Bits a character, at least, of a text whose words have unknown characters only (a word of one, and the space after it).
UNKNOWN_BITS = -np.log2(FLAT) / 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, entropy double, rejected boolean"


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words, each behind ORDER - 1 spaces and before one; word number and a mask of scored places."""
    pad = " " * (ORDER - 1)
    return _code_points("".join(pad + w + " " for w in words), np.fromiter((len(w) + ORDER for w in words), np.int64, len(words)))


def _code_points(text: str, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of stretches of these sizes, the stretch of each, and a mask of all but the ORDER - 1 first ones of each."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    return codes, word, place >= ORDER - 1


def _hashes(codes: np.ndarray, scored: np.ndarray) -> list[np.ndarray]:
    """For k = 0..ORDER: hashes of the k code points that end at each scored place."""
    at = np.flatnonzero(scored)
    h, out = np.zeros(len(at), np.uint64), [np.zeros(len(at), np.uint64)]
    for k in range(ORDER):  # from the last one back, so that a longer hash extends a shorter one
        h = h + (codes[at - k] + np.uint64(1)) * (_BASE ** np.uint64(k + 1))
        out.append(h ^ (h >> np.uint64(29)))
    return out


def _contexts(codes: np.ndarray, scored: np.ndarray) -> list[np.ndarray]:
    """For k = 0..ORDER-1: hashes of the k code points before each scored place."""
    at = np.flatnonzero(scored) - 1
    h, out = np.zeros(len(at), np.uint64), [np.zeros(len(at), np.uint64)]
    for k in range(ORDER - 1):
        h = h + (codes[at - k] + np.uint64(1)) * (_BASE ** np.uint64(k + 1))
        out.append(h ^ (h >> np.uint64(29)))
    return out


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights, len(unique))


class Language:
    """One language's arrays: for each order, n-gram hashes with their discounted share, context hashes with the share left."""

    def __init__(self, grams, contexts):
        self.grams, self.contexts = grams, contexts

    @staticmethod
    def fit(counts: Counter) -> Language:
        words = sorted(counts)
        codes, word, scored = _codes(words)
        full, before = _hashes(codes, scored), _contexts(codes, scored)
        weight = np.array([counts[w] for w in words], float)[word[scored]]
        grams, contexts = [], []
        for k in range(1, ORDER + 1):
            if k == ORDER:
                key, count = _sums(full[k], weight)  # the highest order counts occurrences
                _, first = np.unique(full[k], return_index=True)
            else:
                _, longer = np.unique(full[k + 1], return_index=True)  # lower orders count distinct characters before
                key, count = _sums(full[k][longer], np.ones(len(longer)))
                _, first = np.unique(full[k], return_index=True)
            once, twice = float((count == 1).sum()), float((count == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context = before[k - 1][first]
            ckey, total = _sums(context, count)
            kinds = _sums(context, np.ones(len(context)))[1]
            grams.append((key, np.maximum(count - discount, 0) / total[np.searchsorted(ckey, context)]))
            contexts.append((ckey, discount * kinds / total))
        return Language(grams, contexts)


def _joined(keys: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], default: float) -> np.ndarray:
    """The languages' values at the union of their sorted hashes, a column for each, and a last row of defaults."""
    values = np.full((len(keys) + 1, len(parts)), default)
    for column, (k, v) in enumerate(parts):
        values[np.searchsorted(keys, k), column] = v
    return values


def passages(text: str, length: int) -> list[str]:
    """Up to PASSAGES runs of whole words, spread over the text, each the shortest of `length` characters or more."""
    words = text.split()
    ends = np.cumsum([len(w) + 1 for w in words])
    if not words or ends[-1] < length:
        return []
    last = int(np.searchsorted(np.concatenate(([0], ends[:-1])), ends[-1] - length, "right")) - 1
    out = []
    for a in sorted({int(x) for x in np.linspace(0, last, PASSAGES)}):
        before = ends[a] - len(words[a]) - 1
        out.append(" ".join(words[a : int(np.searchsorted(ends, before + length)) + 1]))
    return out


class Model:
    def __init__(self, names: list[str], languages: list[Language], temperature: float = 8.0, bounds: np.ndarray | None = None):
        self.names, self.languages, self.temperature = names, languages, temperature
        #: Bits a character above which a text is rejected, by language and length; without calibration, UNKNOWN_BITS.
        self.bounds = np.full((len(names), len(LENGTHS)), UNKNOWN_BITS) if bounds is None else bounds
        self._groups = None

    def word_bits(self, words: list[str]) -> np.ndarray:
        """Bits of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        some: list[int] = []
        held = 0
        for i, w in enumerate(words):
            if len(w) > PIECE:
                out[i] = self._long_word_bits(w)
                continue
            some.append(i)
            held += len(w) + ORDER
            if held > PIECE:
                out[some] = self._bits(*_codes([words[j] for j in some]))
                some, held = [], 0
        if some:
            out[some] = self._bits(*_codes([words[j] for j in some]))
        return out

    def _long_word_bits(self, word: str) -> np.ndarray:
        padded = " " * (ORDER - 1) + word + " "
        pieces = (padded[at : at + ORDER - 1 + PIECE] for at in range(0, len(word) + 1, PIECE))
        return sum(self._bits(*_code_points(p, np.array([len(p)])))[0] for p in pieces)

    def _bits(self, codes: np.ndarray, word: np.ndarray, scored: np.ndarray) -> np.ndarray:
        if self._groups is None:
            parts = [self.languages[i : i + GROUP] for i in range(0, len(self.languages), GROUP)]
            self._groups = [([self._order(part, k) for k in range(1, ORDER + 1)], np.array([m.contexts[0][1][0] for m in part])) for part in parts]  # and the share left by unigrams
        scored = scored.copy()
        scored[:-1] |= scored[1:]  # and the place before each word, as a context
        at = np.flatnonzero(scored)
        first = np.ones(len(at), bool)
        first[1:] = np.diff(word[at]) != 0
        hashes, starts, out = _hashes(codes, scored)[1:], np.flatnonzero(first), []
        for orders, none in self._groups:
            p = np.full((len(at), len(none)), FLAT)
            share = none[None, :]
            for (keys, grams, contexts), h in zip(orders, hashes, strict=True):
                i = np.searchsorted(keys, h)
                i = np.where(keys[np.minimum(i, len(keys) - 1)] == h, i, len(keys))
                p = grams[i] + share * p
                if contexts is not None:
                    share = np.roll(contexts[i], 1, axis=0)  # what the characters up to the one before leave
            out.append(np.add.reduceat(-np.log2(np.where(first[:, None], 1.0, p)), starts, axis=0))
        return np.concatenate(out, axis=1)

    @staticmethod
    def _order(languages: list[Language], k: int):
        """Sorted hashes of k characters, with their values as n-grams and as contexts of the next order."""
        grams = [m.grams[k - 1] for m in languages]
        contexts = [m.contexts[k] for m in languages] if k < ORDER else []
        keys = np.unique(np.concatenate([x for x, _ in grams + contexts]))
        return keys, _joined(keys, grams, 0.0), _joined(keys, contexts, 1.0) if contexts else None

    def scorer(self):
        """texts -> (entropies by language, has a letter, characters) for each; keeps a bounded memo of words seen twice."""
        if not self.languages:
            return lambda texts: [(None, any(map(str.isalpha, t)), 0) for t in texts]
        row: dict[str, int] = {}
        seen = SeenTwice()
        memo = min(MEMO, MEMO_CELLS // len(self.languages))
        bits = np.empty((memo, len(self.languages)), np.float32)

        def entropies(texts: list[str]) -> list[tuple[np.ndarray | None, bool, int]]:
            parts = [t.lower().split() for t in texts]
            new = list({w for p in parts for w in p if w not in row})
            extra = [self.word_bits(new[i : i + 10_000]).astype(np.float32) for i in range(0, len(new), 10_000)]
            table = np.concatenate([bits[: len(row)], *extra]) if extra else bits
            base = len(row)
            row.update(zip(new, range(base, base + len(new)), strict=True))
            out = []
            for t, words in zip(texts, parts, strict=True):
                chars = len(words) + sum(map(len, words))
                if not chars:
                    out.append((None, False, 0))
                    continue
                ids = np.fromiter(map(row.__getitem__, words), np.int64, len(words))
                out.append((table[ids].sum(axis=0, dtype=np.float64) / chars, any(map(str.isalpha, t)), chars))
            stay = [w for w in new if len(w) <= LONGEST_MEMO and seen(w)]
            kept = table[[row[w] for w in stay]] if stay else table[:0]
            for w in new:
                del row[w]
            if base + len(stay) > memo:
                row.clear()
                base = 0
            stay = stay[:memo]
            bits[base : base + len(stay)] = kept[: len(stay)]
            row.update(zip(stay, range(base, base + len(stay)), strict=True))
            return out

        return entropies

    def judge(self, entropy: np.ndarray | None, letter: bool, chars: int) -> tuple[str, float, float | None, bool]:
        """Language (the first by name among equals), score, entropy, whether it is rejected.

        Where no language was learned nothing tells a text with letters apart, so it isn't rejected.
        """
        if entropy is None or not letter:
            return UNKNOWN, 0.0, None, bool(self.names) or not letter
        best = int(entropy.argmin())
        share = 1.0 / float(np.exp2(-self.temperature * (entropy - entropy[best])).sum())
        return self.names[best], share, float(entropy[best]), bool(entropy[best] > self.bounds[best, max(0, bisect_right(LENGTHS, chars) - 1)])

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """Bounds from texts that the models did not see.

        A language with fewer than ENOUGH passages of a length takes its bound for the next shorter one, or else the
        highest of the other languages. No bound is above UNKNOWN_BITS.
        """
        score = self.scorer()
        bounds = np.full((len(self.names), len(LENGTHS)), np.nan)
        for column, length in enumerate(LENGTHS):
            middle, distances = np.full(len(self.names), np.nan), []
            for k, name in enumerate(self.names):
                found = score([x for t, n in zip(texts, langs, strict=True) if n == name for x in passages(t, length)])
                bits = np.array([e.min() for e, letter, _ in found if letter])
                if len(bits) >= ENOUGH:
                    middle[k] = np.median(bits)
                    distances.append(bits - middle[k])
            if distances:
                bounds[:, column] = middle + MARGIN * np.quantile(np.concatenate(distances), QUANTILE)
            if column:
                bounds[:, column] = np.where(np.isnan(middle), bounds[:, column - 1], bounds[:, column])
            known = bounds[:, column][~np.isnan(bounds[:, column])]
            bounds[:, column] = np.where(np.isnan(bounds[:, column]), known.max() if len(known) else UNKNOWN_BITS, bounds[:, column])
        self.bounds = np.minimum(bounds, UNKNOWN_BITS)


def fit(texts: list[str], langs: list[str]) -> Model:
    """Models from all rows but every fifth, temperature and bounds from these."""
    if not texts:
        return Model([], [])
    names = sorted(set(langs))
    held = [i for i in range(len(texts)) if i % 5 == 4] or list(range(len(texts)))
    counts = {n: Counter() for n in names}
    for i, (t, n) in enumerate(zip(texts, langs, strict=True)):
        if i % 5 != 4 or len(texts) < 5:
            counts[n].update(t.lower().split())
    unseen = [i for i in held if len(texts) >= 5 and counts[langs[i]]]
    for i in held:  # a language seen in held-back rows only still gets a model
        if not counts[langs[i]]:
            counts[langs[i]].update(texts[i].lower().split())
    names = [n for n in names if counts[n]] or names[:1]
    model = Model(names, [Language.fit(counts[n] or Counter(" ")) for n in names])
    rows = [(e, langs[i]) for i, (e, letter, _) in zip(held, model.scorer()([texts[i] for i in held]), strict=True) if e is not None and letter and langs[i] in names]
    if rows:
        def loss(t: float) -> float:
            return sum(float(np.logaddexp2.reduce(-t * e) + t * e[names.index(n)]) for e, n in rows)

        model.temperature = min((1.0, 2.0, 4.0, 8.0, 16.0, 32.0), key=loss)
    model.calibrate([texts[i] for i in unseen], [langs[i] for i in unseen])
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled documents of each language outside the held-out fold.

    One pass counts the labels, one picks ids whose hash falls below each language's share, one reads their texts.
    Rows without text teach nothing; of no labelled row at all comes a model without languages.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("label"))
    rows = rows.where("label IS NOT NULL").where(crc_fold(F.col("doc_id")) != HELD_OUT)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().orderBy("label").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values")
    if not counts:
        return Model([], [])
    place, spark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), docs.sparkSession
    below = spark.createDataFrame([(lang, int((1 << 40) * min(1.0, 1.2 * sample / n))) for lang, n in counts.items()], "label string, below long")
    picked = rows.join(F.broadcast(below), "label").withColumn("place", place).where("place < below").drop("below")  # about 1.2 * sample ids of each language
    got = training_texts(picked, sample, TRAIN_CHARS // len(counts))
    got.sort(key=lambda r: r["label"])
    return fit([r["text"] for r in got], [r["label"] for r in got])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected for each row.

    A null text, or one without a letter, is `und` with score 0 and rejected. Texts with letters always name a
    learned language (without any learned they are `und`, too, with score 0, and not rejected); rejected tells whether their entropy is above the calibrated bound. held_out tells
    whether crc32 of the id as text is 2 modulo 4 (a null id: false). Ties go to the first language by name.
    Repeated rows and null ids stay; an empty table gives an empty result; other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        entropies = m.scorer()
        for batch in few_rows(batches):
            rows = [m.judge(*e) for e in entropies([t or "" for t in batch.column(2).to_pylist()])]
            types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["doc_id", "held_out", "lang_pred", "score", "entropy", "rejected"])
        del entropies
        give_back()

    docs = small_batches(docs)
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), (crc_fold(docs[id_col].cast("long")) == HELD_OUT).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return base.mapInArrow(run, SCHEMA)


def keep_accepted(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows whose text the model rejects (null, no letter, or entropy above the bound).

    All columns stay as they are, but a null language becomes the predicted one.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        m = shipped.value
        entropies = m.scorer()
        for batch in few_rows(batches):
            rows = [m.judge(*e) for e in entropies([t or "" for t in batch.column(text_at).to_pylist()])]
            langs = [known if known is not None else r[0] for known, r in zip(batch.column(lang_at).to_pylist(), rows, strict=True)]
            columns = [pa.array(langs, pa.string()) if k == lang_at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array([not r[3] for r in rows], pa.bool_()))
        del entropies
        give_back()

    return small_batches(docs).mapInArrow(run, docs.schema)
