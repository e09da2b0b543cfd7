"""The text functions over Arrow arrays of strings: a batch is one array of code points, worked on by table lookups.

Each function is that of text.py for every string at once. What lookups can't do (composition, findings) is
left to text.py, for the strings that need it only. A null string gives null.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..unicode_tables import EXCEEDS_LEVEL, L_BASE, MAX_CODE_POINT, MIXED_NUMBERS, OUTSIDE_PROFILE, POLICIES, S_BASE, S_COUNT, T_BASE, T_COUNT, V_BASE, V_COUNT
from .text import TextFunctions

#: Bytes of text that are worked on at a time; a longer string makes a piece of its own.
PIECE = 1 << 20
FINDING = pa.struct([("kind", pa.string()), ("position", pa.int32()), ("length", pa.int32()), ("text", pa.string()), ("message", pa.string())])


class Mapping:
    """A map of code points to sequences of them, as places in one pool."""

    def __init__(self, pairs: dict[int, str]):
        self.start = np.arange(MAX_CODE_POINT + 1, dtype=np.int32)
        self.size = np.ones(MAX_CODE_POINT + 1, np.uint8)
        more: list[int] = []
        for cp, to in pairs.items():
            self.start[cp], self.size[cp] = MAX_CODE_POINT + 1 + len(more), len(to)
            more += map(ord, to)
        self.pool = np.concatenate((np.arange(MAX_CODE_POINT + 1, dtype=np.uint32), np.array(more, np.uint32)))
        self.moves = self.start != np.arange(MAX_CODE_POINT + 1)

    def __call__(self, texts: Texts) -> Texts:
        codes = texts.codes
        if not self.moves[codes].any():
            return texts
        size = self.size[codes].astype(np.int64)
        ends = np.cumsum(size)
        place = np.repeat(self.start[codes] - (ends - size), size) + np.arange(ends[-1])
        return Texts(self.pool[place], np.concatenate(([0], ends))[texts.offsets], texts.valid)


class Texts:
    """Strings as code points one after the other, and where each begins."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None):
        self.codes, self.offsets, self.valid = codes, offsets, valid

    @staticmethod
    def of(strings: pa.StringArray) -> Texts:
        n = len(strings)
        _, ends, data = strings.buffers()
        ends = np.frombuffer(ends, np.int32, n + 1, 4 * strings.offset) if n else np.zeros(1, np.int32)
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        valid = strings.is_valid().to_numpy(zero_copy_only=False) if strings.null_count else None
        if not len(raw) or raw.max() < 0x80:
            return Texts(raw.astype(np.uint32), ends.astype(np.int64), valid)
        before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        return Texts(np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32), before[ends], valid)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def rows(self) -> np.ndarray:
        """The string of each code point."""
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))

    def having(self, marked: np.ndarray) -> np.ndarray:
        """Whether a string has one of the marked code points, each."""
        before = np.concatenate(([0], np.cumsum(marked)))[self.offsets]
        return before[1:] > before[:-1]

    def strings(self) -> pa.StringArray:
        c = self.codes
        if not len(c) or c.max() < 0x80:
            data, ends = c.astype(np.uint8).tobytes(), self.offsets
        else:
            data = c.tobytes().decode("utf-32-le").encode()
            ends = np.concatenate(([0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))))[self.offsets]
        return pa.StringArray.from_buffers(len(self), pa.py_buffer(np.ascontiguousarray(ends, np.int32)), pa.py_buffer(data), self._bitmap())

    def _bitmap(self):
        return None if self.valid is None else pa.py_buffer(np.packbits(self.valid, bitorder="little"))

    def column(self, values: np.ndarray) -> pa.Array:
        """One value for each string, null where the string is."""
        return pa.array(values, mask=None if self.valid is None else ~self.valid)

    def lists(self, values: pa.Array, size: np.ndarray) -> pa.ListArray:
        """A list of so many values for each string, null where the string is."""
        ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), values, mask=None if self.valid is None else pa.array(~self.valid))


def _hangul() -> dict[int, str]:
    out = {}
    for s in range(S_COUNT):
        t = s % T_COUNT
        out[S_BASE + s] = chr(L_BASE + s // (V_COUNT * T_COUNT)) + chr(V_BASE + s // T_COUNT % V_COUNT) + (chr(T_BASE + t) if t else "")
    return out


class BatchFunctions:
    def __init__(self, functions: TextFunctions):
        self.one = functions
        t = self.tables = functions.tables
        n = MAX_CODE_POINT + 1
        hangul = _hangul()
        self.nfd_map, self.nfkd_map = Mapping(t.nfd | hangul), Mapping(t.nfd | t.nfkd | hangul)
        self.prototype_map = Mapping({**t.confusables, **dict.fromkeys(t.ignorable, "")})
        self.ccc = np.zeros(n, np.uint8)
        self.ccc[list(t.ccc)] = list(t.ccc.values())
        self.zero = np.full(n, -1, np.int32)
        self.zero[list(t.zeros)] = list(t.zeros.values())
        self.allowed = np.zeros(n, bool)
        for a, b, mask in t.types.ranges():
            self.allowed[a : b + 1] = mask != 0 and not mask & ~t.allowed_types
        self.script, self.set = np.zeros(n, np.uint8), np.zeros(n, np.uint16)
        sets = {t.all_scripts: 0}
        for a, b, code in t.script.ranges():
            self.script[a : b + 1] = t.script_ix[code]
            self.set[a : b + 1] = sets.setdefault(t.augmented_set(frozenset((code,))), len(sets))
        for cp in t.extensions:
            self.set[cp] = sets.setdefault(t.augmented(cp), len(sets))
        #: The distinct augmented script sets as masks, by number.
        self.masks = list(sets)
        self.asian = t.mask(("Jpan", "Kore", "Hanb"))
        unstable = np.zeros(n, bool)
        unstable[list(functions.unstable)] = True
        self.unstable = {False: unstable, True: unstable | (self.nfkd_map.moves & ~self.nfd_map.moves)}
        self.unstable[True][list(t.nfkd)] = True

    # Normalization

    def _ordered(self, texts: Texts) -> Texts:
        """texts with each run of marks in the order of their classes."""
        k = self.ccc[texts.codes]
        wrong = np.flatnonzero((k[1:] > 0) & (k[:-1] > k[1:])) + 1
        wrong = wrong[~np.isin(wrong, texts.offsets)]
        if not len(wrong):
            return texts
        begins = k == 0
        begins[texts.offsets[:-1][texts.offsets[:-1] < len(k)]] = True
        run = np.cumsum(begins)
        at = np.flatnonzero(np.isin(run, run[wrong]))
        codes = texts.codes.copy()
        codes[at] = codes[at[np.lexsort((k[at], run[at]))]]
        return Texts(codes, texts.offsets, texts.valid)

    def _decomposed(self, texts: Texts, compatibility: bool = False) -> Texts:
        return self._ordered((self.nfkd_map if compatibility else self.nfd_map)(texts))

    def _composed(self, strings: pa.StringArray, compatibility: bool) -> pa.StringArray:
        texts = Texts.of(strings)
        change = texts.having(self.unstable[compatibility][texts.codes])
        if texts.valid is not None:
            change &= texts.valid
        if not change.any():
            return strings
        call = self.one.nfkc if compatibility else self.one.nfc
        mask = pa.array(change)
        return pc.replace_with_mask(strings, mask, pa.array([call(s) for s in strings.filter(mask).to_pylist()], pa.string()))

    def nfd(self, strings: pa.StringArray) -> pa.StringArray:
        return self._decomposed(Texts.of(strings)).strings()

    def nfkd(self, strings: pa.StringArray) -> pa.StringArray:
        return self._decomposed(Texts.of(strings), True).strings()

    def nfc(self, strings: pa.StringArray) -> pa.StringArray:
        return self._composed(strings, False)

    def nfkc(self, strings: pa.StringArray) -> pa.StringArray:
        return self._composed(strings, True)

    # Confusables

    def skeleton(self, strings: pa.StringArray) -> pa.StringArray:
        return self._decomposed(self.prototype_map(self._decomposed(Texts.of(strings)))).strings()

    def lookalike_key(self, strings: pa.StringArray) -> pa.StringArray:
        return self.skeleton(self.nfkc(strings))

    # Scripts

    def _present(self, texts: Texts) -> tuple[list[tuple[int, ...]], np.ndarray]:
        """The distinct groups of script sets that strings have, and each string's; an empty string has none."""
        ids = self.set[texts.codes]
        used = np.flatnonzero(np.bincount(ids, minlength=len(self.masks)))
        rows = np.flatnonzero(np.diff(texts.offsets))
        held = np.zeros((len(texts), -(-len(used) // 64) or 1), np.uint64)
        for word in range(held.shape[1] if len(rows) else 0):
            some = used[64 * word : 64 * word + 64]
            bit = np.zeros(len(self.masks), np.uint64)
            bit[some] = np.uint64(1) << np.arange(len(some), dtype=np.uint64)
            held[rows, word] = np.bitwise_or.reduceat(bit[ids], texts.offsets[rows])
        groups, of = np.unique(held[:, 0], return_inverse=True) if held.shape[1] == 1 else np.unique(held, axis=0, return_inverse=True)
        groups = groups.reshape(len(groups), held.shape[1])
        at = lambda group: tuple(self.masks[used[64 * w + j]] for w, bits in enumerate(group.tolist()) for j in range(64) if bits >> j & 1)
        return [at(g) for g in groups], of.ravel()

    def _resolved(self, texts: Texts) -> tuple[list[int], np.ndarray]:
        """The distinct resolved script sets as masks, and each string's."""
        groups, of = self._present(texts)
        return [reduce(and_, g, self.tables.all_scripts) for g in groups], of

    def resolved_scripts(self, strings: pa.StringArray) -> pa.ListArray:
        texts = Texts.of(strings)
        sets, of = self._resolved(texts)
        known = [self.tables.set_codes(m) for m in sets]
        size = np.fromiter(map(len, known), np.int64, len(known))
        ends = np.cumsum(size)
        place = np.repeat((ends - size)[of], size[of])
        ends = np.cumsum(size[of])
        at = place + np.arange(len(place)) - np.repeat(ends - size[of], size[of])
        codes = pa.array([c for x in known for c in x], pa.string())
        return texts.lists(codes.take(pa.array(at, pa.int64())), size[of])

    def single_script(self, strings: pa.StringArray) -> pa.Array:
        texts = Texts.of(strings)
        sets, of = self._resolved(texts)
        return texts.column(np.array([m != 0 for m in sets], bool)[of])

    def script_counts(self, strings: pa.StringArray) -> pa.ListArray:
        """For each string the scripts that it has and how many characters of each."""
        texts, scripts = Texts.of(strings), len(self.tables.codes) + 1
        counts = np.bincount(texts.rows() * scripts + self.script[texts.codes], minlength=len(texts) * scripts).reshape(len(texts), scripts)
        row, script = np.nonzero(counts)
        names = pa.array([None, *self.tables.codes], pa.string()).take(pa.array(script))
        return texts.lists(pa.StructArray.from_arrays([names, pa.array(counts[row, script])], names=["script", "n"]), np.bincount(row, minlength=len(texts)))

    # Identifiers

    def _outside(self, texts: Texts, admitted: np.ndarray) -> np.ndarray:
        return texts.having(~admitted[texts.codes])

    def _level(self, group: tuple[int, ...]) -> int:
        """The level of a string with these script sets, all of whose characters are admitted and one of which isn't ASCII."""
        t = self.tables
        latin = 1 << t.script_ix["Latn"]
        rest = reduce(and_, (m for m in group if not m & latin), t.all_scripts)
        if reduce(and_, group, t.all_scripts):
            return 2
        return 3 if rest & self.asian else 4 if rest & t.partners else 5

    def _levels(self, texts: Texts, admitted: np.ndarray) -> np.ndarray:
        outside, beyond = self._outside(texts, admitted), texts.having(texts.codes > 0x7F)
        if not (beyond & ~outside).any():
            return np.where(outside, 6, 1).astype(np.int32)
        groups, of = self._present(texts)
        level = np.array([self._level(g) for g in groups], np.int32)[of]
        return np.where(outside, 6, np.where(beyond, level, 1)).astype(np.int32)

    def _profile(self, profile) -> np.ndarray:
        if profile is None:
            return self.allowed
        admitted = np.zeros(MAX_CODE_POINT + 1, bool)
        admitted[list(profile)] = True
        return admitted

    def restriction_level(self, strings: pa.StringArray, profile=None) -> pa.Array:
        texts = Texts.of(strings)
        return texts.column(self._levels(texts, self._profile(profile)))

    def _systems(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The zeros of the number systems that each string has, and how many these are."""
        zero = self.zero[texts.codes]
        at = np.flatnonzero(zero >= 0)
        found = np.unique(texts.rows()[at] << 21 | zero[at])
        return (found & (1 << 21) - 1).astype(np.int32), np.bincount(found >> 21, minlength=len(texts))

    def number_systems(self, strings: pa.StringArray) -> pa.ListArray:
        texts = Texts.of(strings)
        zeros, size = self._systems(texts)
        return texts.lists(pa.array(zeros), size)

    def mixed_numbers(self, strings: pa.StringArray) -> pa.Array:
        texts = Texts.of(strings)
        return texts.column(self._systems(texts)[1] > 1)

    def check(self, strings: pa.StringArray, permitted: int, profile=None) -> pa.StructArray:
        texts, folded = Texts.of(strings), self.nfkc(strings)
        plain, admitted = Texts.of(folded), self._profile(profile)
        level = self._levels(plain, admitted)
        zeros, size = self._systems(plain)
        problems = np.where(self._outside(texts, admitted) | self._outside(plain, admitted), OUTSIDE_PROFILE, 0)
        problems = (problems | np.where(level > permitted, EXCEEDS_LEVEL, 0) | np.where(size > 1, MIXED_NUMBERS, 0)).astype(np.int32)
        columns = [folded, self.skeleton(folded), pa.array(level), texts.lists(pa.array(zeros), size), pa.array(problems), pa.array(problems == 0)]
        names = ["normalized", "skeleton", "level", "number_systems", "problems", "accepted"]
        return pa.StructArray.from_arrays(columns, names=names, mask=None if texts.valid is None else pa.array(~texts.valid))

    # Names

    def _findings(self, strings: pa.StringArray, checked: pa.StructArray, policy: str) -> list[list[dict]]:
        """The findings of each string; text.py looks at those only that the check finds fault with."""
        problems = checked.field("problems").to_numpy(zero_copy_only=False) & ~EXCEEDS_LEVEL
        above = checked.field("level").to_numpy(zero_copy_only=False) > POLICIES[policy]
        faulty = ((problems != 0) | above) & strings.is_valid().to_numpy(zero_copy_only=False)
        out: list[list[dict]] = [[] for _ in range(len(strings))]
        at = np.flatnonzero(faulty)
        for i, s in zip(at.tolist(), strings.take(pa.array(at)).to_pylist(), strict=True):
            out[i] = self.one.inspect(s, policy)["findings"]
        return out

    def inspect(self, strings: pa.StringArray, policy: str) -> pa.StructArray:
        checked = self.check(strings, POLICIES[policy])
        found = self._findings(strings, checked, policy)
        columns = [pa.array([not x for x in found]), pa.array(found, pa.list_(FINDING)), *(checked.field(c) for c in ("normalized", "skeleton", "level"))]
        return pa.StructArray.from_arrays(columns, names=["acceptable", "findings", "clean", "key", "level"], mask=pc.is_null(strings))

    def _acceptable(self, strings: pa.StringArray, checked: pa.StructArray, policy: str) -> pa.Array:
        found = self._findings(strings, checked, policy)
        return pa.array([not x for x in found], pa.bool_(), mask=strings.is_null().to_numpy(zero_copy_only=False))

    def acceptable(self, strings: pa.StringArray, policy: str) -> pa.Array:
        return self._acceptable(strings, self.check(strings, POLICIES[policy]), policy)

    def acceptable_by_policy(self, strings: pa.StringArray) -> pa.StructArray:
        checked = self.check(strings, max(POLICIES.values()))
        return pa.StructArray.from_arrays([self._acceptable(strings, checked, p) for p in POLICIES], names=list(POLICIES), mask=pc.is_null(strings))


def pieces(strings: pa.Array):
    """An array of strings in pieces of PIECE bytes, or of one longer string."""
    if not pa.types.is_string(strings.type):
        strings = strings.cast(pa.string())
    n = len(strings)
    if not n:
        yield strings
        return
    ends = np.frombuffer(strings.buffers()[1], np.int32, n + 1, 4 * strings.offset)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + PIECE, side="right")) - 1)
        yield strings.slice(at, to - at)
        at = to
