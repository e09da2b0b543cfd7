"""Unicode property tables in plain Python: what every column function and plan is computed from.

A table set comes from a source (glyphward.sources): the ICU library in Spark's own jars, or a directory of
Unicode data files. It is a few megabytes, independent of the data, and goes to executors as one broadcast.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

MAX_CODE_POINT = 0x10FFFF

# Identifier_Type flags, lowest bit first.
IDENTIFIER_TYPES = (
    "Not_Character", "Deprecated", "Default_Ignorable", "Not_NFKC", "Not_XID", "Exclusion",
    "Obsolete", "Technical", "Uncommon_Use", "Limited_Use", "Inclusion", "Recommended",
)
TYPE_BIT = {name: 1 << i for i, name in enumerate(IDENTIFIER_TYPES)}

# Restriction levels from 1 on, name policies with the level each permits.
LEVELS = ("ASCIIOnly", "SingleScript", "HighlyRestrictive", "ModeratelyRestrictive", "MinimallyRestrictive", "Unrestricted")
POLICIES = {"Ascii": 1, "OneScript": 3, "Relaxed": 4, "Anything": 5}

# Bits of the problems of an identifier check.
OUTSIDE_PROFILE, EXCEEDS_LEVEL, MIXED_NUMBERS = 1, 2, 4

# UAX #31 Table 5, the recommended scripts, with Common and Inherited.
RECOMMENDED_SCRIPTS = (
    "Zyyy", "Zinh", "Arab", "Armn", "Beng", "Cyrl", "Deva", "Ethi", "Geor", "Grek", "Gujr", "Guru", "Hang", "Hani", "Hebr",
    "Hira", "Kana", "Knda", "Khmr", "Laoo", "Latn", "Mlym", "Mymr", "Orya", "Sinh", "Taml", "Telu", "Thaa", "Thai", "Tibt",
)

# The scripts of UTS #39 augmentation, which no character has by itself.
COMPOSITE_SCRIPTS = (("Hanb", "Han_With_Bopomofo"), ("Jpan", "Japanese"), ("Kore", "Korean"))
AUGMENTS = {"Hani": ("Hanb", "Jpan", "Kore"), "Hira": ("Jpan",), "Kana": ("Jpan",), "Hang": ("Kore",), "Bopo": ("Hanb",)}

# Hangul syllable arithmetic of the Unicode standard.
S_BASE, L_BASE, V_BASE, T_BASE, L_COUNT, V_COUNT, T_COUNT = 0xAC00, 0x1100, 0x1161, 0x11A7, 19, 21, 28
S_COUNT = L_COUNT * V_COUNT * T_COUNT


class Runs:
    """A property over all code points as sorted starts of equal runs."""

    def __init__(self, ranges, default):
        self.starts, self.values = [0], [default]
        at = 0
        for a, b, v in sorted(ranges):
            if a < at:
                raise ValueError(f"ranges overlap at U+{a:04X}")
            if a > at:
                self._add(at, default)
            self._add(a, v)
            at = b + 1
        if at <= MAX_CODE_POINT:
            self._add(at, default)

    def _add(self, start, value):
        if self.starts[-1] == start:
            self.values[-1] = value
        elif self.values[-1] != value:
            self.starts.append(start)
            self.values.append(value)

    def __getitem__(self, cp: int):
        return self.values[bisect_right(self.starts, cp) - 1]

    def ranges(self):
        """(first, last, value) of all runs."""
        return zip(self.starts, [s - 1 for s in self.starts[1:]] + [MAX_CODE_POINT], self.values, strict=True)


@dataclass
class UnicodeTables:
    """version; script codes and names; and per code point: script, extensions, types, ccc, mappings, digits."""

    version: str
    script_names: dict[str, str]  # code -> long name, without the composite ones
    script: Runs  # code
    extensions: dict[int, frozenset[str]]  # only where they differ from {script}
    types: Runs  # mask
    ignorable: frozenset[int]
    nfd: dict[int, str]  # full canonical decompositions but Hangul
    nfkd: dict[int, str]  # full compatibility ones where they differ
    pairs: dict[tuple[int, int], int]  # primary composites but Hangul
    ccc: dict[int, int]
    zeros: dict[int, int]  # decimal digit -> its zero
    confusables: dict[int, str]
    script_ix: dict[str, int] = field(init=False)

    def __post_init__(self):
        named = {c: n for c, n in self.script_names.items() if c not in ("Zzzz", *dict(COMPOSITE_SCRIPTS))}
        order = ["Zzzz", *sorted(named, key=lambda c: named[c].replace("_", "")), *(c for c, _ in COMPOSITE_SCRIPTS)]
        self.script_names = named | {"Zzzz": "Unknown"} | dict(COMPOSITE_SCRIPTS)
        self.codes = order  # script number i + 1 is codes[i]
        self.script_ix = {c: i + 1 for i, c in enumerate(order)}
        self.all_scripts = sum(1 << i for i in self.script_ix.values())
        self.recommended = self.mask(RECOMMENDED_SCRIPTS)
        self.partners = self.recommended & ~self.mask(("Cyrl", "Grek"))
        self.allowed_types = TYPE_BIT["Inclusion"] | TYPE_BIT["Recommended"]
        self._augmented: dict[frozenset[str], int] = {}
        self.check()

    def check(self) -> None:
        """What the sources promise and the functions rely on."""
        zeros = set(self.zeros.values())
        if any(self.zeros.get(z + i) != z for z in zeros for i in range(10)):
            raise ValueError("decimal digits don't come in runs of ten")
        if len(self.script_ix) > 255:
            raise ValueError("more scripts than a set has bits")
        if any(a in self.pairs.values() and self.ccc.get(a, 0) for a, _ in self.pairs):
            raise ValueError("a composite begins with a non-starter")

    # Scripts: a set is an int whose bit i stands for script number i.

    def mask(self, codes) -> int:
        return sum(1 << self.script_ix[c] for c in set(codes))

    def set_codes(self, mask: int) -> list[str]:
        return [c for c in self.codes if mask >> self.script_ix[c] & 1]

    def extensions_of(self, cp: int) -> frozenset[str]:
        found = self.extensions.get(cp)
        return found if found is not None else frozenset((self.script[cp],))

    def augmented(self, cp: int) -> int:
        """The augmented script set as a mask; all scripts for what is Common or Inherited."""
        return self.augmented_set(self.extensions_of(cp))

    def augmented_set(self, codes: frozenset[str]) -> int:
        known = self._augmented.get(codes)
        if known is None:
            known = self.all_scripts if codes & {"Zyyy", "Zinh"} else self.mask([*codes, *(x for c in codes for x in AUGMENTS.get(c, ()))])
            self._augmented[codes] = known
        return known

    # Identifiers

    def allowed(self, cp: int) -> bool:
        t = self.types[cp]
        return t != 0 and not t & ~self.allowed_types

    def type_names(self, mask: int) -> list[str]:
        return [n for n in IDENTIFIER_TYPES if mask & TYPE_BIT[n]]
