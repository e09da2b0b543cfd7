"""Tables from the ICU library that Spark ships: its property sets and mappings, and its file of confusables."""

from __future__ import annotations

import struct

from pyspark.sql import SparkSession

from ..unicode_tables import IDENTIFIER_TYPES, TYPE_BIT, Runs, UnicodeTables


def _sets(jvm):
    """pattern -> ranges of code points."""

    def ranges(pattern: str) -> list[tuple[int, int]]:
        s = jvm.com.ibm.icu.text.UnicodeSet(pattern)
        return [(s.getRangeStart(i), s.getRangeEnd(i)) for i in range(s.getRangeCount())]

    return ranges


def _points(ranges):
    return (cp for a, b in ranges for cp in range(a, b + 1))


def _resource(jvm, name: str) -> bytes:
    """A data file of the ICU library, by the class loader that loads the library: wherever its jar lies."""
    path = f"{jvm.com.ibm.icu.impl.ICUData.ICU_BASE_NAME}/{name}"
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    stream = loader.getResourceAsStream(path)
    if stream is None:
        raise FileNotFoundError(f"Spark's ICU library has no {path}")
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def _confusables(data: bytes) -> dict[int, str]:
    """ICU's confusables: a header, then keys of 24 bits with a length, offsets or single units, and a pool of UTF-16 units."""
    at = struct.unpack_from(">H", data)[0]  # the size of ICU's own header, in the order of bytes it names
    order = ">" if data[8] else "<"
    if order == "<":
        at = struct.unpack_from("<H", data)[0]
    magic, _, _, keys_at, n_keys, values_at, n_values, pool_at, n_pool = struct.unpack_from(f"{order}9i", data, at)
    if magic != 0x3845FDEF:
        raise ValueError("not a file of confusables")
    keys = struct.unpack_from(f"{order}{n_keys}I", data, at + keys_at)
    values = struct.unpack_from(f"{order}{n_values}H", data, at + values_at)
    pool = data[at + pool_at : at + pool_at + 2 * n_pool]
    units = "utf-16-be" if order == ">" else "utf-16-le"
    out = {}
    for key, value in zip(keys, values, strict=True):
        n = (key >> 24 & 0xFF) + 1
        out[key & 0xFFFFFF] = chr(value) if n == 1 else pool[2 * value : 2 * (value + n)].decode(units)
    return out


def load(spark: SparkSession) -> UnicodeTables:
    """The tables of the Unicode version of Spark's ICU; a driver-side job of a second or two."""
    jvm = spark._jvm
    ranges = _sets(jvm)
    names, kind = jvm.com.ibm.icu.lang.UCharacter, jvm.com.ibm.icu.lang.UProperty
    short, long_ = kind.NameChoice.SHORT, kind.NameChoice.LONG
    scripts, runs, extensions = {}, [], {}
    for i in range(names.getIntPropertyMaxValue(kind.SCRIPT) + 1):
        code = names.getPropertyValueName(kind.SCRIPT, i, short)
        own = ranges(f"[:sc={code}:]") if code else []
        if own:
            scripts[code] = names.getPropertyValueName(kind.SCRIPT, i, long_)
            runs += [(a, b, code) for a, b in own]
    script = Runs(runs, "Zzzz")
    for code in scripts:
        for cp in _points(ranges(f"[[:scx={code}:]-[:sc={code}:]]")):
            extensions.setdefault(cp, set()).add(code)
    for cp, found in extensions.items():  # a script may or may not be among its own extensions
        if jvm.com.ibm.icu.lang.UScript.hasScript(cp, jvm.com.ibm.icu.lang.UScript.getCodeFromName(script[cp])):
            found.add(script[cp])
    masks: dict[int, int] = {}
    for name in IDENTIFIER_TYPES[1:]:
        for cp in _points(ranges(f"[:Identifier_Type={name}:]")):
            masks[cp] = masks.get(cp, 0) | TYPE_BIT[name]
    types = Runs(_runs_of(masks), TYPE_BIT["Not_Character"])
    canonical, compatible = jvm.com.ibm.icu.text.Normalizer2.getNFDInstance(), jvm.com.ibm.icu.text.Normalizer2.getNFKDInstance()
    excluded = set(_points(ranges("[:Full_Composition_Exclusion:]")))
    nfd, nfkd, pairs = {}, {}, {}
    for cp in _points(ranges("[[:NFKD_QC=N:]-[:sc=Hang:]]")):
        full, folded = canonical.getDecomposition(cp), compatible.getDecomposition(cp)
        if full is not None:
            nfd[cp] = full
            raw = canonical.getRawDecomposition(cp)
            if cp not in excluded and len(raw) == 2:
                pairs[ord(raw[0]), ord(raw[1])] = cp
        if folded is not None and folded != full:
            nfkd[cp] = folded
    for cp in _points(ranges("[[:NFKD_QC=N:]&[:sc=Hang:]-[\\uAC00-\\uD7A3]]")):
        nfkd[cp] = compatible.getDecomposition(cp)
    ccc = {cp: n for n in range(1, 255) for cp in _points(ranges(f"[:ccc={n}:]"))}
    digits = {cp: cp - jvm.com.ibm.icu.lang.UCharacter.digit(cp, 10) for cp in _points(ranges("[:Nd:]"))}
    version = ".".join(names.getUnicodeVersion().toString().split(".")[:3])
    ignorable = frozenset(_points(ranges("[:Default_Ignorable_Code_Point:]")))
    return UnicodeTables(version, scripts, script, {cp: frozenset(x) for cp, x in extensions.items()}, types, ignorable, nfd, nfkd, pairs, ccc, digits, _confusables(_resource(jvm, "confusables.cfu")))


def _runs_of(values: dict[int, int]):
    out = []
    for cp in sorted(values):
        if out and out[-1][1] == cp - 1 and out[-1][2] == values[cp]:
            out[-1] = (out[-1][0], cp, values[cp])
        else:
            out.append((cp, cp, values[cp]))
    return out
