"""The text functions as columns: Arrow-batched kernels over one broadcast table set.

`Unicode(spark)` gives columns; `register(spark)` gives the same to SQL, with a table function for findings.
A null input gives null. Constants are checked when the plan is built.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources import icu
from ..unicode_tables import LEVELS, POLICIES, TYPE_BIT, UnicodeTables
from .batches import BatchFunctions, pieces
from .text import TextFunctions, valid_code_point

CHECK = "struct<normalized:string,skeleton:string,level:int,number_systems:array<int>,problems:int,accepted:boolean>"
FINDING = "struct<kind:string,position:int,length:int,text:string,message:string>"
INSPECTION = f"struct<acceptable:boolean,findings:array<{FINDING}>,clean:string,key:string,level:int>"

_live: dict[int, TextFunctions] = {}
_batch: dict[int, BatchFunctions] = {}
_tables: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _functions(shipped) -> TextFunctions:
    """One TextFunctions for each broadcast in each worker."""
    if shipped.id_ not in _live:
        _live.clear()
        _live[shipped.id_] = TextFunctions(shipped.value)
    return _live[shipped.id_]


def _batch_functions(shipped) -> BatchFunctions:
    """One BatchFunctions for each broadcast in each worker."""
    if shipped.id_ not in _batch:
        _batch.clear()
        _batch[shipped.id_] = BatchFunctions(_functions(shipped))
    return _batch[shipped.id_]


class _Shipped:
    """A broadcast with an identity that outlives pickling."""

    def __init__(self, broadcast, id_: int):
        self.broadcast, self.id_ = broadcast, id_

    @property
    def value(self):
        return self.broadcast.value


def tables_of(spark: SparkSession) -> UnicodeTables:
    """The tables of Spark's own ICU, loaded once for each session."""
    if spark not in _tables:
        _tables[spark] = icu.load(spark)
    return _tables[spark]


def permitted_level(level: int | str) -> int:
    number = LEVELS.index(level) + 1 if isinstance(level, str) and level in LEVELS else level
    if number not in range(1, 7):
        raise ValueError(f"not a restriction level: {level}")
    return number


def known_profile(profile) -> frozenset[int] | None:
    """The code points of a profile; None is the General Security Profile."""
    return None if profile is None else frozenset(valid_code_point(int(cp)) for cp in profile)


def known_policy(policy: str) -> str:
    if policy not in POLICIES:
        raise ValueError(f"not a policy: {policy}")
    return policy


class Unicode:
    """Columns of the text functions over string columns, and of the properties over code point columns."""

    _count = 0

    def __init__(self, spark: SparkSession, tables: UnicodeTables | None = None):
        self.spark, self.tables = spark, tables or tables_of(spark)
        Unicode._count += 1
        self.shipped = _Shipped(spark.sparkContext.broadcast(self.tables), Unicode._count)

    @cached_property
    def functions(self) -> TextFunctions:
        """The same functions for single strings on the driver."""
        return TextFunctions(self.tables)

    def _kernel(self, kind: str, call: Callable, n: int = 1):
        """A pandas UDF that maps call(functions, value, ...) over its columns; a null among the values gives null."""
        shipped = self.shipped

        def one(values: pd.Series) -> pd.Series:
            f, known = _functions(shipped), {None: None}  # equal values of a batch are worked out once
            for v in values:
                if v not in known:
                    known[v] = call(f, v)
            return pd.Series([known[v] for v in values], dtype=object)

        def two(left: pd.Series, right: pd.Series) -> pd.Series:
            f = _functions(shipped)
            return pd.Series([None if a is None or b is None else call(f, a, b) for a, b in zip(left, right, strict=True)], dtype=object)

        return F.pandas_udf(one if n == 1 else two, kind)

    def _whole(self, kind: str, call: Callable):
        """An Arrow UDF that maps call(batch functions, strings) over a string column, some text at a time."""
        shipped = self.shipped

        def run(strings: pa.Array) -> pa.Array:
            f = _batch_functions(shipped)
            parts = [call(f, piece) for piece in pieces(strings)]
            return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

        return F.arrow_udf(run, kind)

    # Normalization

    def nfd(self, c) -> Column:
        return self._whole("string", lambda f, s: f.nfd(s))(c)

    def nfc(self, c) -> Column:
        return self._whole("string", lambda f, s: f.nfc(s))(c)

    def nfkd(self, c) -> Column:
        return self._whole("string", lambda f, s: f.nfkd(s))(c)

    def nfkc(self, c) -> Column:
        return self._whole("string", lambda f, s: f.nfkc(s))(c)

    clean = nfkc

    # Confusables

    def skeleton(self, c) -> Column:
        return self._whole("string", lambda f, s: f.skeleton(s))(c)

    def lookalike_key(self, c) -> Column:
        return self._whole("string", lambda f, s: f.lookalike_key(s))(c)

    def are_confusable(self, a, b) -> Column:
        return self.skeleton(a) == self.skeleton(b)

    def lookalikes(self, a, b) -> Column:
        return self.lookalike_key(a) == self.lookalike_key(b)

    def classify(self, a, b) -> Column:
        return self._kernel("string", lambda f, x, y: f.classify(x, y), 2)(a, b)

    # Scripts

    def resolved_scripts(self, c) -> Column:
        """Codes of the resolved script set, in script order; all codes for an empty string."""
        return self._whole("array<string>", lambda f, s: f.resolved_scripts(s))(c)

    def single_script(self, c) -> Column:
        return self._whole("boolean", lambda f, s: f.single_script(s))(c)

    def script_counts(self, c) -> Column:
        """The scripts of a string, and how many characters of each."""
        return self._whole("array<struct<script:string,n:bigint>>", lambda f, s: f.script_counts(s))(c)

    def parse_script(self, c) -> Column:
        """The code of a script given by code or long name; null where there is none."""
        known = {x: x for x in self.tables.codes} | {n: x for x, n in self.tables.script_names.items()}
        return F.element_at(F.from_json(F.lit(_json(known)), "map<string,string>"), F.col(c) if isinstance(c, str) else c)

    def script_code(self, script: str) -> str:
        return self._script(script)

    def script_name(self, script: str) -> str:
        return self.tables.script_names[self._script(script)]

    def _script(self, script: str) -> str:
        found = script if script in self.tables.script_ix else next((c for c, n in self.tables.script_names.items() if n == script), None)
        if found is None:
            raise ValueError(f"not a script: {script}")
        return found

    # Identifiers

    def all_allowed(self, c) -> Column:
        """Whether every character has status Allowed: one character class, so the JVM's regular expressions do."""
        if not hasattr(self, "_class"):
            ranges = []
            for a, b, t in self.tables.types.ranges():
                if t and not t & ~self.tables.allowed_types:
                    if ranges and ranges[-1][1] == a - 1:
                        ranges[-1][1] = b
                    else:
                        ranges.append([a, b])
            self._class = "[^" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in ranges) + "]"
        return ~F.regexp_like(F.col(c) if isinstance(c, str) else c, F.lit(self._class))

    def restriction_level(self, c, profile=None) -> Column:
        """Levels 1 to 6; profile is a set of admitted code points, else the General Security Profile."""
        admits = known_profile(profile)
        return self._whole("int", lambda f, s: f.restriction_level(s, admits))(c)

    def number_systems(self, c) -> Column:
        return self._whole("array<int>", lambda f, s: f.number_systems(s))(c)

    def mixed_numbers(self, c) -> Column:
        return self._whole("boolean", lambda f, s: f.mixed_numbers(s))(c)

    def check(self, c, permitted: int | str, profile=None) -> Column:
        level, admits = permitted_level(permitted), known_profile(profile)
        return self._whole(CHECK, lambda f, s: f.check(s, level, admits))(c)

    # Names

    def inspect(self, c, policy: str = "OneScript") -> Column:
        known_policy(policy)
        return self._whole(INSPECTION, lambda f, s: f.inspect(s, policy))(c)

    def acceptable(self, c, policy: str = "OneScript") -> Column:
        known_policy(policy)
        return self._whole("boolean", lambda f, s: f.acceptable(s, policy))(c)

    def acceptable_by_policy(self, c) -> Column:
        """A struct of a boolean for each policy; the string is folded and checked once."""
        return self._whole("struct<" + ",".join(f"{p}:boolean" for p in POLICIES) + ">", lambda f, s: f.acceptable_by_policy(s))(c)

    # Code points; bad ones raise when a constant, and in the worker when a value

    def _point(self, kind: str, call: Callable):
        return self._kernel(kind, lambda f, cp: call(f, valid_code_point(int(cp))))

    def script_of(self, c) -> Column:
        return self._point("string", lambda f, cp: f.tables.script[cp])(c)

    def extensions_of(self, c) -> Column:
        return self._point("array<string>", lambda f, cp: f.tables.set_codes(f.tables.mask(f.tables.extensions_of(cp))))(c)

    def augmented_of(self, c) -> Column:
        return self._point("array<string>", lambda f, cp: f.tables.set_codes(f.tables.augmented(cp)))(c)

    def identifier_type(self, c) -> Column:
        return self._point("int", lambda f, cp: f.tables.types[cp])(c)

    def type_names(self, mask) -> Column:
        names = F.array(*(F.when(mask.bitwiseAND(bit) != 0, n) for n, bit in TYPE_BIT.items()))
        return F.array_compact(names)

    def allowed(self, c) -> Column:
        return self._point("boolean", lambda f, cp: f.tables.allowed(cp))(c)

    def default_ignorable(self, c) -> Column:
        return self._point("boolean", lambda f, cp: cp in f.tables.ignorable)(c)

    def combining_class(self, c) -> Column:
        return self._point("int", lambda f, cp: f.tables.ccc.get(cp, 0))(c)

    def prototype(self, c) -> Column:
        return self._point("string", lambda f, cp: f.tables.confusables.get(cp))(c)

    def digit_value(self, c) -> Column:
        return self._point("int", lambda f, cp: f.digit_value(cp))(c)

    def version(self) -> Column:
        return F.lit(self.tables.version)


def _json(value) -> str:
    import json

    return json.dumps(value)


#: SQL name -> result type and call over an array of strings.
SQL = {
    "nfd": ("string", lambda f, s: f.nfd(s)),
    "nfc": ("string", lambda f, s: f.nfc(s)),
    "nfkd": ("string", lambda f, s: f.nfkd(s)),
    "nfkc": ("string", lambda f, s: f.nfkc(s)),
    "skeleton": ("string", lambda f, s: f.skeleton(s)),
    "lookalike_key": ("string", lambda f, s: f.lookalike_key(s)),
    "resolved_scripts": ("array<string>", lambda f, s: f.resolved_scripts(s)),
    "single_script": ("boolean", lambda f, s: f.single_script(s)),
    "restriction_level": ("int", lambda f, s: f.restriction_level(s)),
    "number_systems": ("array<int>", lambda f, s: f.number_systems(s)),
    "mixed_numbers": ("boolean", lambda f, s: f.mixed_numbers(s)),
    "clean_name": ("string", lambda f, s: f.nfkc(s)),
}
#: SQL name -> result type and call over one string or code point, and over two strings.
SQL_POINT = {
    "all_allowed": ("boolean", lambda f, s: f.all_allowed(s)),
    "script_of": ("string", lambda f, cp: f.tables.script[valid_code_point(int(cp))]),
    "identifier_type": ("int", lambda f, cp: f.tables.types[valid_code_point(int(cp))]),
    "identifier_allowed": ("boolean", lambda f, cp: f.tables.allowed(valid_code_point(int(cp)))),
    "default_ignorable": ("boolean", lambda f, cp: f.default_ignorable(int(cp))),
    "combining_class": ("int", lambda f, cp: f.combining_class(int(cp))),
    "prototype": ("string", lambda f, cp: f.prototype(int(cp))),
    "digit_value": ("int", lambda f, cp: f.digit_value(int(cp))),
}
SQL_PAIR = {
    "are_confusable": ("boolean", lambda f, a, b: f.are_confusable(a, b)),
    "lookalikes": ("boolean", lambda f, a, b: f.lookalikes(a, b)),
    "confusable_class": ("string", lambda f, a, b: f.classify(a, b)),
    "acceptable_name": ("boolean", lambda f, s, policy: f.inspect(s, known_policy(policy))["acceptable"]),
}


def register(spark: SparkSession, unicode: Unicode | None = None) -> Unicode:
    """Registers every function for SQL, and the table function name_findings(name, policy) for LATERAL."""
    u = unicode or Unicode(spark)
    for name, (kind, call) in SQL.items():
        spark.udf.register(name, u._whole(kind, call))
    for name, (kind, call) in SQL_POINT.items():
        spark.udf.register(name, u._kernel(kind, call))
    for name, (kind, call) in SQL_PAIR.items():
        spark.udf.register(name, u._kernel(kind, call, 2))
    shipped = u.shipped

    class NameFindings:
        def eval(self, name: str, policy: str):
            if name is not None:
                for f in _functions(shipped).inspect(name, known_policy(policy))["findings"]:
                    yield f["kind"], f["position"], f["length"], f["text"], f["message"]

    spark.udtf.register("name_findings", F.udtf(NameFindings, returnType="kind string, position int, length int, text string, message string"))
    return u
