"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest.

The model is fitted on the driver from a small labelled URL table (labelled_urls.tsv beside this module, or any of at
most MAX_TRAIN rows), three rows of four; the fourth ones are held out to measure it. Its weights are integers, so
that sums don't depend on their order. Judging runs as SQL expressions only.
"""

from __future__ import annotations

import math
import os
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the query, as (verdict, rule).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rules of one expression; more make several.
RULES_AT_ONCE = 500
MAX_TRAIN = 5000
#: The labelled table, and which of its rows (by place, modulo HELD_OUT) are kept from fitting.
LABELLED = os.path.join(os.path.dirname(__file__), "labelled_urls.tsv")
HELD_OUT = 4
BUCKETS = 8192
GRAM = 3
SCALE = 1 << 16
_FIRST = 31 * 31
_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def labelled_urls(path: str = LABELLED) -> list[tuple[str, int]]:
    """The rows of a labelled table, tab-separated with a header, as (url, 1 for block or 0 for allow)."""
    with open(path, encoding="utf-8") as f:
        rows = [line.rstrip("\n").split("\t") for line in f][1:]
    return [(url, int(verdict == "block")) for verdict, url in rows]


def parts(rows: list[tuple[str, int]]) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Rows to fit, and rows held out."""
    return [r for i, r in enumerate(rows) if i % HELD_OUT], rows[::HELD_OUT]


def split_url(url: str | None) -> tuple[str, str]:
    m = re.match(_PATTERN, url or "")
    return (m[1].translate(str.maketrans(_UPPER, _LOWER)), m[2]) if m else ("", "")


def grams(host: str, path: str) -> list[int]:
    """Buckets of the n-grams of ^host$ and ^path$; the two fields hash apart."""
    out = []
    for field, s in ((0, f"^{host}$"), (1, f"^{path}$")):
        c = [ord(x) for x in s]
        out += [(c[i] * _FIRST + c[i + 1] * 31 + c[i + 2] + field * 977) % BUCKETS for i in range(len(c) - GRAM + 1)]
    return out


def fit(urls: list[tuple[str, int]], epochs: int = 200, rate: float = 0.02, decay: float = 0.02, weight: float = 2.0) -> tuple[int, list[int]]:
    """Bias and weights, scaled to integers, by plain gradient steps over the rows in the order given; a row to block counts `weight` times."""
    if len(urls) > MAX_TRAIN:
        raise ValueError(f"a labelled table of at most {MAX_TRAIN} urls is expected")
    rows = [(grams(*split_url(u)), y) for u, y in urls]
    w, bias = [0.0] * BUCKETS, 0.0
    for _ in range(epochs):
        for x, y in rows:
            z = bias + sum(w[b] for b in x)
            step = rate * (weight if y else 1.0) * (y - 1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
            bias += step
            for b in x:
                w[b] += step - rate * decay * w[b]
    return round(bias * SCALE), [round(x * SCALE) for x in w]


@lru_cache(maxsize=1)
def default_model() -> tuple[int, tuple[int, ...]]:
    bias, w = fit(parts(labelled_urls())[0])
    return bias, tuple(w)


def _ordered(rules) -> list[tuple[str, str]]:
    """Longest rule first, then by code point; of equal rules the first verdict holds."""
    return sorted(rules, key=lambda r: (-len(r[1]), r[1]))


def _rule_holds(host: Column, path: Column, rule: str) -> Column:
    at = rule.index("/")
    return ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])


def _score(host: Column, path: Column, model) -> Column:
    """The model's log odds in units of 1/SCALE. The weights are one folded array constant."""
    bias, w = model
    weights = F.split(F.lit(",".join(map(str, w))), ",").cast("array<bigint>")

    def field_sum(field: int, s: Column) -> Column:
        codes = F.transform(F.split(F.concat(F.lit("^"), s, F.lit("$")), ""), F.ascii)
        # an empty field, ^$, has no n-gram
        at = F.when(F.size(codes) >= GRAM, F.sequence(F.lit(1), F.size(codes) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(at, F.lit(0).cast("long"), lambda a, i: a + F.element_at(weights, ((F.element_at(codes, i) * _FIRST + F.element_at(codes, i + 1) * 31 + F.element_at(codes, i + 2) + field * 977) % BUCKETS + 1).cast("int")))

    return F.lit(bias).cast("long") + field_sum(0, host) + field_sum(1, path)


def judge(pages: DataFrame, rules=RULES, model=None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row.

    A null url, or one without `://`, has empty host and path and gets the model's verdict on these. rule is
    null where none fits. score is the model's log odds of blocking (in units of 1/65536, 0 where a rule decides;
    block if above 0). Repeated rows and null ids stay; an empty table gives an empty result; other columns are not read.
    """
    url = pages[url_col].cast("string")
    base = pages.select(
        pages[id_col].alias("page_id"),
        F.coalesce(F.translate(F.regexp_extract(url, _PATTERN, 1), _UPPER, _LOWER), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(url, _PATTERN, 2), F.lit("")).alias("path"),
    )
    host, path = F.col("host"), F.col("path")
    ordered, found = _ordered(rules), []
    for at in range(0, len(ordered), RULES_AT_ONCE):
        case = F
        for v, r in ordered[at : at + RULES_AT_ONCE]:
            case = case.when(_rule_holds(host, path, r), F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")))
        found.append(case)
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    base = base.withColumn("found", F.coalesce(*found, none)).withColumn("rule", F.col("found.rule"))
    base = base.withColumn("score", F.when(F.col("rule").isNotNull(), F.lit(0).cast("long")).otherwise(_score(host, path, model or default_model())))
    by_model = F.when(F.col("score") > 0, "block").otherwise("allow")
    return base.select("page_id", "host", "path", "rule", F.coalesce("found.verdict", by_model).alias("verdict"), "score")


def oracle(rules=RULES) -> str:
    bias, w = default_model()
    cases = " ".join(f"WHEN (host = '{r[: r.index('/')]}' OR ends_with(host, '.{r[: r.index('/')]}')) AND starts_with(path, '{r[r.index('/') :]}') THEN '{r}'" for _, r in _ordered(rules))
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in _ordered(rules))
    field = lambda f, s: f"coalesce(list_sum(list_transform(range(1, greatest(1, length({s}) - 1)), lambda i: w[(unicode({s}[i]) * {_FIRST} + unicode({s}[i + 1]) * 31 + unicode({s}[i + 2]) + {f * 977}) % {BUCKETS} + 1])), 0)"
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '{_PATTERN}', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '{_PATTERN}', 2), '') AS path
  FROM pages),
ruled AS (SELECT *, CASE {cases} END AS rule, '^' || host || '$' AS h, '^' || path || '$' AS p FROM parts),
model AS (SELECT [{",".join(map(str, w))}]::BIGINT[] AS w),
scored AS (SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN 0 ELSE ({bias} + {field(0, "h")} + {field(1, "p")})::BIGINT END AS score FROM ruled, model)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN score > 0 THEN 'block' ELSE 'allow' END AS verdict, score FROM scored"""
