import random

import pytest
from glyphward.llm import queries, url_filter


def plain_rule(host, path):
    best = None
    for verdict, rule in url_filter.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


URLS = [
    "http://www.example.com/en/1", "https://example.com/en/x?y#z", "http://m.EXAMPLE.com/fr/", "http://example.net/es/1", "http://a.b.net/fr/2", "http://net/fr/", "http://xnet/fr/", "http://foo.com", "http://foo.com/", "http://foo.com?x=/en/",
    "no scheme", "", None, "://", "http://", "http:///path", "HTTP://ÄÖ.COM/Ä", "http://casino.info/poker/betting", "http://docs.org/wiki/library", "http://a://b/c", "http://example.com/en", "ftp://example.com/EN/", "http://u\nv.com/\n",
]


def test_urls(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[0], None), (0, URLS[0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    bias, w = url_filter.default_model()
    got = {(r["page_id"], r["host"], r["path"]): r for r in url_filter.judge(df).collect()}
    assert url_filter.judge(df).count() == len(rows)
    for i, u, _ in rows:
        host, path = url_filter.split_url(u)
        r = got[i, host, path]
        rule = plain_rule(host, path)
        score = bias + sum(w[b] for b in url_filter.grams(host, path))
        assert (r["rule"], r["verdict"]) == ((rule[1], rule[0]) if rule else (None, "block" if score > 0 else "allow")), u
        assert r["score"] == (0 if rule else score)
    assert got[17, "casino.info", "/poker/betting"]["verdict"] == "block" and got[18, "docs.org", "/wiki/library"]["verdict"] == "allow"


def right(model, rows):
    bias, w = model
    return [(bias + sum(w[b] for b in url_filter.grams(*url_filter.split_url(u))) > 0) == bool(y) for u, y in rows]


def test_labelled_table_is_learned_and_carries_over():
    rows = url_filter.labelled_urls()
    fitted, held = url_filter.parts(rows)
    assert len(rows) == len({u for u, _ in rows}) and sorted(fitted + held) == sorted(rows)
    assert all(right(url_filter.default_model(), fitted))
    folds = [right(url_filter.fit([r for i, r in enumerate(rows) if i % 4 != k]), rows[k::4]) for k in range(4)]
    assert sum(map(sum, folds)) >= 0.85 * len(rows)
    plainly = ["http://university.edu/", "http://bookshop.org/poetry", "http://malware-research.org/papers"]
    assert all(right(url_filter.default_model(), [*((u, 0) for u in plainly), ("https://onlinelottery.info/win", 1)]))
    with pytest.raises(ValueError):
        url_filter.fit(rows * 200)


def test_more_rules_than_one_expression_holds(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "RULES_AT_ONCE", 2)
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    whole = url_filter.judge(df)
    monkeypatch.undo()
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, url_filter.judge(df).collect()))


def test_no_rules_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://example.net/es/")], "page_id long, url string")
    assert url_filter.judge(df, rules=()).first()["rule"] is None
    assert url_filter.judge(df.limit(0)).collect() == []


def test_plan_is_native(spark, tmp_path):
    rng = random.Random(1)
    spark.createDataFrame([(i, rng.choice(URLS), "x") for i in range(50)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    plan = queries.op1_url_filter(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ReadSchema: struct<page_id:bigint,url:string>" in plan
