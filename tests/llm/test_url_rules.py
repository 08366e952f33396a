"""URL filter: fixed rules and mined rules against plain Python."""

import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from liftlake.llm import queries, url_rules
from liftlake.llm.url_rules import UrlRule

from llm_cases import tiny

URLS = ["http://a.Example.ORG/en/1x?q#z", None, "", "nope", "x://org", "a://b://c/d", "http://com/de/", "http://xcom/de/\nq?r", "http://a..org/",
        "http://org?x=/", "http://example.org/en/2", "HTTP://EXAMPLE.ORG/EN/1", "http://b.example.org/es/", "http://É.com/fr/é", "://org/",
        "http://a.com/fr/" + "x" * 100_000, "http://com:80/de/", "http://example.org/en/1"]


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
    if not m:
        return "", "", ""
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2], m[3] or ""


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return min(fits, key=lambda r: (-len(r.name), r.name), default=None)


def plain_tokens(url):
    host, path, query = split(url)
    out = set()
    for kind, text, gap in (("host:", host, r"\."), ("path:", path, r"[\W_]+"), ("query:", query, "&")):
        out |= {kind + w for w in re.split(gap, text.lower()) if w and not re.fullmatch(r"\d+", w)}
    return out


def plain_rules(labelled, min_rows, min_confidence):
    """{items: (support count, confidence)} of all minimal-or-better rules."""
    rows = [(plain_tokens(u), b) for u, b in labelled if b is not None]
    sets = {}
    for items, block in rows:
        for n in range(1, len(items) + 1):
            for c in combinations(sorted(items), n):
                k = sets.setdefault(c, [0, 0])
                k[0] += 1
                k[1] += block
    common = {t for t in set().union(*[i for i, _ in rows]) if all(t in i for i, _ in rows)}
    rules = {c: (b, b / n) for c, (n, b) in sets.items() if b >= min_rows and b / n >= min_confidence and not common & set(c)}
    return {c: v for c, v in rules.items()
            if not any(set(d) < set(c) and rules[d][1] >= v[1] for d in rules)}


def sample_urls(n, seed=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        host = ".".join(rng.choices(["www", "blog", "m"], k=rng.randint(0, 1)) + [rng.choice(["alpha", "beta", "cheap-pills", "gamma"]), "example", rng.choice(["net", "com"])])
        url = f"http://{host}/{rng.choice(['en', 'de', 'shop'])}/{k}{rng.choice(['', '.html'])}{rng.choice(['', '', '', '?ref=x', '?page=2', '?page=2&ref=x'])}"
        t = plain_tokens(url)
        bad = "host:cheap-pills" in t or {"path:shop", "query:ref=x"} <= t or ("host:beta" in t and "path:de" in t and rng.random() < 0.7)
        out.append((url, rng.random() < 0.95 if bad else rng.random() < 0.03))
    return out


def test_fixed_rules_match_plain_python(spark):
    df = spark.createDataFrame([(k, u, "h", "r", "v") for k, u in enumerate(URLS)], "page_id long, url string, host string, `rule` string, verdict string")
    for rules in (queries.URL_RULES, [], [*queries.URL_RULES, UrlRule("org", "/", "block"), UrlRule("b:", "//c", "block")]):
        got = {r.row.page_id: r for r in url_rules.judge_urls(df, rules, url_rules.mine(spark.createDataFrame([], "url string, block boolean"))).collect()}
        assert len(got) == len(URLS)
        for k, u in enumerate(URLS):
            host, path, _ = split(u)
            rule = plain_rule(host, path, rules)
            assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule and rule.name), u
            assert got[k].verdict == (rule.verdict if rule else "allow")
            assert tuple(got[k].row) == (k, u, "h", "r", "v")


def test_mined_rules_match_brute_force(spark):
    labelled = sample_urls(600) + [(None, True), ("http://alpha.example.net/en/1", None), ("nope", False)]
    df = spark.createDataFrame(labelled, "url string, block boolean").repartition(4)
    for min_rows, conf in ((10, 0.8), (3, 0.5), (25, 0.9)):
        rules = url_rules.mine(df, min_support=0, min_rows=min_rows, min_confidence=conf)
        want = plain_rules(labelled, min_rows, conf)
        total = sum(b is not None for _, b in labelled)
        got = {tuple(r["items"]): r for r in rules.collect()}
        assert set(got) == set(want) and want
        for c, r in got.items():
            assert abs(r.confidence - want[c][1]) < 1e-9 and abs(r.support * total - want[c][0]) < 1e-6 and r.key in c
        pages = [(k, u) for k, (u, _) in enumerate(sample_urls(300, seed=9))] + [(1000, None), (1001, "nope")]
        judged = url_rules.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), [], rules)
        verdicts = {r.row.page_id: r.verdict for r in judged.collect()}
        assert verdicts == {k: "block" if any(set(c) <= plain_tokens(u) for c in want) else "allow" for k, u in pages}
        assert {"block", "allow"} <= set(verdicts.values())


def test_rules_find_the_planted_hosts(spark):
    rules = url_rules.mine(spark.createDataFrame(sample_urls(2000), "url string, block boolean"))
    judged = url_rules.judge_urls(spark.createDataFrame([(u,) for u, _ in sample_urls(500, seed=8)], "url string"), [], rules)
    clean = wrong = 0
    for r in judged.collect():
        t = plain_tokens(r.row.url)
        if "host:cheap-pills" in t or {"path:shop", "query:ref=x"} <= t:
            assert r.verdict == "block", r
        elif not {"host:beta", "path:de"} <= t:
            clean, wrong = clean + 1, wrong + (r.verdict == "block")
    assert clean > 200 and wrong <= 0.02 * clean


def test_pages_are_labelled_by_their_document(spark):
    pages = spark.createDataFrame([(1, "http://a.b/en/7.html?x=9"), (2, "http://a.b/en/8/"), (3, "http://a.b/"), (4, None), (5, "http://a.b/9" + "9" * 30)], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 1), (8, 1, 0), (9, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert {(r.url[-5:], r.block) for r in url_rules.labelled_pages(pages, labels).collect()} == {("l?x=9", False), ("en/8/", True)}


def test_empty_tables_and_query(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge_urls(none, queries.URL_RULES, url_rules.mine(spark.createDataFrame([], "url string, block boolean"))).count() == 0
    out = queries.op13_url_filter(spark, tiny("0.01"))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"] and out.filter(F.col("verdict").isNull()).count() == 0


def test_few_usable_urls_give_no_rule(spark):
    rows = [(f"http://h{k}.a/{k}", True) for k in range(12)] + [(f"http://g{k}.b/x/{k}", False) for k in range(3)]
    assert url_rules.mine(spark.createDataFrame(rows, "url string, block boolean"), min_support=0, min_rows=12).count() in (0, 1)
    assert url_rules.mine(spark.createDataFrame([(f"http://h{k}/{k}", True) for k in range(12)], "url string, block boolean")).count() == 0
    assert queries.op13_url_filter(spark, tiny("0.001")).count() > 0
