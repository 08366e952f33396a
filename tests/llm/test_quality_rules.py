"""Statistics against brute force; learning on planted rules; verdicts on the labelled tables."""

import re
from collections import Counter

import pytest

from liftlake.llm import quality_rules as q

from llm_cases import edge_docs, no_docs, pairs, small_docs, tiny


def statistics(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def check_statistics(docs):
    out = q.with_statistics(docs.select("doc_id", "text")).withColumn("failed", q.base_failed()).collect()
    got = Counter((r.doc_id, r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.failed) for r in out)
    want = Counter((i, t, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]) for i, t in pairs(docs) for s in [statistics(t)])
    assert got == want


def test_statistics_match_brute_force(spark):
    check_statistics(small_docs(spark, "0.01"))


def test_statistics_edges(spark):
    check_statistics(edge_docs(spark))
    rows = [(1, "a b c a b c a b c"), (2, "a a a a"), (3, "a b c x a b c"), (4, "x\ny\nx\n \n \nx"), (5, "a\x0bb\x0cc a b\tc"), (6, "a b c d a b c d")]
    check_statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    assert q.with_statistics(no_docs(spark)).count() == 0


def made_rows():
    rows = []
    for i in range(900):
        r = dict.fromkeys(q.FEATURES, 0.0) | {"n_words": 100.0 + i % 70, "mean_word": 4.5 + (i % 10) / 10, "part": i % 3, "bad": 0}
        if i % 5 == 0:
            r |= {"symbols_per_word": 1.0 + i % 4, "bad": 1}
        elif i % 7 == 0:
            r |= {"mean_word": 8.0, "upper_share": 0.6, "bad": 1}
        rows.append(r)
    return rows


def test_covering_finds_planted_rules():
    rows = made_rows()
    rules = q.learn_rules(rows)
    assert 1 <= len(rules) <= 3
    for r in rows:
        assert any(all(c.holds(r) for c in rule) for rule in rules) == bool(r["bad"])
    assert q.learn_rules([]) == [] and q.learn_rules([r | {"bad": 0} for r in rows]) == []


def test_pruning_drops_conditions_of_no_worth():
    good = q.Condition("symbols_per_word", True, 0.5)
    assert q._prune((good, q.Condition("n_words", True, 120.0)), made_rows()) == (good,)


def test_judge_keeps_clean_and_rejects_junk(spark):
    docs = small_docs(spark, "0.1")
    labels = spark.read.parquet(f"{tiny('0.1')}/labels.parquet")
    rows = q.judge(docs, labels).join(labels, "doc_id").filter("NOT base_failed").select("kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.99
    assert 1 - sum(bad) / len(bad) > 0.8


@pytest.mark.parametrize("labels", [[], [(1, None), (None, 0)], [(1, 1), (12, 1)], [(1, 0), (1, 1), (12, 0)]])
def test_judge_edges(spark, labels):
    docs = edge_docs(spark)
    out = q.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(out) == docs.count()
    assert all(not r.kept for r in out if r.base_failed)
