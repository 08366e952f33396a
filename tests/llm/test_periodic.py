"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from liftlake.llm import periodic

from llm_cases import edge_docs, no_docs, pairs, small_docs

EMPTY = hashlib.sha256(b"").hexdigest()


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(6, 4 * q) and not any(
                    all(words[k] == words[k - p] for k in range(start + p, j)) for p in range(1, q)):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and words:
        a, n = h // 10 % len(words), len(words)
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest())


def order(row):
    return tuple((x is not None, x) for x in row)


def check(docs, plant=True):
    got = sorted((tuple(r)[:8] for r in periodic.periodic_runs(docs, plant=plant).collect()), key=order)
    assert got == sorted((brute_row(i, t, plant) for i, t in pairs(docs)), key=order)
    return got


def test_random_texts_match_brute_force():
    rng = random.Random(1)
    for _ in range(800):
        texts = []
        for _ in range(rng.randint(1, 5)):
            letters, text, size = "abcde"[:rng.choice([1, 2, 3, 5])], [], rng.randint(0, 90)
            while len(text) < size:
                text += [rng.choice(letters) for _ in range(rng.randint(1, 9))] * rng.choice([1, 1, 2, 4, 5, 7])
            texts.append(text)
        codes = np.array([ord(c) for t in texts for c in t], np.int64)
        text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        want, begin = [], 0
        for t in texts:
            want += [(s + begin, n, q) for s, n, q in brute_runs(t)]
            begin += len(t)
        assert periodic.find_runs(codes, text_of, max(map(len, texts))) == sorted(want, key=lambda r: (r[0], r[2]))


def test_documents_match_brute_force(spark):
    got = check(small_docs(spark, "0.001"))
    assert any(r[1] for r in got)


def test_slices_do_not_change_the_result(spark):
    docs = small_docs(spark, "0.001").limit(60)
    texts = pairs(docs)
    for size in (1, 5000):
        batch = periodic.pa.array([t or "" for _, t in texts], periodic.pa.large_string()).cast(periodic.pa.large_binary())
        whole = periodic._slice([i for i, _ in texts], batch, True).to_pylist()
        parts = [r for a in range(0, len(texts), 7) for r in periodic._slice([i for i, _ in texts][a:a + 7], batch.slice(a, 7), True).to_pylist()]
        assert whole == parts


def test_edges(spark):
    rows = check(edge_docs(spark).filter("doc_id IS NULL OR doc_id != 12"), plant=False)
    assert sum(r[7] == EMPTY for r in rows) == 4
    assert periodic.periodic_runs(no_docs(spark)).count() == 0


def test_long_text_with_one_common_word(spark):
    """Quadratic in the word's count this would be 2e10 steps."""
    text = "the " * 200_000 + " ".join(f"the w{i}" for i in range(100_000))
    row = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 200_001, 1)
    assert row.collapsed.decode().split()[:3] == ["the", "w0", "the"] and row.exponent_milli == 200_001_000
