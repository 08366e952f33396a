"""Exact dedup, SimHash near-dedup and components against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from liftlake.llm import exact_dedup, simhash
from liftlake.llm.common import keep_rows
from liftlake.llm.components import connected_components

from llm_cases import edge_docs, groups_by_link, no_docs, pairs, small_docs


def normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check_exact(docs, **options):
    texts = Counter(pairs(docs))
    out = exact_dedup.exact_dedup(docs, **options).collect()
    groups = defaultdict(list)
    for (i, t), n in texts.items():
        groups[normal(t)] += [i] * n
    assert len(out) == sum(texts.values())
    by_key = {}
    for (i, t) in texts:
        by_key[(i, xxhash.xxh64(t or "", seed=42).intdigest())] = t
    kept = Counter()
    for r in out:
        t = by_key[(r.doc_id, r.text_key % 2**64)]
        members = groups[normal(t)]
        known = [m for m in members if m is not None]
        assert r.group_size == len(members)
        assert r.keep_id == (max(known) if known else None)
        if r.digest is not None:
            assert bytes(r.digest) == hashlib.sha256(normal(t).encode()).digest()
        assert r.digest is not None or (len(members) == 1 and not options.get("digest_all"))
        kept[normal(t)] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept) == set(groups) and set(kept.values()) <= {1}
    return out


def test_exact_dedup_matches_brute_force(spark):
    check_exact(small_docs(spark, "0.01"), digest_all=True)


def test_exact_dedup_edges(spark):
    out = check_exact(edge_docs(spark))
    assert any(r.digest is None for r in out)
    assert exact_dedup.exact_dedup(no_docs(spark)).count() == 0


def test_exact_dedup_reads_only_survivors_whole(spark):
    docs = spark.createDataFrame([(1, "a" * 300 + "x"), (2, "A" * 300 + "X"), (3, "a" * 300 + "y"), (4, "b" * 301), (5, None)],
                                 "doc_id long, text string")
    out = exact_dedup.exact_dedup(docs, key_all=False)
    read = {r["doc_id"] for r in out.collect() if r["text_key"] is not None or r["digest"] is not None}
    assert read == {1, 2, 3}      # one length and one prefix; 4 and 5 are alone with theirs
    assert sorted(r["doc_id"] for r in keep_rows(docs, out).collect()) == [2, 3, 4, 5]
    rows = exact_dedup.exact_dedup(docs, digest_all=True).collect()
    assert all(r["digest"] is not None and r["text_key"] is not None for r in rows)
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in rows) == [(1, 2, False), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True)]


def test_exact_dedup_does_not_depend_on_the_sieve(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SIEVE_BITS_PER_KEY", 1)
    monkeypatch.setattr(exact_dedup, "PREFIX_BYTES", 4)
    check_exact(small_docs(spark))


def test_keep_rows_keeps_one_row_of_each_group(spark):
    docs = edge_docs(spark)
    out = keep_rows(docs, exact_dedup.exact_dedup(docs))
    assert out.columns == docs.columns
    assert Counter(normal(t) for _, t in pairs(out)) == Counter({normal(t) for _, t in pairs(docs)})


def brute_print(text):
    words = normal(text).encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_simhash(docs):
    rows = pairs(docs)
    out = simhash.near_dedup(docs).collect()
    prints = [(i, brute_print(t)) for i, t in rows]
    assert Counter((r.doc_id, r.fingerprint % 2**64) for r in out) == Counter(prints)
    group = groups_by_link([p for _, p in prints], lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for (i, _), g in zip(prints, group):
        first[g] = min(first.get(g, i), i, key=lambda x: (x is None, x))
    want = Counter((i, first[g]) for (i, _), g in zip(prints, group))
    assert Counter((r.doc_id, r.component_id) for r in out) == want
    assert sum(r.kept for r in out) == len(first)


def test_simhash_matches_brute_force(spark):
    check_simhash(small_docs(spark, "0.01"))


def test_simhash_edges(spark):
    check_simhash(edge_docs(spark))
    assert simhash.near_dedup(no_docs(spark)).count() == 0


@pytest.mark.parametrize("hot,distance", [(4096, 3), (64, 3), (4096, 1), (16, 6)])
def test_near_links_lose_no_link(spark, monkeypatch, hot, distance):
    monkeypatch.setattr(simhash, "HOT_POSTING", hot)
    monkeypatch.setattr(simhash, "CELL_ROWS", 5_000)
    rng = np.random.default_rng(5)
    heads = rng.integers(0, 2**63, 12, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, distance + 3), replace=False)) for _ in range(400)]
    values = sorted({(int(heads[k % 12]) ^ f) - (2**64 if (int(heads[k % 12]) ^ f) >= 2**63 else 0) for k, f in enumerate(flips)})
    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fingerprint long"), distance)
    for r in links.collect():
        assert r.src != r.dst
    got = {r.node: r.component for r in connected_components(links).collect()}
    group = groups_by_link(values, lambda a, b: ((a ^ b) % 2**64).bit_count() <= distance)
    least = {}
    for v, g in zip(values, group):
        least[g] = min(least.get(g, v), v)
    sizes = Counter(group)
    assert got == {v: least[g] for v, g in zip(values, group) if sizes[g] > 1}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (300, 301), (301, 300), (300, 301)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
