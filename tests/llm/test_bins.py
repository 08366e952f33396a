"""Sharding, packing and mixing."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from liftlake.llm import mixing, packing, sharding
from liftlake.llm.binpack import best_fit_decreasing, first_fit_decreasing
from liftlake.llm.queries import vocabulary

from llm_cases import edge_docs, no_docs, pairs, small_docs

SIZES = st.lists(st.integers(1, 50), max_size=300)


def plain_fit(sizes, capacity, choose):
    left, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [b for b, r in enumerate(left) if r >= sizes[i]]
        if not fits:
            left.append(capacity)
            fits = [len(left) - 1]
        out[i] = choose(fits, left)
        left[out[i]] -= sizes[i]
    return [out[i] for i in range(len(sizes))]


@settings(max_examples=60, deadline=None)
@given(SIZES)
def test_best_fit_decreasing_is_the_plain_algorithm(sizes):
    got = best_fit_decreasing(np.array(sizes, np.int64), 50).tolist()
    assert got == plain_fit(sizes, 50, lambda fits, left: min(fits, key=lambda b: (left[b], b)))


@settings(max_examples=60, deadline=None)
@given(SIZES)
def test_first_fit_decreasing_is_the_plain_algorithm(sizes):
    got = first_fit_decreasing(np.array(sizes, np.int64), 50).tolist()
    assert got == plain_fit(sizes, 50, lambda fits, left: fits[0])


def test_best_fit_uses_many_leaves():
    sizes = np.random.default_rng(1).integers(1, 10_000, 5_000)
    bins = best_fit_decreasing(sizes, 10_000)
    loads = np.bincount(bins, sizes)
    assert loads.max() <= 10_000 and len(loads) <= sizes.sum() / 10_000 * 1.03 + 1


def check_shards(docs, shards):
    rows = pairs(docs)
    out = sharding.shard_documents(docs, shards=shards).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    slots, homes, load = defaultdict(list), defaultdict(set), Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        homes[(r["size"], r.text_crc32)].add(r.shard)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values()), "equal texts stay together"
    assert set(load) <= set(range(shards))
    return load


def test_shards_are_even_and_whole(spark):
    load = check_shards(small_docs(spark, "0.1"), 40)
    mean = sum(load.values()) / 40
    assert len(load) == 40 and max(abs(v - mean) for v in load.values()) < 0.01 * mean


def test_shard_edges(spark):
    check_shards(edge_docs(spark), 3)
    assert sharding.shard_documents(no_docs(spark), shards=4).count() == 0


def test_fixed_capacity_shards(spark):
    out = sharding.shard_documents(small_docs(spark), capacity=40_000).groupBy("shard").sum("size").collect()
    total = sum(r[1] for r in out)
    assert all(r[1] <= 40_000 for r in out if r[1] <= 40_000) and len(out) <= total / 40_000 * 1.3 + 2
    with pytest.raises(ValueError):
        sharding.shard_documents(small_docs(spark))


def check_pieces(docs, length=2048, **options):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary())
    want = Counter()
    for i, t in pairs(docs):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    out = packing.pack_documents(docs, vocabulary(), length=length, with_ids=True, **options).collect()
    sequences, copies = defaultdict(list), Counter()
    parts = defaultdict(list)
    for r in out:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        parts[(r.doc_id, r.doc_tokens)].append((r.start, r.ids))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
    for (i, n), found in parts.items():
        by_start = defaultdict(list)
        for start, ids in found:
            by_start[start].append(ids)
        # documents that share id and length: match their pieces in sorted order
        times = len(by_start[0])
        assert sorted(by_start) == list(range(0, n, length)) and {len(v) for v in by_start.values()} == {times}
        if times == 1:
            ids = np.array([x for s in sorted(by_start) for x in by_start[s][0]], "<u4")
            copies[(i, n, zlib.crc32(ids.tobytes()))] += 1
    assert all(want[k] == v for k, v in copies.items())
    assert sum(len(v) for v in parts.values()) >= sum(want.values())
    return sequences, sum(r.length for r in out)


def test_packing_is_complete_and_tight(spark):
    sequences, tokens = check_pieces(small_docs(spark, "0.01"))
    assert tokens / (len(sequences) * 2048) > 0.99


def test_packing_edges(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 30_000)
    check_pieces(edge_docs(spark), length=64)
    assert packing.pack_documents(no_docs(spark), vocabulary()).count() == 0


def test_added_tokens_in_a_text_get_their_ids(spark):
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b ", "<|ENDOFTEXT|>", "<|endoftext", "x " * 3000 + "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_pieces(docs)
    ids = {r.doc_id: r.ids for r in packing.pack_documents(docs, vocabulary(), with_ids=True).collect() if r.start == 0}
    assert ids[0] == [31373, 220, 50256, 995, 1] and ids[1] == [50256, 1]


def test_repeated_rows_are_dealt_into_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 10_000)
    docs = spark.createDataFrame([(1, "one two three " * 80)] * 300, "doc_id long, text string").repartition(3)
    out = packing.pack_documents(docs, vocabulary()).collect()
    sizes = Counter()
    for r in out:
        sizes[r.sequence_id // packing.BIN_SPAN] += r.length
    assert len(sizes) > 4 and max(sizes.values()) < 30_000


def test_other_vocabularies_use_their_own_library(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encode, check = packing.tokenizer(path)
    assert check is None and encode("a word") == encode("A  word")
    assert packing.pack_documents(small_docs(spark).limit(5), path, length=512).count() > 0


def mixture(docs, **options):
    out = mixing.mix(docs, **options)
    rows = out.collect()
    tokens = Counter()
    for r in rows:
        tokens[r.source] += r.mix_tokens
    return rows, tokens


def test_mix_repeats_small_sources_up_to_the_limit(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 5_000)
    docs = small_docs(spark, "0.01")
    rows, tokens = mixture(docs.drop("n_chars"), max_repeats=1.2)
    source = Counter()
    for r in docs.collect():
        source[r.source] += len((r.text or "").split())
    seen = Counter((r.doc_id, r.mix_epoch) for r in rows)
    assert set(seen.values()) == {1} and {i for i, _ in seen} == {i for i, _ in pairs(docs)}
    reps = {s: tokens[s] / source[s] for s in source}
    assert max(reps.values()) < 1.2 * min(reps.values()) + 0.1
    biggest = max(source, key=source.get)
    assert tokens[biggest] == source[biggest]
    # the places of a source's copies tile its budget
    for s in source:
        own = sorted((r.mix_start, r.mix_tokens) for r in rows if r.source == s and r.mix_tokens)
        at = 0
        for start, n in own:
            assert start == at
            at += n


@pytest.mark.parametrize("seed", range(1, 6))
def test_mix_keeps_documents_without_tokens_wherever_their_block_falls(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50_000)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 500)
    rows = [(0, "w " * 300_000, "a"), *[(i, ("", None, " ")[i % 3], "a") for i in range(1, 3_001)], (3_001, "one word", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in mixing.mix(docs, max_repeats=2.0, seed=seed).select("doc_id").collect()} == set(range(3_002))


def test_mix_passes_columns_with_any_name(spark):
    names = ["mix_tokens", "mix_start", "_source", "_block", "_epoch", "_budget", "_first", "_row", "row", "tokens"]
    docs = spark.createDataFrame([(k, f"text {k}", "ab"[k % 2], *names) for k in range(20)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    out = mixing.mix(docs, max_repeats=1.0)
    assert len(out.columns) == len(set(out.columns))
    for r in out.collect():
        assert all(r[n] == n for n in names if not n.startswith("mix_")) and r.mix_tokens == 2 and r.text == f"text {r.doc_id}"


def test_exponent_by_brute_force(spark):
    totals = spark.createDataFrame([("a", 1_000), ("b", 10_000), ("c", 90_000), ("d", 0)], "s string, tokens long")
    p = np.array([1_000, 10_000, 90_000]) / 101_000

    def entropy(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum() / np.log(3)

    got = mixing.find_exponent(totals, target_entropy=0.8)
    assert entropy(got) >= 0.8 > entropy(got + 1e-6)
    got = mixing.find_exponent(totals, max_repeats=4.0)
    assert 90 ** (1 - got) <= 4.0 < 90 ** (1 - got + 1e-6)
    assert mixing.find_exponent(totals, max_repeats=1000.0) == 0.0
    assert mixing.find_exponent(totals, target_entropy=0.01) == 1.0
    assert mixing.find_exponent(totals.filter("tokens < 0"), target_entropy=0.5) == 1.0
    with pytest.raises(ValueError):
        mixing.find_exponent(totals)


def test_mix_to_a_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 5_000)
    rows, tokens = mixture(small_docs(spark, "0.01"), target_entropy=0.999, budget=100_000)
    assert 100_000 <= sum(tokens.values()) < 100_000 + 30_000
    assert len({r.mix_block for r in rows}) == 1


def test_mix_edges(spark):
    docs = edge_docs(spark)
    rows, _ = mixture(docs, max_repeats=3.0)
    assert {(r.doc_id, r.text) for r in rows} == set(pairs(docs))
    first = Counter((r.doc_id, r.text) for r in rows if r.mix_epoch == 0)
    assert first == Counter(pairs(docs))
    assert mixing.mix(no_docs(spark), max_repeats=2.0).count() == 0
