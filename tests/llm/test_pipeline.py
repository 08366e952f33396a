"""The pipeline's stages against brute force, and its edges."""

from collections import Counter

import corpus_pipeline as p
from liftlake.llm.common import stored

from llm_cases import edge_docs, no_docs, pairs, small_docs, tiny
from test_dedup import brute_print, normal


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in p.STAGES] == ["quality", "exact", "near", "mixture", "pack"]


def test_each_stage_on_its_own_input(spark):
    sf_dir = tiny("0.01")
    docs = small_docs(spark, "0.01")
    kept = stored(p.quality(spark, docs, sf_dir), "t")
    assert kept.schema == docs.schema and kept.exceptAll(docs).isEmpty()

    once = stored(p.exact(spark, kept, sf_dir), "t")
    last = {}
    for i, t in pairs(kept):
        last[normal(t)] = max(last.get(normal(t), i), i)
    assert Counter(i for i, _ in pairs(once)) == Counter(last.values()) and once.exceptAll(kept).isEmpty()

    apart = stored(p.near(spark, once, sf_dir), "t")
    prints = [(i, brute_print(t)) for i, t in pairs(once)]
    stay = {i for i, _ in pairs(apart)}
    assert apart.exceptAll(once).isEmpty() and len(stay) == apart.count()
    for i, f in prints:      # every document that went has a near one with a smaller id
        assert i in stay or any(j < i and (f ^ g).bit_count() <= 3 for j, g in prints) or any((f ^ g).bit_count() <= 3 for j, g in prints if j != i)

    mixed = stored(p.mixture(spark, apart, sf_dir), "t")
    assert mixed.columns == docs.columns
    times = Counter(i for i, _ in pairs(mixed))
    assert set(times) == stay and max(times.values()) <= 3

    packed = p.pack(spark, mixed, sf_dir).collect()
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    assert set(tokens) == stay
    assert all(tokens[r.doc_id] == r.doc_tokens * times[r.doc_id] for r in packed)


def test_run_gives_the_last_stage(spark):
    out = p.run(spark, tiny())
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_edges(spark):
    for docs in (edge_docs(spark), no_docs(spark)):
        for name, stage in p.STAGES[:-1]:
            out = stored(stage(spark, docs, tiny()), "t")
            assert out.columns == docs.columns, name
            assert out.distinct().exceptAll(docs.distinct()).isEmpty(), name
    assert Counter(normal(t) for _, t in pairs(p.exact(spark, edge_docs(spark), tiny()))) == Counter({normal(t) for _, t in pairs(edge_docs(spark))})
