"""Prefix trie and radix tree against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from liftlake.llm import prefix_trie
from liftlake.llm.radix import RadixTree, _Full, _Indexed, _Sorted

from llm_cases import tiny

COLS = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append((t is not None, t or 0, r, digest(r, x), x))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in by.items()}
    convs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    members, children, leaves, saved = defaultdict(list), defaultdict(set), Counter(), Counter()
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += p not in children
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, ())), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items())


def found(df, **options):
    nodes = prefix_trie.prefix_trie(prefix_trie.rebuilt(df), **options)
    return Counter(tuple(r)[:8] for r in nodes.collect())


def plain(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_trie_matches_brute_force(spark, sf):
    df = spark.read.parquet(f"{tiny(sf)}/conversations.parquet")
    assert found(df) == brute(plain(df))


@pytest.mark.parametrize("options", [{}, {"block_turns": 3, "tree_keys": 7, "piece_ids": 2}, {"block_turns": 1, "tree_keys": 1, "piece_ids": 1}])
def test_trie_edges(spark, monkeypatch, options):
    monkeypatch.setattr(prefix_trie, "_SUPER_BITS", 1)
    rng = random.Random(2)
    rows = [(c, rng.choice([None, t, t]), rng.choice(["u", None, ""]), rng.choice(["a", "b", "éé", None, "", "ccc"]))
            for c in [*range(-12, 120), None] for t in range(rng.randint(0, 14))]
    rows += [(500 + c, t, "u", f"copy {t}") for c in range(40) for t in range(60)]      # copies, longer than a block
    rows += [(700, 0, "u", "long " * 100_000), (700, 0, "u", "long " * 100_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], COLS + ", id string, n1 int").repartition(5)
    assert found(df, **options) == brute(rows)


def test_hot_conversation_is_split(spark):
    spark.conf.set("liftlake.scan.hotRows", "50")
    try:
        rows = [(10, t, "u", f"t{t % 7}") for t in range(400)] + [(c, t, "u", f"t{t}") for c in range(11, 40) for t in range(c % 6)]
        df = spark.createDataFrame(rows, COLS).repartition(4)
        assert found(df, block_turns=4) == brute(rows)
    finally:
        spark.conf.unset("liftlake.scan.hotRows")


def test_trie_of_nothing(spark):
    assert found(spark.createDataFrame([], COLS)) == Counter()
    assert found(spark.createDataFrame([(None, 1, "u", "x")], COLS)) == Counter()


def test_radix_tree_sums_and_layouts():
    rng = random.Random(3)
    keys = [bytes(rng.choice([rng.randrange(256), rng.randrange(3)]) for _ in range(rng.randrange(6))) for _ in range(3000)]
    tree = RadixTree()
    for k, key in enumerate(keys):
        tree.add(key, (k,), (1, len(key)))
    seen = set()
    for path, start, least, sums in tree.walk():
        below = [k for k, key in enumerate(keys) if key.startswith(path)]
        assert least == (below[0],) and sums == (len(below), sum(len(keys[k]) for k in below))
        assert path not in seen and start < len(path)
        seen.add(path)
    assert set(keys) <= seen and len(seen) <= 2 * len(set(keys))      # compressed: no chain of single children
    layouts, stack = set(), [tree.top]
    while stack:
        node = stack.pop()
        if node.children:
            layouts.add((type(node.children), getattr(node.children, "room", 0)))
            assert [b for b, _ in node.children.items()] == sorted(b for b, _ in node.children.items())
            stack += [n for _, n in node.children.items()]
    assert layouts >= {(_Sorted, 4), (_Sorted, 16), (_Full, 0)}
    grown = _Sorted()
    for b in range(40):
        grown = grown.put(b, b)
    assert isinstance(grown, _Indexed) and grown.get(39) == 39 and grown.get(40) is None
