"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint has eight bytes. Two fingerprints that differ in at most d bits
share at least 8 - d positional bytes (5 for d = 3). Lists of one positional
byte would hold 1/256 of all fingerprints each, and their pairs would grow with
the square of the corpus; the lists are therefore intersected ahead of time. A
pair that shares 8 - d of 8 bytes shares at least 7 - d of the first seven, so
it meets in a posting of 7 - d positional bytes (35 postings of 4 bytes for
d = 3). Inside a posting the shared positional bytes of each pair are tallied;
pairs that reach the guaranteed minimum are verified on the differing bits.

Only distinct fingerprints are indexed. A posting emits a spanning forest of its
links, never all its pairs, and postings above ``HOT_POSTING`` are compared in
blocks by several tasks. Connected components then join the links.

Defined cases: null and blank texts have fingerprint zero and link like any
other; fewer words than a shingle form one shingle; null ids come after every id;
an empty table gives an empty result; columns other than doc_id and text are
not read. A text of any length is processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.llm.common import small_batches, stored, text_bytes, to_signed
from liftlake.llm.components import connected_components

SEED = 42
CELL_ROWS = 200_000       # postings rows handled by one task at a time
HOT_POSTING = 4_096       # fingerprints; larger postings are compared block by block
HASHES_AT_ONCE = 1 << 18  # bounds memory on very long texts


def _hashes(text: bytes, shingle: int) -> Iterator[list[int]]:
    """XXH64 values of the word shingles, some at a time."""
    words = text.split()          # bytes.split() parts at \x20 and \x09-\x0D
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    del words
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(ends) > shingle:
        starts, ends = starts[:-(shingle - 1) or None], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), HASHES_AT_ONCE):
        span = slice(at, at + HASHES_AT_ONCE)
        yield [digest(joined[s:e], SEED) for s, e in zip(starts[span].tolist(), ends[span].tolist())]


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles' hashes."""
    tally, total = np.zeros(64, np.int64), 0
    for values in _hashes((text or b"").lower(), shingle):
        bits = np.unpackbits(np.array(values, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        tally += bits.sum(axis=0, dtype=np.int64)
        total += len(values)
    return int(np.packbits(tally * 2 > total).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_key and fingerprint (its 64 bits as a long) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [raw or b"" for raw in text_bytes(batch)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "text_key": pa.array(to_signed([xxhash.xxh64_intdigest(raw, SEED) for raw in raws])),
                "fingerprint": pa.array(to_signed([fingerprint(raw, shingle) for raw in raws])),
            })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text_key long, fingerprint long")


def _postings(prints: DataFrame, max_distance: int) -> DataFrame:
    """(slot, key, fingerprint): the index, one row per posting that a fingerprint is in."""
    shared = 7 - max_distance

    def byte(i):
        return F.shiftrightunsigned(F.col("fingerprint"), 8 * i).bitwiseAND(F.lit(0xFF))

    entries = []
    for slot, places in enumerate(combinations(range(7), shared)):
        key = F.lit(0).cast("long")
        for p in places:
            key = F.shiftleft(key, 8).bitwiseOR(byte(p))
        entries.append(F.struct(F.lit(slot).alias("slot"), key.alias("key")))
    return prints.select(F.explode(F.array(*entries)).alias("e"), "fingerprint").select("e.slot", "e.key", "fingerprint")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the smallest node of each component: at most one per node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:                       # pointer jumping
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _link(max_distance: int):
    """Links inside the postings of one cell, as a spanning forest."""
    least = 8 - max_distance

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["slot", "key", "block"], kind="stable")
        prints = cell["fingerprint"].to_numpy(np.int64)
        group = np.zeros(len(cell), np.int64)
        if len(cell):
            change = np.zeros(len(cell), bool)
            for c in ("slot", "key", "block"):
                v = cell[c].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            group = np.cumsum(change)
        found_a, found_b, size = [], [], 0
        at, step = np.arange(len(prints)), 1
        while True:
            at = at[at + step < len(prints)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            differ = (prints[at] ^ prints[at + step]).view(np.uint64)
            tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = np.flatnonzero(tally >= least)                                 # count filter
            near = near[np.bitwise_count(differ[near]) <= max_distance]           # verify
            found_a.append(prints[at[near]])
            found_b.append(prints[at[near] + step])
            size += len(near)
            if size > 1_000_000:
                a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, size = [a], [b], 0
            step += 1
        if not found_a:
            return pd.DataFrame({"src": [], "dst": []}, dtype="int64")
        a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
        return pd.DataFrame({"src": a, "dst": b})

    return run


def near_links(prints: DataFrame, max_distance: int = 3) -> DataFrame:
    """Links (src, dst) between distinct ``fingerprint`` values at most ``max_distance`` bits apart.

    Complete up to connectivity: two values are connected by the result exactly
    if they are connected by pairs within the distance. ``max_distance`` 0 to 6."""
    if not 0 <= max_distance <= 6:
        raise ValueError("the index serves distances from 0 to 6 bits")
    count = prints.count()
    postings = _postings(prints, max_distance)
    width = len(list(combinations(range(7), 7 - max_distance)))
    heavy = stored(postings.groupBy("slot", "key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_POSTING), "hot-postings")
    single = postings.withColumn("block", F.lit(0).cast("long"))
    if not heavy.isEmpty():
        h = heavy.withColumn("blocks", F.ceil(F.col("n") * 2 / HOT_POSTING))
        hot = postings.join(h, ["slot", "key"])
        own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        pairs = hot.withColumn("own", own).withColumn("other", other).select(
            "slot", "key", "fingerprint",
            # one unit of work per unordered pair of blocks; 0 marks whole postings
            (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other") + 1).alias("block"))
        single = single.join(heavy.select("slot", "key"), ["slot", "key"], "left_anti").unionByName(pairs)
    cells = max(1, -(-count * width // CELL_ROWS))
    cell = F.pmod(F.xxhash64("slot", "key", "block"), F.lit(cells))
    links = single.withColumn("cell", cell).groupBy("cell").applyInPandas(_link(max_distance), "src long, dst long")
    return links.distinct()


def near_dedup(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, text_key, fingerprint (long), component_id, kept.

    component_id is the smallest doc_id that is reachable through links. The
    row with that id stays; of repeated rows with it, exactly one."""
    rows = stored(fingerprints(docs, shingle).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    prints = stored(rows.groupBy("fingerprint").agg(first.alias("first")), "distinct-fingerprints")
    members = connected_components(near_links(prints.select("fingerprint"), max_distance))
    classed = prints.join(members.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("component"), "first")
    classed = stored(classed, "classes")
    heads = classed.groupBy("component").agg(F.min("first").alias("head"))
    heads = classed.select("fingerprint", "component").join(heads, "component").select("fingerprint", "head")
    return rows.join(heads, "fingerprint").select(
        "doc_id", "text_key", "fingerprint", F.col("head.doc_id").alias("component_id"),
        (F.col("head.row") == F.col("row")).alias("kept"))
