"""Conversation prefix trie: adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is the 16 bytes of its digest and the 4 big-endian bytes of its
text's length; a conversation is the string of its ids. Radix trees
(``radix.RadixTree``) hold these strings; a byte depth is a trie node only where
it is a whole number of ids, also inside a compressed path.

*Distribution.* Conversations are cut into blocks of ``BLOCK_TURNS`` turns, so no
row grows with a conversation. A block belongs to its context, the prefix before
it, named by the XOR of position-keyed hashes (two of 64 bits), which is a running
aggregate of the blocks. Equal blocks of one context are counted first, then
sorted and range-partitioned; each task builds trees of at most ``TREE_KEYS`` keys
over its own stretch of the order. A node that several trees hold comes out in
parts that are summed by its prefix name. A first turn shared by a third of all
conversations is thus spread over many tasks, and copies cost one key.

*Subtree sums without a bottom-up pass.* Each node belongs to its smallest
member; the nodes that a conversation owns are the end of its path, from where it
leaves all smaller conversations. With ``shared`` the text bytes before that point,
the tokens saved below a node v at depth d are the sum of ``shared`` over its
members but the smallest, less (members - 1) times the bytes of the first d - 1
turns; its leaves are the members that own a leaf. So a first pass over the trees
finds the owners, a second sums those two measures over each node's members.

Defined cases: a null role or text counts as empty; turns are ordered by turn
(null first), then role, then digest, and repeated rows are repeated turns; rows
without a conv_id belong to no conversation and are left out; an empty table has
no node; other columns are not read; texts are only digested and measured.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftlake.llm.common import stored
from liftlake.llm.radix import RadixTree
from liftlake.operators.scan import KeyedScan

ID_BYTES = 20
BLOCK_TURNS = 32
TREE_KEYS = 20_000
PIECE_IDS = 4096
_SUPER_BITS = 12              # blocks summed by one window: 2 ** _SUPER_BITS
HEAD_TURNS = 9                # the rebuilt head has fewer turns than this
HEAD_GROUP = 5                # conversations that share a head

_NODES = ("n1 long, n2 long, p1 long, p2 long, depth long, conv_id long, shared_least long, "
          "n long, shared long, leaves long, upto long, last long")


def turn_positions(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, id): each turn's place from 0 in its conversation and its fixed-width id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    length = F.unhex(F.lpad(F.hex(F.octet_length(text)), 8, "0"))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.concat(digest, length).alias("id"))
    scan = KeyedScan.build(rows, ["conv_id"], ["turn", "role", "id"])
    return scan.with_seq(scan.df).select("conv_id", (F.col("seq") - 1).cast("long").alias("pos"), "id")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, id, total) of rebuilt conversations; a turnless one has a single row without pos and id.

    Conversation c takes the first h turns of c - c % 5, h = crc32(decimal c) % 9, then its own after its first h."""
    own = stored(turn_positions(turns), "turns")
    sizes = own.groupBy("conv_id").count()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS
    convs = sizes.select("conv_id", F.col("count").alias("size"), h.alias("h"), (F.col("conv_id") - F.col("conv_id") % HEAD_GROUP).alias("base"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("count").alias("base_size")), "base", "left")
    head = F.least("h", F.coalesce("base_size", F.lit(0)))
    convs = stored(convs.select("conv_id", "base", "h", head.alias("head"),
                                (head + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("total")), "heads")
    tails = own.join(convs, "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "id", "total")
    heads = (own.filter(F.col("pos") < HEAD_TURNS - 1).withColumnRenamed("conv_id", "base").join(convs, "base")
             .filter("pos < h").select("conv_id", "pos", "id", "total"))
    none = convs.filter("total = 0").select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("id"), "total")
    return tails.unionByName(heads).unionByName(none)


def _text_bytes(ids):
    return F.conv(F.hex(F.substring(ids, 17, 4)), 16, 10).cast("long")


def _blocks(turns: DataFrame, block_turns: int) -> DataFrame:
    """One row per block: conv_id, begin (turns before it), context (c1, c2, before: bytes of text), key, ends, and the names after it (e1, e2, upto)."""
    place = F.unhex(F.lpad(F.hex("pos"), 16, "0"))
    rows = turns.select(
        "conv_id", "total", F.coalesce(F.floor(F.col("pos") / block_turns), F.lit(0)).alias("block"), "pos", F.hex("id").alias("id"),
        F.coalesce(_text_bytes(F.col("id")), F.lit(0)).alias("bytes"),
        F.when(F.col("pos").isNotNull(), F.xxhash64(F.concat("id", place))).otherwise(0).alias("x1"),
        F.when(F.col("pos").isNotNull(), F.xxhash64(F.concat(place, "id"))).otherwise(0).alias("x2"))
    blocks = rows.groupBy("conv_id", "total", "block").agg(
        F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))), lambda t: t["id"]), "")).alias("key"),
        F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("bytes").alias("bytes"))
    blocks = stored(blocks.withColumn("super", F.shiftright("block", _SUPER_BITS)), "blocks")
    before = Window.partitionBy("conv_id", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"x1": F.bit_xor, "x2": F.bit_xor, "bytes": F.sum}
    supers = blocks.filter("block > 0").select("conv_id").distinct().join(blocks, "conv_id").groupBy("conv_id", "super").agg(
        *[f(c).alias(c) for c, f in sums.items()])
    supers = supers.select("conv_id", "super", *[f(c).over(earlier).alias(f"s_{c}") for c, f in sums.items()]).filter("super > 0")
    zero = F.lit(0).cast("long")
    out = blocks.withColumns({f"b_{c}": f(c).over(before) for c, f in sums.items()}).join(supers, ["conv_id", "super"], "left")
    for c in ("x1", "x2"):
        out = out.withColumn(f"c{c[1]}", F.coalesce(f"b_{c}", zero).bitwiseXOR(F.coalesce(f"s_{c}", zero)))
    out = out.withColumn("before", F.coalesce("b_bytes", zero) + F.coalesce("s_bytes", zero))
    return out.select("conv_id", (F.col("block") * block_turns).alias("begin"), "c1", "c2", "before", "key", "total",
                      (F.col("block") == F.floor(F.greatest(F.col("total") - 1, zero) / block_turns)).alias("ends"),
                      F.col("c1").bitwiseXOR(F.col("x1")).alias("e1"), F.col("c2").bitwiseXOR(F.col("x2")).alias("e2"),
                      (F.col("before") + F.col("bytes")).alias("upto"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _rows(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in fields))


def tree_nodes(keys: list[tuple], begin: int, c1: int, c2: int, before: int) -> Iterator[tuple]:
    """Rows of ``_NODES`` of one tree. ``keys``: (key, conv_id, shared_least, n, shared, leaves) of one context."""
    tree = RadixTree()
    for key, conv_id, shared_least, n, shared, leaves in keys:
        tree.add(key, (conv_id, shared_least), (n, shared, leaves))
    names = {0: (c1 % 2**64, c2 % 2**64, before)}     # by turn-aligned byte depth on the current path
    for path, start, least, sums in tree.walk():
        if start < 0 and begin == 0:
            yield 0, 0, None, None, 0, *least, *sums, 0, 0
        for end in range((max(start, 0) // ID_BYTES + 1) * ID_BYTES, len(path) + 1, ID_BYTES):
            one, two, upto = names[end - ID_BYTES]
            turn, depth = path[end - ID_BYTES:end], begin + end // ID_BYTES
            place, last = (depth - 1).to_bytes(8, "big"), int.from_bytes(turn[16:], "big")
            names[end] = (one ^ xxhash.xxh64_intdigest(turn + place, 42), two ^ xxhash.xxh64_intdigest(place + turn, 42), upto + last)
            yield *map(_signed, names[end][:2]), _signed(one), _signed(two), depth, *least, *sums, upto + last, last


def _trees(tree_keys: int):
    """Task function: sorted keys in, rows of ``_NODES`` out."""
    fields = ("begin", "c1", "c2", "before", "key", "conv_id", "shared_least", "n", "shared", "leaves")
    names = [part.split()[0] for part in _NODES.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for context, members in groupby(_rows(batches, fields), key=lambda r: r[:4]):
            while keys := [row[4:] for row in islice(members, tree_keys)]:
                for node in tree_nodes(keys, *context):
                    out.append(node)
                    if len(out) == tree_keys:
                        yield batch_of(out)
                        out = []
        if out:
            yield batch_of(out)

    return task


def _nodes(blocks: DataFrame, tree_keys: int, name: str) -> DataFrame:
    """All trie nodes with the totals of their members; ``blocks`` carries shared and leaf of each member."""
    context = ["begin", "c1", "c2"]
    keys = blocks.groupBy(*context, "key").agg(
        F.min("before").alias("before"), F.min(F.struct("conv_id", "shared")).alias("least"), F.count("*").alias("n"),
        F.sum("shared").alias("shared"), F.sum("leaf").alias("leaves"))
    keys = keys.select(*context, "before", "key", "least.conv_id", F.col("least.shared").alias("shared_least"), "n", "shared", "leaves")
    keys = stored(keys, "keys").repartitionByRange(*context, "key").sortWithinPartitions(*context, "key")
    parts = keys.mapInArrow(_trees(tree_keys), _NODES)
    whole = parts.groupBy("n1", "n2", "depth").agg(
        F.min(F.struct("conv_id", "shared_least")).alias("least"), *[F.sum(c).alias(c) for c in ("n", "shared", "leaves")],
        *[F.max(c).alias(c) for c in ("p1", "p2", "upto", "last")])
    return stored(whole.select("n1", "n2", "depth", "p1", "p2", "least.conv_id", "least.shared_least", "n", "shared", "leaves", "upto", "last"), name)


def _pieces(piece_ids: int):
    """Task function: comma-joined ids of each node, cut every ``piece_ids``; rows come sorted by node and id."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for node, members in groupby(_rows(batches, ("e1", "e2", "total", "conv_id")), key=lambda r: r[:3]):
                while ids := [row[3] for row in islice(members, piece_ids)]:
                    yield *node, ids[0], ",".join(map(str, ids))

        made = pieces()
        while some := list(islice(made, 500)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some)], ["e1", "e2", "total", "first", "piece"])

    return task


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in order, one piece at a time."""
    node, state, out = None, None, []
    for batch in batches:
        for *key, piece in zip(*(batch.column(c).to_pylist() for c in ("e1", "e2", "total", "piece"))):
            if key != node:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["e1", "e2", "total", "ends_sha256"])
            out = []
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, state.hexdigest())], ["e1", "e2", "total", "ends_sha256"])


def ends_digest(ends: DataFrame, piece_ids: int = PIECE_IDS) -> DataFrame:
    """(e1, e2, total, ends_sha256): hash of the ascending, comma-joined ids that end at each node."""
    where = ["e1", "e2", "total"]
    pieces = (ends.select(*where, "conv_id").repartitionByRange(*where, "conv_id").sortWithinPartitions(*where, "conv_id")
              .mapInArrow(_pieces(piece_ids), "e1 long, e2 long, total long, first long, piece string"))
    return (pieces.repartition(*where).sortWithinPartitions(*where, "first")
            .mapInArrow(_hashes, "e1 long, e2 long, total long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, block_turns: int = BLOCK_TURNS, tree_keys: int = TREE_KEYS, piece_ids: int = PIECE_IDS) -> DataFrame:
    """One row per trie node of ``turns(conv_id, pos, id, total)``, as ``rebuilt`` makes them.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    and the node's name (n1, n2)."""
    blocks = stored(_blocks(turns, block_turns), "named")
    first = _nodes(blocks.withColumns({"shared": F.lit(0).cast("long"), "leaf": F.lit(0).cast("long")}), tree_keys, "owners")
    parent = first.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    children = (first.filter("depth > 0").groupBy("p1", "p2", "depth").agg(F.count("*").alias("n_children"))
                .select(F.col("p1").alias("n1"), F.col("p2").alias("n2"), (F.col("depth") - 1).alias("depth"), "n_children"))
    links = (first.select("n1", "n2", "p1", "p2", "depth", "conv_id", "upto", "last").join(parent, ["p1", "p2", "depth"], "left")
             .join(children, ["n1", "n2", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    links = stored(links, "links")
    # Where a conversation leaves all smaller ones, and whether it owns a leaf; one that owns nothing shares all its turns.
    marks = (links.select("conv_id", F.when(F.col("parent_conv_id").isNull() | (F.col("parent_conv_id") != F.col("conv_id")),
                                            F.col("upto") - F.col("last")).alias("shared"),
                          (F.col("n_children") == 0).cast("long").alias("leaf"))
             .filter("shared IS NOT NULL OR leaf = 1").groupBy("conv_id").agg(F.max("shared").alias("shared"), F.max("leaf").alias("leaf")))
    ends = blocks.filter("ends").select("conv_id", "e1", "e2", "total", "upto")
    members = stored(ends.join(marks, "conv_id", "left").select(
        "conv_id", F.coalesce("shared", "upto").alias("shared"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")), "members")
    sums = _nodes(blocks.join(members, "conv_id"), tree_keys, "sums")
    digests = ends_digest(ends, piece_ids).select(F.col("e1").alias("n1"), F.col("e2").alias("n2"), F.col("total").alias("depth"), "ends_sha256")
    nodes = (sums.select("n1", "n2", "depth", "conv_id", "n", "shared", "shared_least", "leaves", "upto", "last")
             .join(links.select("n1", "n2", "depth", "parent_conv_id", "n_children"), ["n1", "n2", "depth"])
             .join(digests, ["n1", "n2", "depth"], "left"))
    before = F.col("upto") - F.col("last")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("shared") - F.col("shared_least") - (F.col("n") - 1) * before).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "n1", "n2")
