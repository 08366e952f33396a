"""Shards of near-equal bytes by best-fit-decreasing bin packing.

Equal texts form an indivisible group. Groups are packed twice. First, groups
below a grain of one ``GRAINS``-th of a shard are dealt by hash into cells of
about ``CELL_GROUPS`` groups, and every cell packs its own into bundles of one
grain. Then the bundles and the larger groups, whose number is bounded by the
shards and the cells and not by the rows, are packed into the shards. Both
steps are best-fit decreasing on a balanced tree of remaining capacities.

Two uses: ``shards=n`` balances over exactly n shards (an item that fits none
goes to the emptiest, so sizes differ by a grain, unless one group alone is
larger than a shard); ``capacity=c`` opens as many shards of c bytes as needed,
and a group above c has a shard of its own.

Defined cases: a null text counts as an empty one; null ids and repeated rows
are rows like any other; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.llm.binpack import best_fit_decreasing
from liftlake.llm.common import numbered, stored

ROW_BYTES = 16            # a row's size beside its text
GRAINS = 400
CELL_GROUPS = 50_000


def _bundles(grain: int):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["size", "digest"], ascending=[False, True])
        bins = best_fit_decreasing(cell["size"].to_numpy(), grain)
        return pd.DataFrame({"digest": cell["digest"], "item": [f"{cell['cell'].iloc[0]}/{b}" for b in bins], "size": cell["size"]})
    return run


def _shards(shards: int | None, capacity: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["size", "item"], ascending=[False, True])
        bins = best_fit_decreasing(items["size"].to_numpy(), capacity, shards)
        return pd.DataFrame({"item": items["item"], "shard": bins.astype(np.int32)})
    return run


def shard_documents(docs: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, size, text_crc32, shard (int), slot (gapless from 0)."""
    if (shards is None) == (capacity is None):
        raise ValueError("give shards or capacity")
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                              F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")), "shard-rows")
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("size")), "shard-groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    capacity = capacity or max(1, -(-total // shards))
    grain = max(1, capacity // GRAINS)
    small = groups.filter(F.col("size") <= grain)
    cells = max(1, -(-small.count() // CELL_GROUPS))
    placed = stored(
        small.withColumn("cell", F.pmod(F.xxhash64("digest"), F.lit(cells)))
        .groupBy("cell").applyInPandas(_bundles(grain), "digest binary, item string, size long")
        .unionByName(groups.filter(F.col("size") > grain).select("digest", F.hex("digest").alias("item"), "size")), "shard-items")
    items = placed.groupBy("item").agg(F.sum("size").alias("size"))
    # Bounded: at most 2 * GRAINS bundles or groups a shard, and one part-filled bundle a cell.
    to_shard = stored(items.groupBy(F.lit(0).alias("all")).applyInPandas(_shards(shards, capacity), "item string, shard int"), "shards")
    where = placed.select("digest", "item").join(to_shard, "item").select("digest", "shard")
    return numbered(rows.join(where, "digest").select("doc_id", "size", "text_crc32", "shard"), "shard", "slot")
