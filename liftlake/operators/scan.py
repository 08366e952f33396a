"""Skew-safe ordered scans over keyed sequences.

Sequence features (lags, leads, running counts/sums/maxima, "last event so
far") are window functions partitioned by a key. A plain
``Window.partitionBy(key)`` puts every row of one key into one task, so a key
holding a third of the data would stall the job. ``KeyedScan`` splits such
hot keys:

1. A light pre-aggregation (key columns only, partial aggregation before the
   shuffle) counts rows per key and finds the keys above ``hot_rows``. Their
   number is bounded by ``rows / hot_rows``.
2. The rows of hot keys are range-partitioned and sorted by key and the full
   order tuple, cut every ``hot_rows`` rows and stored. Each ``_chunk`` is
   a contiguous run of its key's order of at most ``hot_rows`` rows, whatever
   the values are, and ``_place`` its rows' number in that order, which stands for the order from then on. Other keys keep chunk 0; where more keys are hot than may be
   broadcast, all rows are cut, which needs no join to find the hot ones. Windows
   then partition by ``_kh, _kg, _chunk``: two hashes (128 bits) stand for the key,
   in which null parts are a value like any other.
3. Running quantities are computed per chunk and then corrected with a carry
   table: one row per non-empty hot chunk, holding the chunk's aggregate,
   prefix-combined over the earlier chunks of the same key. The carry table
   is bounded by the number of hot chunks; it is broadcast when that bound is
   under ``broadcast_rows`` (200,000 rows of at most a few hundred bytes), otherwise joined on ``_kh, _kg, _chunk`` by plain
   equality (which the windowed side is already partitioned by, so the rows do not move again).

When no key is hot, the scan is a plain window partitioned by the key, with
one shuffle, and downstream ``groupBy(key)`` reuses that partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftlake.session import stored

DEFAULT_HOT_ROWS = 2_000_000
DEFAULT_BROADCAST_ROWS = 200_000
CHUNK = ["_kh", "_kg", "_chunk"]     # what windows and carries of a split scan are keyed by


def _conf_int(df: DataFrame, name: str, default: int) -> int:
    try:
        value = df.sparkSession.conf.get(name, None)
    except Exception:  # pragma: no cover - conf access is best effort
        value = None
    return int(value) if value else default


def null_safe_join(df: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Left join on ``cols`` that matches null with null; keeps df's columns."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in cols})
    on = [df[c].eqNullSafe(renamed[f"_r_{c}"]) for c in cols]
    return df.join(renamed, on, "left").drop(*[f"_r_{c}" for c in cols])


@dataclass
class KeyedScan:
    df: DataFrame              # input plus ``_chunk`` (and ``_hot`` when split)
    key: tuple
    order: tuple
    hot: bool                  # any key split into chunks
    carry_rows: int            # upper bound of carry-table rows
    broadcast_rows: int
    whole: bool = False        # every row is in a chunk, so ``_place`` alone orders them

    # -- construction --------------------------------------------------------
    @classmethod
    def build(cls, df: DataFrame, key: Sequence[str], order: Sequence[str],
              hot_rows: int | None = None, broadcast_rows: int | None = None,
              assume_cold: bool = False) -> "KeyedScan":
        """``assume_cold``: the caller knows no key can be hot (e.g. a coarser
        key of the same rows was checked and none was), so skip the check."""
        key, order = tuple(key), tuple(order)
        hot_rows = hot_rows or _conf_int(df, "liftlake.scan.hotRows", DEFAULT_HOT_ROWS)
        broadcast_rows = broadcast_rows or _conf_int(df, "liftlake.scan.broadcastRows",
                                                     DEFAULT_BROADCAST_ROWS)
        if assume_cold:
            return cls(df.withColumn("_chunk", F.lit(0).cast("long")), key, order, False, 0,
                       broadcast_rows or DEFAULT_BROADCAST_ROWS)
        counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        is_hot = F.col("_n") > hot_rows
        # One small driver-side row: how many (hot) keys and rows exist.
        stats = counts.agg(F.count_if(is_hot).alias("k"), F.sum(F.when(is_hot, F.col("_n"))).alias("n"),
                           F.count(F.lit(1)).alias("keys"), F.sum("_n").alias("rows")).first()
        n_hot, n_rows = int(stats["k"] or 0), int(stats["n"] or 0)
        if n_hot == 0:
            out = df.withColumn("_chunk", F.lit(0).cast("long"))
            return cls(out, key, order, False, 0, broadcast_rows)
        if n_hot <= broadcast_rows:
            lookup = F.broadcast(counts.where(is_hot).select(*key, F.lit(True).alias("_hot")))
            flagged = null_safe_join(df, lookup, key).withColumn("_hot", F.coalesce("_hot", F.lit(False)))
        else:
            flagged = df.withColumn("_hot", F.lit(True))
            n_hot, n_rows = int(stats["keys"]), int(stats["rows"])
        parted = [x for c in key for x in (F.col(c), F.col(c).isNull())]
        flagged = flagged.withColumns({"_kh": F.xxhash64(*parted), "_kg": F.xxhash64(F.lit("key"), *parted)})
        # Sorted range partitions, cut every ``hot_rows`` rows. Stored: the
        # row numbers are fixed from here on.
        low = F.lit((1 << 33) - 1)
        split = (flagged.where("_hot").repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
                 .withColumn("_place", F.monotonically_increasing_id())
                 .withColumn("_chunk", F.col("_place") - F.col("_place").bitwiseAND(low)
                             + F.floor(F.col("_place").bitwiseAND(low) / hot_rows).cast("long") + 1))
        whole = n_rows == int(stats["rows"])
        if whole:
            out = stored(split.drop("_hot")).withColumn("_hot", F.lit(True))
        else:
            none = {c: F.lit(0).cast("long") for c in ("_place", "_chunk")}
            out = flagged.where(~F.col("_hot")).withColumns(none).unionByName(stored(split))
        # chunks, one more per range partition, and keys that share one
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        return cls(out, key, order, True, -(-n_rows // hot_rows) + parts + n_hot, broadcast_rows, whole)

    # -- windows -------------------------------------------------------------
    @property
    def parts(self) -> list[str]:
        return CHUNK if self.hot else list(self.key)

    def window(self):
        order = (["_place"] if self.hot else []) + ([] if self.whole else list(self.order))
        return Window.partitionBy(*self.parts).orderBy(*order)

    def running(self):
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def _carry_join(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        if self.carry_rows <= self.broadcast_rows:
            carry = F.broadcast(carry)
        return df.join(carry, CHUNK, "left")

    def _chunk_window(self):
        return Window.partitionBy("_kh", "_kg").orderBy("_chunk")

    def _hot_rows_of(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("_hot"))

    # -- carried quantities ------------------------------------------------------
    def with_seq(self, df: DataFrame, name: str = "seq") -> DataFrame:
        """1-based position of the row in its key's order."""
        local = F.row_number().over(self.window())
        if not self.hot:
            return df.withColumn(name, local)
        sizes = self._hot_rows_of(df).groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("_cn"))
        carry = sizes.select(*CHUNK, F.coalesce(
            F.sum("_cn").over(self._chunk_window().rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias(f"_{name}_off"))
        return (self._carry_join(df.withColumn(name, local), carry)
                .withColumn(name, (F.col(name) + F.coalesce(F.col(f"_{name}_off"), F.lit(0))).cast("int"))
                .drop(f"_{name}_off"))

    def with_lags(self, df: DataFrame, value: str, depth: int, prefix: str, base: DataFrame | None = None) -> DataFrame:
        """``{prefix}{i}`` = value ``i`` rows earlier in the key, i = 1..depth. ``base``: the same rows
        before other windows, if they have the value: the carry is then made without those."""
        w = self.window()
        cols = {f"{prefix}{i}": F.lag(value, i).over(w) for i in range(1, depth + 1)}
        if not self.hot:
            return df.withColumns(cols)
        pos = F.row_number().over(w)
        rows = self._hot_rows_of(df if base is None else base).select(*CHUNK, "_place", F.col(value).alias("v"))
        if depth == 1:      # a partial aggregate leaves one row a chunk before the shuffle
            tails = rows.groupBy(*CHUNK).agg(F.array(F.max_by(F.struct("_place", "v"), "_place")).alias("_tail"))
        else:
            rdesc = Window.partitionBy(*CHUNK).orderBy(F.col("_place").desc())
            tails = (rows.withColumn("_rd", F.row_number().over(rdesc))
                     .where(F.col("_rd") <= depth)
                     .groupBy(*CHUNK)
                     .agg(F.array_sort(F.collect_list(F.struct("_place", "v"))).alias("_tail")))
        # previous ``depth`` non-empty chunks hold at least ``depth`` rows in total
        carry = tails.select(*CHUNK, F.flatten(F.collect_list("_tail").over(
            self._chunk_window().rowsBetween(-depth, -1))).alias("_prev"))
        carry = carry.select(*CHUNK, F.transform(
            F.slice(F.col("_prev"), F.greatest(F.size("_prev") - depth + 1, F.lit(1)), depth),
            lambda s: s["v"]).alias(f"_{prefix}carry"))
        out = self._carry_join(df.withColumn("_pos", pos).withColumns(cols), carry)
        fixed = {}
        for i in range(1, depth + 1):
            back = F.lit(i) - F.col("_pos") + 1  # how far into the previous chunks
            from_carry = F.when(back <= F.size(F.col(f"_{prefix}carry")),
                                F.element_at(F.col(f"_{prefix}carry"), -back))
            fixed[f"{prefix}{i}"] = F.when(F.col("_pos") > i, F.col(f"{prefix}{i}")).otherwise(from_carry)
        return out.withColumns(fixed).drop("_pos", f"_{prefix}carry")

    def with_lead1(self, df: DataFrame, value: str, name: str) -> DataFrame:
        """``name`` = value of the next row in the key, NULL on the last row."""
        w = self.window()
        if not self.hot:
            return df.withColumn(name, F.lead(value, 1).over(w))
        firsts = (self._hot_rows_of(df).groupBy(*CHUNK)
                  .agg(F.min_by(F.col(value), "_place").alias("_first")))
        carry = firsts.select(*CHUNK,
                              F.lead("_first").over(self._chunk_window()).alias(f"_{name}_next"),
                              F.lead(F.lit(True)).over(self._chunk_window()).alias(f"_{name}_has"))
        out = df.withColumn(name, F.lead(value, 1).over(w)).withColumn(
            "_last", F.lead(F.lit(True), 1).over(w).isNull())
        out = self._carry_join(out, carry)
        return (out.withColumn(name, F.when(F.col("_last") & F.col(f"_{name}_has").isNotNull(),
                                            F.col(f"_{name}_next")).otherwise(F.col(name)))
                .drop("_last", f"_{name}_next", f"_{name}_has"))

    def with_running(self, df: DataFrame, specs: dict[str, tuple[str, Column]], base: DataFrame | None = None) -> DataFrame:
        """Running aggregates from the key's first row to the current one.

        ``specs``: name -> (kind, column) with kind in sum, max, min, last
        (last non-null value so far) and first (first non-null value). ``base`` as in ``with_lags``.
        """
        r = self.running()
        local_fn = {
            "sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "min": lambda c: F.min(c),
            "last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True),
        }
        out = df.withColumns({n: local_fn[k](c).over(r) for n, (k, c) in specs.items()})
        if not self.hot:
            return out
        aggs = []
        for n, (k, c) in specs.items():
            if k in ("sum", "max", "min"):
                aggs.append(local_fn[k](c).alias(f"_{n}_c"))
            elif k == "last":
                aggs.append(F.max_by(c, F.when(c.isNotNull(), F.col("_place"))).alias(f"_{n}_c"))
            else:
                aggs.append(F.min_by(c, F.when(c.isNotNull(), F.col("_place"))).alias(f"_{n}_c"))
        per_chunk = self._hot_rows_of(df if base is None else base).groupBy(*CHUNK).agg(*aggs)
        before = self._chunk_window().rowsBetween(Window.unboundedPreceding, -1)
        prefix = {
            "sum": lambda c: F.sum(c).over(before), "max": lambda c: F.max(c).over(before),
            "min": lambda c: F.min(c).over(before),
            "last": lambda c: F.last(c, ignorenulls=True).over(before),
            "first": lambda c: F.first(c, ignorenulls=True).over(before),
        }
        carry = per_chunk.select(*CHUNK, *[
            prefix[k](F.col(f"_{n}_c")).alias(f"_{n}_p") for n, (k, _) in specs.items()])
        out = self._carry_join(out, carry)
        combine = {
            "sum": lambda loc, p: F.when(p.isNull(), loc).otherwise(F.coalesce(loc, F.lit(0)) + p),
            "max": lambda loc, p: F.greatest(loc, p), "min": lambda loc, p: F.least(loc, p),
            "last": lambda loc, p: F.coalesce(loc, p), "first": lambda loc, p: F.coalesce(p, loc),
        }
        fixed = {n: combine[k](F.col(n), F.col(f"_{n}_p")) for n, (k, _) in specs.items()}
        return out.withColumns(fixed).drop(*[f"_{n}_p" for n in specs])

    def finish(self, df: DataFrame) -> DataFrame:
        return df.drop(*CHUNK, "_hot", "_place")
