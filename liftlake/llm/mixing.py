"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent, normalised. The
exponent is found by bisection: the largest one in [0, 1] whose weights reach a
target entropy (as a part of the largest possible), or whose most repeated
source is not read more than ``max_repeats`` times as often as the least
repeated. Weights become token budgets. By default the budgets are scaled so
that every document appears at least once; ``budget`` sets the mixture's tokens
instead, and then sources above their budget are read in part.

A source is read in epochs. Each epoch is a fresh keyed permutation of the
source's blocks (about ``BLOCK_TOKENS`` tokens each) and of the documents in a
block; the last epoch stops at the budget, inside a block. A copy's place in
its source's budget gives the output block, so that every block of the mixture
holds the sources by their weights. Prefix sums run over blocks, then inside a
block: no window spans a source.

Defined cases: a null source is a source of its own; a source without tokens is
read once; null ids and repeated rows are documents like any other; a null text
has no tokens and is read with its block, at least once; an empty table gives an
empty result; other columns pass through ``mix`` untouched, whatever their names,
but for those that it adds (``ADDED``), which replace the table's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftlake.llm.common import stored, words_of

BLOCK_TOKENS = 200_000
BLOCK_ROWS = 50_000
BROADCAST_SOURCES = 100_000   # plan rows (about 10 MB) up to which the plan is broadcast
OUTPUT_TOKENS = 1_000_000     # tokens of one block of the mixture
SECTIONS = 31                 # exponents tried in one pass of the bisection
PASSES = 6                    # the exponent is known to 32 ** -6


#: Columns that ``mix`` adds.
ADDED = ("mix_tokens", "mix_doc", "mix_weight", "mix_epoch", "mix_start", "mix_block", "mix_order")


def token_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def _entropy(share: Column, exponent: float) -> Column:
    """Entropy of the normalised powered shares, over the largest possible (1 for one source)."""
    power = F.pow(share, F.lit(exponent))
    z = F.sum(power)
    entropy = F.log(z) - F.sum(power * F.log(share)) * exponent / z
    return F.when(F.count("*") <= 1, 1.0).otherwise(entropy / F.log(F.count("*")))


def _repeats(share: Column, exponent: float) -> Column:
    """How much oftener the smallest source is read than the largest."""
    return F.pow(F.max(share) / F.min(share), F.lit(1.0 - exponent))


def find_exponent(totals: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """Bisect the exponent over ``totals(tokens)``, SECTIONS trial points a pass.

    Entropy and repetition both fall as the exponent grows. With a target
    entropy the result is the largest exponent that still reaches it (0 if
    none does); with a limit it is the smallest that keeps it."""
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give target_entropy or max_repeats")
    live = totals.filter("tokens > 0")
    whole = live.agg(F.sum("tokens")).first()[0]
    if not whole:
        return 1.0
    share = F.col("tokens") / F.lit(float(whole))
    low, high = 0.0, 1.0

    def measures(points):
        cols = [(_entropy(share, p) if max_repeats is None else _repeats(share, p)).alias(f"p{i}") for i, p in enumerate(points)]
        return list(live.agg(*cols).first())

    at_low, at_high = measures([low, high])
    if max_repeats is None:
        if at_high >= target_entropy:
            return 1.0
        if at_low < target_entropy:
            return 0.0
    elif at_low <= max_repeats:
        return 0.0
    for _ in range(PASSES):
        points = [low + (high - low) * i / (SECTIONS + 1) for i in range(1, SECTIONS + 1)]
        for p, m in zip(points, measures(points)):
            if max_repeats is None:
                low, high = (p, high) if m >= target_entropy else (low, min(high, p))
            else:
                low, high = (p, high) if m > max_repeats else (low, min(high, p))
    return low if max_repeats is None else high


def _keyed(*parts: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with mix_tokens (words) and mix_doc (64-bit key of id and text)."""
    return docs.withColumns({"mix_tokens": token_count(F.col("text")), "mix_doc": F.xxhash64("doc_id", "text")})


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Join the plan, one row per source; broadcast while it is checked to be small."""
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    return rows.join(plan, "_source")


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None,
        budget: int | None = None, seed: int = 1) -> DataFrame:
    """The copies of ``docs(doc_id, text, source, ...)`` that the mixture reads, with all their columns.

    Added: mix_tokens, mix_doc, mix_weight (of the source), mix_epoch (from 0),
    mix_start (tokens of the source read before), mix_block (output block) and
    mix_order (sort key in the block). ``docs`` may bring ``measured``'s
    columns instead of the text. Whole rows move once, to their block."""
    if "text" in docs.columns or not {"mix_tokens", "mix_doc"} <= set(docs.columns):
        docs = measured(docs)
    names = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "mix_tokens", "mix_doc",
                       F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-")).alias("_source"))
    narrow = stored(rows.select("_source", "mix_tokens", "mix_doc"), "mix-tokens")
    totals = stored(narrow.groupBy("_source").agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("n")), "mix-sources")
    exponent = find_exponent(totals, target_entropy, max_repeats)
    tokens = F.col("tokens").cast("double")
    scale = totals.filter("tokens > 0").agg(F.sum(F.pow(tokens, F.lit(exponent))), F.max(F.pow(tokens, F.lit(1.0 - exponent)))).first()
    z, least = (scale[0] or 1.0), (scale[1] or 1.0)
    size = float(budget) if budget else z * least        # every source at least once
    weight = F.when(F.col("tokens") > 0, F.pow(tokens, F.lit(exponent)) / z).otherwise(0.0)
    turns_ = F.when(F.col("tokens") > 0, weight * size / tokens).otherwise(0.0)
    whole = F.when(F.abs(turns_ - F.round(turns_)) < 1e-9, F.round(turns_)).otherwise(turns_)   # no document lost to float error
    plan = stored(totals.select(
        "_source", F.col("tokens").alias("_total"), weight.alias("mix_weight"), F.round(whole * tokens).cast("long").alias("_budget"),
        F.when(F.col("tokens") > 0, F.ceil(whole)).otherwise(1).cast("long").alias("_epochs"),
        F.greatest(F.lit(1), F.ceil(tokens / BLOCK_TOKENS), F.ceil(F.col("n") / BLOCK_ROWS)).cast("long").alias("_blocks")), "mix-plan")

    # Blocks of a source: by hash, the same in every epoch. Turns: one row per (source, block, epoch).
    block = F.pmod(_keyed("mix_doc", seed=seed), F.col("_blocks")).alias("_block")
    sizes = _with_plan(narrow, plan.select("_source", "_blocks")).groupBy("_source", block).agg(F.sum("mix_tokens").alias("_size"))
    epoch = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_epochs") - 1)).alias("_epoch")
    turns = _with_plan(stored(sizes, "mix-blocks"), plan.filter("_epochs > 0").drop("_blocks", "mix_weight")).select("*", epoch)
    turns = turns.withColumn("_turn", _keyed("_epoch", "_block", seed=seed + 1))
    before = Window.partitionBy("_source", "_epoch").orderBy("_turn", "_block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_epoch") * F.col("_total") + F.coalesce(F.sum("_size").over(before), F.lit(0))
    turns = turns.withColumn("_first", first)
    # A block without tokens is read once, wherever the permutation puts it.
    turns = turns.filter((F.col("_first") < F.col("_budget")) | ((F.col("_size") == 0) & (F.col("_epoch") == 0)))

    # Documents follow their blocks; a copy is read if it starts inside the budget.
    copies = _with_plan(rows, plan.select("_source", "_blocks", "mix_weight", "_budget")).withColumn("_block", block)
    copies = copies.join(turns.select("_source", "_block", "_epoch", "_first"), ["_source", "_block"])
    inside = Window.partitionBy("_source", "_block", "_epoch").orderBy(_keyed("_epoch", "mix_doc", seed=seed + 2), "mix_doc")
    prior = F.coalesce(F.sum("mix_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    copies = copies.withColumn("mix_start", F.col("_first") + prior)
    copies = copies.filter((F.col("mix_start") < F.col("_budget")) | (F.col("mix_tokens") == 0))
    blocks = max(1, -(-int(size) // OUTPUT_TOKENS))
    place = F.floor(F.col("mix_start") / F.greatest(F.col("_budget"), F.lit(1)) * blocks)
    return copies.select(
        *[F.col(f"row.`{c}`").alias(c) for c in names], "mix_tokens", "mix_doc", "mix_weight", F.col("_epoch").alias("mix_epoch"), "mix_start",
        F.least(place, F.lit(blocks - 1)).cast("long").alias("mix_block"), _keyed("mix_doc", "_epoch", seed=seed + 3).alias("mix_order"))
