"""Adapters from the driver's tables to the training-log domain.

``sessions`` comes from ``events`` (one row per logged top set),
``session_audit`` from ``sessions``, and ``sets`` (a raw set export with
dates, workouts and exercise names) from ``lineitem`` joined to ``orders``.
Every adapter is a lazy projection: filters and column pruning reach the
parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftlake.functions.scalar import local_table, nan_to_null
from liftlake.operators.scan import null_safe_join
from liftlake.schema import EXERCISES, KEY, ORDER, UNMAPPED_EXERCISES

# event_type -> compound; 'error' rows are not sessions.
EVENT_COMPOUND = (("click", "squat"), ("view", "bench_press"),
                  ("purchase", "lat_pulldown"), ("signup", "seated_row"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(table: DataFrame, key: str) -> DataFrame:
    """A plain scan of fewer partitions than cores, dealt out by ``key``; a larger one as it is.

    A file of one row group is read by one task, whatever follows in the same
    stage. Such a table is small, so its shuffle is, and a join on ``key`` needs no other."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table


def _event_k() -> F.Column:
    return F.get_json_object(F.col("props"), "$.k").cast("int")


def session_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a session row, with its event_type; compound is null where the type is no lift."""
    ev = read_table(spark, sf_dir, "events")
    compound = None
    for e, c in EVENT_COMPOUND:
        compound = (F.when(F.col("event_type") == e, F.lit(c)) if compound is None
                    else compound.when(F.col("event_type") == e, F.lit(c)))
    k = _event_k()
    return ev.select(
        "user_id", compound.alias("compound"), "ts", "event_id",
        nan_to_null("value").alias("weight"),
        (k % 12 + 1).cast("int").alias("reps"),
        F.when(k % 10 == 0, F.lit(None).cast("double"))
         .otherwise(F.lit(5.0) + (k % 11).cast("double") * F.lit(0.5)).alias("rpe"),
        k.alias("k"), "event_type")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sessions(user_id, compound, ts, event_id, weight, reps, rpe, k): the events that are lifts."""
    lifts = F.col("event_type").isin([e for e, _ in EVENT_COMPOUND])
    return session_candidates(spark, sf_dir).where(lifts).drop("event_type")


def session_audit(spark: SparkSession, sf_dir: str, pending_newest: int = 0) -> DataFrame:
    """Completed audit rows; the ``pending_newest`` newest rows per key stay pending."""
    s = sessions(spark, sf_dir)
    k, w = F.col("k"), F.col("weight")
    model = F.coalesce(k % 2 == 0, F.lit(False))
    rec = F.when(model, w * (F.lit(1.0) + ((k % 7) - 3).cast("double") * F.lit(0.04))).otherwise(
        w * (F.lit(1.0) + ((k % 11) - 5).cast("double") * F.lit(0.04)))
    out = s.select(
        *KEY, *ORDER, "weight", "reps", "rpe",
        F.when(k % 10 == 9, F.lit("hard")).otherwise(F.lit("normal")).alias("deviation_reason"),
        F.when(model, F.lit("model")).otherwise(F.lit("rule_based")).alias("prediction_source"),
        rec.alias("recommended_weight"))
    status = F.lit("complete")
    if pending_newest:
        # the newest few per key by a map-side limit, joined back on key and order: no key is ranked whole
        newest = Window.partitionBy(*KEY).orderBy(*[F.col(c).desc() for c in ORDER])
        top = (s.select(*KEY, *ORDER).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= pending_newest)
               .select(*KEY, *ORDER, F.lit(True).alias("_pending")).distinct())
        out = null_safe_join(out, top, [*KEY, *ORDER])
        status = F.when(F.col("_pending"), F.lit("pending")).otherwise(status)
    done = status == "complete"
    out = out.withColumns({
        "actual_weight": F.when(done, F.col("weight")),
        "accuracy_delta": F.when(done, F.col("weight") - F.col("recommended_weight")),
        "prediction_status": status,
    })
    return out.drop("_pending") if pending_newest else out


def exercise_catalog() -> list[tuple[int, str, str]]:
    """(entry number, normalised name, display name) for the 72 adapter exercises."""
    names = sorted(e for e, _, _ in EXERCISES) + list(UNMAPPED_EXERCISES)
    return [(i, n, n.replace("_", " ").title()) for i, n in enumerate(names)]


def exercise_catalog_df(spark: SparkSession) -> DataFrame:
    return local_table(spark, exercise_catalog(), ["ex_idx", "ex_norm", "ex_display"], ["long", "string", "string"])


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw set log: one row per lineitem, its order giving user, date and workout.

    Columns: user_id, date, workout_name, set_order, exercise_name, weight,
    reps, rpe, distance, plus the lineitem columns that together identify a
    row (key, quantity, price, discount, flag) as the unique tie-break.
    """
    li = spread(read_table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                                   "o_orderpriority")
    cat = F.broadcast(exercise_catalog_df(spark))  # 72 fixed rows
    j = (li.join(od, li.l_orderkey == od.o_orderkey, "inner")
         .join(cat, (F.col("l_partkey") % 72) == F.col("ex_idx"), "left"))
    display = F.col("ex_display")
    raw_name = (F.when(F.col("l_linenumber") == 2, F.concat(display, F.lit(" (Barbell)")))
                .when(F.col("l_linenumber") == 3, F.concat(F.lit(" "), display, F.lit(" ")))
                .otherwise(display))
    return j.select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("workout_name"),
        F.col("l_linenumber").alias("set_order"),
        raw_name.alias("exercise_name"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("weight"),
        F.col("l_quantity").cast("int").alias("reps"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double"))
         .otherwise(F.lit(5.0) + F.lit(50.0) * F.col("l_discount")).alias("rpe"),
        F.when(F.col("l_returnflag") == "R", F.lit(None).cast("double"))
         .otherwise(F.lit(0.0)).alias("distance"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag")


SET_ORDER = ("date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_returnflag")


def export_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set log in the raw export layout: export column names, all strings.

    A few values are deliberately unparsable ('n/a' weights, a bad date) and
    some names carry stray whitespace, so coercion and stripping have work.
    ``source`` says which of the two exports a row belongs to: ``full`` rows
    carry RPE and set order, ``lite`` rows (every fifth order) lack both.
    """
    s = sets(spark, sf_dir)
    lite = (F.col("l_orderkey") % 5) == 0
    bad_w = (F.col("l_partkey") % 97) == 0
    bad_d = ((F.col("l_linenumber") == 6) & ((F.col("l_partkey") % 50) == 0))
    return s.select(
        F.when(bad_d, F.lit("not a date"))
         .otherwise(F.date_format("date", "yyyy-MM-dd HH:mm:ss")).alias("Date"),
        F.when(F.col("l_linenumber") == 4, F.concat(F.lit(" "), "workout_name", F.lit("\t")))
         .otherwise(F.col("workout_name")).alias("Workout Name"),
        (F.col("l_linenumber") * 10).cast("string").alias("Duration"),
        F.col("exercise_name").alias("Exercise Name"),
        F.when(lite, F.lit(None).cast("string")).otherwise(F.col("set_order").cast("string")).alias("Set Order"),
        F.when(bad_w, F.lit("n/a")).otherwise(F.col("weight").cast("string")).alias("Weight"),
        F.col("reps").cast("string").alias("Reps"),
        F.col("distance").cast("string").alias("Distance"),
        F.lit("0").alias("Seconds"),
        F.lit(None).cast("string").alias("Notes"),
        F.lit("").alias("Workout Notes"),
        F.when(lite, F.lit(None).cast("string")).otherwise(F.col("rpe").cast("string")).alias("RPE"),
        F.col("user_id"),
        F.when(lite, F.lit("lite")).otherwise(F.lit("full")).alias("source"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag")
