"""Structured Streaming: stream == batch, late events, foreachBatch refreshes."""
import os

from pyspark.sql import functions as F

from liftlake.operators import calibrate as C
from liftlake.operators import sequence
from liftlake.sources.adapters import sessions
from liftlake.streaming import ingest

from conftest import SF_SMALL


def _split_files(spark, scratch, n=4):
    s = sessions(spark, SF_SMALL).drop("k")
    bounds = s.agg(F.min("ts"), F.max("ts")).first()
    lo, hi = bounds[0], bounds[1]
    step = (hi - lo) / n
    src = os.path.join(scratch, "src")
    for i in range(n):
        a, b = lo + step * i, lo + step * (i + 1)
        part = s.where((F.col("ts") >= a) & ((F.col("ts") < b) if i < n - 1 else F.lit(True)))
        part.coalesce(1).write.mode("overwrite").parquet(os.path.join(scratch, f"tmp{i}"))
        f = [x for x in os.listdir(os.path.join(scratch, f"tmp{i}")) if x.endswith(".parquet")][0]
        os.makedirs(src, exist_ok=True)
        os.link(os.path.join(scratch, f"tmp{i}", f), os.path.join(src, f"part{i}.parquet"))
    return src, s.schema


def test_stream_equals_batch_over_many_batches(spark, scratch):
    src, schema = _split_files(spark, scratch)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = ingest.run_to_table(ingest.session_ingest(stream), "t_ingest", spark,
                              checkpoint=os.path.join(scratch, "ckpt"))
    assert out.where("late").count() == 0
    got = {r["event_id"]: (r["load_delta"], r["seq"]) for r in out.collect()}
    batch = sequence.periodization(sessions(spark, SF_SMALL))
    want = {r["event_id"]: (r["load_delta"], r["seq"]) for r in batch.collect()}
    assert got.keys() == want.keys()
    for k, (d, s) in want.items():
        assert abs(got[k][0] - d) < 1e-9 and got[k][1] == s


def test_late_events_flagged(spark, scratch):
    src, schema = _split_files(spark, scratch, n=2)
    # replay the first file again under a new name: every row is now late
    os.link(os.path.join(src, "part0.parquet"), os.path.join(src, "part9.parquet"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = ingest.run_to_table(ingest.session_ingest(stream), "t_late", spark,
                              checkpoint=os.path.join(scratch, "ckpt"))
    n0 = spark.read.parquet(os.path.join(src, "part0.parquet")).count()
    assert out.where("late").count() == n0


def test_calibration_refresh_single_batch_equals_batch(spark, scratch):
    src, schema = _split_files(spark, scratch, n=1)
    stream = spark.readStream.schema(schema).parquet(src)
    q = ingest.calibration_refresh(stream, os.path.join(scratch, "state"), os.path.join(scratch, "ckpt"))
    q.awaitTermination()
    from liftlake.sources.store import read_snapshot
    got = read_snapshot(spark, os.path.join(scratch, "state", "calibration"))
    want = C.calibrate(C.stand_in_scores(sessions(spark, SF_SMALL))).drop("refit")
    cols = ["user_id", "compound", "last_calibrated_size", "runs"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(tuple(r) for r in want.select(*cols).collect())


def test_quality_refresh_runs_incrementally(spark, scratch):
    src, schema = _split_files(spark, scratch, n=3)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    root = os.path.join(scratch, "q")
    q = ingest.quality_refresh(stream, root, os.path.join(scratch, "ckpt"))
    q.awaitTermination()
    audit = spark.read.parquet(os.path.join(root, "audit"))
    closures = spark.read.parquet(os.path.join(root, "closures"))
    assert audit.count() > 0 and closures.count() > 0
    # every closure refers to a pending audit from an earlier batch
    assert closures.join(audit, "event_id", "left_anti").count() == 0
    # only a key's very first logged session can lack a previous one
    per_key = audit.where(F.col("prediction_source") == "insufficient_data").groupBy("user_id", "compound").count()
    assert per_key.where(F.col("count") > 1).count() == 0
    from liftlake.sources.store import read_snapshot
    quality = read_snapshot(spark, os.path.join(root, "quality"))
    keys = sessions(spark, SF_SMALL).select("user_id").distinct().count()
    assert quality.select("user_id").distinct().count() == keys
