"""Streaming tables: the same rows however the stream is cut, late rows, retried batches, hot keys; bucketed tables and batch logs."""

import datetime
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftlake.sources.buckets import BatchLog, BucketTable
from liftlake.streaming import tables as ST

from conftest import SF_SMALL

DDL = "user_id long, compound string, ts timestamp_ntz, event_id long, weight double, reps int, rpe double"


def made_sessions(seed=5, n=420):
    """Sessions of a few keys, some of them constant, some invalid; one key holds a third of the rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = 1 if rng.random() < 0.33 else rng.randint(2, 6)
        weight = 50.0 if user == 6 and i < 300 else rng.choice([40.0, 42.5, 45.0, 60.0, None, -1.0] if user == 3 else [40.0, 42.5, 45.0, 60.0])
        rows.append((user, rng.choice(["squat", "bench_press"]), datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i // 2), i, weight,
                     rng.choice([1, 5, 5, 0]), rng.choice([None, 7.0, 8.5, 11.0])))
    return rows


def by_id(df):
    return {r.event_id: r.asDict() for r in df.collect()}


JOBS = {"ingest_sessions": lambda t: t.outcomes(), "refresh_quality_stream": lambda t: t.view(),
        "refresh_calibration_stream": lambda t: t.calibration()}


@pytest.mark.parametrize("job", JOBS)
def test_results_do_not_depend_on_the_batches(spark, scratch, job):
    rows = spark.createDataFrame([(None if r[0] == 2 else r[0], *r[1:]) for r in made_sessions()], DDL)
    seen = []
    for n in (1, 4):
        tables, step = getattr(ST, job)(spark, f"{scratch}/{n}")
        ST.replay(rows, step, f"{scratch}/r{n}", n)
        extra = tables.quality.read().collect() if job == "refresh_quality_stream" else []
        seen.append(sorted(map(str, [*JOBS[job](tables).collect(), *extra])))
    assert seen[0] == seen[1] and len(seen[0]) > 8


def plain_calibration(rows):
    """Event by event: score, window of 32, fit when due; as the reference does on every prediction."""
    out, by = {}, defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        by[r[:2]].append(r[4])
    for key, w in by.items():
        a, b, size, runs, used = 1.0, 0.0, 0, 0, []
        for i in range(1, len(w)):
            prev = [v for v in w[max(0, i - 4):i - 1] if v is not None]
            if not prev or w[i] is None or w[i - 1] is None:
                continue
            used = (used + [(np.mean(prev) - w[i - 1], w[i] - w[i - 1])])[-32:]
            x, y = np.array(used).T
            if len(used) < 8 or not (size == 0 or len(used) - size >= 10) or not x.any():
                continue
            const = x.min() == x.max()
            slope = y.mean() / (2 * x[0]) if const else np.cov(x, y, bias=True)[0, 1] / x.var()
            icpt = y.mean() / 2 if const else y.mean() - slope * x.mean()
            a, b, size, runs = float(np.clip(slope, 0.6, 1.4)), float(icpt), len(used), runs + 1
        out[key] = (round(a, 6), round(b, 6), size, runs)
    return out


@pytest.mark.parametrize("batches", [3])
def test_calibration_equals_an_event_by_event_fold(spark, scratch, batches):
    rows = made_sessions()
    tables, step = ST.refresh_calibration_stream(spark, f"{scratch}/t")
    ST.replay(spark.createDataFrame(rows, DDL), step, f"{scratch}/r", batches)
    got = {(r.user_id, r.compound): (round(r.a, 6), round(r.b, 6), r.last_calibrated_size, r.runs) for r in tables.calibration().collect()}
    want = plain_calibration(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=2e-6), k
    assert {v[3] for v in want.values()} >= {1, 3}


@pytest.mark.parametrize("hot", [None, 5])
def test_ingest_holds_every_row_once_and_splits_hot_keys(spark, scratch, hot):
    rows = made_sessions()
    tables, step = ST.ingest_sessions(spark, f"{scratch}/t", hot_rows=hot)
    ST.replay(spark.createDataFrame(rows, DDL), step, f"{scratch}/r", 3)
    accepted, rejected = by_id(tables.accepted()), by_id(tables.rejected())
    assert tables.late().count() == 0 and len(accepted) + len(rejected) == len(rows)
    last, count = {}, Counter()
    for u, c, ts, i, w, reps, rpe in rows:
        bad = ("weight_not_positive" if w is None or w <= 0 else "reps_not_positive_integer" if reps <= 0
               else "rpe_out_of_range" if rpe is None or rpe > 10 else None)
        if bad:
            assert rejected[i]["reject_reason"] == bad
            continue
        count[u, c] += 1
        assert accepted[i]["load_delta"] == w - last.get((u, c), w) and accepted[i]["seq"] == count[u, c]
        last[u, c] = w


def test_late_rows_change_nothing(spark, scratch):
    rows = [r for r in made_sessions() if r[4] is not None]
    df = spark.createDataFrame(rows, DDL)
    late = spark.createDataFrame([(1, "squat", datetime.datetime(2024, 1, 2), 10_000, 99.0, 5, 8.0), (1, "squat", None, 10_001, 99.0, 5, 8.0)], DDL)
    for make, read in ((ST.ingest_sessions, lambda t: t.accepted()), (ST.refresh_quality_stream, lambda t: t.view()),
                       (ST.refresh_calibration_stream, lambda t: t.calibration())):
        root = f"{scratch}/{make.__name__}"
        tables, step = make(spark, f"{root}/t")
        ST.replay(df, step, f"{root}/r", 2)
        before = sorted(map(str, read(tables).collect()))
        step(late, 2)
        assert sorted(map(str, read(tables).collect())) == before
        assert {r.event_id for r in tables.late().collect()} == {10_000, 10_001}


def test_retried_batches_give_the_same_tables(spark, scratch):
    df = spark.createDataFrame([r for r in made_sessions() if r[4] is not None], DDL).withColumn("k", F.hour("ts"))
    parts = [df.where(F.col("event_id") < 150).drop("k"), df.where(F.col("event_id").between(150, 299)).drop("k"), df.where(F.col("event_id") >= 300).drop("k")]
    seen = []
    for order in ((0, 1, 2), (0, 1, 1, 2)):
        tables, step = ST.refresh_quality_stream(spark, f"{scratch}/{len(order)}", hot_rows=40 if len(order) > 3 else None)
        for i in order:
            step(parts[i], i)
        seen.append((sorted(map(str, tables.view().collect())), sorted(map(str, tables.quality.read().collect()))))
    assert seen[0] == seen[1] and seen[0][0]
    # every session is logged once, closed by the next one of its key
    closed = [r for r in tables.view().collect() if r.prediction_status == "complete"]
    keys = df.select("user_id", "compound").distinct().count()
    assert len(closed) == df.count() - keys


SCHEMA = "user_id bigint, compound string, v double"


def frame(spark, pairs):
    return spark.createDataFrame([(u, "squat", v) for u, v in pairs], SCHEMA)


def test_upsert_rewrites_touched_buckets_only(spark, scratch):
    table = BucketTable(spark, f"{scratch}/t", SCHEMA, buckets=16)
    assert table.read().count() == 0
    table.upsert(frame(spark, [(u, float(u)) for u in range(200)]), 0)
    table.upsert(frame(spark, [(7, 70.0), (500, 5.0)]), 1)
    assert {r.user_id: r.v for r in table.read().collect()} == {**{u: float(u) for u in range(200)}, 7: 70.0, 500: 5.0}
    assert len(table.touched(frame(spark, [(7, 0.0), (500, 0.0)]))) == len({b for b, i in table._commit(None).items() if i == 1}) <= 2
    assert {r.user_id: r.v for r in table.read(before=1).collect()}[7] == 7.0      # readers of the older commit


def test_uncommitted_and_retried_batches(spark, scratch):
    table = BucketTable(spark, f"{scratch}/t", SCHEMA, buckets=4)
    table.upsert(frame(spark, [(1, 1.0), (2, 2.0)]), 0)
    frame(spark, [(1, 9.0)]).write.parquet(f"{scratch}/t/data/batch=1/bucket=0")      # a batch that died before its commit
    assert {r.user_id: r.v for r in table.read().collect()} == {1: 1.0, 2: 2.0}
    for _ in range(2):
        table.upsert(frame(spark, [(1, 10.0), (3, 3.0)]), 1)
        assert {r.user_id: r.v for r in table.read().collect()} == {1: 10.0, 2: 2.0, 3: 3.0}
    table.upsert(frame(spark, []), 2)
    assert table.read().count() == 3
    with pytest.raises(ValueError):
        BucketTable(spark, f"{scratch}/t", SCHEMA, buckets=5).read()


def test_null_keys_are_a_key(spark, scratch):
    table = BucketTable(spark, f"{scratch}/t", SCHEMA, buckets=4)
    table.upsert(frame(spark, [(None, 1.0), (1, 1.0)]), 0)
    table.upsert(frame(spark, [(None, 2.0)]), 1)
    assert sorted(((r.user_id, r.v) for r in table.read().collect()), key=str) == [(1, 1.0), (None, 2.0)]


def test_batch_log_is_retry_safe(spark, scratch):
    log = BatchLog(spark, f"{scratch}/log", SCHEMA)
    assert log.read().count() == 0
    for batch, n in ((0, 3), (1, 4), (1, 4), (0, 3), (2, 0)):
        log.write(frame(spark, [(batch * 10 + k, 0.0) for k in range(n)]), batch)
    assert Counter(r.user_id for r in log.read().collect()) == Counter([0, 1, 2, 10, 11, 12, 13])
    assert log.read(upto=0).count() == 3 and log.batch(1).count() == 4
    frame(spark, [(99, 0.0)]).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{scratch}/log/batch=7")
    assert log.read().where("user_id = 99").count() == 0
