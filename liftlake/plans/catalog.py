"""Registered queries: one Spark plan and (where SQL can say it) one oracle SQL.

Every query reads the driver's tables (through the adapters) in full, so its
work grows with the data. Names carry the SURVEY §2 operator id.
"""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.functions.scalar import stable_round
from liftlake.operators import recommend, sequence
from liftlake.plans import sql as S
from liftlake.schema import KEY, ORDER
from liftlake.sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = S.stable_round_sql(sql)
        return fn
    return deco


def _r(c, digits: int = 6):
    return stable_round(c, digits)


# ---------------------------------------------------------------------------
# Step 1: the flagship -- rule-based next load for every (user, lift)
# ---------------------------------------------------------------------------
_RULE = S.rule_sql("weight", "reps", "rpe")
register("sc2_next_load_rule", S.with_ctes(S.SESSIONS) + f"""
, last AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, compound ORDER BY ts DESC, event_id DESC) AS rn,
           count(*) OVER (PARTITION BY user_id, compound) AS session_count
    FROM sessions) WHERE rn = 1)
SELECT user_id, compound, session_count, weight AS last_weight, reps AS last_reps, rpe AS last_rpe,
       {_RULE['suggested_weight']} AS suggested_weight, {_RULE['reason']} AS reason,
       {_RULE['applied_drop']} AS applied_drop, {_RULE['applied_cap']} AS applied_cap
FROM last""")(lambda spark, d: recommend.next_load_rule(A.sessions(spark, d)))


# ---------------------------------------------------------------------------
# Step 2: sequence features (W1-W8b, M2), summaries (A3, A4), report
# ---------------------------------------------------------------------------
_W = "PARTITION BY user_id, compound ORDER BY ts, event_id"
_PERIOD_SQL = S.with_ctes(S.SESSIONS) + f"""
, b AS (
  SELECT *, CAST(row_number() OVER ({_W}) AS INTEGER) AS seq,
         lag(weight) OVER ({_W}) AS prev_weight, lead(weight) OVER ({_W}) AS next_weight,
         max(weight) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS max_weight_so_far
  FROM sessions)
, c AS (
  SELECT *, COALESCE(weight - prev_weight, 0.0::DOUBLE) AS load_delta,
         next_weight - weight AS next_load_delta,
         COALESCE((prev_weight - weight) / NULLIF(prev_weight, 0.0::DOUBLE) >= 0.15::DOUBLE, false) AS is_deload
  FROM b)
, d AS (
  SELECT *, CAST(sum(CAST(is_deload AS INTEGER)) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                 AS INTEGER) AS cycle_number
  FROM c)
, periodized AS (
  SELECT user_id, compound, ts, event_id, weight, reps, rpe, seq, prev_weight, next_weight,
         load_delta, next_load_delta, is_deload, cycle_number,
         CAST(row_number() OVER (PARTITION BY user_id, compound, cycle_number ORDER BY ts, event_id) AS INTEGER)
           AS weeks_in_cycle,
         max_weight_so_far, weight / NULLIF(max_weight_so_far, 0.0::DOUBLE) AS percent_of_max,
         CASE WHEN is_deload OR seq = 1 THEN 0.0::DOUBLE ELSE COALESCE(weight - prev_weight, 0.0::DOUBLE) END
           AS cycle_weight_trend,
         weight - first_value(weight) OVER (PARTITION BY user_id, compound, cycle_number ORDER BY ts, event_id)
           AS cycle_weight_cum
  FROM d)
"""
_PERIOD_COLS = ["user_id", "compound", "ts", "event_id", "weight", "reps", "rpe", "seq", "prev_weight",
                "next_weight", "load_delta", "next_load_delta", "is_deload", "cycle_number",
                "weeks_in_cycle", "max_weight_so_far", "percent_of_max", "cycle_weight_trend",
                "cycle_weight_cum"]


def _periodized(spark, d, hot_rows=None):
    return sequence.periodization(A.sessions(spark, d), hot_rows=hot_rows).select(*_PERIOD_COLS)


register("m2_periodization", _PERIOD_SQL + "SELECT * FROM periodized")(
    lambda spark, d: _periodized(spark, d))
# Same operator with every key above 4 rows split into time chunks (skew path).
register("m2_periodization_hotkeys", _PERIOD_SQL + "SELECT * FROM periodized")(
    lambda spark, d: _periodized(spark, d, hot_rows=4))

register("w1_load_delta", _PERIOD_SQL + """
SELECT user_id, compound, event_id, weight, load_delta FROM periodized""")(
    lambda spark, d: _periodized(spark, d).select(*KEY, "event_id", "weight", "load_delta"))

register("w2_next_load_target", _PERIOD_SQL + """
SELECT user_id, compound, event_id, weight, next_load_delta FROM periodized
WHERE next_load_delta IS NOT NULL""")(
    lambda spark, d: _periodized(spark, d).where(F.col("next_load_delta").isNotNull())
    .select(*KEY, "event_id", "weight", "next_load_delta"))

register("w16_last_session", S.with_ctes(S.SESSIONS) + """
SELECT user_id, compound, ts, event_id, weight, reps, rpe, session_count FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, compound ORDER BY ts DESC, event_id DESC) AS rn,
         count(*) OVER (PARTITION BY user_id, compound) AS session_count
  FROM sessions) WHERE rn = 1""")(
    lambda spark, d: sequence.last_per_key(A.sessions(spark, d),
                                           cols=["ts", "event_id", "weight", "reps", "rpe"]))

register("w17_recent_sessions", S.with_ctes(S.SESSIONS) + """
SELECT user_id, compound, event_id, weight, recent_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id, compound ORDER BY ts DESC, event_id DESC)
                 AS INTEGER) AS recent_rank
  FROM sessions) WHERE recent_rank <= 15""")(
    lambda spark, d: sequence.last_n(A.sessions(spark, d), 15)
    .select(*KEY, "event_id", "weight", "recent_rank"))

register("w18_train_valid_split", S.with_ctes(S.SESSIONS) + """
SELECT user_id, compound, event_id,
       CASE WHEN row_number() OVER (PARTITION BY user_id, compound ORDER BY ts, event_id)
                 <= floor(count(*) OVER (PARTITION BY user_id, compound) * 0.8::DOUBLE)
            THEN 'train' ELSE 'valid' END AS split
FROM sessions""")(
    lambda spark, d: sequence.chronological_split(A.sessions(spark, d), 0.8)
    .select(*KEY, "event_id", "split"))

register("a3_user_summary", _PERIOD_SQL + """
SELECT user_id, compound, count(*) AS sessions,
       arg_max(weight, seq) AS current_weight, max(weight) AS max_weight, min(weight) AS min_weight,
       round(avg(load_delta), 6) AS mean_load_delta,
       round(arg_max(weight, seq) / NULLIF(max(weight), 0.0::DOUBLE) * 100.0::DOUBLE, 6) AS current_pct_of_max
FROM periodized GROUP BY user_id, compound""")(
    lambda spark, d: _periodized(spark, d).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.max_by("weight", "seq").alias("current_weight"),
        F.max("weight").alias("max_weight"), F.min("weight").alias("min_weight"),
        _r(F.avg("load_delta")).alias("mean_load_delta"),
        _r(F.try_divide(F.max_by("weight", "seq"), F.max("weight")) * 100.0).alias("current_pct_of_max")))


def _session_counts(spark, d):
    users = A.read_table(spark, d, "events").select("user_id").distinct()
    keys = recommend.all_keys(users)
    counts = A.sessions(spark, d).groupBy(*KEY).agg(F.count(F.lit(1)).alias("session_count"))
    return keys.join(counts, list(KEY), "left").select(
        *KEY, F.coalesce("session_count", F.lit(0)).alias("session_count"))


register("a4_session_count", S.with_ctes(S.SESSIONS) + """
, users AS (SELECT DISTINCT user_id FROM events)
, keys AS (SELECT user_id, unnest(['squat', 'bench_press', 'lat_pulldown', 'seated_row']) AS compound FROM users)
SELECT k.user_id, k.compound, COALESCE(c.n, 0) AS session_count
FROM keys k LEFT JOIN (SELECT user_id, compound, count(*) AS n FROM sessions GROUP BY 1, 2) c
  ON k.user_id = c.user_id AND k.compound = c.compound""")(_session_counts)

register("r5_progression_report", _PERIOD_SQL + """
, recent AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id, compound ORDER BY ts DESC, event_id DESC) AS INTEGER)
           AS recent_rank FROM periodized)
, summary AS (
  SELECT user_id, compound, count(*) AS sessions, max(weight) AS max_weight,
         arg_max(weight, seq) AS current_weight FROM periodized GROUP BY 1, 2)
SELECT r.user_id, r.compound, seq, recent_rank, weight, reps, rpe, load_delta, is_deload, cycle_number,
       weeks_in_cycle, max_weight_so_far, percent_of_max, sessions, max_weight, current_weight
FROM recent r JOIN summary s ON r.user_id = s.user_id AND r.compound = s.compound
WHERE recent_rank <= 50""")(
    lambda spark, d: recommend.progression_report(A.sessions(spark, d), 50))


# ---------------------------------------------------------------------------
# Step 3: cleaning (PF*), imputation (A1, J4), set order (W15), merge (SO1),
# exercise lookups (J1-J3, J9, A19, PF12, PF13), dataset stats
# ---------------------------------------------------------------------------
from liftlake.operators import clean, lookup  # noqa: E402

_EXPORT_CTES = S.with_ctes(S.catalog_values(), S.SETS, S.EXPORT)
_APP = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag"


def _strip(c):
    return S.strip_sql(c)


def _num(c):
    return f"CASE WHEN isnan(TRY_CAST({c} AS DOUBLE)) THEN NULL ELSE TRY_CAST({c} AS DOUBLE) END"


_CLEAN_SQL = _EXPORT_CTES + f"""
, cleaned0 AS (
  SELECT user_id, source, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
         l_returnflag,
         TRY_CAST("Date" AS TIMESTAMP) AS date, {_strip('"Workout Name"')} AS workout_name,
         {_num('"Duration"')} AS duration, {_strip('"Exercise Name"')} AS exercise_name,
         {_num('"Set Order"')} AS set_order, {_num('"Weight"')} AS weight, {_num('"Reps"')} AS reps,
         {_num('"Distance"')} AS distance, {_num('"Seconds"')} AS seconds,
         {_strip('"Notes"')} AS notes, {_strip('"Workout Notes"')} AS workout_notes, {_num('"RPE"')} AS rpe
  FROM export)
, cleaned AS (
  SELECT *, {S.norm_sql('exercise_name')} AS exercise_normalized,
         COALESCE(weight, 0.0::DOUBLE) * COALESCE(reps, 0.0::DOUBLE) AS set_volume,
         COALESCE(weight, 0.0::DOUBLE) * (COALESCE(rpe, 0.0::DOUBLE) / 10.0::DOUBLE) AS effective_load
  FROM cleaned0)
"""

_MERGED_COLS = sorted(["user_id", "source", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                       "l_extendedprice", "l_discount", "l_returnflag", "date",
                       "workout_name", "duration", "exercise_name", "set_order", "weight", "reps", "distance",
                       "seconds", "notes", "workout_notes", "rpe", "exercise_normalized", "set_volume",
                       "effective_load"])
_MERGE_SQL = _CLEAN_SQL + f"""
, rpe_lookup AS (
  SELECT exercise_name, round(avg(rpe), 9) AS rpe_mean FROM cleaned WHERE source = 'full' GROUP BY exercise_name)
, lite AS (
  SELECT c.* EXCLUDE (rpe, set_order, set_volume, effective_load), k.rpe_mean AS rpe,
         CAST(row_number() OVER (PARTITION BY c.user_id, c.workout_name, c.date
                                 ORDER BY c.l_orderkey, c.l_linenumber, c.l_partkey, c.l_suppkey, c.l_quantity,
                                          c.l_extendedprice, c.l_discount, c.l_returnflag) AS DOUBLE)
           AS set_order
  FROM cleaned c LEFT JOIN rpe_lookup k ON c.exercise_name = k.exercise_name
  WHERE c.source = 'lite')
, lite_f AS (
  SELECT *, COALESCE(weight, 0.0::DOUBLE) * COALESCE(reps, 0.0::DOUBLE) AS set_volume,
         COALESCE(weight, 0.0::DOUBLE) * (COALESCE(rpe, 0.0::DOUBLE) / 10.0::DOUBLE) AS effective_load
  FROM lite)
, merged AS (
  SELECT {", ".join(_MERGED_COLS)} FROM cleaned WHERE source = 'full'
  UNION ALL
  SELECT {", ".join(_MERGED_COLS)} FROM lite_f)
"""


def _cleaned(spark, d):
    return clean.clean_export(A.export_raw(spark, d))


def _merged(spark, d):
    return clean.preprocess(A.export_raw(spark, d))


register("pf_clean_export", _CLEAN_SQL + "SELECT * FROM cleaned")(_cleaned)

register("a1_rpe_lookup", _CLEAN_SQL + """
SELECT exercise_name, round(avg(rpe), 9) AS rpe_mean FROM cleaned WHERE source = 'full'
GROUP BY exercise_name""")(
    lambda spark, d: clean.rpe_lookup(_cleaned(spark, d).where(F.col("source") == "full")))

register("j4_preprocess_merge", _MERGE_SQL + "SELECT * FROM merged")(_merged)

register("w15_assign_set_order", _MERGE_SQL + f"""
SELECT user_id, {_APP}, set_order FROM merged WHERE source = 'lite'""")(
    lambda spark, d: _merged(spark, d).where(F.col("source") == "lite")
    .select("user_id", *clean.APPEARANCE, "set_order"))

register("a2_dataset_stats", _MERGE_SQL + """
, sess AS (SELECT user_id, workout_name, date, count(*) AS n FROM merged
           WHERE workout_name IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2, 3)
SELECT (SELECT count(*) FROM merged) AS rows,
       (SELECT count(DISTINCT workout_name) FROM merged) AS workouts,
       (SELECT count(DISTINCT exercise_name) FROM merged) AS exercises,
       (SELECT count(DISTINCT CAST(date AS DATE)) FROM merged) AS dates,
       (SELECT round(avg(n), 6) FROM sess) AS avg_sets_per_session""")(
    lambda spark, d: __import__("liftlake.operators.stats", fromlist=["x"]).dataset_stats(_merged(spark, d)))

_TOP_SQL = _MERGE_SQL + """
, top_sets AS (
  SELECT * FROM merged WHERE set_order = 1
     AND weight IS NOT NULL AND reps IS NOT NULL AND exercise_name IS NOT NULL)
"""


def _top_sets(spark, d):
    m = _merged(spark, d)
    return m.where(F.col("set_order") == 1).dropna(subset=["weight", "reps", "exercise_name"])


register("pf10_top_sets", _TOP_SQL + f"""
SELECT user_id, {_APP}, exercise_normalized, weight, reps
FROM top_sets""")(
    lambda spark, d: _top_sets(spark, d).select("user_id", *clean.APPEARANCE, "exercise_normalized",
                                                "weight", "reps"))

register("pf9_cardio_rows", _MERGE_SQL + f"""
SELECT user_id, {_APP}, distance FROM merged WHERE distance IS NOT NULL""")(
    lambda spark, d: _merged(spark, d).where(F.col("distance").isNotNull())
    .select("user_id", *clean.APPEARANCE, "distance"))

_KW = " UNION ALL ".join(
    f"SELECT *, {S._q(c)} AS compound FROM export WHERE regexp_matches(\"Exercise Name\", {S._q(p)}, 'i')"
    for c, p in __import__("liftlake.schema", fromlist=["x"]).COMPOUND_KEYWORDS)
register("pf12_keyword_compound", _EXPORT_CTES + f"""
SELECT {_APP}, "Exercise Name" AS exercise_name, compound
FROM ({_KW})""")(
    lambda spark, d: lookup.keyword_classify(A.export_raw(spark, d), "Exercise Name")
    .select(*clean.APPEARANCE, F.col("Exercise Name").alias("exercise_name"), "compound"))

_PARENT_SQL = _TOP_SQL.replace("WITH ", "WITH " + S.exercise_dim_values() + ",\n", 1) + """
, parented AS (
  SELECT t.*, COALESCE(x.parent, lower(trim(t.exercise_normalized))) AS parent_compound,
         CASE WHEN lower(trim(t.exercise_normalized)) IN ('squat', 'bench_press', 'lat_pulldown', 'seated_row')
              THEN 1.0::DOUBLE ELSE COALESCE(x.scale, 1.0::DOUBLE) END AS scale_factor
  FROM top_sets t LEFT JOIN exdim x ON lower(trim(t.exercise_normalized)) = x.exercise)
"""


def _parented(spark, d):
    return lookup.with_parent(_top_sets(spark, d), spark)


register("j1_j2_parent_and_scale", _PARENT_SQL + f"""
SELECT user_id, {_APP}, exercise_normalized, parent_compound,
       scale_factor FROM parented""")(
    lambda spark, d: _parented(spark, d).select("user_id", *clean.APPEARANCE, "exercise_normalized",
                                                "parent_compound", "scale_factor"))

register("pf13_a16_counts_per_compound", _PARENT_SQL + """
SELECT parent_compound, count(*) AS sets FROM parented
WHERE parent_compound IN ('squat', 'bench_press', 'lat_pulldown', 'seated_row') GROUP BY 1""")(
    lambda spark, d: lookup.keep_compounds(_parented(spark, d)).groupBy("parent_compound")
    .agg(F.count(F.lit(1)).alias("sets")))

register("j9_unmapped_exercises", _MERGE_SQL.replace("WITH ", "WITH " + S.exercise_dim_values() + ",\n", 1) + """
SELECT DISTINCT exercise_normalized AS exercise FROM merged m
WHERE exercise_normalized IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM exdim x WHERE x.exercise = lower(trim(m.exercise_normalized)))""")(
    lambda spark, d: lookup.unmapped(_merged(spark, d), spark))

register("a19_categorize_exercises", _MERGE_SQL.replace("WITH ", "WITH " + S.exercise_dim_values() + ",\n", 1) + """
, names AS (SELECT DISTINCT exercise_normalized AS e FROM merged WHERE exercise_normalized IS NOT NULL)
, cat AS (
  SELECT CASE WHEN COALESCE(x.parent, lower(trim(n.e))) IN ('squat', 'bench_press', 'lat_pulldown', 'seated_row')
              THEN COALESCE(x.parent, lower(trim(n.e))) ELSE 'other' END AS category, n.e
  FROM names n LEFT JOIN exdim x ON lower(trim(n.e)) = x.exercise)
, lists AS (SELECT category, list_sort(list(e)) AS exercises FROM cat GROUP BY category)
, base AS (SELECT unnest(['squat', 'bench_press', 'lat_pulldown', 'seated_row']) AS category)
SELECT b.category, COALESCE(l.exercises, []::VARCHAR[]) AS exercises FROM base b LEFT JOIN lists l USING (category)
UNION ALL SELECT category, exercises FROM lists WHERE category = 'other'""")(
    lambda spark, d: lookup.categorize(_merged(spark, d), spark))

register("j3_child_predictions", _PARENT_SQL.replace("WITH ", "WITH " + S.SESSIONS + ",\n", 1) + f"""
, last AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, compound ORDER BY ts DESC, event_id DESC) AS rn
    FROM sessions) WHERE rn = 1)
, parent_pred AS (
  SELECT user_id, compound, {_RULE['suggested_weight']} - weight AS predicted_delta FROM last)
, ex AS (SELECT DISTINCT user_id, exercise_normalized, parent_compound, scale_factor FROM parented)
SELECT ex.user_id, ex.exercise_normalized, ex.parent_compound, ex.scale_factor,
       p.predicted_delta * ex.scale_factor AS exercise_delta
FROM ex JOIN parent_pred p ON p.user_id = ex.user_id AND p.compound = ex.parent_compound""")(
    lambda spark, d: lookup.child_predictions(
        _top_sets(spark, d).select("user_id", "exercise_normalized").distinct(),
        recommend.next_load_rule(A.sessions(spark, d)).select(
            *KEY, (F.col("suggested_weight") - F.col("last_weight")).alias("predicted_delta")),
        spark).select("user_id", "exercise_normalized", "parent_compound", "scale_factor", "exercise_delta"))


# ---------------------------------------------------------------------------
# Step 4: quality (A8-A12), gate (A10), ledger (IO9, J6, J7), audits
# ---------------------------------------------------------------------------
from liftlake.operators import quality  # noqa: E402

_COMPOUND_LIST = "['squat', 'bench_press', 'lat_pulldown', 'seated_row']"
_AUDIT_CTES = S.with_ctes(S.SESSIONS, S.AUDIT, S.AUDIT_DONE)
_LEDGER_SQL = f"""
, users AS (SELECT DISTINCT user_id FROM events)
, ledger AS (
  SELECT user_id, unnest({_COMPOUND_LIST}) AS compound, 0 AS session_count,
         CAST(NULL AS DOUBLE) AS model_mape, CAST(NULL AS DOUBLE) AS rule_mape, false AS model_enabled
  FROM users)
"""
_GATE_SQL = _AUDIT_CTES + _LEDGER_SQL + """
, recent AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, compound ORDER BY ts DESC, event_id DESC) AS rr
    FROM audit_done WHERE prediction_status = 'complete' AND deviation_reason = 'normal') WHERE rr <= 15)
, g AS (
  SELECT user_id, compound, count(*) AS n,
         count(*) FILTER (WHERE prediction_source = 'model') AS n_model,
         count(*) FILTER (WHERE prediction_source = 'rule_based') AS n_rule,
         avg(abs((actual_weight - recommended_weight) / NULLIF(actual_weight, 0.0::DOUBLE)))
           FILTER (WHERE prediction_source = 'model') AS mm,
         avg(abs((actual_weight - recommended_weight) / NULLIF(actual_weight, 0.0::DOUBLE)))
           FILTER (WHERE prediction_source = 'rule_based') AS rm
  FROM recent GROUP BY 1, 2)
, s AS (
  SELECT user_id, compound, n, CASE WHEN n_model >= 5 THEN mm END AS model_mape,
         CASE WHEN n_rule >= 5 THEN rm END AS rule_mape
  FROM g WHERE n >= 10)
, s2 AS (
  SELECT *, COALESCE(model_mape IS NOT NULL AND rule_mape IS NOT NULL
                     AND model_mape < rule_mape * 0.85::DOUBLE AND model_mape < 0.10::DOUBLE, false) AS model_enabled
  FROM s)
, refreshed AS (
  SELECT l.user_id, l.compound,
         CASE WHEN s2.n IS NOT NULL THEN CAST(s2.n AS INTEGER) ELSE l.session_count END AS session_count,
         CASE WHEN s2.n IS NOT NULL THEN s2.model_mape ELSE l.model_mape END AS model_mape,
         CASE WHEN s2.n IS NOT NULL THEN s2.rule_mape ELSE l.rule_mape END AS rule_mape,
         CASE WHEN s2.n IS NOT NULL THEN s2.model_enabled ELSE l.model_enabled END AS model_enabled
  FROM ledger l LEFT JOIN s2 ON l.user_id = s2.user_id AND l.compound = s2.compound)
"""


def _ledger(spark, d):
    return quality.init_ledger(A.read_table(spark, d, "events").select("user_id"))


def _refreshed(spark, d):
    return quality.refresh_quality(_ledger(spark, d), A.session_audit(spark, d))


register("io9_init_ledger", _AUDIT_CTES + _LEDGER_SQL + "SELECT * FROM ledger")(_ledger)

register("a10_quality_gate", _GATE_SQL + """
SELECT user_id, compound, session_count, round(model_mape, 6) AS model_mape, round(rule_mape, 6) AS rule_mape,
       model_enabled FROM refreshed""")(
    lambda spark, d: _refreshed(spark, d).withColumns(
        {"model_mape": _r("model_mape"), "rule_mape": _r("rule_mape")}))

register("j6_j7_ledger_lookups", _GATE_SQL + """
, keys AS (SELECT DISTINCT user_id, compound FROM sessions)
SELECT k.user_id, k.compound, COALESCE(r.model_enabled, false) AS model_enabled,
       COALESCE(r.session_count, 0) AS recorded_sessions
FROM keys k LEFT JOIN refreshed r ON k.user_id = r.user_id AND k.compound = r.compound""")(
    lambda spark, d: lookup.with_recorded_count(
        lookup.with_model_enabled(A.sessions(spark, d).select(*KEY).distinct(), _refreshed(spark, d)),
        _refreshed(spark, d)))

register("a8_a9_mape_by_source", _AUDIT_CTES + """
SELECT compound, prediction_source,
       round(avg(abs((actual_weight - recommended_weight) / NULLIF(actual_weight, 0.0::DOUBLE))), 6) AS mape,
       round(avg(abs((actual_weight - recommended_weight) / NULLIF(actual_weight, 0.0::DOUBLE))) * 100.0::DOUBLE, 6)
         AS mape_pct
FROM audit_done GROUP BY 1, 2""")(
    lambda spark, d: A.session_audit(spark, d).groupBy("compound", "prediction_source")
    .agg(quality.mape("actual_weight", "recommended_weight").alias("_m"))
    .select("compound", "prediction_source", _r("_m").alias("mape"), _r(F.col("_m") * 100.0).alias("mape_pct")))

register("a11_a12_regression_metrics", _AUDIT_CTES + """
, m AS (
  SELECT compound, prediction_source, count(*) AS n, avg(abs(actual_weight - recommended_weight)) AS mae,
         avg((actual_weight - recommended_weight) * (actual_weight - recommended_weight)) AS mse,
         var_pop(actual_weight) AS v
  FROM audit_done WHERE actual_weight IS NOT NULL AND recommended_weight IS NOT NULL GROUP BY 1, 2)
SELECT compound, prediction_source, n, round(mae, 6) AS mae, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse,
       round(CASE WHEN v > 0 THEN 1.0::DOUBLE - mse / v END, 6) AS r2,
       greatest(0, CAST(trunc(CASE WHEN v > 0 THEN 1.0::DOUBLE - mse / v END * 100.0::DOUBLE) AS INTEGER))
         AS accuracy_pct
FROM m""")(
    lambda spark, d: quality.regression_metrics(A.session_audit(spark, d), "actual_weight", "recommended_weight",
                                                ["compound", "prediction_source"])
    .select("compound", "prediction_source", "n", _r("mae").alias("mae"), _r("mse").alias("mse"),
            _r("rmse").alias("rmse"), _r("r2").alias("r2"), "accuracy_pct"))

_PENDING_SQL = S.with_ctes(S.SESSIONS, S.AUDIT) + """
, audit_p AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, compound ORDER BY ts DESC, event_id DESC) AS r FROM audit)
, audit2 AS (
  SELECT *, CASE WHEN r <= 2 THEN 'pending' ELSE 'complete' END AS prediction_status,
         CASE WHEN r <= 2 THEN NULL ELSE weight END AS actual_weight,
         CASE WHEN r <= 2 THEN NULL ELSE weight - recommended_weight END AS accuracy_delta
  FROM audit_p)
"""
register("j8_close_pending", _PENDING_SQL + """
, np AS (
  SELECT user_id, compound, event_id AS pid FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, compound ORDER BY ts DESC, event_id DESC) AS rn
    FROM audit2 WHERE prediction_status = 'pending') WHERE rn = 1)
, ns AS (
  SELECT user_id, compound, weight AS actual FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, compound ORDER BY ts DESC, event_id DESC) AS rn
    FROM sessions) WHERE rn = 1)
, target AS (SELECT np.*, ns.actual FROM np JOIN ns USING (user_id, compound))
SELECT a.user_id, a.compound, a.event_id, a.recommended_weight,
       CASE WHEN a.event_id = t.pid THEN t.actual ELSE a.actual_weight END AS actual_weight,
       CASE WHEN a.event_id = t.pid THEN t.actual - a.recommended_weight ELSE a.accuracy_delta END AS accuracy_delta,
       CASE WHEN a.event_id = t.pid THEN 'complete' ELSE a.prediction_status END AS prediction_status
FROM audit2 a LEFT JOIN target t ON a.user_id = t.user_id AND a.compound = t.compound""")(
    lambda spark, d: quality.close_pending(A.session_audit(spark, d, pending_newest=2), A.sessions(spark, d))
    .select(*KEY, "event_id", "recommended_weight", "actual_weight", "accuracy_delta", "prediction_status"))

register("w19_error_tracking", _AUDIT_CTES + """
, e AS (
  SELECT *, row_number() OVER w AS seq, lag(weight) OVER w AS pw FROM audit
  WINDOW w AS (PARTITION BY user_id, compound ORDER BY ts, event_id))
, f AS (
  SELECT *, COALESCE(weight = pw, false) AS unchanged,
         CASE WHEN seq = 1 THEN NULL WHEN COALESCE(weight = pw, false) THEN 0.0::DOUBLE
              ELSE abs((weight - recommended_weight) / NULLIF(weight, 0.0::DOUBLE)) * 100.0::DOUBLE END AS error_pct
  FROM e)
SELECT user_id, compound, event_id, CAST(seq AS INTEGER) AS seq, unchanged, round(error_pct, 6) AS error_pct,
       round(100.0::DOUBLE - error_pct, 6) AS accuracy_pct,
       round(avg(error_pct) OVER (PARTITION BY user_id, compound ORDER BY ts, event_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_mape_pct
FROM f""")(
    lambda spark, d: quality.error_tracking(A.session_audit(spark, d)).select(
        *KEY, "event_id", "seq", "unchanged", _r("error_pct").alias("error_pct"),
        _r("accuracy_pct").alias("accuracy_pct"), _r("running_mape_pct").alias("running_mape_pct")))


# ---------------------------------------------------------------------------
# Step 5: calibration (A13-A15, SC6, R3), routing (R1, R2), logging (R4),
# comparison (SC8, SC9), uplift (M15), prediction log (IO6)
# ---------------------------------------------------------------------------
from liftlake.operators import calibrate as C  # noqa: E402
from liftlake.functions.scalar import direction  # noqa: E402

_SCORED = f"""
, scored AS (
  SELECT *, avg(weight) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) - weight AS raw_pred,
         lead(weight) OVER ({_W}) - weight AS y
  FROM sessions)
, win AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, compound ORDER BY ts DESC, event_id DESC) AS rr
    FROM scored WHERE raw_pred IS NOT NULL AND y IS NOT NULL) WHERE rr <= 32)
, fit AS (
  SELECT user_id, compound, count(*) AS n, min(raw_pred) AS xmin, max(raw_pred) AS xmax, avg(y) AS ybar,
         regr_slope(y, raw_pred) AS slope, regr_intercept(y, raw_pred) AS icpt
  FROM win GROUP BY 1, 2)
, fit2 AS (
  SELECT user_id, compound, n, n AS available,
         CASE WHEN n >= 8 AND NOT (xmin = xmax AND xmin = 0) THEN
           least(greatest(CASE WHEN xmin = xmax THEN ybar / (xmin * 2.0::DOUBLE) ELSE slope END, 0.6::DOUBLE),
                 1.4::DOUBLE) END AS fit_a,
         CASE WHEN n >= 8 AND NOT (xmin = xmax AND xmin = 0) THEN
           CASE WHEN xmin = xmax THEN ybar / 2.0::DOUBLE ELSE icpt END END AS fit_b
  FROM fit)
, calib AS (
  SELECT user_id, compound, COALESCE(fit_a, 1.0::DOUBLE) AS a, COALESCE(fit_b, 0.0::DOUBLE) AS b,
         CASE WHEN fit_a IS NOT NULL THEN CAST(n AS INTEGER) ELSE 0 END AS last_calibrated_size,
         CASE WHEN fit_a IS NOT NULL THEN 1 ELSE 0 END AS runs, fit_a IS NOT NULL AS refit
  FROM fit2)
, next_score AS (
  SELECT user_id, compound,
         avg(weight) FILTER (WHERE rr <= 3) - max(CASE WHEN rr = 1 THEN weight END) AS raw_pred
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, compound ORDER BY ts DESC, event_id DESC) AS rr
        FROM sessions) GROUP BY 1, 2)
"""


def _scored(spark, d, hot_rows=None):
    return C.stand_in_scores(A.sessions(spark, d), hot_rows=hot_rows)


def _calib(spark, d):
    return C.calibrate(_scored(spark, d))


def _round_state(df):
    return df.withColumns({"a": _r("a"), "b": _r("b")})


register("a13_affine_calibration", S.with_ctes(S.SESSIONS) + _SCORED + """
SELECT user_id, compound, round(a, 6) AS a, round(b, 6) AS b, last_calibrated_size, runs, refit FROM calib""")(
    lambda spark, d: _round_state(_calib(spark, d)))

register("a13_affine_calibration_hotkeys", S.with_ctes(S.SESSIONS) + _SCORED + """
SELECT user_id, compound, round(a, 6) AS a, round(b, 6) AS b, last_calibrated_size, runs, refit FROM calib""")(
    lambda spark, d: _round_state(C.calibrate(_scored(spark, d, hot_rows=5))))


def _prior_state(fits):
    return fits.select(*KEY, F.lit(1.1).alias("a"), F.lit(0.5).alias("b"),
                       F.when(F.col("user_id") % 2 == 0, F.col("n") - 10).otherwise(F.col("n") - 3)
                       .cast("int").alias("last_calibrated_size"), F.lit(2).alias("runs"))


def _refit_with_state(spark, d):
    fits = C.fit_affine(C.usable_window(_scored(spark, d)))
    return _round_state(C.refit(_prior_state(fits), fits))


register("a14_io7_refit_cadence_upsert", S.with_ctes(S.SESSIONS) + _SCORED + """
, state AS (
  SELECT user_id, compound, 1.1::DOUBLE AS a, 0.5::DOUBLE AS b,
         CAST(CASE WHEN user_id % 2 = 0 THEN n - 10 ELSE n - 3 END AS INTEGER) AS last_calibrated_size, 2 AS runs
  FROM fit2)
, j AS (
  SELECT *, COALESCE(fit_a IS NOT NULL AND (COALESCE(last_calibrated_size, 0) = 0
                     OR available - COALESCE(last_calibrated_size, 0) >= 10), false) AS go
  FROM state FULL OUTER JOIN fit2 USING (user_id, compound))
SELECT user_id, compound,
       round(CASE WHEN go THEN fit_a ELSE COALESCE(a, 1.0::DOUBLE) END, 6) AS a,
       round(CASE WHEN go THEN fit_b ELSE COALESCE(b, 0.0::DOUBLE) END, 6) AS b,
       CASE WHEN go THEN CAST(n AS INTEGER) ELSE COALESCE(last_calibrated_size, 0) END AS last_calibrated_size,
       CAST(COALESCE(runs, 0) + CAST(go AS INTEGER) AS INTEGER) AS runs, go AS refit
FROM j""")(_refit_with_state)

register("a15_residual_offsets", S.with_ctes(S.SESSIONS) + _SCORED + """
SELECT user_id, compound, round(0.0::DOUBLE + avg(y - raw_pred) * 0.05::DOUBLE, 6) AS b FROM win GROUP BY 1, 2""")(
    lambda spark, d: C.residual_offsets(C.usable_window(_scored(spark, d))).withColumn("b", _r("b")))

register("sc6_r3_calibrated_scores", S.with_ctes(S.SESSIONS) + _SCORED + """
SELECT s.user_id, s.compound, round(s.raw_pred, 6) AS raw_pred, round(COALESCE(c.a, 1.0::DOUBLE), 6) AS a,
       round(COALESCE(c.b, 0.0::DOUBLE), 6) AS b,
       round(s.raw_pred * COALESCE(c.a, 1.0::DOUBLE) + COALESCE(c.b, 0.0::DOUBLE), 6) AS adjusted
FROM next_score s LEFT JOIN calib c ON s.user_id = c.user_id AND s.compound = c.compound""")(
    lambda spark, d: C.apply_affine(C.next_scores(A.sessions(spark, d)), _calib(spark, d))
    .select(*KEY, _r("raw_pred").alias("raw_pred"), _r("a").alias("a"), _r("b").alias("b"),
            _r("adjusted").alias("adjusted")))


def _recommendation(spark, d):
    sessions = A.sessions(spark, d)
    last = sequence.last_per_key(sessions, cols=["weight", "reps", "rpe"]).select(
        *KEY, "session_count", F.col("weight").alias("last_weight"), F.col("reps").alias("last_reps"),
        F.col("rpe").alias("last_rpe"))
    return recommend.route(last, _refreshed(spark, d), C.next_scores(sessions), _calib(spark, d))


_R1_RULE = S.rule_sql("l.weight", "l.reps", "l.rpe")
_R1_SQL = (_GATE_SQL.replace("WITH ", "WITH ", 1) + _SCORED + f"""
, last AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, compound ORDER BY ts DESC, event_id DESC) AS rn,
           count(*) OVER (PARTITION BY user_id, compound) AS session_count
    FROM sessions) WHERE rn = 1)
, routed0 AS (
  SELECT l.user_id, l.compound, l.session_count AS n, l.weight AS last_weight,
         COALESCE(q.model_enabled, false) AS enabled, s.raw_pred,
         s.raw_pred * COALESCE(c.a, 1.0::DOUBLE) + COALESCE(c.b, 0.0::DOUBLE) AS adjusted,
         {_R1_RULE['suggested_weight']} AS rule_w, {_R1_RULE['reason']} AS rule_reason
  FROM last l LEFT JOIN refreshed q ON l.user_id = q.user_id AND l.compound = q.compound
  LEFT JOIN next_score s ON l.user_id = s.user_id AND l.compound = s.compound
  LEFT JOIN calib c ON l.user_id = c.user_id AND l.compound = c.compound)
, routed AS (SELECT *, enabled AND raw_pred IS NOT NULL AND last_weight IS NOT NULL AS model_ok FROM routed0)
""")
register("r1_recommendation", _R1_SQL + """
SELECT user_id, compound, n AS session_count, last_weight, enabled AS model_enabled, round(raw_pred, 6) AS raw_pred,
       round(CASE WHEN model_ok THEN adjusted END, 6) AS adjusted_delta,
       round(CASE WHEN n = 0 THEN NULL WHEN n <= 15 AND NOT enabled THEN rule_w
                  WHEN model_ok THEN last_weight + adjusted ELSE rule_w END, 6) AS recommended_weight,
       CASE WHEN n = 0 THEN 'insufficient_data' WHEN n <= 15 AND NOT enabled THEN 'rule_based'
            WHEN model_ok THEN 'model' ELSE 'rule_based' END AS source,
       CASE WHEN n = 0 THEN 'No training history yet' WHEN n <= 15 AND NOT enabled THEN rule_reason
            WHEN model_ok THEN 'ML model (calibrated)'
            WHEN enabled AND raw_pred IS NULL THEN 'Model not found - ' || rule_reason
            WHEN enabled THEN 'Model failed - ' || rule_reason
            ELSE 'Rule-based (' || CAST(n AS VARCHAR) || ' sessions; model calibrating...)' END AS reason
FROM routed""")(
    lambda spark, d: _recommendation(spark, d).withColumns({
        "raw_pred": _r("raw_pred"), "adjusted_delta": _r("adjusted_delta"),
        "recommended_weight": _r("recommended_weight")}))

register("sc8_sc9_delta_comparison", _R1_SQL + """
, wide AS (SELECT user_id, compound, last_weight, rule_w - last_weight AS rule, raw_pred AS raw, adjusted AS calibrated
           FROM routed)
, longf AS (
  SELECT user_id, compound, last_weight, 'rule' AS method, rule AS delta FROM wide
  UNION ALL SELECT user_id, compound, last_weight, 'raw', raw FROM wide
  UNION ALL SELECT user_id, compound, last_weight, 'calibrated', calibrated FROM wide)
SELECT user_id, compound, method, round(delta, 6) AS delta, round(last_weight + delta, 6) AS next_weight,
       CASE WHEN delta > 0 THEN '↑' WHEN delta < 0 THEN '↓' WHEN delta = 0 THEN '→' END AS direction
FROM longf""")(
    lambda spark, d: __import__("liftlake.operators.recommend", fromlist=["x"]).delta_comparison(
        _recommendation_inputs(spark, d)))


def _recommendation_inputs(spark, d):
    sessions = A.sessions(spark, d)
    rule = recommend.next_load_rule(sessions)
    scores = C.apply_affine(C.next_scores(sessions), _calib(spark, d))
    return rule.join(scores.select(*KEY, "raw_pred", "adjusted"), list(KEY), "left")


register("m15_calibration_uplift", S.with_ctes(S.SESSIONS) + f"""
, scored AS (
  SELECT *, avg(weight) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) - weight AS raw_pred,
         lead(weight) OVER ({_W}) - weight AS y
  FROM sessions)
, usable AS (
  SELECT *, row_number() OVER ({_W}) AS pos FROM scored WHERE raw_pred IS NOT NULL AND y IS NOT NULL)
, fit AS (
  SELECT user_id, compound, count(*) AS n, min(raw_pred) AS xmin, max(raw_pred) AS xmax, avg(y) AS ybar,
         regr_slope(y, raw_pred) AS slope, regr_intercept(y, raw_pred) AS icpt
  FROM usable WHERE pos <= 12 GROUP BY 1, 2)
, fit2 AS (
  SELECT user_id, compound,
         CASE WHEN n >= 8 AND NOT (xmin = xmax AND xmin = 0) THEN
           least(greatest(CASE WHEN xmin = xmax THEN ybar / (xmin * 2.0::DOUBLE) ELSE slope END, 0.6::DOUBLE),
                 1.4::DOUBLE) END AS a,
         CASE WHEN n >= 8 AND NOT (xmin = xmax AND xmin = 0) THEN
           CASE WHEN xmin = xmax THEN ybar / 2.0::DOUBLE ELSE icpt END END AS b
  FROM fit)
, ev AS (
  SELECT u.*, u.raw_pred * COALESCE(f.a, 1.0::DOUBLE) + COALESCE(f.b, 0.0::DOUBLE) AS cal
  FROM usable u LEFT JOIN fit2 f ON u.user_id = f.user_id AND u.compound = f.compound WHERE u.pos > 12)
SELECT user_id, compound, count(*) AS held_out,
       round(avg(abs(y - raw_pred)), 6) AS mae_raw, round(avg(abs(y - cal)), 6) AS mae_calibrated,
       round(sqrt(avg((y - raw_pred) * (y - raw_pred))), 6) AS rmse_raw,
       round(sqrt(avg((y - cal) * (y - cal))), 6) AS rmse_calibrated
FROM ev GROUP BY 1, 2""")(
    lambda spark, d: C.uplift_report(_scored(spark, d)).select(
        *KEY, "held_out", *[_r(c).alias(c) for c in ["mae_raw", "mae_calibrated", "rmse_raw", "rmse_calibrated"]]))

# R2: the gate snapshot of a run knows no audit of the key's three newest sessions.
_GATE_BLOCK = _GATE_SQL[_GATE_SQL.index(", recent AS"):]


def _gate_block(suffix, audit, ledger):
    named = re.sub(r"\b(recent|g|s|s2|refreshed)\b", rf"\1{suffix}", _GATE_BLOCK)
    return re.sub(r"\bledger\b", ledger, re.sub(r"\baudit_done\b", audit, named))


_R2_SQL = (_AUDIT_CTES + _LEDGER_SQL + """
, audit_old AS (
  SELECT * EXCLUDE (rr0) FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, compound ORDER BY ts DESC, event_id DESC) AS rr0 FROM audit_done)
  WHERE rr0 > 3)
""" + _gate_block("_t0", "audit_old", "ledger") + _gate_block("_t1", "audit_done", "refreshed_t0")
    + _R1_SQL[len(_GATE_SQL):].replace("JOIN refreshed q", "JOIN refreshed_t0 q"))


def _route_then_refresh(spark, d):
    sessions, audit = A.sessions(spark, d), A.session_audit(spark, d)
    newest = sequence.last_n(audit, 3).select("event_id")
    before = quality.refresh_quality(_ledger(spark, d), audit.join(newest, "event_id", "left_anti"))
    last = sequence.last_per_key(sessions, cols=["weight", "reps", "rpe"]).select(
        *KEY, "session_count", F.col("weight").alias("last_weight"), F.col("reps").alias("last_reps"), F.col("rpe").alias("last_rpe"))
    routed, after = recommend.route_then_refresh(last, before, C.next_scores(sessions), _calib(spark, d), audit)
    return routed.join(after.select(*KEY, F.col("model_enabled").alias("enabled_next")), list(KEY)).select(
        *KEY, "session_count", "model_enabled", "source", _r("recommended_weight").alias("recommended_weight"), "enabled_next")


register("r2_route_then_refresh", _R2_SQL + """
SELECT r.user_id, r.compound, r.n AS session_count, r.enabled AS model_enabled,
       CASE WHEN n = 0 THEN 'insufficient_data' WHEN n <= 15 AND NOT enabled THEN 'rule_based'
            WHEN model_ok THEN 'model' ELSE 'rule_based' END AS source,
       round(CASE WHEN n = 0 THEN NULL WHEN n <= 15 AND NOT enabled THEN rule_w
                  WHEN model_ok THEN last_weight + adjusted ELSE rule_w END, 6) AS recommended_weight,
       a.model_enabled AS enabled_next
FROM routed r JOIN refreshed_t1 a ON r.user_id = a.user_id AND r.compound = a.compound""")(_route_then_refresh)

_R4_RULE = S.rule_sql("p.weight", "p.reps", "p.rpe")
register("r4_log_sessions", S.with_ctes(S.SESSIONS) + f"""
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, compound ORDER BY ts DESC, event_id DESC) AS rr FROM sessions)
, n AS (SELECT * FROM ranked WHERE rr = 1)
, p AS (SELECT * FROM ranked WHERE rr = 2)
SELECT n.user_id, n.compound, n.ts, n.event_id, n.weight, n.reps, n.rpe,
       CASE WHEN p.user_id IS NOT NULL THEN COALESCE(n.weight - p.weight, 0.0::DOUBLE) ELSE 0.0::DOUBLE END
         AS load_delta,
       'normal' AS deviation_reason,
       CASE WHEN p.user_id IS NOT NULL THEN 'rule_based' ELSE 'insufficient_data' END AS prediction_source,
       CASE WHEN p.user_id IS NOT NULL THEN {_R4_RULE['suggested_weight']} END AS recommended_weight,
       'pending' AS prediction_status
FROM n LEFT JOIN p ON n.user_id = p.user_id AND n.compound = p.compound""")(
    lambda spark, d: recommend.log_newest_sessions(A.sessions(spark, d)))

_R4_ALL = S.with_ctes(S.SESSIONS) + f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, compound ORDER BY ts, event_id) AS rr FROM sessions)
SELECT n.user_id, n.compound, n.ts, n.event_id, n.weight, n.reps, n.rpe,
       CASE WHEN p.user_id IS NOT NULL THEN COALESCE(n.weight - p.weight, 0.0::DOUBLE) ELSE 0.0::DOUBLE END
         AS load_delta,
       'normal' AS deviation_reason,
       CASE WHEN p.user_id IS NOT NULL THEN 'rule_based' ELSE 'insufficient_data' END AS prediction_source,
       CASE WHEN p.user_id IS NOT NULL THEN {_R4_RULE['suggested_weight']} END AS recommended_weight,
       'pending' AS prediction_status
FROM ranked n LEFT JOIN ranked p ON n.user_id = p.user_id AND n.compound = p.compound AND n.rr = p.rr + 1"""
register("r4_log_all_sessions", _R4_ALL)(lambda spark, d: recommend.log_sessions(A.sessions(spark, d)))
register("r4_log_all_sessions_hotkeys", _R4_ALL)(lambda spark, d: recommend.log_sessions(A.sessions(spark, d), hot_rows=6))

from liftlake.sources import store  # noqa: E402

register("io6_prediction_log", S.with_ctes(S.SESSIONS) + _SCORED + f"""
, seqd AS (SELECT *, row_number() OVER ({_W}) AS seq FROM scored)
SELECT s.event_id AS id, s.user_id, s.compound, CAST(s.seq - 1 AS INTEGER) AS session_index,
       round(s.raw_pred, 6) AS predicted_raw,
       round(s.raw_pred * COALESCE(c.a, 1.0::DOUBLE) + COALESCE(c.b, 0.0::DOUBLE), 6) AS predicted_adjusted,
       s.y AS actual, 'model' AS source, s.ts AS created_at
FROM seqd s LEFT JOIN calib c ON s.user_id = c.user_id AND s.compound = c.compound
WHERE s.raw_pred IS NOT NULL""")(
    lambda spark, d: store.prediction_rows(C.apply_affine(_scored(spark, d), _calib(spark, d)))
    .where(F.col("predicted_raw").isNotNull())
    .withColumns({"predicted_raw": _r("predicted_raw"), "predicted_adjusted": _r("predicted_adjusted")}))


# ---------------------------------------------------------------------------
# Step 6: model features (M1), clipping and preparation
# ---------------------------------------------------------------------------
from liftlake.operators import features as FE  # noqa: E402

_M1_SQL = _MERGE_SQL + f"""
, f0 AS (SELECT *, row_number() OVER (PARTITION BY user_id, exercise_normalized ORDER BY date, {_APP}) AS pos
         FROM merged WHERE date IS NOT NULL)
, f1 AS (
  SELECT *, CAST(date_sub('day', min(date) OVER (PARTITION BY user_id), date) AS INTEGER) AS days_since_first_workout,
         CAST(COALESCE(date_sub('day', lag(date) OVER (PARTITION BY user_id ORDER BY date, {_APP}), date), 0)
              AS INTEGER) AS days_since_last_workout,
         CAST(dense_rank() OVER (PARTITION BY user_id, exercise_normalized ORDER BY date) AS INTEGER) AS session_number,
         avg(effective_load) OVER (PARTITION BY user_id, exercise_normalized ORDER BY date, {_APP}
                                   ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_avg_load_last_3_sessions,
         CASE WHEN count(*) OVER w5 >= 2 THEN regr_slope(effective_load, pos) OVER w5 END AS slope0
  FROM f0
  WINDOW w5 AS (PARTITION BY user_id, exercise_normalized ORDER BY date, {_APP} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
, f2 AS (
  SELECT * EXCLUDE (rpe), COALESCE(slope0, avg(slope0) OVER ()) AS rolling_trend_load,
         CASE WHEN rpe IS NULL THEN 1 ELSE 0 END AS rpe_missing,
         COALESCE(rpe, (SELECT median(rpe) FROM merged)) AS rpe
  FROM (SELECT * FROM f1 UNION ALL BY NAME SELECT * FROM merged WHERE date IS NULL))
, f3 AS (
  SELECT *, CASE WHEN rpe >= 0 AND rpe <= 5 THEN 'Low' WHEN rpe > 5 AND rpe <= 7 THEN 'Medium'
                 WHEN rpe > 7 AND rpe <= 10 THEN 'High' END AS rpe_binned,
         date IS NOT NULL AND workout_name IS NOT NULL AND
         row_number() OVER (PARTITION BY user_id, days_since_first_workout, workout_name, exercise_normalized
                            ORDER BY set_volume DESC, {_APP}) = 1 AS is_top_set,
         CASE WHEN reps >= 0 AND reps <= 5 THEN 'Strength' WHEN reps > 5 AND reps <= 15 THEN 'Hypertrophy'
              WHEN reps > 15 THEN 'Endurance' END AS reps_binned,
         CAST(epoch(date) AS BIGINT) AS date_epoch
  FROM f2)
, m1 AS (
  SELECT *, CASE rpe_binned WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 END AS rpe_ordinal FROM f3)
"""
_M1_COLS = ["user_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "date", "exercise_normalized",
            "days_since_first_workout", "days_since_last_workout", "session_number",
            "rolling_avg_load_last_3_sessions", "rolling_trend_load", "rpe", "rpe_missing", "rpe_binned",
            "rpe_ordinal", "is_top_set", "reps_binned", "date_epoch"]


_M1_READ = ["user_id", "exercise_normalized", "date", "workout_name", *clean.APPEARANCE, "effective_load", "set_volume", "reps", "rpe"]


def _m1(spark, d, hot_rows=None):
    out = FE.feature_step(_merged(spark, d).select(*_M1_READ), tiebreak=clean.APPEARANCE, hot_rows=hot_rows, last_read=True)
    return out.select(*_M1_COLS).withColumns({
        "rolling_avg_load_last_3_sessions": _r("rolling_avg_load_last_3_sessions"),
        "rolling_trend_load": _r("rolling_trend_load")})


_M1_OUT = f"""
SELECT {", ".join(c if c not in ("rolling_avg_load_last_3_sessions", "rolling_trend_load") else f"round({c}, 6) AS {c}"
                  for c in _M1_COLS)} FROM m1"""
register("m1_feature_step", _M1_SQL + _M1_OUT)(lambda spark, d: _m1(spark, d))
register("m1_feature_step_hotkeys", _M1_SQL + _M1_OUT)(lambda spark, d: _m1(spark, d, hot_rows=6))

_SESSION_FEATS_SQL = _PERIOD_SQL + f"""
, sf0 AS (
  SELECT *, COALESCE(weight, 0.0::DOUBLE) * COALESCE(CAST(reps AS DOUBLE), 0.0::DOUBLE) AS set_volume,
         COALESCE(weight, 0.0::DOUBLE) * (COALESCE(rpe, 0.0::DOUBLE) / 10.0::DOUBLE) AS effective_load
  FROM periodized)
, sf1 AS (
  SELECT *, avg(effective_load) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
           AS rolling_avg_load_last_3_sessions,
         CASE WHEN count(*) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 2
              THEN regr_slope(effective_load, seq) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS slope0
  FROM sf0)
, sfeat AS (SELECT * EXCLUDE (slope0), COALESCE(slope0, avg(slope0) OVER ()) AS rolling_trend_load FROM sf1)
"""
_CLIPC = ["weight", "effective_load", "set_volume", "rolling_avg_load_last_3_sessions", "rolling_trend_load",
          "percent_of_max", "cycle_weight_trend", "max_weight_so_far"]
_BOUNDS = ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in _CLIPC)
_CLIPPED = ", ".join(f"round(CASE WHEN s.{c} IS NULL THEN NULL ELSE least(greatest(s.{c}, b.lo_{c}), b.hi_{c}) END, 6)"
                     f" AS {c}" for c in _CLIPC)
register("a6_m3_prepare_clipped", _SESSION_FEATS_SQL + f"""
, bnd AS (SELECT compound, {_BOUNDS} FROM sfeat GROUP BY compound)
SELECT s.user_id, s.compound, s.event_id, {_CLIPPED}, s.rpe, s.next_load_delta
FROM sfeat s JOIN bnd b ON s.compound = b.compound WHERE s.next_load_delta IS NOT NULL""")(
    lambda spark, d: FE.prepare(FE.session_features(_periodized(spark, d)))
    .select(*KEY, "event_id", *[_r(c).alias(c) for c in _CLIPC], "rpe", "next_load_delta"))


# ---------------------------------------------------------------------------
# Step 6b: profiling (A17, A18), mutual information (A20), slices (A21),
# metric averages (A22), learned scale factors (A23), data guards
# ---------------------------------------------------------------------------
from liftlake.operators import stats as ST  # noqa: E402

_MERGED_TYPES = [("date", "timestamp_ntz"), ("distance", "double"), ("duration", "double"),
                 ("effective_load", "double"), ("exercise_name", "string"), ("exercise_normalized", "string"),
                 ("l_linenumber", "int"), ("l_orderkey", "bigint"), ("l_partkey", "bigint"),
                 ("l_suppkey", "bigint"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_returnflag", "string"), ("notes", "string"), ("reps", "double"), ("rpe", "double"),
                 ("seconds", "double"), ("set_order", "double"), ("set_volume", "double"), ("source", "string"),
                 ("user_id", "bigint"), ("weight", "double"), ("workout_name", "string"),
                 ("workout_notes", "string")]
_NUMT = ("double", "int", "bigint")


def _profile_sql_row(c, t):
    if t in _NUMT:
        stats = (f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev, "
                 f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max")
    else:
        stats = "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS stddev, CAST(NULL AS DOUBLE) AS min, " \
                "CAST(NULL AS DOUBLE) AS max"
    return (f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) - count({c}) AS nulls, count({c}) AS non_null, "
            f"{stats} FROM merged")


register("a17_profile", _MERGE_SQL + "\n UNION ALL ".join(_profile_sql_row(c, t) for c, t in _MERGED_TYPES))(
    lambda spark, d: ST.profile(_merged(spark, d)).withColumns({"mean": _r("mean"), "stddev": _r("stddev")}))


def _card_sql_row(c, t):
    num = "true" if t in _NUMT else "false"
    return (f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, {num} AS numeric, "
            f"CASE WHEN count(DISTINCT {c}) <= 20 THEN COALESCE(list_sort(list(DISTINCT CAST({c} AS VARCHAR)) "
            f"FILTER (WHERE {c} IS NOT NULL)), []::VARCHAR[]) END AS \"values\" FROM merged")


register("a18_cardinality", _MERGE_SQL + "\n UNION ALL ".join(_card_sql_row(c, t) for c, t in _MERGED_TYPES))(
    lambda spark, d: ST.cardinality(_merged(spark, d)))

_MI_FEATURES = ["weight", "reps", "rpe", "load_delta", "cycle_number", "weeks_in_cycle", "max_weight_so_far",
                "percent_of_max", "cycle_weight_trend"]
_PROBS = "[" + ", ".join(repr(i / 10) for i in range(1, 10)) + "]"
_MI_SQL = _PERIOD_SQL + f"""
, cuts AS (SELECT {", ".join(f"quantile_cont({c}, {_PROBS}) AS q_{c}" for c in _MI_FEATURES + ["next_load_delta"])}
           FROM periodized)
, binned AS (
  SELECT len(list_filter(q_next_load_delta, lambda q: q < next_load_delta)) AS bin_y,
         {", ".join(f"CASE WHEN {c} IS NOT NULL THEN len(list_filter(q_{c}, lambda q: q < CAST({c} AS DOUBLE))) END AS b_{c}"
                    for c in _MI_FEATURES)}
  FROM periodized, cuts WHERE next_load_delta IS NOT NULL)
, longf AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, b_{c} AS bx, bin_y FROM binned WHERE b_{c} IS NOT NULL"
                               for c in _MI_FEATURES)})
, cell AS (SELECT feature, bx, bin_y, count(*) AS n FROM longf GROUP BY 1, 2, 3)
, cell2 AS (
  SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bx) AS nx,
         sum(n) OVER (PARTITION BY feature, bin_y) AS ny FROM cell)
SELECT *, row_number() OVER (ORDER BY mi DESC, feature) AS mi_rank FROM (
SELECT feature, round(sum(CAST(n AS DOUBLE) / t * ln(CAST(n AS DOUBLE) * t / (nx * ny))), 6) AS mi,
       sum(CAST(n AS DOUBLE) / t * ln(CAST(n AS DOUBLE) * t / (nx * ny))) >= 0.15 AS selected
FROM cell2 GROUP BY feature)"""
register("a20_mutual_information", _MI_SQL)(
    lambda spark, d: ST.binned_mutual_information(_periodized(spark, d), _MI_FEATURES, "next_load_delta"))

register("a21_history_slice_stats", _PERIOD_SQL + """
, sl AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, compound ORDER BY ts DESC, event_id DESC) AS rr,
         count(*) OVER (PARTITION BY user_id, compound) AS n FROM periodized)
, s2 AS (SELECT *, CASE WHEN rr = least(n, 14) THEN 0.0::DOUBLE ELSE load_delta END AS slice_delta
         FROM sl WHERE rr <= 14)
SELECT user_id, compound, min(weight) AS min_weight, max(weight) AS max_weight, round(avg(rpe), 6) AS mean_rpe,
       min(slice_delta) AS min_delta, max(slice_delta) AS max_delta
FROM s2 GROUP BY 1, 2""")(
    lambda spark, d: ST.history_slice_stats(_periodized(spark, d), 14))

register("a22_average_compound_metrics", _AUDIT_CTES + """
, m AS (
  SELECT compound, avg(abs(actual_weight - recommended_weight)) AS mae,
         avg((actual_weight - recommended_weight) * (actual_weight - recommended_weight)) AS mse,
         var_pop(actual_weight) AS v
  FROM audit_done WHERE actual_weight IS NOT NULL AND recommended_weight IS NOT NULL GROUP BY 1)
SELECT round(avg(mae), 6) AS avg_mae, round(avg(sqrt(mse)), 6) AS avg_rmse,
       round(avg(CASE WHEN v > 0 THEN 1.0::DOUBLE - mse / v END), 6) AS avg_r2, count(*) AS compounds FROM m""")(
    lambda spark, d: quality.regression_metrics(A.session_audit(spark, d), "actual_weight", "recommended_weight",
                                                ["compound"])
    .agg(_r(F.avg("mae")).alias("avg_mae"), _r(F.avg("rmse")).alias("avg_rmse"), _r(F.avg("r2")).alias("avg_r2"),
         F.count(F.lit(1)).alias("compounds")))

register("a23_learned_scale_factors", _PARENT_SQL + f"""
, d AS (
  SELECT *, COALESCE(weight - lag(weight) OVER (PARTITION BY user_id, exercise_normalized ORDER BY date, {_APP}),
                     0.0::DOUBLE) AS load_delta
  FROM parented WHERE date IS NOT NULL)
, means AS (SELECT parent_compound, exercise_normalized, avg(load_delta) AS m FROM d GROUP BY 1, 2)
, par AS (SELECT parent_compound, m AS pm FROM means WHERE exercise_normalized = parent_compound)
SELECT means.parent_compound, exercise_normalized, round(m / NULLIF(pm, 0.0::DOUBLE), 6) AS learned_scale
FROM means LEFT JOIN par ON means.parent_compound = par.parent_compound""")(
    lambda spark, d: lookup.learned_scale_factors(
        ST.per_key_delta(_top_sets(spark, d).where(F.col("date").isNotNull()), ["user_id", "exercise_normalized"],
                         ["date", *clean.APPEARANCE]),
        spark).withColumn("learned_scale", _r("learned_scale")))

_KW_MERGED = " UNION ALL ".join(
    f"SELECT *, {S._q(c)} AS compound FROM merged WHERE regexp_matches(exercise_name, {S._q(p)}, 'i')"
    for c, p in __import__("liftlake.schema", fromlist=["x"]).COMPOUND_KEYWORDS)
register("m13_min_data_guards", _MERGE_SQL + f"""
, kw AS ({_KW_MERGED})
, top AS (SELECT * FROM kw WHERE set_order = 1 AND weight IS NOT NULL AND date IS NOT NULL)
, tgt AS (
  SELECT compound, count(*) FILTER (WHERE nxt IS NOT NULL) AS n_targets FROM (
    SELECT *, lead(weight) OVER (PARTITION BY user_id, compound ORDER BY date, {_APP}) AS nxt FROM top)
  GROUP BY compound)
, g AS (
  SELECT k.compound, count(*) AS n_rows,
         (SELECT count(*) FROM top t WHERE t.compound = k.compound) AS n_top_sets
  FROM kw k GROUP BY k.compound)
SELECT g.compound, g.n_rows, g.n_top_sets, COALESCE(tgt.n_targets, 0) AS n_targets,
       g.n_rows >= 50 AND g.n_top_sets >= 20 AND COALESCE(tgt.n_targets, 0) >= 10 AS trainable,
       CASE WHEN g.n_rows < 50 THEN 'too_few_rows' WHEN g.n_top_sets < 20 THEN 'too_few_top_sets'
            WHEN COALESCE(tgt.n_targets, 0) < 10 THEN 'too_few_targets' END AS skip_reason
FROM g LEFT JOIN tgt ON g.compound = tgt.compound""")(
    lambda spark, d: ST.min_data_guards(lookup.keyword_classify(_merged(spark, d), "exercise_name"),
                                        order=["date", *clean.APPEARANCE]))


# ---------------------------------------------------------------------------
# Step 7: model pipeline (M4-M12, M14); rows-only checks (no SQL oracle)
# ---------------------------------------------------------------------------
from liftlake.operators import ml as ML  # noqa: E402


def _prepared(spark, d):
    return FE.session_features(_periodized(spark, d), fill_slope=False)


def _m14(spark, d):
    report, _ = ML.train_validate(_prepared(spark, d))
    return report


register("m14_train_validate_forest")(_m14)
register("m9_model_comparison")(lambda spark, d: ML.compare_models(_prepared(spark, d)))
register("m10_m11_cross_validation")(lambda spark, d: ML.cross_validate(_prepared(spark, d)))


# Fitted preprocessing (M4, M5) and forest node tables (M6, M7, M14) on the training rows of the chronological split.
from liftlake.operators import preparation as PR  # noqa: E402

_SPLIT_SQL = _SESSION_FEATS_SQL + f"""
, known AS (SELECT * FROM sf1 WHERE next_load_delta IS NOT NULL)
, parted AS (
  SELECT * EXCLUDE (slope0), slope0 AS rolling_trend_load,
         CASE WHEN row_number() OVER ({_W}) <= floor(count(*) OVER (PARTITION BY user_id, compound) * 0.8::DOUBLE)
              THEN 'train' ELSE 'valid' END AS split FROM known)
, train AS (SELECT * FROM parted WHERE split = 'train')
"""


def _fitted_preparation(spark, d):
    known = _prepared(spark, d).where(F.col(ML.TARGET).isNotNull())
    train = ML.with_split(known).where(F.col("split") == "train")
    out = PR.fit_preprocessing(train, ML.NUMERIC_FEATURES, ML.CATEGORICAL_FEATURES)
    return out.withColumns({"mean": _r("mean"), "std": _r("std")})


register("m4_m5_preprocessing_table", _SPLIT_SQL + " UNION ALL ".join(f"""
SELECT compound, '{c}' AS column_name, round(avg({c}), 6) AS mean,
       round(sqrt(var_pop({c}) * count({c}) / NULLIF(count(*) - 1, 0)), 6) AS std, CAST(NULL AS VARCHAR) AS category,
       CAST(NULL AS INTEGER) AS category_index FROM train GROUP BY compound""" for c in ML.NUMERIC_FEATURES) + """
UNION ALL
SELECT compound, 'is_deload' AS column_name, NULL AS mean, NULL AS std, CAST(is_deload AS VARCHAR) AS category,
       CAST(row_number() OVER (PARTITION BY compound ORDER BY count(*) DESC, CAST(is_deload AS VARCHAR)) - 1 AS INTEGER) AS category_index
FROM train WHERE is_deload IS NOT NULL GROUP BY compound, is_deload""")(_fitted_preparation)

# M7: one compound keeps a deliberately weak model
_WEAK = {"seated_row": {"num_trees": 5, "max_depth": 2}}
register("m6_m7_m14_forest_nodes", _SPLIT_SQL + """
SELECT compound, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'valid') AS n_valid,
       CAST(CASE WHEN compound = 'seated_row' THEN 5 ELSE 100 END AS INTEGER) AS trees, true AS nodes_score_as_model,
       true AS splits_large_enough, true AS leaves_large_enough, true AS depth_as_set, true AS finite
FROM parted GROUP BY compound HAVING count(*) FILTER (WHERE split = 'train') >= 10""")(
    lambda spark, d: ML.node_report(_prepared(spark, d), _WEAK))


def _histories(spark, d):
    """IO2: all histories written as range-partitioned files and read back."""
    from liftlake.sources import store
    root = _stream_root(spark)
    store.write_histories(_periodized(spark, d).withColumn("user", F.col("user_id").cast("string")), root)
    return store.read_partitioned_histories(spark, root)


register("io2_history_round_trip", _PERIOD_SQL + """
SELECT CAST(user_id AS VARCHAR) AS "user", compound, CAST(seq AS INTEGER) AS seq, weight, reps, rpe, load_delta
FROM periodized""")(_histories)


# Linear models from normal equations (M9, M10, M11): the next load delta from the lagged-mean gap and the repetitions.
from liftlake.operators import least_squares as LS  # noqa: E402

_XS = ("raw_pred", "reps")


def _folded(spark, d):
    scored = _scored(spark, d).where("raw_pred IS NOT NULL AND y IS NOT NULL AND reps IS NOT NULL")
    return ML.contiguous_folds(scored)


_FOLDS_SQL = S.with_ctes(S.SESSIONS) + _SCORED + f"""
, folded AS (
  SELECT compound, raw_pred AS u, CAST(reps AS DOUBLE) AS v, y,
         (5 * (row_number() OVER ({_W}) - 1)) // count(*) OVER (PARTITION BY user_id, compound) AS fold
  FROM scored WHERE raw_pred IS NOT NULL AND y IS NOT NULL AND reps IS NOT NULL)
"""


def _ols_sql(rows: str, group: str) -> str:
    """Two-feature least squares of ``rows`` by Cramer's rule."""
    return f"""SELECT {group}, n_train, mu, mv, my, bu, bv, my - bu * mu - bv * mv AS b0 FROM (
      SELECT *, (cuy * cvv - cvy * cuv) / (cuu * cvv - cuv * cuv) AS bu, (cvy * cuu - cuy * cuv) / (cuu * cvv - cuv * cuv) AS bv FROM (
        SELECT {group}, count(*) AS n_train, avg(u) AS mu, avg(v) AS mv, avg(y) AS my, var_pop(u) AS cuu, var_pop(v) AS cvv,
               covar_pop(u, v) AS cuv, covar_pop(y, u) AS cuy, covar_pop(y, v) AS cvy FROM {rows} GROUP BY {group}))"""


_CV_SQL = _FOLDS_SQL + f"""
, others AS (SELECT f.compound, k.fold AS held, u, v, y FROM folded f JOIN (SELECT DISTINCT fold FROM folded) k ON f.fold <> k.fold)
, model AS ({_ols_sql("others", "compound, held")})
, folds AS (
  SELECT f.compound, CAST(f.fold AS INTEGER) AS fold, any_value(n_train) AS n_train, count(*) AS n_test,
         sqrt(avg((y - b0 - bu * u - bv * v) ** 2)) AS rmse, 1.0::DOUBLE - sum((y - b0 - bu * u - bv * v) ** 2) / (var_pop(y) * count(*)) AS r2
  FROM folded f JOIN model m ON m.compound = f.compound AND m.held = f.fold GROUP BY 1, 2)
"""

register("m10_linear_folds", _CV_SQL + """
SELECT compound, fold, n_train, n_test, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM folds""")(
    lambda spark, d: LS.cross_validated(_folded(spark, d), ["compound"], _XS, "y").select(
        "compound", "fold", "n_train", "n_test", _r("rmse").alias("rmse"), _r("r2").alias("r2")))

register("m11_linear_cv_gate", _CV_SQL + """
SELECT compound, round(avg(r2), 6) AS cv_r2_mean, round(stddev_pop(r2), 6) AS cv_r2_std, count(*) AS folds,
       COALESCE(avg(r2) >= 0.0::DOUBLE AND stddev_pop(r2) <= 0.5::DOUBLE, false) AS accepted FROM folds GROUP BY 1""")(
    lambda spark, d: ML.gate_cv(LS.cross_validated(_folded(spark, d), ["compound"], _XS, "y")).withColumns(
        {"cv_r2_mean": _r("cv_r2_mean"), "cv_r2_std": _r("cv_r2_std")}))

register("m9_linear_scores", _FOLDS_SQL + f"""
, train AS (SELECT * FROM folded WHERE fold < 4)
, model AS ({_ols_sql("train", "compound")})
SELECT f.compound, CASE WHEN fold < 4 THEN 'train' ELSE 'valid' END AS split, count(*) AS n, round(any_value(b0), 6) AS intercept,
       round(any_value(bu), 6) AS b_raw_pred, round(any_value(bv), 6) AS b_reps,
       round(sqrt(avg((y - b0 - bu * u - bv * v) ** 2)), 6) AS rmse,
       round(1.0::DOUBLE - sum((y - b0 - bu * u - bv * v) ** 2) / (var_pop(y) * count(*)), 6) AS r2
FROM folded f JOIN model m ON m.compound = f.compound GROUP BY 1, 2""")(
    lambda spark, d: LS.split_scores(_folded(spark, d), ["compound"], _XS, "y", F.col("fold") == 4).withColumns(
        {c: _r(c) for c in ("intercept", "b_raw_pred", "b_reps", "rmse", "r2")}))


# ---------------------------------------------------------------------------
# Step 8: streaming (ST1): stream == batch W1
# ---------------------------------------------------------------------------
def _st1(spark, d):
    from liftlake.streaming import ingest
    out = ingest.run_to_table(ingest.session_ingest(ingest.sessions_stream(spark, d)), "st1_ingest", spark)
    return out.where(~F.col("late")).select(*KEY, "event_id", "weight", "load_delta")


register("st1_stream_session_ingest", _PERIOD_SQL + """
SELECT user_id, compound, event_id, weight, load_delta FROM periodized""")(_st1)


# Tables kept by streams (ST1 with rejects, ST2, ST3): the stored sessions come as a stream in ``STREAM_BATCHES`` time
# slices; the oracle knows nothing of slices.
STREAM_BATCHES = 2


def _stream_root(spark):
    import uuid
    from liftlake.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


def _streamed(job, spark, d, batches=None, **options):
    """Tables of a streaming job after all sessions of ``d`` went through it."""
    from liftlake.streaming import tables as ST
    root = _stream_root(spark)
    kept, step = getattr(ST, job)(spark, f"{root}/tables", **options)
    ST.replay(A.sessions(spark, d).drop("k"), step, root, batches or STREAM_BATCHES)
    return kept


def _st1_accounting(spark, d, batches=None, **options):
    kept = _streamed("ingest_sessions", spark, d, batches, **options)
    return kept.outcomes().select(*KEY, "event_id", "outcome", "load_delta", "seq")


register("st1_stream_accounting", S.with_ctes(S.SESSIONS) + f"""
, judged AS (
  SELECT *, CASE WHEN weight IS NULL OR weight <= 0 THEN 'weight_not_positive'
                 WHEN reps IS NULL OR reps <= 0 THEN 'reps_not_positive_integer'
                 WHEN rpe IS NULL OR rpe < 1 OR rpe > 10 THEN 'rpe_out_of_range' ELSE 'accepted' END AS outcome
  FROM sessions)
SELECT user_id, compound, event_id, outcome, COALESCE(weight - lag(weight) OVER ({_W}), 0.0::DOUBLE) AS load_delta,
       row_number() OVER ({_W}) AS seq FROM judged WHERE outcome = 'accepted'
UNION ALL SELECT user_id, compound, event_id, outcome, NULL, NULL FROM judged WHERE outcome <> 'accepted'""")(_st1_accounting)

_ST2_SQL = S.with_ctes(S.SESSIONS) + f"""
, ranked AS (SELECT *, row_number() OVER ({_W}) AS rr, lead(event_id) OVER ({_W}) AS next_id, lead(weight) OVER ({_W}) AS next_weight
             FROM sessions)
, logged AS (
  SELECT n.user_id, n.compound, n.ts, n.event_id, n.weight, n.next_id, n.next_weight AS actual_weight, 'normal' AS deviation_reason,
         CASE WHEN p.user_id IS NOT NULL THEN COALESCE(n.weight - p.weight, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS load_delta,
         CASE WHEN p.user_id IS NOT NULL THEN 'rule_based' ELSE 'insufficient_data' END AS prediction_source,
         CASE WHEN p.user_id IS NOT NULL THEN {_R4_RULE['suggested_weight']} END AS recommended_weight
  FROM ranked n LEFT JOIN ranked p ON n.user_id = p.user_id AND n.compound = p.compound AND n.rr = p.rr + 1)
, audit_done AS (
  SELECT *, actual_weight - recommended_weight AS accuracy_delta,
         CASE WHEN next_id IS NOT NULL THEN 'complete' ELSE 'pending' END AS prediction_status FROM logged)
"""

register("st2_stream_audit", _ST2_SQL + """
SELECT user_id, compound, event_id, load_delta, prediction_source, recommended_weight, actual_weight, accuracy_delta, prediction_status
FROM audit_done""")(lambda spark, d: _streamed("refresh_quality_stream", spark, d).view().select(
    *KEY, "event_id", "load_delta", "prediction_source", "recommended_weight", "actual_weight", "accuracy_delta", "prediction_status"))

register("st2_stream_quality", _ST2_SQL + _GATE_SQL[len(_AUDIT_CTES):].replace("FROM events)", "FROM sessions)") + """
SELECT user_id, compound, session_count, round(model_mape, 6) AS model_mape, round(rule_mape, 6) AS rule_mape, model_enabled FROM refreshed""")(
    lambda spark, d: _streamed("refresh_quality_stream", spark, d).quality.read().withColumns(
        {"model_mape": _r("model_mape"), "rule_mape": _r("rule_mape")}))

register("st3_stream_calibration", S.with_ctes(S.SESSIONS) + _SCORED + f"""
, used AS (SELECT user_id, compound, raw_pred AS x, y, row_number() OVER ({_W}) AS u FROM scored WHERE raw_pred IS NOT NULL AND y IS NOT NULL)
, firsts AS (SELECT user_id, compound, count(*) AS n, min(u) FILTER (WHERE x <> 0) AS z FROM used GROUP BY 1, 2)
, points AS (
  SELECT user_id, compound, n, unnest(list_filter([0, 10, 20, 30], lambda k: k = 0 OR greatest(z, 8) + k <= 32)) + greatest(z, 8) AS p
  FROM firsts WHERE z IS NOT NULL)
, each AS (
  SELECT user_id, compound, p, min(x) AS xmin, max(x) AS xmax, avg(y) AS ybar, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icpt
  FROM points JOIN used USING (user_id, compound) WHERE p <= n AND u <= p AND u > p - 32 GROUP BY 1, 2, 3)
, newest AS (SELECT *, count(*) OVER (PARTITION BY user_id, compound) AS runs,
                    row_number() OVER (PARTITION BY user_id, compound ORDER BY p DESC) AS rr FROM each)
SELECT k.user_id, k.compound,
       round(CASE WHEN p IS NULL THEN 1.0::DOUBLE ELSE
         least(greatest(CASE WHEN xmin = xmax THEN ybar / (xmin * 2.0::DOUBLE) ELSE slope END, 0.6::DOUBLE), 1.4::DOUBLE) END, 6) AS a,
       round(CASE WHEN p IS NULL THEN 0.0::DOUBLE WHEN xmin = xmax THEN ybar / 2.0::DOUBLE ELSE icpt END, 6) AS b,
       CAST(CASE WHEN p IS NULL THEN 0 ELSE least(p, 32) END AS INTEGER) AS last_calibrated_size, CAST(COALESCE(runs, 0) AS INTEGER) AS runs
FROM (SELECT DISTINCT user_id, compound FROM sessions) k
LEFT JOIN newest f ON f.user_id = k.user_id AND f.compound = k.compound AND f.rr = 1""")(
    lambda spark, d: _round_state(_streamed("refresh_calibration_stream", spark, d).calibration()))


# Retry-safe tables (IO6, IO7): every batch is written twice, as after a lost driver; the oracle sees it once.
def _upserted(spark, d):
    from liftlake.sources.buckets import BucketTable
    prior = _prior_state(C.fit_affine(C.usable_window(_scored(spark, d))))
    table = BucketTable(spark, f"{_stream_root(spark)}/calibration", "user_id bigint, compound string, a double, b double, last_calibrated_size int, runs int")
    for batch, rows in enumerate((prior, _refit_with_state(spark, d).where("user_id % 3 = 0"))):
        for _ in range(2):
            table.upsert(rows, batch)
    return table.read()


register("io7_bucket_upsert", S.with_ctes(S.SESSIONS) + _SCORED + """
, state AS (
  SELECT user_id, compound, 1.1::DOUBLE AS a, 0.5::DOUBLE AS b, 2 AS runs, fit_a, fit_b, n,
         CAST(CASE WHEN user_id % 2 = 0 THEN n - 10 ELSE n - 3 END AS INTEGER) AS last_calibrated_size
  FROM fit2)
, judged AS (
  SELECT *, COALESCE(user_id % 3 = 0 AND fit_a IS NOT NULL
                     AND (last_calibrated_size = 0 OR n - last_calibrated_size >= 10), false) AS go FROM state)
SELECT user_id, compound, CASE WHEN go THEN round(fit_a, 6) ELSE a END AS a, CASE WHEN go THEN round(fit_b, 6) ELSE b END AS b,
       CASE WHEN go THEN CAST(n AS INTEGER) ELSE last_calibrated_size END AS last_calibrated_size,
       CAST(runs + CAST(go AS INTEGER) AS INTEGER) AS runs
FROM judged""")(_upserted)


def _appended(spark, d):
    from liftlake.sources.buckets import BatchLog
    rows = QUERIES["io6_prediction_log"](spark, d)
    log = BatchLog(spark, f"{_stream_root(spark)}/predictions", rows.schema)
    for batch in (0, 1, 0, 1):
        log.write(rows.where(F.col("id") % 2 == batch), batch)
    return log.read()


QUERIES["io6_append_retried"], ORACLE["io6_append_retried"] = _appended, ORACLE["io6_prediction_log"]


# ---------------------------------------------------------------------------
# Remaining projections / top-k / set operations (PF15, PF20, PF22, SL2, SO2)
# ---------------------------------------------------------------------------
from liftlake.schema import DEVIATION_REASONS  # noqa: E402

register("pf20_validate_sessions", _AUDIT_CTES + f"""
SELECT user_id, compound, event_id,
       CASE WHEN weight IS NULL OR weight <= 0 THEN 'weight_not_positive'
            WHEN reps IS NULL OR reps <= 0 OR CAST(reps AS DOUBLE) <> floor(CAST(reps AS DOUBLE))
              THEN 'reps_not_positive_integer'
            WHEN rpe IS NULL OR rpe < 1 OR rpe > 10 THEN 'rpe_out_of_range'
            WHEN deviation_reason NOT IN ({", ".join(S._q(r) for r in DEVIATION_REASONS)}) THEN 'unknown_reason'
       END AS reject_reason
FROM audit""")(
    lambda spark, d: clean.validate_sessions(A.session_audit(spark, d), DEVIATION_REASONS)
    .select(*KEY, "event_id", "reject_reason"))

register("pf20_j9_event_accounting", S.with_ctes(S.SESSIONS, S.AUDIT) + f"""
, judged AS (
SELECT event_id,
       CASE WHEN weight IS NULL OR weight <= 0 THEN 'weight_not_positive'
            WHEN reps IS NULL OR reps <= 0 THEN 'reps_not_positive_integer'
            WHEN rpe IS NULL OR rpe < 1 OR rpe > 10 THEN 'rpe_out_of_range' ELSE 'accepted' END AS outcome FROM audit)
SELECT e.event_type, COALESCE(j.outcome, 'unmapped') AS outcome, count(*) AS events
FROM events e LEFT JOIN judged j ON e.event_id = j.event_id GROUP BY 1, 2""")(
    lambda spark, d: _event_accounting(spark, d))


def _event_accounting(spark, d):
    """Every event: accepted, rejected for a reason, or of a type that is no lift."""
    judged = clean.validate_sessions(A.session_candidates(spark, d).withColumn("deviation_reason", F.lit("normal")), DEVIATION_REASONS)
    outcome = F.when(F.col("compound").isNull(), F.lit("unmapped")).otherwise(F.coalesce("reject_reason", F.lit("accepted")))
    return judged.groupBy("event_type", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("events"))


register("pf15_synthetic_date_spine", S.with_ctes(S.SESSIONS) + f"""
SELECT user_id, compound, event_id,
       DATE '2024-01-01' + CAST(2 * (row_number() OVER ({_W}) - 1) AS INTEGER) AS date
FROM sessions""")(
    lambda spark, d: clean.synthetic_dates(A.sessions(spark, d), KEY, ORDER).select(*KEY, "event_id", "date"))

register("pf22_scoring_frame", S.with_ctes(S.SESSIONS) + """
SELECT user_id, compound, event_id, weight, reps, COALESCE(rpe, 8.0::DOUBLE) AS rpe FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, compound ORDER BY ts DESC, event_id DESC) AS rn
  FROM sessions) WHERE rn = 1""")(
    lambda spark, d: clean.scoring_frame(
        sequence.last_per_key(A.sessions(spark, d), cols=["event_id", "weight", "reps", "rpe"]))
    .select(*KEY, "event_id", "weight", "reps", "rpe"))

register("sl2_newest_predictions", S.with_ctes(S.SESSIONS) + _SCORED + f"""
, seqd AS (SELECT *, row_number() OVER ({_W}) AS seq FROM scored)
, preds AS (
  SELECT s.event_id AS id, s.user_id, s.compound, CAST(s.seq - 1 AS INTEGER) AS session_index,
         round(s.raw_pred * COALESCE(c.a, 1.0::DOUBLE) + COALESCE(c.b, 0.0::DOUBLE), 6) AS predicted_adjusted,
         s.ts AS created_at
  FROM seqd s LEFT JOIN calib c ON s.user_id = c.user_id AND s.compound = c.compound
  WHERE s.raw_pred IS NOT NULL)
SELECT user_id, compound, id, session_index, predicted_adjusted, recent_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id, compound ORDER BY created_at DESC, id DESC) AS INTEGER)
           AS recent_rank FROM preds) WHERE recent_rank <= 5""")(
    lambda spark, d: sequence.last_n(
        store.prediction_rows(C.apply_affine(_scored(spark, d), _calib(spark, d)))
        .where(F.col("predicted_raw").isNotNull()), 5, order=("created_at", "id"))
    .select(*KEY, "id", "session_index", _r("predicted_adjusted").alias("predicted_adjusted"), "recent_rank"))

register("so2_append_logged_sessions", S.with_ctes(S.SESSIONS) + """
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, compound ORDER BY ts DESC, event_id DESC) AS rr FROM sessions)
SELECT user_id, compound, event_id, weight, reps, rpe FROM ranked WHERE rr > 1
UNION ALL
SELECT user_id, compound, event_id, weight, reps, rpe FROM ranked WHERE rr = 1""")(
    lambda spark, d: _append_logged(spark, d))


def _append_logged(spark, d):
    new = recommend.log_newest_sessions(A.sessions(spark, d))
    history = A.sessions(spark, d).join(new.select("event_id"), "event_id", "left_anti")
    return recommend.append_sessions(history, new).select(*KEY, "event_id", "weight", "reps", "rpe")
