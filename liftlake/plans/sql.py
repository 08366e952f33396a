"""DuckDB-dialect building blocks for the oracle SQL.

The oracle re-states each query in plain SQL over the driver's tables. These
CTEs mirror the adapters in ``liftlake.sources.adapters`` column for column.
Decimal literals are written as DOUBLE so arithmetic matches Spark's doubles.
"""

from __future__ import annotations

from liftlake.schema import EXERCISES
from liftlake.sources.adapters import EVENT_COMPOUND, exercise_catalog


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


COMPOUND_CASE = "CASE event_type " + " ".join(
    f"WHEN {_q(e)} THEN {_q(c)}" for e, c in EVENT_COMPOUND) + " END"

SESSIONS = f"""sessions AS (
  SELECT user_id, {COMPOUND_CASE} AS compound, ts, event_id,
         CASE WHEN isnan(value) THEN NULL ELSE value END AS weight,
         CAST(k % 12 + 1 AS INTEGER) AS reps,
         CASE WHEN k % 10 = 0 THEN NULL
              ELSE 5.0::DOUBLE + CAST(k % 11 AS DOUBLE) * 0.5::DOUBLE END AS rpe,
         k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events WHERE event_type IN ({", ".join(_q(e) for e, _ in EVENT_COMPOUND)})) e)"""

AUDIT = """audit AS (
  SELECT user_id, compound, ts, event_id, weight, reps, rpe,
         CASE WHEN k % 10 = 9 THEN 'hard' ELSE 'normal' END AS deviation_reason,
         CASE WHEN COALESCE(k % 2 = 0, false) THEN 'model' ELSE 'rule_based' END AS prediction_source,
         CASE WHEN COALESCE(k % 2 = 0, false)
              THEN weight * (1.0::DOUBLE + CAST(k % 7 - 3 AS DOUBLE) * 0.04::DOUBLE)
              ELSE weight * (1.0::DOUBLE + CAST(k % 11 - 5 AS DOUBLE) * 0.04::DOUBLE) END
           AS recommended_weight
  FROM sessions)"""

AUDIT_DONE = """audit_done AS (
  SELECT *, weight AS actual_weight, weight - recommended_weight AS accuracy_delta,
         'complete' AS prediction_status
  FROM audit)"""


def catalog_values() -> str:
    rows = ", ".join(f"({i}, {_q(n)}, {_q(d)})" for i, n, d in exercise_catalog())
    return f"catalog(ex_idx, ex_norm, ex_display) AS (VALUES {rows})"


def exercise_dim_values() -> str:
    rows = ", ".join(f"({_q(e)}, {_q(p)}, {s!r}::DOUBLE)" for e, p, s in EXERCISES)
    return f"exdim(exercise, parent, scale) AS (VALUES {rows})"


SETS = """sets AS (
  SELECT o.o_custkey AS user_id, o.o_orderdate AS date, o.o_orderpriority AS workout_name,
         l.l_linenumber AS set_order,
         CASE WHEN l.l_linenumber = 2 THEN c.ex_display || ' (Barbell)'
              WHEN l.l_linenumber = 3 THEN ' ' || c.ex_display || ' '
              ELSE c.ex_display END AS exercise_name,
         l.l_extendedprice / NULLIF(l.l_quantity, 0) AS weight,
         CAST(l.l_quantity AS INTEGER) AS reps,
         CASE WHEN l.l_linenumber = 7 THEN NULL
              ELSE 5.0::DOUBLE + 50.0::DOUBLE * l.l_discount END AS rpe,
         CASE WHEN l.l_returnflag = 'R' THEN NULL ELSE 0.0::DOUBLE END AS distance,
         l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_discount,
         l.l_returnflag
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN catalog c ON l.l_partkey % 72 = c.ex_idx)"""

# Normalised exercise name (PF4 + PF5) of a SQL expression.
WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip_sql(e: str) -> str:
    return f"trim({e}, {WS})"


def norm_sql(e: str) -> str:
    cut = f"split_part(translate(lower({strip_sql(e)}), ' -', '__'), '(', 1)"
    return f"rtrim({strip_sql(cut)}, '_')"


def plate_sql(x: str, plate: float = 2.5) -> str:
    return f"(round_even(({x}) / {plate}::DOUBLE, 0) * {plate}::DOUBLE)"


def rule_sql(w: str, r: str, p: str) -> dict[str, str]:
    """SC2 as SQL expressions: suggested_weight, reason, applied_drop, applied_cap."""
    fatigue = f"(COALESCE({p} > 9, false) OR COALESCE(5.0::DOUBLE - CAST({r} AS DOUBLE) >= 2, false))"
    hold = f"COALESCE({p} >= 8.5, false)"
    easy = f"COALESCE({p} < 7, false)"
    delta = (f"CASE WHEN {fatigue} THEN -{w} * 0.05::DOUBLE WHEN {hold} THEN 0.0::DOUBLE "
             f"WHEN {easy} THEN least(5.0::DOUBLE, {w} * 0.05::DOUBLE) "
             f"ELSE least(5.0::DOUBLE / 2.0::DOUBLE, {w} * 0.025::DOUBLE) END")
    s0 = plate_sql(f"{w} + ({delta})")
    up = f"({s0} > {w} + 5.0::DOUBLE)"
    s1 = f"(CASE WHEN {up} THEN {plate_sql(f'{w} + 5.0::DOUBLE')} ELSE {s0} END)"
    floor_w = f"({w} * 0.9::DOUBLE)"
    down = f"({s1} < {floor_w})"
    s2 = f"(CASE WHEN {down} THEN {plate_sql(floor_w)} ELSE {s1} END)"
    reason = (f"CASE WHEN {fatigue} THEN 'fatigue_or_underreps' WHEN {hold} THEN 'hold_near_limit' "
              f"WHEN {easy} THEN 'easy_session' ELSE 'steady_progress' END")
    has = f"({w} IS NOT NULL)"
    return {
        "suggested_weight": f"CASE WHEN {has} THEN {s2} ELSE 0.0::DOUBLE END",
        "reason": f"CASE WHEN {has} THEN {reason} ELSE 'no_weight_history' END",
        "applied_drop": f"({has} AND {fatigue})",
        "applied_cap": f"({has} AND ({up} OR {down}))",
    }


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


EXPORT = """export AS (
  SELECT CASE WHEN l_linenumber = 6 AND l_partkey % 50 = 0 THEN 'not a date'
              ELSE strftime(date, '%Y-%m-%d %H:%M:%S') END AS "Date",
         CASE WHEN l_linenumber = 4 THEN ' ' || workout_name || chr(9) ELSE workout_name END AS "Workout Name",
         CAST(l_linenumber * 10 AS VARCHAR) AS "Duration",
         exercise_name AS "Exercise Name",
         CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(set_order AS VARCHAR) END AS "Set Order",
         CASE WHEN l_partkey % 97 = 0 THEN 'n/a' ELSE CAST(weight AS VARCHAR) END AS "Weight",
         CAST(reps AS VARCHAR) AS "Reps", CAST(distance AS VARCHAR) AS "Distance",
         '0' AS "Seconds", CAST(NULL AS VARCHAR) AS "Notes", '' AS "Workout Notes",
         CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(rpe AS VARCHAR) END AS "RPE",
         user_id, CASE WHEN l_orderkey % 5 = 0 THEN 'lite' ELSE 'full' END AS source,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag
  FROM sets)"""


def stable_round_sql(sql: str) -> str:
    """Rewrite every ``round(x, d)`` as decimal half-away-from-zero rounding of
    x snapped to 9 places -- the same rule as ``stable_round`` in Spark."""
    out, i, n = [], 0, len(sql)
    low = sql.lower()
    while i < n:
        j = low.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            break
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, args, start = 1, j + 6, [], j + 6
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                args.append(sql[start:k])
                start = k + 1
            k += 1
        args.append(sql[start:k - 1])
        out.append(sql[i:j])
        if len(args) == 2 and args[1].strip().isdigit():
            inner = stable_round_sql(args[0])
            d = args[1].strip()
            out.append(f"CAST(round(CAST(round({inner}, 9) AS DECIMAL(38, 9)), {d}) AS DOUBLE)")
        else:
            out.append("round(" + stable_round_sql(sql[j + 6:k - 1]) + ")")
        i = k
    return "".join(out)
