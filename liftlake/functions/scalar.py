"""Scalar column expressions (JVM-side, no Python UDFs).

Every function takes and returns ``Column`` objects so it composes inside
``select``/``withColumns`` and stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftlake.schema import RuleParams


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN -> NULL (Spark orders NaN above every number, so normalise at ingest).

    ``nanvl`` evaluates its value once; a condition on it would parse a text twice."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


# -- SC1 -------------------------------------------------------------------
def round_to_plate(weight: str | Column, plate: float = 2.5) -> Column:
    """Nearest multiple of ``plate``, ties to even; plate <= 0 leaves it as is."""
    w = col(weight)
    if plate <= 0:
        return w
    return F.bround(w / F.lit(float(plate)), 0) * F.lit(float(plate))


# -- SC2 -------------------------------------------------------------------
def rule_progression(weight: str | Column, reps: str | Column, rpe: str | Column,
                     params: RuleParams = RuleParams()) -> Column:
    """Deterministic next-load rule as a struct column.

    Fields: suggested_weight double, reason string, applied_drop boolean,
    applied_cap boolean. Branch order: no weight; fatigue or under-reps;
    hold near limit; easy session; steady progress. The rounded suggestion
    is capped at +max_increment and at -2*drop_fraction, each cap
    re-rounded to the plate grid.
    """
    w, r, p = nan_to_null(col(weight)), col(reps).cast("double"), nan_to_null(col(rpe))
    inc = F.lit(float(params.max_increment))
    drop = float(params.drop_fraction)
    fatigue = F.coalesce(p > 9, F.lit(False)) | F.coalesce(
        (F.lit(float(params.target_reps)) - r) >= 2, F.lit(False))
    hold = F.coalesce(p >= 8.5, F.lit(False))
    easy = F.coalesce(p < 7, F.lit(False))
    delta = (F.when(fatigue, -w * drop)
             .when(hold, F.lit(0.0))
             .when(easy, F.least(inc, w * 0.05))
             .otherwise(F.least(inc / 2.0, w * 0.025)))
    reason = (F.when(fatigue, F.lit("fatigue_or_underreps"))
              .when(hold, F.lit("hold_near_limit"))
              .when(easy, F.lit("easy_session"))
              .otherwise(F.lit("steady_progress")))
    s0 = round_to_plate(w + delta, params.plate)
    cap_up = s0 > w + inc
    s1 = F.when(cap_up, round_to_plate(w + inc, params.plate)).otherwise(s0)
    floor_w = w * (1 - 2 * drop)
    cap_down = s1 < floor_w
    s2 = F.when(cap_down, round_to_plate(floor_w, params.plate)).otherwise(s1)
    has_w = w.isNotNull()
    return F.struct(
        F.when(has_w, s2).otherwise(F.lit(0.0)).alias("suggested_weight"),
        F.when(has_w, reason).otherwise(F.lit("no_weight_history")).alias("reason"),
        (has_w & fatigue).alias("applied_drop"),
        (has_w & (cap_up | cap_down)).alias("applied_cap"),
    )


# -- SC3 / SC4 / SC5 ---------------------------------------------------------
def rpe_bin(rpe: str | Column) -> Column:
    """[0,5] Low, (5,7] Medium, (7,10] High; outside -> NULL."""
    p = col(rpe)
    return (F.when((p >= 0) & (p <= 5), F.lit("Low"))
            .when((p > 5) & (p <= 7), F.lit("Medium"))
            .when((p > 7) & (p <= 10), F.lit("High")))


def rpe_ordinal(binned: str | Column) -> Column:
    b = col(binned)
    return (F.when(b == "Low", F.lit(1)).when(b == "Medium", F.lit(2))
            .when(b == "High", F.lit(3)))


def reps_bin(reps: str | Column) -> Column:
    """[0,5] Strength, (5,15] Hypertrophy, (15,inf) Endurance; negative -> NULL."""
    r = col(reps)
    return (F.when((r >= 0) & (r <= 5), F.lit("Strength"))
            .when((r > 5) & (r <= 15), F.lit("Hypertrophy"))
            .when(r > 15, F.lit("Endurance")))


# -- SC6 / SC8 / SC9 ---------------------------------------------------------
def affine(x: str | Column, a: str | Column, b: str | Column) -> Column:
    return col(x) * col(a) + col(b)


def direction(delta: str | Column) -> Column:
    d = col(delta)
    return F.when(d > 0, F.lit("↑")).when(d < 0, F.lit("↓")).when(d == 0, F.lit("→"))


# -- PF4 / PF5 / PF12 ----------------------------------------------------------
# The whitespace set stripped at both ends (``trim`` alone strips spaces only).
WHITESPACE = " \t\n\x0b\f\r"


def strip_ws(s: str | Column) -> Column:
    """Strip leading/trailing whitespace (a character-set trim, no regex)."""
    return F.btrim(col(s), F.lit(WHITESPACE))


def normalize_exercise(name: str | Column, strict: bool = False) -> Column:
    """lower + strip, spaces/hyphens -> '_', cut at '('; trailing '_' removed.

    ``strict=True`` keeps the trailing underscore a parenthesis leaves behind.
    """
    n = F.replace(F.replace(F.lower(strip_ws(name)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    n = strip_ws(F.substring_index(n, "(", 1))
    return n if strict else F.rtrim(n, F.lit("_"))


def keyword_compounds(name: str | Column, keywords) -> Column:
    """Array of every compound whose case-insensitive pattern matches ``name``."""
    n = col(name)
    hits = [F.when(n.rlike("(?i)" + pat), F.lit(comp)) for comp, pat in keywords]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def local_table(spark, rows, names, types):
    """A small fixed table built on the JVM (a local relation: no Python
    worker, no RDD), e.g. a dimension of a few dozen rows. One SQL call."""
    cols = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types))
    if not rows:
        nulls = ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in zip(names, types))
        return spark.sql(f"SELECT {nulls} WHERE false")
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT {cols} FROM VALUES {values} AS t({', '.join(names)})")


def stable_round(c: str | Column, digits: int = 6) -> Column:
    """Round to ``digits`` places, half away from zero, after snapping to 9
    places: last-bit noise from summation order (about 1e-11 for values near
    1e5) cannot flip the result."""
    return F.round(F.round(col(c), 9), digits)
