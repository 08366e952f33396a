"""Schemas, enumerations, parameters and fixed lookup values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Grouping key of every per-lift sequence and its total order.
KEY = ("user_id", "compound")
ORDER = ("ts", "event_id")

# --------------------------------------------------------------------------
# Fixed values (must equal the reference's for right results)
# --------------------------------------------------------------------------
COMPOUNDS = ("squat", "bench_press", "lat_pulldown", "seated_row")
DEVIATION_REASONS = ("normal", "easy", "hard", "injury", "external_stress", "other")
PREDICTION_STATUS = ("pending", "complete")
PREDICTION_SOURCES = ("rule_based", "model", "insufficient_data")

# Exercise -> (parent compound, scaling factor relative to the parent).
# Fixed values, in the reference's order.
EXERCISES = (
    ("bench_press", "bench_press", 1.00),
    ("close_grip_bench_press", "bench_press", 0.95),
    ("incline_bench_press", "bench_press", 0.85),
    ("low_incline_dumbbell_bench", "bench_press", 0.75),
    ("hex_press", "bench_press", 0.70),
    ("chest_fly", "bench_press", 0.40),
    ("cable_fly", "bench_press", 0.45),
    ("incline_chest_fly", "bench_press", 0.40),
    ("incline_cable_chest_fly", "bench_press", 0.45),
    ("weighted_dips", "bench_press", 0.90),
    ("push_up", "bench_press", 0.30),
    ("push_ups", "bench_press", 0.30),
    ("overhead_press", "bench_press", 0.65),
    ("seated_overhead_press", "bench_press", 0.60),
    ("shoulder_press_machine", "bench_press", 0.55),
    ("seated_shoulder_press_machine", "bench_press", 0.50),
    ("lateral_raise", "bench_press", 0.25),
    ("upright_row", "bench_press", 0.60),
    ("lying_skullcrusher", "bench_press", 0.45),
    ("triceps_extension", "bench_press", 0.40),
    ("triceps_pushdown", "bench_press", 0.35),
    ("lat_pulldown", "lat_pulldown", 1.00),
    ("lat_pulldown_wide", "lat_pulldown", 0.95),
    ("lat_pulldown_close", "lat_pulldown", 1.05),
    ("lat_pulldown_underhand_close", "lat_pulldown", 1.10),
    ("lat_pull_in", "lat_pulldown", 0.85),
    ("chin_up", "lat_pulldown", 0.90),
    ("chin_ups", "lat_pulldown", 0.90),
    ("neutral_chin", "lat_pulldown", 0.85),
    ("pull_ups", "lat_pulldown", 0.95),
    ("seated_row", "seated_row", 1.00),
    ("seated_cable_row", "seated_row", 0.95),
    ("hammer_seated_row", "seated_row", 0.90),
    ("hammer_row_wide", "seated_row", 0.85),
    ("bent_over_row", "seated_row", 1.05),
    ("bent_over_one_arm_row", "seated_row", 0.85),
    ("incline_row", "seated_row", 0.95),
    ("face_pull", "seated_row", 0.35),
    ("reverse_fly", "seated_row", 0.30),
    ("shrug", "seated_row", 0.75),
    ("barbell_curl", "seated_row", 0.40),
    ("ez_bar_curl", "seated_row", 0.38),
    ("dumbbell_curl", "seated_row", 0.35),
    ("incline_curl", "seated_row", 0.30),
    ("hammer_curl", "seated_row", 0.36),
    ("barbell_row", "seated_row", 1.05),
    ("dumbbell_row", "seated_row", 0.85),
    ("chest_supported_row", "seated_row", 0.95),
    ("machine_row", "seated_row", 0.90),
    ("pendulum_row", "seated_row", 0.88),
    ("squat", "squat", 1.00),
    ("high_bar_squat", "squat", 0.95),
    ("front_squat", "squat", 0.85),
    ("hack_squat", "squat", 0.90),
    ("leg_press", "squat", 0.80),
    ("seated_leg_press", "squat", 0.75),
    ("leg_extension", "squat", 0.40),
    ("leg_extensions", "squat", 0.40),
    ("leg_outward_fly", "squat", 0.30),
    ("deadlift", "squat", 1.20),
    ("trap_bar_deadlift", "squat", 1.25),
    ("sumo_deadlift", "squat", 1.25),
    ("romanian_deadlift", "squat", 0.90),
    ("rack_pull_1_pin", "squat", 1.30),
    ("rack_pull_2_pin", "squat", 1.40),
    ("good_morning", "squat", 0.60),
    ("glute_extension", "squat", 0.45),
    ("seated_leg_curl", "squat", 0.40),
    ("lying_leg_curl", "squat", 0.45),
    ("calf_press_seated_leg_press", "squat", 0.60),
)

# Keyword patterns that assign a raw exercise name to a compound
# (case-insensitive). Fixed values.
COMPOUND_KEYWORDS = (
    ("squat", "Squat|Leg Press|Deadlift|Leg Extension"),
    ("bench_press", "Bench|Chest|Triceps|Overhead Press"),
    ("lat_pulldown", "Lat|Pull|Chin|Pulldown"),
    ("seated_row", "Row|Curl|Bicep|Shrug"),
)

# Raw export columns -> snake_case names. Fixed values.
EXPORT_COLUMNS = {
    "Date": "date",
    "Workout Name": "workout_name",
    "Duration": "duration",
    "Exercise Name": "exercise_name",
    "Set Order": "set_order",
    "Weight": "weight",
    "Reps": "reps",
    "Distance": "distance",
    "Seconds": "seconds",
    "Notes": "notes",
    "Workout Notes": "workout_notes",
    "RPE": "rpe",
}
EXPORT_NUMERIC = ("duration", "weight", "reps", "distance", "seconds", "rpe", "set_order")
EXPORT_STRINGS = ("workout_name", "exercise_name", "notes", "workout_notes")

# Compact baseline layout -> session columns. Fixed values.
BASELINE_COLUMNS = {
    "Exercise": "exercise_name",
    "Category": "category",
    "Weight_lbs": "weight",
    "Reps": "reps",
    "Volume": "set_volume",
}

# Feature columns clipped to [q01, q99] before training. Fixed values.
CLIP_FEATURES = (
    "weight", "effective_load", "set_volume",
    "rolling_avg_load_last_3_sessions", "rolling_trend_load",
    "percent_of_max", "cycle_weight_trend", "max_weight_so_far",
)

# Two unmapped exercise names used by the sets adapter.
UNMAPPED_EXERCISES = ("farmer_walk", "plank")


# --------------------------------------------------------------------------
# Parameters
# --------------------------------------------------------------------------
@dataclass(frozen=True)
class RuleParams:
    target_reps: int = 5
    max_increment: float = 5.0
    drop_fraction: float = 0.05
    plate: float = 2.5


@dataclass(frozen=True)
class CalibrationConfig:
    min_samples: int = 8
    refit_every: int = 10
    window: int = 32
    gain_low: float = 0.6
    gain_high: float = 1.4
    # "window": available rows are capped at ``window`` (faithful);
    # "total": available rows count the whole usable history.
    cadence: str = "window"


@dataclass(frozen=True)
class GateParams:
    recent: int = 15
    min_records: int = 10
    min_per_source: int = 5
    relative: float = 0.85
    absolute: float = 0.10


@dataclass(frozen=True)
class RouteParams:
    rule_until: int = 15          # count <= rule_until and not enabled -> rule based
    neutral_rpe: float = 8.0


@dataclass(frozen=True)
class ForestParams:
    num_trees: int = 100
    max_depth: int = 4
    feature_subset: str = "sqrt"
    min_instances_per_node: int = 3
    seed: int = 42


# --------------------------------------------------------------------------
# Table schemas
# --------------------------------------------------------------------------
SESSION_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("compound", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("reps", T.IntegerType()),
    T.StructField("rpe", T.DoubleType()),
])

PREDICTIONS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("compound", T.StringType()),
    T.StructField("session_index", T.IntegerType()),
    T.StructField("predicted_raw", T.DoubleType()),
    T.StructField("predicted_adjusted", T.DoubleType()),
    T.StructField("actual", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

CALIBRATION_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("compound", T.StringType()),
    T.StructField("a", T.DoubleType()),
    T.StructField("b", T.DoubleType()),
    T.StructField("last_calibrated_size", T.IntegerType()),
    T.StructField("runs", T.IntegerType()),
])

MODEL_QUALITY_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("compound", T.StringType()),
    T.StructField("session_count", T.IntegerType()),
    T.StructField("model_mape", T.DoubleType()),
    T.StructField("rule_mape", T.DoubleType()),
    T.StructField("model_enabled", T.BooleanType()),
])

AUDIT_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("compound", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("reps", T.IntegerType()),
    T.StructField("rpe", T.DoubleType()),
    T.StructField("deviation_reason", T.StringType()),
    T.StructField("prediction_source", T.StringType()),
    T.StructField("recommended_weight", T.DoubleType()),
    T.StructField("actual_weight", T.DoubleType()),
    T.StructField("accuracy_delta", T.DoubleType()),
    T.StructField("prediction_status", T.StringType()),
])
