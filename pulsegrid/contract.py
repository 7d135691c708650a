"""The column contract: 42 features in fixed order, feature sets, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Feature names and their order, label codes, sets.
EDA = ["eda_scl_mean", "eda_scl_sd", "eda_scr_sd", "eda_range", "eda_slope", "eda_scr_count", "eda_scr_amp_sum", "eda_scr_amp_mean", "eda_scr_risetime_mean", "eda_scr_duration_sum"]
HR = ["hr_mean", "hr_sd", "hr_min", "hr_max", "hr_range", "hr_slope", "hr_baseline_delta"]
IMU = [
    "acc_x_mean", "acc_y_mean", "acc_z_mean", "acc_mag_mean",
    "acc_x_sd", "acc_y_sd", "acc_z_sd", "acc_mag_sd",
    "acc_x_absint", "acc_y_absint", "acc_z_absint", "acc_mag_absint",
    "acc_x_peakfreq", "acc_y_peakfreq", "acc_z_peakfreq",
    "motion_flag", "motion_fraction",
]
TEMP = ["temp_mean", "temp_min", "temp_max", "temp_range", "temp_slope", "temp_baseline_delta"]
CROSS = ["hr_delta_x_still", "eda_range_gated"]
FEATURE_NAMES = EDA + HR + IMU + TEMP + CROSS
META = ["subject", "label", "label_name", "t_start"]
LABEL_NAMES = {1: "baseline", 2: "stress", 3: "amusement", 4: "meditation"}
TIME = "t_start"
POSTURE = ["acc_x_mean", "acc_y_mean", "acc_z_mean", "acc_mag_mean"]
TEMP_ABSOLUTE = ["temp_mean", "temp_min", "temp_max", "temp_range"]


def _without(*gone: list[str]) -> list[str]:
    return [c for c in FEATURE_NAMES if not any(c in g for g in gone)]


FEATURE_SETS = {
    "all": FEATURE_NAMES,
    "no_temp": _without(TEMP),
    "no_posture": _without(POSTURE),
    "clean": _without(TEMP_ABSOLUTE, POSTURE),
    "eda_only": EDA,
    "hr_only": HR,
    "eda_hr": EDA + HR,
    "time_only": [TIME],
    "clean_plus_time": _without(TEMP_ABSOLUTE, POSTURE) + [TIME],
    "eda_plus_time": EDA + [TIME],
}
BLOCKS = {"EDA": EDA, "HR": HR, "IMU": IMU, "TEMP": TEMP}


class ContractError(ValueError):
    """Columns do not meet the contract."""


def resolve(name: str, columns: list[str]) -> list[str]:
    """The columns of a feature set that are present, in contract order; none is an error."""
    if name not in FEATURE_SETS:
        raise ContractError(f"unknown feature set {name!r}")
    found = [c for c in FEATURE_SETS[name] if c in columns]
    if not found:
        raise ContractError(f"no column of {name!r} is present")
    return found


def check_columns(df: DataFrame) -> DataFrame:
    """A feature table must have every feature and the start time."""
    if missing := [c for c in [*FEATURE_NAMES, TIME] if c not in df.columns]:
        raise ContractError(f"stale table, missing {missing}")
    return df


def exact(columns: list[str]) -> None:
    """Exactly the 42 features."""
    missing, extra = sorted(set(FEATURE_NAMES) - set(columns)), sorted(set(columns) - set(FEATURE_NAMES))
    if missing or extra:
        raise ContractError(f"missing {missing}, extra {extra}")


def guard(columns: list[str], feature_set: str | None = None) -> None:
    """A model that is exported or scored may not see elapsed time, nor columns outside the contract."""
    if TIME in columns or (feature_set is not None and TIME in FEATURE_SETS[feature_set]):
        raise ContractError("elapsed time is not a feature of an exported model")
    if unknown := [c for c in columns if c not in FEATURE_NAMES]:
        raise ContractError(f"columns outside the contract: {unknown}")


def check_row_schema(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ContractError(f"rows lack {missing}")
    return df
