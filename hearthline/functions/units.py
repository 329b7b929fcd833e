"""Column names of the form quantity__unit, and physical constants."""

from __future__ import annotations

from pyspark.sql import DataFrame

# fixed values: plain physics and reference conditions for natural gas in the Netherlands
S_MIN, S_H, S_D, D_WEEK = 60, 3600, 86400, 7
J_KWH, W_KW, J_MJ = 3_600_000.0, 1000.0, 1e6
CM2_M2 = 1e4
G_NORM_HHV_J_M3 = 35.17e6
G_NORM_LHV_J_M3 = 31.65e6
P_NORM_PA, T_NORM_K, ZERO_C_K = 101_325.0, 273.15, 273.15
P_GAS_METER_OVERPRESSURE_PA = 2_500.0
T_GAS_METER_DEFAULT_C = 7.0
CO2_GAS_G_M3 = 1788.0
RHO_WATER_KG_M3, GRAVITY_M_S2 = 997.0, 9.81


def unit_of(column: str) -> str | None:
    """The unit of quantity__unit; None without one."""
    return column.rpartition("__")[2] if "__" in column else None


def with_unit(df: DataFrame, unit: str) -> list[str]:
    """The columns of a unit."""
    return [c for c in df.columns if unit_of(c) == unit]


def power_name(column: str) -> str | None:
    """The name of the average power of a cumulative meter column; None for other columns."""
    if column.endswith("_cum__kWh"):
        return column.removesuffix("_cum__kWh") + "__W"
    if column.endswith("_cum__m3"):
        stem = column.removesuffix("_cum__m3")
        return f"{stem}__W" if stem.endswith(("_hhv", "_lhv")) else f"{stem}_hhv__W"
    return None


def joules_per_unit(column: str) -> float | None:
    """Energy of one unit of a cumulative meter column."""
    if column.endswith("_cum__kWh"):
        return J_KWH
    if column.endswith("_cum__m3"):
        return G_NORM_LHV_J_M3 if "_lhv_" in column else G_NORM_HHV_J_M3
    return None
