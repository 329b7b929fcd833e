"""Column expressions of heating physics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.units import CO2_GAS_G_M3, G_NORM_HHV_J_M3, GRAVITY_M_S2, P_GAS_METER_OVERPRESSURE_PA, P_NORM_PA, RHO_WATER_KG_M3, T_GAS_METER_DEFAULT_C, ZERO_C_K


def _c(x: str | float | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def quotient(above: str | Column, below: str | Column) -> Column:
    """above / below of doubles; over zero as in floating-point arithmetic, infinite or not a number, where the operator raises an error."""
    above, below = (F.col(x) if isinstance(x, str) else x for x in (above, below))
    return F.when(below == 0, above * F.lit(float("inf"))).otherwise(above / below)


def polynomial(x: str | Column, coefficients: list) -> Column:
    """Horner's rule; coefficients from the highest power down, numbers or columns."""
    return reduce(lambda a, c: a * _c(x) + _c(c), coefficients[1:], _c(coefficients[0]))


def water_heat_capacity(temp: str | Column, coefficients: list[float]) -> Column:
    """Volumetric heat capacity of water in J/(dm3 K), a cubic of the temperature."""
    return polynomial(temp, coefficients)


def effective_outdoor_temperature(temp: str | Column, wind: str | Column) -> Column:
    """Outdoor temperature less two thirds of a degree for each m/s of wind."""
    return _c(temp) - _c(wind) * F.lit(2.0) / F.lit(3.0)


def distribution_temperature(flow: str | Column, ret: str | Column) -> tuple[Column, Column]:
    """Mean and difference of flow and return temperature."""
    return (_c(flow) + _c(ret)) / 2, _c(flow) - _c(ret)


def flow_rate(heat: str | Column, temp: str | Column, delta: str | Column, coefficients: list[float], most: float) -> Column:
    """heat / (capacity of water * delta), null unless delta > 0, within 0 and most."""
    q = F.when(_c(delta) > 0, _c(heat) / (water_heat_capacity(temp, coefficients) * _c(delta)))
    return F.when(q.isNotNull(), F.least(F.greatest(q, F.lit(0.0)), F.lit(float(most))))


def head_pressure(height: str | Column) -> Column:
    return _c(height) * F.lit(RHO_WATER_KG_M3 * GRAVITY_M_S2)


def hydraulic_resistance(pressure: str | Column, slope: str | Column) -> Column:
    """Pressure over the square of the flow at full pump speed."""
    return _c(pressure) / F.pow(_c(slope) * 100, F.lit(2))


def boiler_efficiency(load: str | Column, temp: str | Column, c: dict[str, str | float | Column]) -> Column:
    """A polynomial with a kink at the condensation temperature, which is itself a quadratic of the load.

    c names cond0..2, t_cond1..2, t_nocond1, g_cond0..2, g_nocond0..2 and eta0; below the kink the temperature goes in
    as a quadratic, above it as a straight line.
    """
    kink = polynomial(load, [c["cond2"], c["cond1"], c["cond0"]])
    over = _c(temp) - kink
    low = _c(c["eta0"]) + over * _c(c["t_cond1"]) + over * over * _c(c["t_cond2"]) + polynomial(load, [c["g_cond2"], c["g_cond1"], c["g_cond0"]])
    high = _c(c["eta0"]) + over * _c(c["t_nocond1"]) + polynomial(load, [c["g_nocond2"], c["g_nocond1"], c["g_nocond0"]])
    return F.when(_c(temp) < kink, low).otherwise(high)


def is_comfortable(indoor: str | Column, setpoint: str | Column, occupied: str | Column, under: float, over: float) -> Column:
    """Within the margins around the set point while occupied; true while not; null where a temperature is missing."""
    t, s = _c(indoor), _c(setpoint)
    known = t.isNotNull() & s.isNotNull()
    return F.when(known & _c(occupied), (t >= s - F.lit(float(under))) & (t <= s + F.lit(float(over)))).when(known, F.lit(True))


def in_comfort_zone(indoor: str | Column, occupied: str | Column, low: float, high: float) -> Column:
    """Without a set point: within a fixed zone while occupied; true while not; null where the temperature is missing."""
    t = _c(indoor)
    return F.when(t.isNotNull() & _c(occupied), t.between(F.lit(float(low)), F.lit(float(high)))).when(t.isNotNull(), F.lit(True))


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """The value held within the limits; null stays null."""
    out = _c(c)
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def gas_conversion(df: DataFrame, gas_m3_s: str, actual_hhv: str, air_pressure: str, fan: str, fan_low: str, fan_high: str, q_low: str, q_high: str) -> DataFrame:
    """df with gas power from the meter, and boiler load and power from the fan speed.

    Adds gas_power_hhv__W (volume to norm conditions times the actual calorific value), fan_rotations__pct (clipped to
    0..100), power_lhv__kW (between the boiler's least and greatest power) and load__pct.
    """
    to_norm = (F.col(air_pressure) + F.lit(P_GAS_METER_OVERPRESSURE_PA)) / F.lit(P_NORM_PA) * F.lit(ZERO_C_K / (ZERO_C_K + T_GAS_METER_DEFAULT_C))
    share = clip((F.col(fan) - F.col(fan_low)) / (F.col(fan_high) - F.col(fan_low)) * 100, 0.0, 100.0)
    return (
        df.withColumn("gas_power_hhv__W", F.col(gas_m3_s) * to_norm * F.coalesce(F.col(actual_hhv), F.lit(G_NORM_HHV_J_M3)))
        .withColumn("fan_rotations__pct", share)
        .withColumn("power_lhv__kW", F.col(q_low) + (F.col(q_high) - F.col(q_low)) * F.col("fan_rotations__pct") / 100)
        .withColumn("load__pct", clip(F.col("power_lhv__kW") / F.col(q_high) * 100, 0.0, 100.0))
    )


def corrected_power(power: str | Column, factors: list[str]) -> Column:
    """A power times its factors (calorific value, pressure, temperature): a meter that corrects for one itself goes without that one."""
    return reduce(lambda a, f: a * F.col(f), factors, _c(power))


def boiler_gas_use(df: DataFrame, power_kw: str, valve_open: str, factors: list[str], purposes: dict[str, str]) -> DataFrame:
    """df with the actual gas power of a boiler from its power at reference gas, while the valve is open, and its parts by purpose.

    Adds use_hhv__W, and use_<purpose>_hhv__W for each purpose with the flag column that says when the gas is for it.
    """
    flag = lambda c: F.col(c).cast("int").cast("double")
    df = df.withColumn("use_hhv__W", corrected_power(flag(valve_open) * F.col(power_kw) * F.lit(1000.0), factors))
    return df.withColumns({f"use_{p}_hhv__W": F.col("use_hhv__W") * flag(c) for p, c in purposes.items()})


def carbon(power: str | Column, hhv: float = G_NORM_HHV_J_M3) -> Column:
    """Grams of CO2 a second of burning gas at a power in W."""
    return _c(power) * F.lit(CO2_GAS_G_M3 / hhv)


def home_parameters(home_id: str | Column) -> dict[str, Column]:
    """Heat loss, time constant and solar aperture that a synthetic home's id spells, in blocks of two and three digits."""
    i = _c(home_id)
    return {"actual_H__W_K": F.floor(i / 100_000).cast("long"), "actual_tau__h": F.floor(F.pmod(i, F.lit(100_000)) / 100).cast("long"), "actual_A__m2": F.pmod(i, F.lit(100)).cast("long")}


def grid_cell(lat: str, lon: str, step: float) -> dict[str, Column]:
    """Key and centre of the square cell of a place."""
    a, b = (F.floor(F.col(x) / F.lit(step)) for x in (lat, lon))
    return {"cell": F.concat_ws("_", a, b), "cell_lat__degN": (a + 0.5) * F.lit(step), "cell_lon__degE": (b + 0.5) * F.lit(step)}
