"""Cost-of-energy and cashflow arithmetic; short loops are higher-order functions inside the row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Utility-scale assumptions and the IRR search.
PACKING_MWP_PER_KM2 = 45.0
CAPEX_USD_PER_KWP = 1000.0
OPEX_USD_PER_KWP_YR = 17.0
DISCOUNT_RATE = 0.07
LIFETIME_YEARS = 25
PERFORMANCE_RATIO = 0.75
IRR_BRACKET = (-0.95, 2.0)
IRR_STEPS = 100
IRR_TOLERANCE = 1e-6


def capital_recovery_factor(rate: Column, years: Column) -> Column:
    growth = F.pow(1.0 + rate, years)
    return rate * growth / (growth - 1.0)


def lcoe_usd_per_mwh(
    specific_yield: Column,
    capex: float = CAPEX_USD_PER_KWP,
    opex: float = OPEX_USD_PER_KWP_YR,
    rate: float = DISCOUNT_RATE,
    years: int = LIFETIME_YEARS,
) -> Column:
    """NULL when nothing is produced."""
    growth = (1.0 + rate) ** years
    yearly = capex * (rate * growth / (growth - 1.0)) + opex
    return F.lit(yearly) / F.nullif(specific_yield, F.lit(0.0)) * 1000.0


def yearly_flows(net_cost: Column, savings: Column, degradation: Column, years: Column) -> Column:
    """Year 0 pays the net cost, year t earns savings x (1 - degradation)^(t-1)."""
    earned = F.transform(F.sequence(F.lit(1), years), lambda t: savings * F.pow(1.0 - degradation, t - 1))
    return F.concat(F.array(-net_cost), earned)


def present_value(flows: Column, rate: Column) -> Column:
    """Horner form over the reversed flows: one division per year, no powers."""
    return F.aggregate(F.reverse(flows), F.lit(0.0), lambda acc, cash: acc / (1.0 + rate) + cash)


def _bisect(value_at: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """P31 for a whole batch: each row is halved until its value is within tolerance.

    NaN where the value has no sign change over the bracket.
    """
    lo, hi = np.full(size, IRR_BRACKET[0]), np.full(size, IRR_BRACKET[1])
    at_lo, at_hi = value_at(lo), value_at(hi)
    found = np.where(at_lo == 0.0, lo, np.nan)
    defined = at_lo * at_hi <= 0.0
    for _ in range(IRR_STEPS):
        mid = (lo + hi) / 2.0
        at_mid = value_at(mid)
        found = np.where(np.isnan(found) & (np.abs(at_mid) < IRR_TOLERANCE), mid, found)
        if not (defined & np.isnan(found)).any():
            break
        left = at_lo * at_mid < 0.0
        lo, at_lo = np.where(left, lo, mid), np.where(left, at_lo, at_mid)
        hi = np.where(left, mid, hi)
    rate = np.where(np.isnan(found), (lo + hi) / 2.0, found)
    return np.where(defined | (at_lo == 0.0), rate, np.nan)


@F.pandas_udf(T.DoubleType())
def _level_irr(net_cost: pd.Series, savings: pd.Series, degradation: pd.Series, years: pd.Series) -> pd.Series:
    cost, earned = net_cost.to_numpy(dtype=float), savings.to_numpy(dtype=float)
    kept, n = 1.0 - degradation.to_numpy(dtype=float), years.to_numpy(dtype=float)

    def value_at(rate: np.ndarray) -> np.ndarray:
        ratio = kept / (1.0 + rate)
        level = np.abs(ratio - 1.0) < 1e-12
        series = np.where(level, n, (1.0 - ratio**n) / np.where(level, 1.0, 1.0 - ratio))
        return earned / (1.0 + rate) * series - cost

    with np.errstate(all="ignore"):
        rate = pd.Series(_bisect(value_at, len(cost)))
    return rate.astype(object).where(rate.notna(), None)


@F.pandas_udf(T.DoubleType())
def _flows_irr(flows: pd.Series) -> pd.Series:
    out = np.full(len(flows), np.nan)
    lengths = flows.map(lambda f: -1 if f is None else len(f)).to_numpy()
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == length)
        cash = np.stack(flows.iloc[rows].to_numpy())

        def value_at(rate: np.ndarray, cash: np.ndarray = cash) -> np.ndarray:
            total = np.zeros(len(rate))
            for t in range(cash.shape[1] - 1, -1, -1):
                total = total / (1.0 + rate) + cash[:, t]
            return total

        out[rows] = _bisect(value_at, len(rows))
    rate = pd.Series(out)
    return rate.astype(object).where(rate.notna(), None)


# Bisection runs over Arrow batches: a hundred dependent steps per row are far slower as
# higher-order functions, which Spark interprets. Marked non-deterministic so that a filter
# on a result never repeats the call.
_level_irr = _level_irr.asNondeterministic()
_flows_irr = _flows_irr.asNondeterministic()


def level_irr(net_cost: Column, savings: Column, degradation: Column, years: Column) -> Column:
    """P31 for the cash of ``yearly_flows``, whose present value is a geometric series."""
    return _level_irr(net_cost, savings, degradation, years.cast("double"))


def irr(flows: Column) -> Column:
    """P31 for any flows: the rate with zero present value; NULL without a sign change."""
    return _flows_irr(flows)


def degraded_lifetime(annual: Column, degradation: Column, years: Column) -> Column:
    """Sum over ``years`` of annual x (1 - degradation)^t, t from 0."""
    return F.aggregate(
        F.sequence(F.lit(0), years - 1),
        F.lit(0.0),
        lambda total, t: total + annual * F.pow(1.0 - degradation, t),
    )
