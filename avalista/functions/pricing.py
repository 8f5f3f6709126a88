"""Guarantee pricing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guarantee programme, category cuts and texts, rate and fee constants.
PROGRAM_LIMIT, PROGRAM_SMALL, PROGRAM_LARGE = 2000000, 0.80, 0.70
ULTRA_CUT, ORO_CUT = 0.01, 0.03
ULTRA, ORO, REJECT = "Ultra–Oro", "Oro", "Rechazo (Riesgo Alto)"
ULTRA_PCT, ORO_PCT = 0.85, 0.70
ULTRA_ACTION = "Aprobación Rápida con Beneficio"
ORO_ACTION = "Aprobación con Condiciones Preferenciales"
REJECT_ACTION = "Rechazo por Política de Riesgo"
ULTRA_LIMIT, ORO_LIMIT = 0.8, 0.75
MARKET_RATE, MIN_SPREAD, MIN_MARGIN = 7.6103, 2.0, 1.5
RISK_SHARE, OPERATING_SHARE = 0.65, 0.35
FEE_SHARE, EL_MARGIN = 0.05, 1.20
APPROVE_CUT, REVIEW_CUT = 0.05, 0.15
APPROVE, REVIEW, DECLINE = "APROBAR - Riesgo bajo", "REVISAR - Riesgo moderado", "RECHAZAR - Riesgo alto"


def _three_way(pd_, low_cut, high_cut, low, mid, high) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return (
        F.when(pd_ < low_cut, lit(low)).when(pd_ < high_cut, lit(mid)).when(pd_.isNotNull(), lit(high))
    )


def program_guarantee(amount) -> Column:
    return F.when(amount <= PROGRAM_LIMIT, amount * PROGRAM_SMALL).otherwise(amount * PROGRAM_LARGE)


def gps_category(pd_) -> Column:
    return _three_way(pd_, ULTRA_CUT, ORO_CUT, ULTRA, ORO, REJECT)


def gps_guarantee_pct(pd_) -> Column:
    return _three_way(pd_, ULTRA_CUT, ORO_CUT, ULTRA_PCT, ORO_PCT, 0.0)


def gps_action(pd_) -> Column:
    return _three_way(pd_, ULTRA_CUT, ORO_CUT, ULTRA_ACTION, ORO_ACTION, REJECT_ACTION)


def gps_limit(pd_, amount) -> Column:
    return _three_way(pd_, ULTRA_CUT, ORO_CUT, amount * ULTRA_LIMIT, amount * ORO_LIMIT, 0.0)


def is_rejected(pd_) -> Column:
    return pd_ >= ORO_CUT


def final_bank_rate(pd_, market_rate) -> Column:
    """Market rate with the risk part of its spread cut by the guaranteed share; 0 when rejected."""
    spread = F.greatest(market_rate - MARKET_RATE, F.lit(MIN_SPREAD))
    premium = spread * RISK_SHARE * (F.lit(1.0) - gps_guarantee_pct(pd_))
    rate = F.lit(MARKET_RATE) + spread * OPERATING_SHARE + premium
    priced = F.greatest(rate, F.lit(MARKET_RATE + MIN_MARGIN))
    return F.when(is_rejected(pd_), F.lit(0.0)).when(pd_.isNotNull() & market_rate.isNotNull(), priced)


def guaranteed_amount(pd_, amount) -> Column:
    return amount * gps_guarantee_pct(pd_)


def guarantee_fee(pd_, amount, expected_loss=None, fee_mode: str = "flat") -> Column:
    """``flat``: a share of the guaranteed amount. ``el_margin``: expected loss plus a margin."""
    if fee_mode == "flat":
        fee = guaranteed_amount(pd_, amount) * FEE_SHARE
    elif fee_mode == "el_margin":
        fee = expected_loss * EL_MARGIN
    else:
        raise ValueError(f"unknown fee_mode {fee_mode!r}")
    return F.when(is_rejected(pd_), F.lit(0.0)).otherwise(fee)


def monthly_payment(principal, annual_rate, months) -> Column:
    """Constant annuity; straight division at rate 0; null for 0 months."""
    monthly = annual_rate / 100.0 / 12.0
    growth = F.pow(F.lit(1.0) + monthly, months.cast("double"))
    annuity = F.try_divide(principal * (monthly * growth), growth - 1.0)
    return F.when(annual_rate == 0, F.try_divide(principal, months.cast("double"))).otherwise(annuity)


def decision_by_pd(pd_) -> Column:
    return _three_way(pd_, APPROVE_CUT, REVIEW_CUT, APPROVE, REVIEW, DECLINE)
