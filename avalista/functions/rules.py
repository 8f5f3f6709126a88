"""Rule-based risk columns over the canonical loan columns.

They need the sector attributes ``base_rate`` and ``volatility`` and the state
``tier``; ``operators.rules`` joins those in.
"""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column
from pyspark.sql import functions as F

from avalista.functions.segments import size_class

# Risk multipliers, score limits, loss rates, typical amounts and propensities.
NEW_BY_VOLATILITY = {"alta": 1.8, "media": 1.5, "baja": 1.3}
EXISTING_FACTOR = 0.85
EMPLOYEE_STEPS = [(3, 1.4), (10, 1.15), (50, 1.0), (250, 0.80)]
EMPLOYEE_LARGE = 0.60
PORTION_STEPS = [(0.70, 0.65), (0.50, 0.75)]
PORTION_ANY = 0.85
COLLATERAL_FACTOR = 0.75
AMOUNT_PER_EMPLOYEE = 80000.0
RATIO_STEPS = [(8, 1.35), (5, 1.20), (3, 1.10)]
RATIO_LOW = 0.90
TERM_STEPS = [(84, 1.25), (60, 1.15)]
TERM_SHORT = (18, 0.95)
TIER_FACTORS = {"high": 0.85, "medium": 1.0}
TIER_OTHER = 1.15
RURAL_FACTOR = 1.20
CRISIS_VOLATILE, CRISIS_OTHER = 1.7, 1.4
SCORE_LIMITS = (0.02, 0.40)
PD_LIMITS = (0.01, 0.50)
LOSS_BOTH, LOSS_GUARANTEE, LOSS_COLLATERAL, LOSS_NONE = 0.20, 0.25, 0.35, 0.75
MEAN_BALANCE = 0.60
DEFAULT_BASE_RATE, DEFAULT_VOLATILITY = 0.07, "media"
TYPICAL_AMOUNTS = {"Micro": 150000.0, "Pequeña": 800000.0, "Mediana": 3500000.0, "Grande": 15000000.0}
CAPITAL_SECTORS, CAPITAL_FACTOR = ["23", "53"], 1.3
GUARANTEE_BY_SECTOR = [(["31", "32", "33"], 0.50), (["11"], 0.45), (["54", "51"], 0.40), (["72", "71"], 0.20)]
GUARANTEE_OTHER = 0.35
GUARANTEE_BY_SIZE = {"Grande": 1.3, "Mediana": 1.15, "Micro": 0.85}
GUARANTEE_CAP = 0.70
COLLATERAL_BY_SIZE = {"Grande": 0.60, "Mediana": 0.45, "Pequeña": 0.30}
COLLATERAL_OTHER, COLLATERAL_CAP = 0.10, 0.75
COLLATERAL_BY_AMOUNT = [(2000000, 0.15), (1000000, 0.10)]
URBAN_BY_STATE = [
    (["CDMX", "NL", "JAL", "QRO", "AGS"], 0.90),
    (["MEX", "GTO", "PUE", "COAH", "CHIH", "BC", "SON", "TAM"], 0.75),
    (["OAX", "CHIS", "GRO", "HGO", "ZAC", "DGO"], 0.50),
]
URBAN_OTHER = 0.65
NEW_SHARE_BY_VOLATILITY = {"alta": 0.35, "media": 0.25}
NEW_SHARE_OTHER = 0.15
RATE_BASE, RATE_MICRO, RATE_SMALL, RATE_NEW, RATE_VOLATILE = 12.0, 4.0, 2.0, 3.0, 2.0
RATE_LIMITS = (8.0, 28.0)

c = F.col


def _clip(value, limits) -> Column:
    return F.least(F.greatest(value, F.lit(limits[0])), F.lit(limits[1]))


def _case(pairs, otherwise) -> Column:
    """First matching (condition, value) pair, else ``otherwise``."""
    out = F
    for condition, value in pairs:
        out = out.when(condition, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def risk_multipliers() -> list[Column]:
    """One factor per risk driver, in the order they are multiplied."""
    volatility = c("volatility")
    per_employee = c("GrAppv") / F.greatest(c("NoEmp") * F.lit(AMOUNT_PER_EMPLOYEE), F.lit(1.0))
    age = _case(
        [(c("NewExist") == 1, _case([(volatility == v, f) for v, f in list(NEW_BY_VOLATILITY.items())[:2]],
                                    NEW_BY_VOLATILITY["baja"]))],
        EXISTING_FACTOR,
    )
    return [
        age,
        _case([(c("NoEmp") <= limit, f) for limit, f in EMPLOYEE_STEPS], EMPLOYEE_LARGE),
        _case([(c("Portion") >= p, f) for p, f in PORTION_STEPS] + [(c("Portion") > 0, PORTION_ANY)], 1.0),
        _case([(c("RealEstate") == 1, COLLATERAL_FACTOR)], 1.0),
        _case([(per_employee > r, f) for r, f in RATIO_STEPS] + [(per_employee < 1, RATIO_LOW)], 1.0),
        _case([(c("Term") > t, f) for t, f in TERM_STEPS] + [(c("Term") < TERM_SHORT[0], TERM_SHORT[1])], 1.0),
        _case([(c("tier") == t, f) for t, f in TIER_FACTORS.items()], TIER_OTHER),
        _case([(c("UrbanRural") == 2, RURAL_FACTOR)], 1.0),
        _case([(c("Recession") == 1, _case([(volatility == "alta", CRISIS_VOLATILE)], CRISIS_OTHER))], 1.0),
    ]


def risk_score() -> Column:
    return _clip(c("base_rate") * reduce(mul, risk_multipliers()), SCORE_LIMITS)


def score_to_pd(score) -> Column:
    """Step map from score to default probability; monotone except at its own steps."""
    s = _clip(score, PD_LIMITS)
    return _case([(s > 0.25, 0.80), (s > 0.15, s * 2.5), (s > 0.08, s * 1.5), (s > 0.04, s)], 0.03)


def rule_lgd_rate() -> Column:
    guaranteed, collateral = c("Portion") > 0, c("RealEstate") == 1
    return _case(
        [(guaranteed & collateral, LOSS_BOTH), (guaranteed, LOSS_GUARANTEE), (collateral, LOSS_COLLATERAL)], LOSS_NONE
    )


def rule_loss_given_default() -> Column:
    return F.round(c("GrAppv") * rule_lgd_rate() * F.lit(MEAN_BALANCE), 2)


def reference_rate() -> Column:
    size = size_class("NoEmp")
    rate = (
        F.lit(RATE_BASE)
        + _case([(size == "Micro", RATE_MICRO), (size == "Pequeña", RATE_SMALL)], 0.0)
        + _case([(c("NewExist") == 1, RATE_NEW)], 0.0)
        + _case([(c("volatility") == "alta", RATE_VOLATILE)], 0.0)
    )
    return _clip(rate, RATE_LIMITS)


def guarantee_propensity() -> Column:
    by_sector = _case([(c("SCIAN").isin(codes), p) for codes, p in GUARANTEE_BY_SECTOR], GUARANTEE_OTHER)
    by_size = _case([(size_class("NoEmp") == s, f) for s, f in GUARANTEE_BY_SIZE.items()], 1.0)
    return F.least(by_sector * by_size, F.lit(GUARANTEE_CAP))


def guarantee_pct_mid() -> Column:
    by_amount = _case([(c("GrAppv") <= 500000, 0.75), (c("GrAppv") <= 2000000, 0.675)], 0.60)
    return _case([(c("Portion") > 0, by_amount)], 0.0)


def collateral_propensity() -> Column:
    by_size = _case([(size_class("NoEmp") == s, p) for s, p in COLLATERAL_BY_SIZE.items()], COLLATERAL_OTHER)
    by_amount = _case([(c("GrAppv") > a, p) for a, p in COLLATERAL_BY_AMOUNT], 0.0)
    return F.least(by_size + by_amount, F.lit(COLLATERAL_CAP))


def urban_propensity() -> Column:
    return _case([(c("State").isin(codes), p) for codes, p in URBAN_BY_STATE], URBAN_OTHER)


def new_business_propensity() -> Column:
    return _case([(c("volatility") == v, p) for v, p in NEW_SHARE_BY_VOLATILITY.items()], NEW_SHARE_OTHER)


def typical_amount() -> Column:
    """Null for a loan of unknown size."""
    size = size_class("NoEmp")
    by_size = _case([(size == s, a) for s, a in TYPICAL_AMOUNTS.items()], None)
    return by_size * _case([(c("SCIAN").isin(CAPITAL_SECTORS), CAPITAL_FACTOR)], 1.0)
