"""Pricing of whole application tables. Row-local: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avalista.functions import cleaning as clean
from avalista.functions import pricing as price
from avalista.functions import text
from avalista.operators.lookups import with_sector_name, with_state_name
from avalista.schema import require
from avalista.sources.dims import SECTOR_CODES, STATE_CODES, TERMS

c = F.col

# Limits of the application form.
AMOUNT_LIMITS, EMPLOYEE_LIMITS, RATE_LIMITS = (50000, 50000000), (1, 1000), (8.0, 35.0)


def parse_application_text(raw: DataFrame) -> DataFrame:
    """Typed application columns from free text; text that is no number becomes null."""
    typed = {
        "approved_amount": text.number, "term_months": text.whole_number, "num_employees": text.whole_number,
        "is_new_business": text.yes_no, "scian_code": text.sector_code, "state_code": text.state_code,
        "market_bank_rate": text.number, "has_real_estate": text.yes_no, "in_recession": text.yes_no,
    }
    return raw.withColumns({name: parse(c(name)) for name, parse in typed.items() if name in raw.columns})


def validate_applications(applications: DataFrame) -> DataFrame:
    """Check every field against the form's domain; the first failure is the reason."""
    checks = [
        ("amount", c("approved_amount").between(*AMOUNT_LIMITS)),
        ("term", c("term_months").isin(*TERMS)),
        ("employees", c("num_employees").between(*EMPLOYEE_LIMITS)),
        ("sector", c("scian_code").isin(*SECTOR_CODES)),
        ("state", c("state_code").isin(*STATE_CODES)),
        ("rate", c("market_bank_rate").between(*RATE_LIMITS)),
    ]
    reason = F.coalesce(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(n)) for n, ok in checks])
    return applications.withColumn("reject_reason", reason).withColumn("is_valid", c("reject_reason").isNull())


def application_features(applications: DataFrame) -> DataFrame:
    """The model's feature columns for an application; original columns stay."""
    amount, employees = c("approved_amount"), c("num_employees")
    guaranteed = price.program_guarantee(amount)
    flag = lambda name: F.coalesce(c(name).cast("int"), F.lit(0))
    return applications.withColumns({
        "GrAppv": amount,
        "NAFIN_Appv": guaranteed,
        "Term": c("term_months"),
        "NoEmp": employees,
        "IsNewBusiness": flag("is_new_business"),
        "NewExist": F.when(flag("is_new_business") == 1, F.lit(1.0)).otherwise(F.lit(2.0)),
        "SCIAN": F.substring(c("scian_code"), 1, 2),
        "State": F.upper("state_code"),
        "NAFIN_Portion": clean.nafin_portion(guaranteed, amount),
        "Loan_per_Employee": F.try_divide(amount, employees + 1),
        "Term_Years": clean.term_years(c("term_months")),
        "Debt_to_NAFIN": clean.debt_to_nafin(amount, guaranteed),
        "Log_GrAppv": clean.log_amount(amount),
        "HasRealEstate": flag("has_real_estate"),
        "InRecession": flag("in_recession"),
        "IsUrban": F.lit(1),
    })


# Fields of a quote.
QUOTE_FIELDS = [
    "approved_amount", "nafin_guaranteed", "pd", "expected_loss", "guarantee_fee",
    "total_financed", "monthly_payment", "term_months", "original_rate",
    "final_bank_rate", "scian_code", "state", "gps_category",
    "soform_guarantee_pct", "action",
]


def price_applications(scored: DataFrame, factor: float = 1.0, fee_mode: str = "flat", keep=()) -> DataFrame:
    """Quote rows from applications that carry ``pd`` and ``lgd``."""
    require(scored, ["approved_amount", "term_months", "market_bank_rate", "pd", "lgd"], "applications")
    amount, pd_ = c("approved_amount"), c("pd")
    step1 = scored.withColumns({
        "expected_loss": pd_ * c("lgd") * F.lit(float(factor)) * (c("segment_factor") if "segment_factor" in scored.columns else F.lit(1.0)),
        "original_rate": c("market_bank_rate"),
        "state": c("state_code"),
        "gps_category": price.gps_category(pd_),
        "soform_guarantee_pct": price.gps_guarantee_pct(pd_),
        "action": price.gps_action(pd_),
        "final_bank_rate": price.final_bank_rate(pd_, c("market_bank_rate")),
        "nafin_guaranteed": price.guaranteed_amount(pd_, amount),
    })
    step2 = step1.withColumn(
        "guarantee_fee", price.guarantee_fee(pd_, amount, c("expected_loss"), fee_mode)
    ).withColumn("total_financed", amount + c("guarantee_fee"))
    payment = price.monthly_payment(c("total_financed"), c("final_bank_rate"), c("term_months"))
    priced = step2.withColumn(
        "monthly_payment", F.when(price.is_rejected(pd_), F.lit(0.0)).otherwise(payment)
    )
    return priced.select(*keep, *QUOTE_FIELDS)


def quote(applications: DataFrame, model=None, factor: float = 1.0, fee_mode: str = "flat", keep=(), segment: str | None = None) -> DataFrame:
    """Price applications, scoring them first when a trained model is given; ``segment`` then names the calibration by segment to use."""
    if model is None:
        return price_applications(applications, factor, fee_mode, keep)
    scored = model.score(application_features(applications), segment)
    return price_applications(scored, model.factor, fee_mode, keep)


quick_quote = quote


def compare_schemes(quotes: DataFrame) -> DataFrame:
    """Payments and rate with and without the guarantee."""
    before = price.monthly_payment(c("approved_amount"), c("original_rate"), c("term_months"))
    return quotes.withColumn("traditional_payment", before).withColumns({
        "payment_difference": c("monthly_payment") - c("traditional_payment"),
        "monthly_saving": c("traditional_payment") - c("monthly_payment"),
        "total_saving": (c("traditional_payment") - c("monthly_payment")) * c("term_months"),
        "rate_reduction": c("original_rate") - c("final_bank_rate"),
    })


def el_margin_fee(quotes: DataFrame) -> DataFrame:
    fee = c("expected_loss") * price.EL_MARGIN
    return quotes.withColumns({
        "el_fee": fee, "el_fee_pct": F.try_divide(fee * 100, c("nafin_guaranteed"))
    })


def decision_by_pd(scored: DataFrame) -> DataFrame:
    return scored.withColumns({
        "expected_loss": c("pd") * c("lgd"), "decision": price.decision_by_pd(c("pd"))
    })


def quote_summary(quotes: DataFrame) -> DataFrame:
    """Roll-up per category, with the fee income over the expected loss."""
    one = quotes.groupBy("gps_category").agg(
        F.count("*").alias("n"),
        F.sum("approved_amount").alias("amount"),
        F.sum("nafin_guaranteed").alias("guaranteed"),
        F.sum("guarantee_fee").alias("fee"),
        F.sum("expected_loss").alias("expected_loss"),
        F.avg(c("original_rate") - c("final_bank_rate")).alias("mean_rate_reduction"),
    )
    return one.withColumns({
        "fee_minus_el": c("fee") - c("expected_loss"),
        "fee_over_el": F.try_divide(c("fee"), c("expected_loss")),
    })


def quote_json(quotes: DataFrame, keep=()) -> DataFrame:
    """One JSON record of formatted, labelled fields per quote."""
    named = with_sector_name(quotes, "scian_code", "No especificado", None, "_sector")
    named = with_state_name(named, "state", "code", None, "_state")
    mxn = lambda x: F.concat(text.money_label(x, 2), F.lit(" MXN"))
    pct = lambda x: F.concat(text.plain_label(x, 2), F.lit("%"))
    rejected = price.is_rejected(c("pd"))
    fields = {
        "Monto Aprobado": mxn(c("approved_amount")),
        "Plazo": F.concat(c("term_months").cast("string"), F.lit(" meses")),
        "Probabilidad de Default (PD)": text.percent_label(c("pd"), 4),
        "Pérdida Esperada (EL)": mxn(c("expected_loss")),
        "Categoría GPS": c("gps_category"),
        "Garantía GPS (%)": text.percent_label(c("soform_guarantee_pct"), 0),
        "Garantía GPS (Monto)": mxn(c("nafin_guaranteed")),
        "Comisión GPS": mxn(c("guarantee_fee")),
        "Tasa Original": pct(c("original_rate")),
        "Tasa Ajustada": pct(c("final_bank_rate")),
        "Reducción de Tasa": F.concat(
            text.plain_label(c("original_rate") - c("final_bank_rate"), 2), F.lit(" puntos porcentuales")
        ),
        "Pago Mensual": F.when(rejected, F.lit("N/A")).otherwise(mxn(c("monthly_payment"))),
        "Sector": F.concat(c("scian_code"), F.lit(" - "), c("_sector")),
        "Estado": F.concat(c("state"), F.lit(" - "), c("_state")),
    }
    return named.select(*keep, F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("quote"))


def risk_table_labels(summary: DataFrame) -> DataFrame:
    """Text columns of the risk class table."""
    return summary.withColumns({
        "mean_el_label": text.money_label(c("mean_el")), "default_rate_label": text.percent_label(c("default_rate"))
    })
