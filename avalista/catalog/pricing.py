"""Quotes and their roll-ups."""

from pyspark.sql import functions as F

from avalista.catalog.loan_view import applications, scored
from avalista.catalog.registry import query, rounded
from avalista.catalog.sources import scratch
from avalista.functions import pricing as price
from avalista.operators import quotes as q
from avalista.streaming.quotes import quote_stream, read_application_stream, write_quote_stream

c = F.col

PCT_SQL = "CASE WHEN pd < 0.01e0 THEN 0.85e0 WHEN pd < 0.03e0 THEN 0.7e0 ELSE 0e0 END"
CATEGORY_SQL = "CASE WHEN pd < 0.01e0 THEN 'Ultra–Oro' WHEN pd < 0.03e0 THEN 'Oro' ELSE 'Rechazo (Riesgo Alto)' END"
ACTION_SQL = "CASE WHEN pd < 0.01e0 THEN 'Aprobación Rápida con Beneficio' WHEN pd < 0.03e0 THEN 'Aprobación con Condiciones Preferenciales' ELSE 'Rechazo por Política de Riesgo' END"


def _payment_sql(principal, rate, months):
    m = f"({rate} / 100e0 / 12e0)"
    return f"(CASE WHEN {rate} = 0 THEN {principal} / {months} ELSE {principal} * ({m} * pow(1e0 + {m}, {months})) / (pow(1e0 + {m}, {months}) - 1e0) END)"


QUOTE_SQL = f"""q1 AS (
  SELECT *, pd * lgd AS expected_loss, {PCT_SQL} AS pct, {CATEGORY_SQL} AS gps_category, {ACTION_SQL} AS action,
    greatest(market_bank_rate - 7.6103e0, 2e0) AS spread FROM applications
), q2 AS (
  SELECT *, CASE WHEN pd >= 0.03e0 THEN 0e0 ELSE greatest(7.6103e0 + spread * 0.35e0 + spread * 0.65e0 * (1e0 - pct), 9.1103e0) END AS final_bank_rate,
    approved_amount * pct AS nafin_guaranteed, approved_amount * pct * 0.05e0 AS guarantee_fee FROM q1
), q3 AS (SELECT *, approved_amount + guarantee_fee AS total_financed FROM q2
), quotes AS (
  SELECT *, CASE WHEN pd >= 0.03e0 THEN 0e0 ELSE {_payment_sql("total_financed", "final_bank_rate", "term_months")} END AS monthly_payment,
    {_payment_sql("approved_amount", "market_bank_rate", "term_months")} AS traditional_payment FROM q3
)"""


def _quotes(spark, sf, **options):
    return q.quote(applications(spark, sf), keep=["application_id"], **options)


@query("program_guarantee", "SELECT application_id, CASE WHEN approved_amount <= 2000000 THEN approved_amount * 0.8e0 ELSE approved_amount * 0.7e0 END AS program_guarantee FROM applications")
def _(spark, sf):
    return applications(spark, sf).select("application_id", price.program_guarantee(c("approved_amount")).alias("program_guarantee"))


@query("application_features", """SELECT application_id, approved_amount AS GrAppv, g AS NAFIN_Appv, term_months AS Term, num_employees AS NoEmp, is_new_business::INTEGER AS IsNewBusiness,
  CASE WHEN is_new_business THEN 1e0 ELSE 2e0 END AS NewExist, substring(scian_code, 1, 2) AS SCIAN, upper(state_code) AS State,
  CASE WHEN approved_amount > 0 THEN g / approved_amount ELSE 0e0 END AS NAFIN_Portion, approved_amount / (num_employees + 1) AS Loan_per_Employee, term_months / 12e0 AS Term_Years,
  approved_amount - g AS Debt_to_NAFIN, round(ln(1e0 + approved_amount), 8) AS Log_GrAppv, has_real_estate::INTEGER AS HasRealEstate, in_recession::INTEGER AS InRecession, 1 AS IsUrban
  FROM (SELECT *, CASE WHEN approved_amount <= 2000000 THEN approved_amount * 0.8e0 ELSE approved_amount * 0.7e0 END AS g FROM applications)""")
def _(spark, sf):
    source = applications(spark, sf, customer=True)
    out = q.application_features(source).drop(*[x for x in source.columns if x != "application_id"])
    return rounded(out, Log_GrAppv=8)


@query("gps_category", f"SELECT application_id, pd, {CATEGORY_SQL} AS gps_category, {PCT_SQL} AS pct, {ACTION_SQL} AS action, CASE WHEN pd < 0.01e0 THEN approved_amount * 0.8e0 WHEN pd < 0.03e0 THEN approved_amount * 0.75e0 ELSE 0e0 END AS max_guarantee_limit FROM applications")
def _(spark, sf):
    p = c("pd")
    return applications(spark, sf).select(
        "application_id", "pd", price.gps_category(p).alias("gps_category"), price.gps_guarantee_pct(p).alias("pct"),
        price.gps_action(p).alias("action"), price.gps_limit(p, c("approved_amount")).alias("max_guarantee_limit"),
    )


@query("final_bank_rate", f", {QUOTE_SQL} SELECT application_id, round(final_bank_rate, 8) AS final_bank_rate FROM quotes")
def _(spark, sf):
    out = applications(spark, sf).select("application_id", price.final_bank_rate(c("pd"), c("market_bank_rate")).alias("final_bank_rate"))
    return rounded(out, final_bank_rate=8)


@query("guarantee_amounts", f", {QUOTE_SQL} SELECT application_id, round(nafin_guaranteed, 4) AS nafin_guaranteed, round(guarantee_fee, 4) AS guarantee_fee, round(total_financed, 4) AS total_financed FROM quotes")
def _(spark, sf):
    out = _quotes(spark, sf).select("application_id", "nafin_guaranteed", "guarantee_fee", "total_financed")
    return rounded(out, nafin_guaranteed=4, guarantee_fee=4, total_financed=4)


@query("monthly_payment", f", {QUOTE_SQL} SELECT application_id, round(traditional_payment, 4) AS monthly_payment FROM quotes")
def _(spark, sf):
    payment = price.monthly_payment(c("approved_amount"), c("market_bank_rate"), c("term_months"))
    return rounded(applications(spark, sf).select("application_id", payment.alias("monthly_payment")), monthly_payment=4)


@query("quote", f""", {QUOTE_SQL} SELECT application_id, approved_amount, round(nafin_guaranteed, 4) AS nafin_guaranteed, pd, expected_loss, round(guarantee_fee, 4) AS guarantee_fee,
  round(total_financed, 4) AS total_financed, round(monthly_payment, 4) AS monthly_payment, term_months, market_bank_rate AS original_rate, round(final_bank_rate, 8) AS final_bank_rate,
  scian_code, state_code AS state, gps_category, pct AS soform_guarantee_pct, action FROM quotes""")
def quote_applications(spark, sf):
    return rounded(_quotes(spark, sf), nafin_guaranteed=4, guarantee_fee=4, total_financed=4, monthly_payment=4, final_bank_rate=8)


@query("quote_el_margin_mode", f", {QUOTE_SQL} SELECT application_id, gps_category, CASE WHEN pd >= 0.03e0 THEN 0e0 ELSE expected_loss * 1.2e0 END AS guarantee_fee FROM quotes")
def _(spark, sf):
    return _quotes(spark, sf, fee_mode="el_margin").select("application_id", "gps_category", "guarantee_fee")


@query("compare_schemes", f""", {QUOTE_SQL} SELECT application_id, round(traditional_payment, 4) AS traditional_payment, round(monthly_payment - traditional_payment, 4) AS payment_difference,
  round(traditional_payment - monthly_payment, 4) AS monthly_saving, round((traditional_payment - monthly_payment) * term_months, 2) AS total_saving, round(market_bank_rate - final_bank_rate, 8) AS rate_reduction FROM quotes""")
def _(spark, sf):
    out = q.compare_schemes(_quotes(spark, sf)).select("application_id", "traditional_payment", "payment_difference", "monthly_saving", "total_saving", "rate_reduction")
    return rounded(out, traditional_payment=4, payment_difference=4, monthly_saving=4, total_saving=2, rate_reduction=8)


@query("el_margin_fee", f", {QUOTE_SQL} SELECT application_id, expected_loss * 1.2e0 AS el_fee, CASE WHEN nafin_guaranteed <> 0 THEN expected_loss * 1.2e0 * 100 / nafin_guaranteed END AS el_fee_pct FROM quotes")
def _(spark, sf):
    return q.el_margin_fee(_quotes(spark, sf)).select("application_id", "el_fee", "el_fee_pct")


@query("decision_by_pd", "SELECT LoanNr, pd * lgd AS expected_loss, CASE WHEN pd < 0.05e0 THEN 'APROBAR - Riesgo bajo' WHEN pd < 0.15e0 THEN 'REVISAR - Riesgo moderado' ELSE 'RECHAZAR - Riesgo alto' END AS decision FROM (SELECT * REPLACE (pd * 2e0 AS pd) FROM scored)")
def _(spark, sf):
    doubled = scored(spark, sf).withColumn("pd", c("pd") * 2)
    return q.decision_by_pd(doubled).select("LoanNr", "expected_loss", "decision")


@query("quote_summary", f""", {QUOTE_SQL} SELECT gps_category, count(*) AS n, round(sum(approved_amount), 2) AS amount, round(sum(nafin_guaranteed), 2) AS guaranteed, round(sum(guarantee_fee), 2) AS fee,
  round(sum(expected_loss), 1) AS expected_loss, round(avg(market_bank_rate - final_bank_rate), 8) AS mean_rate_reduction, round(sum(guarantee_fee) - sum(expected_loss), 1) AS fee_minus_el,
  round(sum(guarantee_fee) / sum(expected_loss), 8) AS fee_over_el FROM quotes GROUP BY 1""")
def quote_summary(spark, sf):
    return rounded(q.quote_summary(_quotes(spark, sf)), amount=2, guaranteed=2, fee=2, expected_loss=1, mean_rate_reduction=8, fee_minus_el=1, fee_over_el=8)


@query("quote_json", f""", {QUOTE_SQL} SELECT application_id, json_object(
  'Monto Aprobado', format('${{:,.2f}} MXN', approved_amount), 'Plazo', term_months || ' meses',
  'Probabilidad de Default (PD)', format('{{:.4f}}%', pd * 100), 'Pérdida Esperada (EL)', format('${{:,.2f}} MXN', expected_loss),
  'Categoría GPS', gps_category, 'Garantía GPS (%)', format('{{:.0f}}%', pct * 100),
  'Garantía GPS (Monto)', format('${{:,.2f}} MXN', nafin_guaranteed), 'Comisión GPS', format('${{:,.2f}} MXN', guarantee_fee),
  'Tasa Original', format('{{:.2f}}%', market_bank_rate), 'Tasa Ajustada', format('{{:.2f}}%', final_bank_rate),
  'Reducción de Tasa', format('{{:.2f}} puntos porcentuales', market_bank_rate - final_bank_rate),
  'Pago Mensual', CASE WHEN pd >= 0.03e0 THEN 'N/A' ELSE format('${{:,.2f}} MXN', monthly_payment) END,
  'Sector', scian_code || ' - ' || coalesce(sector_name, 'No especificado'), 'Estado', state_code || ' - ' || coalesce(state_name, state_code))::VARCHAR AS quote
  FROM quotes LEFT JOIN sectors ON scian_code = sector_code LEFT JOIN states USING (state_code)""")
def _(spark, sf):
    return q.quote_json(_quotes(spark, sf), keep=["application_id"])


@query("quote_stream", f""", {QUOTE_SQL} SELECT application_id, gps_category, round(guarantee_fee, 4) AS guarantee_fee, round(monthly_payment, 4) AS monthly_payment, round(final_bank_rate, 8) AS final_bank_rate FROM quotes""")
def _(spark, sf):
    """The whole application table as a file stream, priced and written, then read back."""
    source, sink, state = scratch(spark, "applications"), scratch(spark, "quotes"), scratch(spark, "state")
    table = applications(spark, sf)
    table.write.parquet(source)
    stream = read_application_stream(spark, source, schema=table.schema)
    run = write_quote_stream(quote_stream(stream, keep=["application_id"]), sink, state)
    run.awaitTermination()
    out = spark.read.parquet(sink).select("application_id", "gps_category", "guarantee_fee", "monthly_payment", "final_bank_rate")
    return rounded(out, guarantee_fee=4, monthly_payment=4, final_bank_rate=8)
