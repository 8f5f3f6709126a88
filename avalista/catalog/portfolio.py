"""Portfolio aggregates, distributions and top lists."""

from pyspark.sql import functions as F

from avalista.catalog.features import AMOUNT_ORD_SQL, AMOUNT_SQL, PORTION_SQL, SIZE_SQL, TERM_ORD_SQL, TERM_SQL
from avalista.catalog.loan_view import dirty, loans, scored
from avalista.catalog.registry import query, rounded
from avalista.functions import segments as seg
from avalista.operators import portfolio as p
from avalista.sources.dims import BANKS, MICRO_EMPLOYEE_SHARES, SIZE_SHARES, TERM_SHARES, target_shares

c = F.col
RATE = 'round(avg("Default") * 100, 6) AS default_rate'
SIZE_LONG_SQL = "CASE WHEN NoEmp <= 0 THEN NULL WHEN NoEmp <= 10 THEN 'Micro (≤10)' WHEN NoEmp <= 50 THEN 'Pequeña (11-50)' WHEN NoEmp <= 250 THEN 'Mediana (51-250)' WHEN NoEmp <= 1000 THEN 'Grande (>250)' END"


@query("portfolio_summary", """SELECT count(*) AS n_loans, round(avg("Default"), 8) AS default_rate, round(sum(GrAppv), 2) AS total_amount, round(avg(GrAppv), 4) AS mean_amount,
  round(sum(ChgOffPrinGr), 2) AS total_loss, round(avg(ChgOffPrinGr) FILTER (WHERE ChgOffPrinGr > 0), 4) AS mean_loss_when_lost,
  count(*) FILTER (WHERE Portion > 0) AS n_guaranteed, round(avg((Portion > 0)::INTEGER), 8) AS share_guaranteed,
  count(*) FILTER (WHERE RealEstate = 1) AS n_collateral, round(avg((RealEstate = 1)::INTEGER), 8) AS share_collateral FROM loans""")
def _(spark, sf):
    return rounded(p.portfolio_summary(loans(spark, sf)), default_rate=8, total_amount=2, mean_amount=4, total_loss=2, mean_loss_when_lost=4, share_guaranteed=8, share_collateral=8)


@query("default_rate_by_bank", """SELECT Bank AS segment, count(*) AS n, round(avg("Default"), 8) AS default_rate, round((SELECT avg("Default") FROM loans), 8) AS overall_rate FROM loans GROUP BY Bank""")
def _(spark, sf):
    return rounded(p.default_rate_by(loans(spark, sf), "Bank", overall=True), default_rate=8, overall_rate=8)


@query("default_rate_by_amount_bucket", f"SELECT {AMOUNT_SQL} AS bucket, {AMOUNT_ORD_SQL} AS bucket_ord, count(*) AS n, {RATE} FROM loans WHERE GrAppv > 0 GROUP BY 1, 2")
def default_rate_by_amount_bucket(spark, sf):
    return rounded(p.by_amount_bucket(loans(spark, sf)), default_rate=6)


@query("default_rate_by_term_bucket", f"SELECT {TERM_SQL} AS bucket, {TERM_ORD_SQL} AS bucket_ord, count(*) AS n, {RATE} FROM loans GROUP BY 1, 2")
def _(spark, sf):
    return rounded(p.by_term_bucket(loans(spark, sf)), default_rate=6)


@query("default_rate_by_business_age", f"SELECT CASE WHEN NewExist = 1 THEN 'Nuevo' ELSE 'Existente' END AS business, count(*) AS n, {RATE} FROM loans GROUP BY 1")
def _(spark, sf):
    view = loans(spark, sf, customer=True).withColumn("IsNewBusiness", (c("NewExist") == 1).cast("int"))
    return rounded(p.by_business_age(view), default_rate=6)


@query("default_rate_by_year", f'SELECT ApprovalFY AS year, count(*) AS n, {RATE}, round((SELECT avg("Default") * 100 FROM loans), 6) AS overall_rate FROM loans GROUP BY 1')
def _(spark, sf):
    return rounded(p.by_approval_year(loans(spark, sf)), default_rate=6, overall_rate=6)


@query("default_rate_by_sector", 'SELECT SCIAN, count(*) AS n, round(avg("Default"), 8) AS default_rate FROM loans GROUP BY 1')
def _(spark, sf):
    return rounded(p.by_sector(loans(spark, sf)), default_rate=8)


@query("sort_by_rate", 'SELECT SCIAN, round(avg("Default"), 8) AS default_rate, row_number() OVER (ORDER BY avg("Default"), SCIAN)::INTEGER AS place FROM loans GROUP BY 1')
def _(spark, sf):
    from pyspark.sql import Window

    rates = p.by_sector(loans(spark, sf))  # one row per sector
    placed = rates.withColumn("place", F.row_number().over(Window.orderBy("default_rate", "SCIAN")))
    return rounded(placed.select("SCIAN", "default_rate", "place"), default_rate=8)


@query("sector_amounts", 'SELECT SCIAN, count(*) AS n, round(avg("Default"), 8) AS default_rate, round(sum(GrAppv), 2) AS total_amount FROM loans GROUP BY 1')
def _(spark, sf):
    return rounded(p.by_sector_amount(loans(spark, sf)), default_rate=8, total_amount=2)


@query("sector_min_support", f"SELECT SCIAN, count(*) AS n, {RATE} FROM loans GROUP BY 1 HAVING count(*) >= 100")
def _(spark, sf):
    return rounded(p.by_sector_with_support(loans(spark, sf)), default_rate=6)


@query("state_min_support", f"SELECT State, count(*) AS n, {RATE}, round(avg(GrAppv), 4) AS mean_amount FROM loans GROUP BY 1 HAVING count(*) >= 50")
def _(spark, sf):
    return rounded(p.by_state_with_support(loans(spark, sf)), default_rate=6, mean_amount=4)


@query("default_rate_by_size_class", f"""SELECT label AS size_class, i::INTEGER AS size_class_ord, coalesce(n, 0) AS n, default_rate FROM
  (SELECT unnest(['Micro (≤10)','Pequeña (11-50)','Mediana (51-250)','Grande (>250)']) AS label, unnest([1,2,3,4]) AS i)
  LEFT JOIN (SELECT {SIZE_LONG_SQL} AS label, count(*) AS n, {RATE} FROM loans GROUP BY 1) USING (label)""")
def _(spark, sf):
    return rounded(p.by_size_class(loans(spark, sf)), default_rate=6)


@query("default_rate_by_portion_band", f"""SELECT label AS portion_band, i::INTEGER AS portion_band_ord, coalesce(n, 0) AS n, default_rate FROM
  (SELECT unnest(['Con NAFIN (≥70%)','Con NAFIN (50-70%)','Con NAFIN (<50%)','Sin NAFIN']) AS label, unnest([1,2,3,4]) AS i)
  LEFT JOIN (SELECT {PORTION_SQL} AS label, count(*) AS n, {RATE} FROM loans GROUP BY 1) USING (label)""")
def _(spark, sf):
    return rounded(p.by_portion_band(loans(spark, sf)), default_rate=6)


@query("default_rate_by_collateral", f"SELECT RealEstate, count(*) AS n, {RATE} FROM loans GROUP BY 1")
def _(spark, sf):
    return rounded(p.by_collateral(loans(spark, sf)), default_rate=6)


@query("default_rate_by_crisis", f"SELECT Recession, count(*) AS n, {RATE} FROM loans GROUP BY 1")
def _(spark, sf):
    return rounded(p.by_crisis(loans(spark, sf)), default_rate=6)


_SEGMENT_SQL = {
    "amount": AMOUNT_SQL, "term": TERM_SQL, "size": SIZE_SQL, "portion": PORTION_SQL, "sector": "SCIAN", "state": "State",
    "business": "CASE WHEN NewExist = 1 THEN 'Nuevo' ELSE 'Existente' END", "collateral": "RealEstate::VARCHAR",
    "crisis": "Recession::VARCHAR", "year": "ApprovalFY::VARCHAR",
}


@query("multi_segment_rates", " UNION ALL ".join(
    f"""SELECT '{n}' AS dimension, {x} AS segment, count(*) AS n, round(avg("Default"), 8) AS default_rate, round(sum(ChgOffPrinGr), 2) AS total_loss FROM loans WHERE ({x}) IS NOT NULL GROUP BY 2"""
    for n, x in _SEGMENT_SQL.items()))
def _(spark, sf):
    return rounded(p.multi_segment_rates(loans(spark, sf, customer=True)), default_rate=8, total_loss=2)


@query("value_counts", "SELECT State, count(*) AS n, round(count(*) / (SELECT count(State) FROM dirty), 8) AS share FROM dirty WHERE State IS NOT NULL GROUP BY State")
def _(spark, sf):
    return rounded(p.value_counts(dirty(spark, sf), "State"), share=8)


@query("score_quantiles", "SELECT " + ", ".join(f"round(quantile_cont(InterestRate, {q}), 6) AS {n}" for n, q in [("min", 0), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("max", 1)]) + " FROM loans")
def _(spark, sf):
    return rounded(p.score_quantiles(loans(spark, sf), "InterestRate"), min=6, p25=6, median=6, p75=6, max=6)


def _histogram_sql(value, source, bins, where="TRUE", extra=""):
    return f"""(WITH d AS (SELECT ({value})::DOUBLE AS x FROM {source} WHERE {where}), lim AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS m FROM d WHERE x IS NOT NULL),
      b AS (SELECT least(floor((x - lo) / ((hi - lo) / {bins}))::BIGINT, {bins - 1}) AS bin, count(*) AS n FROM d, lim WHERE x IS NOT NULL GROUP BY 1)
    SELECT g.bin, round(lo + g.bin * ((hi - lo) / {bins}), 6) + 0e0 AS bin_lo, round(lo + (g.bin + 1) * ((hi - lo) / {bins}), 6) + 0e0 AS bin_hi, coalesce(n, 0) AS n, round(m, 6) AS mean{extra}
    FROM (SELECT unnest(generate_series(0, {bins - 1})) AS bin) g LEFT JOIN b USING (bin), lim)"""


@query("histogram_amount", f"SELECT * FROM {_histogram_sql('GrAppv', 'loans', 50)}")
def _(spark, sf):
    return rounded(p.histogram(loans(spark, sf), "GrAppv", 50), bin_lo=6, bin_hi=6, mean=6)


@query("histogram_pd", f"SELECT * FROM {_histogram_sql('pd', 'scored', 50)}")
def _(spark, sf):
    return rounded(p.histogram(scored(spark, sf), "pd", 50), bin_lo=6, bin_hi=6, mean=6)


@query("histogram_loss", "SELECT * FROM " + _histogram_sql('ChgOffPrinGr', 'loans', 50, '"Default" = 1'))
def _(spark, sf):
    return rounded(p.histogram(loans(spark, sf).filter(c("Default") == 1), "ChgOffPrinGr", 50), bin_lo=6, bin_hi=6, mean=6)


@query("histogram_el", f"SELECT * FROM {_histogram_sql('el', 'scored', 50)}")
def _(spark, sf):
    return rounded(p.histogram(scored(spark, sf), "el", 50), bin_lo=6, bin_hi=6, mean=6)


@query("box_stats", f"""SELECT segment, count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3,
    min(GrAppv) FILTER (WHERE inside) AS whisker_lo, max(GrAppv) FILTER (WHERE inside) AS whisker_hi, count(*) FILTER (WHERE NOT inside) AS n_outliers
  FROM (SELECT *, GrAppv >= q1 - 1.5e0 * (q3 - q1) AND GrAppv <= q3 + 1.5e0 * (q3 - q1) AS inside FROM (SELECT {SIZE_SQL} AS segment, GrAppv FROM loans)
    JOIN (SELECT {SIZE_SQL} AS segment, quantile_cont(GrAppv, 0.25) AS q1, quantile_cont(GrAppv, 0.5) AS q2, quantile_cont(GrAppv, 0.75) AS q3 FROM loans GROUP BY 1) USING (segment)) GROUP BY segment""")
def _(spark, sf):
    return rounded(p.box_stats(loans(spark, sf), "GrAppv", seg.size_class()), q1=6, median=6, q3=6)


@query("loss_by_amount_bucket", f"SELECT {AMOUNT_SQL} AS bucket, {AMOUNT_ORD_SQL} AS bucket_ord, round(sum(el), 2) AS predicted_el, round(sum(ChgOffPrinGr), 2) AS actual_loss FROM scored WHERE GrAppv > 0 GROUP BY 1, 2")
def _(spark, sf):
    return rounded(p.loss_by_amount_bucket(scored(spark, sf)), predicted_el=2, actual_loss=2)


def _mix_sql(key, target, source="loans", where="TRUE"):
    return f"""WITH a AS (SELECT {key} AS key, count(*) AS n FROM {source} WHERE ({key}) IS NOT NULL AND {where} GROUP BY 1), t AS (SELECT * FROM {target}),
      m AS (SELECT key, coalesce(n, 0) AS n, coalesce(n / (SELECT sum(n) FROM a), 0e0) AS share, coalesce(w / (SELECT sum(w) FROM t), 0e0) AS target_share FROM a FULL JOIN t USING (key))
    SELECT key, n, round(share, 8) AS share, round(target_share, 8) AS target_share, round(share - target_share, 8) + 0e0 AS difference,
      round(CASE WHEN share > 0 THEN target_share / share END, 8) AS weight FROM m"""


def _mix(out):
    return rounded(out, share=8, target_share=8, difference=8, weight=8)


def _rows(rows):
    body = ", ".join(f"({k!r}, {w!r}e0)" for k, w in rows)
    return f"(VALUES {body}) AS v(key, w)"


@query("mix_vs_target_state", f"SELECT * FROM ({_mix_sql('State', '(SELECT state_code AS key, state_share AS w FROM states)')})")
def _(spark, sf):
    return _mix(p.mix_vs_target(loans(spark, sf), "State", target_shares(spark, "state")))


@query("mix_vs_target_sector", f"SELECT * FROM ({_mix_sql('SCIAN', '(SELECT sector_code AS key, sector_share AS w FROM sectors WHERE sector_share IS NOT NULL)')})")
def _(spark, sf):
    return _mix(p.mix_vs_target(loans(spark, sf), "SCIAN", target_shares(spark, "sector")))


@query("mix_vs_target_bank", f"SELECT * FROM ({_mix_sql('Bank', _rows(BANKS))})")
def _(spark, sf):
    return _mix(p.mix_vs_target(loans(spark, sf), "Bank", target_shares(spark, "bank")))


@query("mix_vs_target_size", f"SELECT * FROM ({_mix_sql(SIZE_SQL, _rows(SIZE_SHARES))})")
def _(spark, sf):
    return _mix(p.mix_vs_target(loans(spark, sf), seg.size_class(), target_shares(spark, "size")))


@query("mix_vs_target_micro_employees", f"SELECT key::BIGINT AS key, * EXCLUDE (key) FROM ({_mix_sql('NoEmp', _rows(MICRO_EMPLOYEE_SHARES), where='NoEmp <= 10')})")
def _(spark, sf):
    micro = loans(spark, sf).filter(c("NoEmp") <= 10)
    return _mix(p.mix_vs_target(micro, c("NoEmp").cast("long"), target_shares(spark, "micro_employees")))


@query("mix_vs_target_term", f"""SELECT amount_band, key::BIGINT AS key, n, round(share, 8) AS share, round(target_share, 8) AS target_share,
    round(share - target_share, 8) + 0e0 AS difference, round(CASE WHEN share > 0 THEN target_share / share END, 8) AS weight FROM (
  SELECT amount_band, key, coalesce(n, 0) AS n, coalesce(share, 0e0) AS share, coalesce(target_share, 0e0) AS target_share FROM
  (SELECT amount_band, Term AS key, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY amount_band) AS share
   FROM (SELECT *, CASE WHEN GrAppv < 200000 THEN '<200K' WHEN GrAppv < 500000 THEN '200K-500K' WHEN GrAppv < 2000000 THEN '500K-2M' ELSE '>=2M' END AS amount_band FROM loans) GROUP BY 1, 2)
  FULL JOIN (SELECT amount_band, key, w / sum(w) OVER (PARTITION BY amount_band) AS target_share FROM (VALUES {", ".join(f"('{b}', {t}, {w}e0)" for b, t, w in TERM_SHARES)}) AS v(amount_band, key, w)) USING (amount_band, key))""")
def _(spark, sf):
    view = loans(spark, sf).withColumn("amount_band", seg.term_band_for_amount())
    return _mix(p.mix_vs_target(view, c("Term").cast("long"), target_shares(spark, "term"), within="amount_band"))


@query("top_risk_sectors", f"SELECT SCIAN, n, default_rate, substring(coalesce(sector_name, SCIAN), 1, 20) AS sector FROM (SELECT SCIAN, count(*) AS n, {RATE} FROM loans GROUP BY 1 HAVING count(*) >= 100 ORDER BY avg(\"Default\") DESC, SCIAN LIMIT 8) LEFT JOIN sectors ON SCIAN = sector_code")
def _(spark, sf):
    return rounded(p.top_risk_sectors(loans(spark, sf)), default_rate=6)


@query("top5_sectors", f"SELECT SCIAN, n, default_rate, total_amount, substring(coalesce(sector_name, 'Desconocido'), 1, 30) AS sector FROM (SELECT SCIAN, count(*) AS n, {RATE}, round(sum(GrAppv), 2) AS total_amount FROM loans GROUP BY 1 ORDER BY avg(\"Default\") DESC, SCIAN LIMIT 5) LEFT JOIN sectors ON SCIAN = sector_code")
def _(spark, sf):
    return rounded(p.top5_sectors(loans(spark, sf)), default_rate=6, total_amount=2)


@query("top_states", f"SELECT State, n, default_rate, mean_amount, substring(coalesce(state_name, State), 1, 15) AS state_label FROM (SELECT State, count(*) AS n, {RATE}, round(avg(GrAppv), 4) AS mean_amount FROM loans GROUP BY 1 HAVING count(*) >= 50 ORDER BY count(*) DESC, State LIMIT 15) LEFT JOIN states ON State = state_code")
def _(spark, sf):
    return rounded(p.top_states(loans(spark, sf)), default_rate=6, mean_amount=4)


@query("rank_sectors", """SELECT SCIAN, count(*) AS n, round(avg("Default"), 8) AS default_rate, row_number() OVER (ORDER BY avg("Default") DESC, SCIAN)::INTEGER AS position, dense_rank() OVER (ORDER BY avg("Default") DESC)::INTEGER AS rate_rank FROM loans GROUP BY 1""")
def _(spark, sf):
    return rounded(p.rank_sectors(loans(spark, sf)), default_rate=8)
