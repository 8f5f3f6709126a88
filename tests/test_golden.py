"""Hand-computed rows: quotes, payments, scores, bucket edges, small curves."""

import pytest
from pyspark.sql import functions as F

from avalista.functions import pricing as price
from avalista.functions import segments as seg
from avalista.functions import text
from avalista.operators import calibration, curves, metrics, quotes, rules

c = F.col

QUOTES = [
    (0.005, 500000.0, 36, 18.5, "Ultra–Oro", 425000.0, 21250.0, 521250.0, 12.483441, 17433.5626, 18201.8572),
    (0.0099, 500000.0, 36, 8.0, "Ultra–Oro", 425000.0, 21250.0, 521250.0, 9.1103, 16602.3820, 15668.1827),
    (0.01, 500000.0, 36, 18.5, "Oro", 350000.0, 17500.0, 517500.0, 13.545186, 17572.8237, 18201.8572),
    (0.02, 500000.0, 48, 14.5, "Oro", 350000.0, 17500.0, 517500.0, 11.365187, 13467.0196, 13788.9764),
    (0.0299, 2500000.0, 120, 35.0, "Oro", 1750000.0, 87500.0, 2587500.0, 22.537686, 54433.2616, 75307.5201),
    (0.03, 500000.0, 36, 18.5, "Rechazo (Riesgo Alto)", 0.0, 0.0, 500000.0, 0.0, 0.0, 18201.8572),
]


def test_quotes(spark):
    rows = [(i, q[0], 1000.0, q[1], q[2], q[3], "46", "JAL") for i, q in enumerate(QUOTES)]
    table = spark.createDataFrame(
        rows, "id int, pd double, lgd double, approved_amount double, term_months int, market_bank_rate double, scian_code string, state_code string"
    )
    got = quotes.compare_schemes(quotes.quote(table, keep=["id"])).orderBy("id").collect()
    for row, q in zip(got, QUOTES):
        assert row.gps_category == q[4]
        assert row.nafin_guaranteed == pytest.approx(q[5])
        assert row.guarantee_fee == pytest.approx(q[6])
        assert row.total_financed == pytest.approx(q[7])
        assert row.final_bank_rate == pytest.approx(q[8], abs=1e-6)
        assert row.monthly_payment == pytest.approx(q[9], abs=1e-4)
        assert row.traditional_payment == pytest.approx(q[10], abs=1e-4)
        assert row.rate_reduction == pytest.approx(q[3] - q[8], abs=1e-6)


def test_payments(spark):
    table = spark.createDataFrame(
        [(120000.0, 0.0, 12), (100000.0, 12.0, 12), (100000.0, 12.0, 0), (100000.0, 0.0, 0)], "p double, r double, n int"
    )
    got = [r[0] for r in table.select(price.monthly_payment(c("p"), c("r"), c("n"))).collect()]
    assert got[0] == 10000
    assert got[1] == pytest.approx(8884.8788678)
    assert got[2] is None and got[3] is None


def test_fee_modes(spark):
    row = spark.range(1).select(
        price.guarantee_fee(F.lit(0.02), F.lit(500000.0), F.lit(1000.0)).alias("flat"),
        price.guarantee_fee(F.lit(0.02), F.lit(500000.0), F.lit(1000.0), "el_margin").alias("margin"),
    ).first()
    assert (row.flat, row.margin) == (17500.0, 1200.0)
    with pytest.raises(ValueError):
        price.guarantee_fee(F.lit(0.02), F.lit(1.0), F.lit(1.0), "other")


SCORES = [
    (dict(SCIAN="54", NewExist=2, NoEmp=30, Portion=0.72, RealEstate=1, GrAppv=800000.0, Term=36, State="NL", UrbanRural=1, Recession=0), 0.02, 0.03),
    (dict(SCIAN="72", NewExist=1, NoEmp=2, Portion=0.0, RealEstate=0, GrAppv=150000.0, Term=12, State="OAX", UrbanRural=2, Recession=1), 0.40, 0.80),
    (dict(SCIAN="46", NewExist=2, NoEmp=8, Portion=0.55, RealEstate=0, GrAppv=400000.0, Term=24, State="MEX", UrbanRural=1, Recession=0), 0.052785, 0.052785),
]


def test_rule_scores(make_loans):
    table = make_loans(*[dict(LoanNr=i, **row) for i, (row, _, _) in enumerate(SCORES)])
    got = rules.score_to_pd(rules.risk_score(table)).orderBy("LoanNr").collect()
    for row, (_, score, pd_) in zip(got, SCORES):
        assert row.risk_score == pytest.approx(score)
        assert row.rule_pd == pytest.approx(pd_)


def _column(spark, values, type_, build):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in table.orderBy("i").select(build(c("v"))).collect()]


def test_amount_edges(spark):
    values = [0.0, 200000.0, 200000.01, 500000.0, 1000000.0, 1000000.01, None]
    want = [None, "<$200K", "$200K-500K", "$200K-500K", "$500K-1M", ">$1M", None]
    assert _column(spark, values, "double", seg.amount_bucket) == want
    assert _column(spark, values, "double", seg.amount_bucket_ord) == [None, 1, 2, 2, 3, 4, None]


def test_size_edges(spark):
    values = [0, 10, 11, 50, 51, 250, 251, 1000, 1001, None]
    want = [None, "Micro", "Pequeña", "Pequeña", "Mediana", "Mediana", "Grande", "Grande", None, None]
    assert _column(spark, values, "int", seg.size_class) == want


def test_term_edges(spark):
    want = ["<2 años", "2-5 años", "2-5 años", "5-10 años", "5-10 años", ">10 años", None]
    assert _column(spark, [23, 24, 60, 61, 120, 121, None], "int", seg.term_bucket) == want


def test_portion_edges(spark):
    want = ["Con NAFIN (≥70%)", "Con NAFIN (50-70%)", "Con NAFIN (<50%)", "Sin NAFIN", None, None]
    assert _column(spark, [0.7, 0.5, 0.49, 0.0, -0.1, None], "double", seg.portion_band) == want


def test_program_guarantee(spark):
    got = _column(spark, [2000000.0, 2000001.0], "double", price.program_guarantee)
    assert got == [1600000.0, pytest.approx(1400000.7)]


def test_decision_cuts(spark):
    got = _column(spark, [0.0499, 0.05, 0.15], "double", price.decision_by_pd)
    assert got == ["APROBAR - Riesgo bajo", "REVISAR - Riesgo moderado", "RECHAZAR - Riesgo alto"]


def test_crisis_edges(spark):
    days = ["2020-02-29", "2020-03-01", "2021-06-30", "2021-07-01"]
    assert _column(spark, days, "string", lambda v: seg.crisis_flag(v.cast("date"))) == [False, True, True, False]


def test_rate_light(spark):
    assert _column(spark, [0.11, 0.10, 0.07, None], "double", seg.rate_light) == ["red", "amber", "green", None]


def test_labels(spark):
    assert _column(spark, [1234567.5, 0.5, 1.5], "double", text.money_label) == ["$1,234,568", "$0", "$2"]
    assert _column(spark, [0.1225, 0.5, 12.5], "double", text.percent_label) == ["12.2%", "50.0%", "1250.0%"]


def _scored(spark):
    return spark.createDataFrame(
        [(1, 0.9, 1, 10.0), (2, 0.8, 1, 20.0), (3, 0.8, 0, 0.0), (4, 0.3, 0, 0.0)],
        "LoanNr long, pd double, Default int, ChgOffPrinGr double",
    )


def test_auc_and_roc(spark):
    assert curves.auc(_scored(spark)).first().auc == 0.875
    points = curves.roc_curve(_scored(spark)).orderBy("fpr", "tpr").collect()
    assert [(p.fpr, p.tpr) for p in points] == [(0, 0), (0, 0.5), (0.5, 1), (1, 1)]


def test_confusion(spark):
    cells = {(r.actual, r.predicted): r.n for r in metrics.confusion(_scored(spark)).collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 2}


def test_calibration(spark):
    table = spark.createDataFrame(
        [("a", 30.0, 20.0), ("b", 5.0, 0.0), (None, 9.0, 3.0)], "seg string, ChgOffPrinGr double, el double"
    )
    assert calibration.calibration_factor(table.filter("seg = 'a'")).first().factor == 1.5
    assert calibration.calibration_factor(table.filter("seg = 'b'")).first().factor == 1.0
    found = {r.seg: r.factor for r in calibration.segment_calibration(table, "seg").collect()}
    assert found == {"a": 1.5, "b": 1.0, None: 1.0}
