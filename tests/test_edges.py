"""Missing and odd values, absent columns, unknown codes, validation."""

import pytest
from pyspark.sql import functions as F

from avalista.functions import cleaning
from avalista.operators import encoding, features, lookups, metrics, portfolio, quotes, rules
from avalista.sources import dims

c = F.col


def test_features_of_empty_values(spark):
    row = {"ChgOffPrinGr": None, "GrAppv": 0.0, "Term": None, "NoEmp": None, "NewExist": None}
    table = spark.createDataFrame([row], "ChgOffPrinGr double, GrAppv double, Term int, NoEmp int, NewExist double")
    got = features.build_features(table).first()
    assert (got.Default, got.ChgOffPrinGr, got.Term, got.NoEmp, got.NewExist) == (0, 0.0, 0, 0, 2.0)
    assert (got.State, got.SCIAN, got.NAFIN_Appv, got.NAFIN_Portion, got.IsNewBusiness) == ("CDMX", "00", 0.0, 0.0, 0)
    assert (got.HasRealEstate, got.InRecession, got.IsUrban, got.Log_GrAppv) == (0, 0, 1, 0.0)


def test_employees_of_minus_one(make_loans):
    assert features.build_features(make_loans({"NoEmp": -1})).first().Loan_per_Employee == 0.0


def test_default_and_new_columns_win(make_loans):
    table = make_loans({"Default": 0, "ChgOffPrinGr": 10.0}).withColumn("New", F.lit(1))
    got = features.build_features(table).first()
    assert (got.Default, got.IsNewBusiness) == (0, 1)


def test_missing_required_column_raises(make_loans):
    with pytest.raises(ValueError, match="GrAppv"):
        features.build_features(make_loans({}).drop("GrAppv"))


def test_sector_cleaning(spark):
    table = spark.createDataFrame([(x,) for x in ["461110", "0", "nan", "na", None, "7"]], "s string")
    got = [r[0] for r in table.select(cleaning.clean_scian(c("s"))).collect()]
    assert got == ["46", "00", "00", "00", "00", "7"]


def test_integer_sector_codes(spark):
    table = spark.createDataFrame([(46,), (0,)], "s int")
    assert [r[0] for r in table.select(cleaning.clean_scian(c("s"))).collect()] == ["46", "00"]


def test_legacy_round_trip(make_loans):
    table = make_loans({})
    back = features.normalize_legacy(features.to_legacy_format(table))
    assert back.first().NAFIN_Appv == 220000.0 and back.first().SCIAN == "46"
    both = features.to_legacy_format(table.withColumn("NAICS", F.lit("x")))
    assert both.columns.count("NAICS") == 1 and both.first().NAICS == "46"


def test_unknown_codes_and_fallbacks(make_loans):
    table = make_loans({"SCIAN": "99", "State": "ZZ"}, {"LoanNr": 2})
    assert {(r.dimension, r.code, r.n_loans) for r in lookups.unknown_codes(table).collect()} == {("SCIAN", "99", 1), ("State", "ZZ", 1)}
    named = lookups.with_sector_name(table).orderBy("LoanNr").collect()
    assert [r.sector for r in named] == ["99", "Comercio al por meno"]
    assert lookups.with_sector_name(table, fallback=None).orderBy("LoanNr").first().sector is None
    info = lookups.with_sector_info(table).orderBy("LoanNr").first()
    assert (info.base_rate, info.volatility) == (0.07, "media")
    assert lookups.with_development_tier(table).orderBy("LoanNr").first().tier == "low"


def test_segment_factors_leave_unknown_segments(spark):
    loans = spark.createDataFrame([("a", 10.0), ("b", 10.0), (None, 10.0)], "s string, el double")
    factors = spark.createDataFrame([("a", 2.0), (None, 9.0)], "s string, factor double")
    got = {r.s: r.el_segment for r in lookups.apply_segment_factors(loans, factors, "s").collect()}
    assert got == {"a": 20.0, "b": 10.0, None: 10.0}


def test_large_factor_tables_are_not_broadcast(spark):
    from avalista.session import broadcast_if_small

    table = spark.range(50).withColumnRenamed("id", "k")
    plan = lambda limit: spark.range(50).join(broadcast_if_small(table, limit), c("id") == c("k"))._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(50) and "broadcast" not in plan(49)


def test_empty_categories_are_listed(make_loans):
    got = portfolio.by_size_class(make_loans({"NoEmp": 5, "Default": 1}), long=False).orderBy("size_class_ord").collect()
    assert [(r.size_class, r.n, r.default_rate) for r in got] == [
        ("Micro", 1, 100.0), ("Pequeña", 0, None), ("Mediana", 0, None), ("Grande", 0, None)
    ]


def test_summary_of_an_empty_portfolio(make_loans):
    got = portfolio.portfolio_summary(make_loans({}).limit(0)).first()
    assert got.n_loans == 0 and got.default_rate is None and got.n_guaranteed == 0


def test_split_is_a_stable_partition(spark):
    loans = spark.range(5000).select(c("id").alias("LoanNr"), (c("id") % 10 == 0).cast("int").alias("Default"))
    fold = encoding.with_fold(loans)
    again = encoding.with_fold(loans.repartition(7))
    assert fold.exceptAll(again).count() == 0
    train, test = fold.filter("fold = 'train'").drop("fold"), fold.filter("fold = 'test'").drop("fold")
    assert train.intersect(test).count() == 0
    assert train.unionByName(test).exceptAll(loans).count() == 0
    assert test.count() == pytest.approx(1000, abs=100)
    exact = encoding.with_exact_fold(loans).groupBy("Default").agg(F.count_if(c("fold") == "test").alias("n"))
    assert {r.Default: r.n for r in exact.collect()} == {0: 900, 1: 100}


def test_label_codes_of_unseen_values_raise(make_loans):
    codes = {"State": encoding.label_codes(make_loans({"State": "JAL"}, {"State": "AGS"}), "State")}
    assert {r.State: r.State_encoded for r in codes["State"].collect()} == {"AGS": 0, "JAL": 1}
    with pytest.raises(Exception, match="unseen State"):
        encoding.label_encode(make_loans({"State": "XX"}), ["State"], codes).collect()


def test_one_hot_of_unknown_is_zero(make_loans):
    got = encoding.one_hot(make_loans({"State": "XX"}), "State", ["NL", "AGS"]).first()
    assert (got.cat__State_AGS, got.cat__State_NL) == (0, 0)


def test_class_weights(make_loans):
    table = make_loans(*[{"Default": int(i == 0)} for i in range(4)])
    got = {r.Default: r.weight for r in encoding.class_weights(table).collect()}
    assert got == {0: pytest.approx(4 / 6), 1: 2.0}
    per_row = {r.Default: r.weight for r in encoding.with_class_weight(table).collect()}
    assert per_row == got
    assert {r.Default: r.weight for r in encoding.class_weights(table, mode="positive").collect()} == {0: 1.0, 1: 3.0}


def test_metrics_on_perfect_and_constant_data(spark):
    table = spark.createDataFrame([(1, 5.0, 5.0, 1.0), (1, 5.0, 5.0, 1.0)], "Default int, ChgOffPrinGr double, lgd double, pd double")
    got = metrics.evaluate_lgd(table).first()
    assert (got.mae, got.r2) == (0.0, None)
    assert metrics.log_loss(table).first()[0] < 1e-12
    report = {r["class"]: r for r in metrics.classification_report(table).collect()}
    assert report["0"].precision == 0.0 and report["1"].f1 == 1.0 and report["0"].support == 0


def test_validation_reasons(spark):
    base = (100000.0, 36, 10, "46", "JAL", 18.5)
    rows = [base, (49999.0, *base[1:]), (base[0], 13, *base[2:]), (*base[:2], 0, *base[3:]), (*base[:3], "99", *base[4:]),
            (*base[:4], "XX", base[5]), (*base[:5], 35.5), (*base[:5], None)]
    table = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "i int, approved_amount double, term_months int, num_employees int, scian_code string, state_code string, market_bank_rate double",
    )
    got = [(r.is_valid, r.reject_reason) for r in quotes.validate_applications(table).orderBy("i").collect()]
    reasons = [None, "amount", "term", "employees", "sector", "state", "rate", "rate"]
    assert got == [(r is None, r) for r in reasons]


def test_parsing_form_text(spark):
    table = spark.createDataFrame([(" 500000 ", "36", "abc", "SÍ", " 4611", " jal ", "12.5", None)],
                                  "approved_amount string, term_months string, num_employees string, is_new_business string, scian_code string, state_code string, market_bank_rate string, has_real_estate string")
    got = quotes.parse_application_text(table).first()
    assert (got.approved_amount, got.term_months, got.num_employees, got.is_new_business) == (500000.0, 36, None, True)
    assert (got.scian_code, got.state_code, got.market_bank_rate, got.has_real_estate) == ("46", "JAL", 12.5, False)


def test_rules_reject_unknown_names(make_loans):
    with pytest.raises(ValueError):
        rules.observed_vs_rule(make_loans({}), "nothing", c("State"))


def test_dimension_tables(spark):
    assert dims.dim_sectors(spark).count() == 21 and dims.dim_states(spark).count() == 32 and dims.dim_banks(spark).count() == 14
    assert [s[0] for s in dims.SECTORS] == sorted(s[0] for s in dims.SECTORS)
    assert [s[0] for s in dims.STATES] == sorted(s[0] for s in dims.STATES)
    with pytest.raises(ValueError):
        dims.target_shares(spark, "planet")


def test_quote_json(spark):
    import json

    table = spark.createDataFrame([(0.02, 1000.0, 500000.0, 48, 14.5, "46", "JAL")], "pd double, lgd double, approved_amount double, term_months int, market_bank_rate double, scian_code string, state_code string")
    record = json.loads(quotes.quote_json(quotes.quote(table)).first().quote)
    assert len(record) == 14
    assert record["Monto Aprobado"] == "$500,000.00 MXN"
    assert record["Probabilidad de Default (PD)"] == "2.0000%"
    assert record["Tasa Ajustada"] == "11.37%"
    assert record["Pago Mensual"] == "$13,467.02 MXN"
    assert record["Sector"] == "46 - Comercio al por menor" and record["Estado"] == "JAL - Jalisco"
    assert record["Garantía GPS (%)"] == "70%"
