"""Files: loan tables, saved layouts, application streams."""

import pytest
from pyspark.sql import functions as F

from avalista.catalog.loan_view import applications, loans
from avalista.operators.quotes import quote
from avalista.sources.loans import read_loans, write_loans
from avalista.streaming.quotes import quote_stream, read_application_stream, write_quote_stream

HEADER = "GrAppv,LoanNr,SCIAN,ApprovalDate,Term,NoEmp,NewExist,ChgOffPrinGr,Extra\n"


def _file(tmp_path, *lines):
    path = tmp_path / "loans.csv"
    path.write_text(HEADER + "\n".join(lines) + "\n")
    return str(path)


def test_csv_types_and_missing_texts(spark, tmp_path):
    table = read_loans(spark, _file(tmp_path, "1000.5,7,00,2020-03-01,36.0,NA,,nan,x", "N/A,8,11,,null,5,1,2.5,"))
    rows = table.orderBy("LoanNr").collect()
    assert (rows[0].GrAppv, rows[0].LoanNr, rows[0].SCIAN, str(rows[0].ApprovalDate)) == (1000.5, "7", "00", "2020-03-01")
    assert (rows[0].Term, rows[0].NoEmp, rows[0].NewExist, rows[0].ChgOffPrinGr, rows[0].Extra) == (36, None, None, None, "x")
    assert (rows[1].GrAppv, rows[1].Term, rows[1].ChgOffPrinGr) == (None, None, 2.5)


def test_bad_numbers_raise_or_become_null(spark, tmp_path):
    path = _file(tmp_path, "oops,7,00,2020-03-01,36,1,1,0,x")
    with pytest.raises(Exception):
        read_loans(spark, path).collect()
    assert read_loans(spark, path, on_bad_value="null").first().GrAppv is None


def test_missing_columns_and_files_raise(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("LoanNr,Term\n1,2\n")
    with pytest.raises(ValueError, match="GrAppv"):
        read_loans(spark, str(path))
    with pytest.raises(Exception):
        read_loans(spark, str(tmp_path / "none.csv"))


def test_csv_write_drops_scratch_and_formats_dates(spark, sf, tmp_path):
    table = loans(spark, sf, customer=True).withColumn("score_riesgo", F.lit(1.0))
    write_loans(table, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert "score_riesgo" not in back.columns
    assert back.filter(~F.col("ApprovalDate").rlike(r"^\d{4}-\d{2}-\d{2}$")).count() == 0
    assert back.count() == table.count()


def test_parquet_is_pruned_by_year(spark, sf, tmp_path):
    path = str(tmp_path / "out")
    write_loans(loans(spark, sf, customer=True), path, "parquet")
    one_year = read_loans(spark, path, "parquet").filter("ApprovalFY = 2016")
    assert "ApprovalFY" in one_year._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("]")[0]
    assert one_year.count() == loans(spark, sf).filter("ApprovalFY = 2016").count()


def test_stream_equals_batch(spark, sf, tmp_path):
    table = applications(spark, sf)
    table.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = read_application_stream(spark, str(tmp_path / "in"), schema=table.schema, files_per_trigger=1)
    run = write_quote_stream(quote_stream(stream, keep=["application_id"]), str(tmp_path / "out"), str(tmp_path / "state"))
    run.awaitTermination()
    got, want = spark.read.parquet(str(tmp_path / "out")), quote(table, keep=["application_id"])
    assert got.count() == want.count()
    assert want.exceptAll(got.select(*want.columns)).count() == 0


def test_typed_files_get_the_types_of_their_names(spark, tmp_path):
    rows = [("7", 46, "24", 8, "2", 1000, 0.0, "bad"), ("8", 54, "36.0", 3, "1", 2000, 5.0, "2020-03-01")]
    path = str(tmp_path / "typed")
    spark.createDataFrame(rows, "LoanNr string, SCIAN int, Term string, NoEmp int, NewExist string, GrAppv int, ChgOffPrinGr double, ApprovalDate string").write.parquet(path)
    loans = read_loans(spark, path, "parquet", on_bad_value="null").orderBy("LoanNr")
    assert [(r.LoanNr, r.SCIAN, r.Term, r.NewExist, r.GrAppv, str(r.ApprovalDate)) for r in loans.collect()] == [
        ("7", "46", 24, 2, 1000.0, "None"), ("8", "54", 36, 1, 2000.0, "2020-03-01")]
    with pytest.raises(Exception):
        read_loans(spark, path, "parquet").collect()


def test_checked_stream_equals_the_batch(spark, tmp_path):
    """Bad rows go aside with their reason; a batch that runs again, and a restart, leave every application once."""
    import os

    from pyspark.sql.types import DoubleType, StructField, StructType

    from avalista.streaming.quotes import TEXT_SCHEMA, check_and_quote, write_checked_quotes

    schema = StructType([*TEXT_SCHEMA.fields, StructField("pd", DoubleType()), StructField("lgd", DoubleType())])
    names = schema.names
    good = {"approved_amount": " 500000 ", "term_months": "48", "num_employees": "10", "is_new_business": "no", "scian_code": "46", "state_code": "CDMX", "market_bank_rate": "14.5"}
    changes = [{}, {"approved_amount": "abc"}, {"term_months": "7"}, {"state_code": "ZZ"}, {"market_bank_rate": None}, {"num_employees": "3"}, {"approved_amount": "1"}, {"scian_code": "72"}]
    rows = [tuple(str(i) if n == "application_id" else {**good, **change}.get(n, 0.02 if n == "pd" else 90000.0 if n == "lgd" else None) for n in names) for i, change in enumerate(changes)]

    def put(part, number):
        spark.createDataFrame(part, schema).coalesce(1).write.option("header", True).csv(str(tmp_path / "in" / f"part{number}"))

    def run():
        stream = read_application_stream(spark, str(tmp_path / "in" / "*"), "csv", schema, files_per_trigger=1)
        write_checked_quotes(stream, str(tmp_path / "out"), str(tmp_path / "state"), keep=["application_id"]).awaitTermination()

    def got(name):
        return sorted(map(str, spark.read.parquet(str(tmp_path / "out" / name)).drop("batch").collect()))

    put(rows[:3], 0)
    put(rows[3:5], 1)
    run()
    commits = str(tmp_path / "state" / "commits")
    last = max((x for x in os.listdir(commits) if x.isdigit()), key=int)
    for name in (last, f".{last}.crc"):  # as if the driver had gone before the batch was marked as done
        os.remove(os.path.join(commits, name))
    put(rows[5:], 2)
    run()
    want = check_and_quote(spark.createDataFrame(rows, schema), keep=["application_id"])
    for name, table in want.items():
        assert got(name) == sorted(map(str, table.collect())) and got(name)
    assert len(got("rejected")) + len(got("quotes")) == len(rows)
