"""Readers, writers, dimension tables and profiles, driven by the loan view."""

from pyspark.sql import functions as F

from avalista.catalog.loan_view import dirty, loans
from avalista.catalog.registry import query, rounded
from avalista.operators import portfolio as p
from avalista.session import scratch_dir as scratch
from avalista.sources import dims
from avalista.sources.loans import read_loans, write_loans

c = F.col
FILE_COLUMNS = ["LoanNr", "Name", "State", "SCIAN", "ApprovalDate", "Term", "NoEmp", "NewExist", "GrAppv", "NAFIN_Appv", "Portion", "RealEstate", "Default", "ChgOffPrinGr"]


SAME_ROWS = 'SELECT LoanNr::VARCHAR AS LoanNr, Name, State, SCIAN, ApprovalDate, Term, NoEmp, NewExist, GrAppv, NAFIN_Appv, Portion, RealEstate, "Default", ChgOffPrinGr FROM '


@query("read_loans_csv", SAME_ROWS + "dirty")
def _(spark, sf):
    path = scratch(spark, "csv")
    write_loans(dirty(spark, sf, customer=True).select(*FILE_COLUMNS), path, "csv")
    return read_loans(spark, path, "csv")


@query("write_loans_parquet", 'SELECT LoanNr, State, ApprovalDate, ApprovalFY, GrAppv, "Default", ChgOffPrinGr FROM loans')
def _(spark, sf):
    path = scratch(spark, "parquet")
    write_loans(loans(spark, sf, customer=True), path, "parquet")
    back = read_loans(spark, path, "parquet")
    return back.select("LoanNr", "State", "ApprovalDate", "ApprovalFY", "GrAppv", "Default", "ChgOffPrinGr")


@query("dim_sectors", """SELECT sector_code, sector_name, sector_share, base_rate, volatility, count(LoanNr) AS n_loans
  FROM sectors LEFT JOIN loans ON sector_code = SCIAN GROUP BY ALL""")
def _(spark, sf):
    counts = loans(spark, sf).groupBy(c("SCIAN").alias("sector_code")).agg(F.count("LoanNr").alias("n_loans"))
    return dims.dim_sectors(spark).join(counts, "sector_code", "left").fillna(0, ["n_loans"])


@query("dim_states", """SELECT state_code, state_name, state_share, tier, count(LoanNr) AS n_loans
  FROM states LEFT JOIN loans ON state_code = State GROUP BY ALL""")
def _(spark, sf):
    counts = loans(spark, sf).groupBy(c("State").alias("state_code")).agg(F.count("LoanNr").alias("n_loans"))
    return dims.dim_states(spark).join(counts, "state_code", "left").fillna(0, ["n_loans"])


@query("dim_banks", "SELECT bank_name, bank_share, count(LoanNr) AS n_loans FROM banks LEFT JOIN loans ON bank_name = Bank GROUP BY ALL")
def _(spark, sf):
    counts = loans(spark, sf).groupBy(c("Bank").alias("bank_name")).agg(F.count("LoanNr").alias("n_loans"))
    return dims.dim_banks(spark).join(counts, "bank_name", "left").fillna(0, ["n_loans"])


@query("list_codes", """SELECT 'sector' AS kind, sector_code AS code, sector_name AS name FROM sectors WHERE sector_code IN (SELECT SCIAN FROM loans)
  UNION ALL SELECT 'state', state_code, state_name FROM states WHERE state_code IN (SELECT State FROM loans)""")
def _(spark, sf):
    view = loans(spark, sf)

    def used(kind, dim, column):
        codes = p.list_codes(dim).toDF("code", "name")
        return codes.join(view.select(c(column).alias("code")).distinct(), "code", "left_semi").select(
            F.lit(kind).alias("kind"), "code", "name"
        )

    return used("sector", dims.dim_sectors(spark), "SCIAN").unionByName(used("state", dims.dim_states(spark), "State"))


@query("profile_loans", "SELECT count(*) AS n_rows, 14::BIGINT AS n_columns, '" + ",".join(FILE_COLUMNS) + "' AS column_names FROM loans")
def _(spark, sf):
    return p.profile_loans(loans(spark, sf, customer=True).select(*FILE_COLUMNS))


@query("first_rows", "SELECT LoanNr, State, SCIAN, GrAppv FROM loans ORDER BY LoanNr LIMIT 5")
def _(spark, sf):
    return p.first_rows(loans(spark, sf).select("LoanNr", "State", "SCIAN", "GrAppv"))


@query("describe", """SELECT column_name, n, round(mean, 6) AS mean, round(std, 6) AS std, min, max, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75 FROM (
  SELECT column_name, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
    quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75
  FROM (SELECT unnest(['GrAppv','Term','NoEmp','Portion','InterestRate','ChgOffPrinGr']) AS column_name,
    unnest([GrAppv, Term::DOUBLE, NoEmp::DOUBLE, Portion, InterestRate, ChgOffPrinGr]) AS value FROM dirty) GROUP BY column_name)""")
def _(spark, sf):
    out = p.describe(dirty(spark, sf), ["GrAppv", "Term", "NoEmp", "Portion", "InterestRate", "ChgOffPrinGr"])
    return rounded(out, mean=6, std=6, p25=6, p50=6, p75=6)


@query("null_counts", " UNION ALL ".join(f"SELECT '{x}' AS column_name, count(*) FILTER (WHERE {x} IS NULL) AS n_null FROM dirty" for x in ["GrAppv", "State", "SCIAN", "RealEstate", "NoEmp", "Bank"]))
def _(spark, sf):
    return p.null_counts(dirty(spark, sf), ["GrAppv", "State", "SCIAN", "RealEstate", "NoEmp", "Bank"])
