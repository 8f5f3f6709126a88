"""Table layouts. Column names and label texts are part of the data model."""

from pyspark.sql import types as T

_S, _I, _D, _DATE = T.StringType(), T.IntegerType(), T.DoubleType(), T.DateType()

# The canonical loan file, in file order.
CANONICAL = [
    ("LoanNr", _S), ("Name", _S), ("State", _S), ("SCIAN", _S), ("Bank", _S),
    ("ApprovalDate", _DATE), ("Term", _I), ("NoEmp", _I), ("NewExist", _I),
    ("UrbanRural", _I), ("GrAppv", _D), ("NAFIN_Appv", _D), ("Portion", _D),
    ("RealEstate", _I), ("Recession", _I), ("InterestRate", _D), ("Default", _I),
    ("prob_default", _D), ("ChgOffPrinGr", _D), ("NAICS", _S), ("SBA_Appv", _D),
    ("ApprovalFY", _I), ("RevLineCr", _S), ("LowDoc", _S),
]

# Further columns of the dictionary layout.
DICTIONARY_ONLY = [
    ("LoanNr_ChkDgt", _S), ("City", _S), ("Zip", _S), ("BankState", _S),
    ("CreateJob", _I), ("RetainedJob", _I), ("FranchiseCode", _I),
    ("ChgOffDate", _DATE), ("DisbursementDate", _DATE), ("DisbursementGross", _D),
    ("BalanceGross", _D), ("MIS_Status", _S), ("New", _I), ("daysterm", _I),
]

COLUMN_TYPES = dict(CANONICAL + DICTIONARY_ONLY)

REQUIRED = ["ChgOffPrinGr", "GrAppv", "Term", "NoEmp", "NewExist"]

# Texts that mean "missing" in a loan file.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

APPLICATION_SCHEMA = T.StructType([
    T.StructField("application_id", T.LongType()),
    T.StructField("approved_amount", _D),
    T.StructField("term_months", _I),
    T.StructField("num_employees", _I),
    T.StructField("is_new_business", T.BooleanType()),
    T.StructField("scian_code", _S),
    T.StructField("state_code", _S),
    T.StructField("market_bank_rate", _D),
    T.StructField("has_real_estate", T.BooleanType()),
    T.StructField("in_recession", T.BooleanType()),
])

# Model features in order.
NUMERIC_FEATURES = [
    "GrAppv", "NAFIN_Appv", "Debt_to_NAFIN", "Log_GrAppv", "Term", "Term_Years",
    "NoEmp", "IsNewBusiness", "NAFIN_Portion", "Loan_per_Employee",
    "HasRealEstate", "InRecession", "IsUrban",
]
CATEGORICAL_FEATURES = ["SCIAN", "State"]

# Features of the example models, before and after encoding.
EXAMPLE_NUMERIC = [
    "GrAppv", "NAFIN_Appv", "Term", "NoEmp", "NewExist", "UrbanRural",
    "RealEstate", "Portion", "Recession", "New",
]
EXAMPLE_CATEGORICAL = ["State", "SCIAN", "Bank"]


def require(df, columns, what="input"):
    """Raise when a needed column is absent; resolved on the schema, before any job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s): {', '.join(missing)}")
