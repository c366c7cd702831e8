"""Table schemas and the literal values that the bookkeeping rules depend on."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
TOTAL = T.DecimalType(28, 2)

JOURNAL = T.StructType([
    T.StructField("src_row", T.LongType(), False),
    T.StructField("sheet", T.StringType()),
    T.StructField("entry_id", T.StringType(), False),
    T.StructField("year", T.IntegerType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("old_type", T.StringType(), False),
    T.StructField("amount", MONEY, False),
    T.StructField("date", T.TimestampType(), False),
    T.StructField("quarter", T.IntegerType()),
    T.StructField("notes", T.StringType()),
])

RULES = T.StructType([
    T.StructField("rule_ord", T.LongType(), False),
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("condition", T.StringType(), False),
    T.StructField("account_code", T.StringType(), False),
    T.StructField("priority", T.IntegerType(), False),
    T.StructField("old_type", T.StringType()),
    T.StructField("new_type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("generates_multiple", T.BooleanType()),
    T.StructField("ledger_type", T.StringType()),
])

ACCOUNTS = T.StructType([
    T.StructField("ord", T.LongType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("level", T.IntegerType(), False),
    T.StructField("parent_code", T.StringType()),
    T.StructField("full_path", T.StringType(), False),
])

LEDGER_COLUMNS = [
    "src_row", "line_no", "entry_id", "account_code", "account_path", "amount", "date",
    "description", "source_entry_id", "rule_applied", "quarter", "year", "ledger_type",
]

# Fixed values ---------------------------------------------------------------
MISSING_TYPE = "__MISSING_TYPE__"
DEFAULT_DESCRIPTION = "无描述"
UNMATCHED_CODE = "UNMATCHED"
UNMATCHED_PATH = "Unmatched (no mapping rule) / 待匹配"
NO_MATCH_RULE = "NO_MATCH"
DEPOSIT_ACCOUNT = "应付OL押金"
DEPOSIT_SPLIT = 150
SPLIT_TYPE = "OL"
SPLIT_YEAR = 2024
DEPOSIT_MARK = "押金"
DEPOSIT_MARK_LATIN = "ol-d"
SKIP_DESCRIPTIONS = ("余利宝-基金赎回", "余利宝自动转入")
MIN_YEAR, MAX_YEAR = 2000, 2100
REMAP_FLOOR_YEAR = 2020
LARGE_AMOUNT = 1_000_000_000
TOLERANCE = "0.01"
EXTRA_ACCOUNT = ("4250", "收入SCOL", 2, "收入 > 收入SCOL")
