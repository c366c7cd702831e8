"""Scans of independently kept books and of our own published summaries."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import sized
from ..functions.text import account_key, parse_money, strip, to_double

# Words that identify a column of a ledger-style book, in order of preference.
BOOK_HEADERS = {
    "account": ["Ledger ID", "Account", "账户", "Code", "科目代码"],
    "cr": ["CR Amount", "CR", "Credit", "贷方"],
    "dr": ["DR Amount", "DR", "Debit", "借方"],
    "net": ["Net Amount", "Net", "余额", "Balance"],
}
SUMMARY_SKIPPED = ("项目名称", "nan", "备注")
# Row labels of quarterly book reports, the account they belong to, sign changed.
QUARTER_LABELS = [
    ("捐赠收入", "捐赠收入", False),
    ("投资收入", "投资收益", False),
    ("投资收益", "投资收益", False),
    ("组委工资", "组委工资", True),
    ("组织管理费用", "管理费用", True),
]


def find_book_columns(columns: list[str], column_map: dict | None = None, order: str | None = None) -> dict:
    """Book column per role: by name or position when given, else the first header word that occurs."""
    columns = [c for c in columns if c != order]
    if column_map:
        def given(role):
            c = column_map.get(role)
            return (columns[c] if c < len(columns) else None) if isinstance(c, int) else c
        found = {role: given(role) for role in BOOK_HEADERS}
    else:
        found = {
            role: next((c for word in words for c in columns if word.lower() in c.strip().lower()), None)
            for role, words in BOOK_HEADERS.items()}
    found["account"] = found["account"] or columns[0]
    return found


def read_book(df: DataFrame, order: str = "ord", column_map: dict | None = None) -> DataFrame:
    """(account, cr, dr, net) of a ledger-style book; a later row for the same account wins."""
    cols = find_book_columns(df.columns, column_map, order)

    def number(role):
        name = cols[role]
        return F.coalesce(to_double(F.col(f"`{name}`").cast("string")), F.lit(0.0)) if name in df.columns else F.lit(0.0)

    text = strip(F.col(f"`{cols['account']}`").cast("string"))
    rows = df.filter(text.isNotNull() & ~F.upper(text).isin("TOTAL", "NAN", "")).select(
        account_key(text).alias("account"), number("cr").alias("cr"), number("dr").alias("dr"),
        number("net").alias("net"), F.col(order).alias("ord"))
    return rows.groupBy("account").agg(F.max_by(F.struct("cr", "dr", "net"), "ord").alias("v")).select("account", "v.*")


def period_column(columns: list[str], label: str, category: str, order: str | None = None) -> str:
    """The first amount column named with the period label, else the fourth column."""
    others = [c for c in columns if c not in (category, order)]
    listed = [c for c in columns if c != order]
    return next((c for c in others if label in c), listed[min(3, len(listed) - 1)])


def read_summary(df: DataFrame, label: str, category: str, order: str = "ord") -> DataFrame:
    """(account, net) of a wide summary for one period; a later row for the same category wins."""
    amount = period_column(df.columns, label, category, order)
    name = strip(F.col(f"`{category}`").cast("string"))
    return df.filter((name != "") & ~name.isin(*SUMMARY_SKIPPED)).groupBy(name.alias("account")).agg(
        F.max_by(parse_money(F.col(f"`{amount}`").cast("string")), F.col(order)).alias("net"))


def summary_periods(df: DataFrame, category: str, order: str = "ord") -> DataFrame:
    """The wide summary as rows (account, period, net) for all periods at once."""
    periods = [c for c in df.columns if c not in (category, order)]
    text = df.select(F.col(order), strip(F.col(f"`{category}`").cast("string")).alias("account"),
                     *[F.col(f"`{c}`").cast("string").alias(c) for c in periods])
    long = text.unpivot([order, "account"], periods, "period", "amount_text")
    return long.filter((F.col("account") != "") & ~F.col("account").isin(*SUMMARY_SKIPPED)).groupBy(
        "account", "period").agg(F.max_by(parse_money(F.col("amount_text")), F.col(order)).alias("net"))


def published_by_id(summary: DataFrame, year: int | None = None) -> DataFrame:
    """(year, account, cr, dr, net) of a published yearly summary by ledger id, TOTAL left out."""
    return _published(summary, "ledger_id", account_key(F.col("ledger_id")), year)


def published_by_name(summary: DataFrame, year: int | None = None) -> DataFrame:
    """The same by account name."""
    return _published(summary, "account_name", strip("account_name"), year)


def _published(summary, column, key, year):
    rows = summary.filter(F.col("row_kind") != "TOTAL") if "row_kind" in summary.columns else summary
    if year is not None:
        rows = rows.filter(F.col("year") == year)
    rows = rows.filter(F.coalesce(strip(column) != "", F.lit(False)) & (F.upper(strip(column)) != "TOTAL"))
    # Several accounts may share a name: the last account code wins, as in a keyed reading.
    return rows.groupBy("year", key.alias("account")).agg(
        F.max_by(F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in
                            (("cr_amount", "cr"), ("dr_amount", "dr"), ("net_amount", "net"))]),
                 "account_code").alias("v")).select("year", "account", "v.*")


def quarter_periods(columns: list[str]) -> list[str]:
    """Columns headed like a quarter or several of any year, e.g. 2020Q1 or 2021Q2-3."""
    return [c for c in columns if "Q" in c and re.search(r"(?<![0-9])(19|20)[0-9]{2}(?![0-9])", c)]


def read_quarter_labels(df: DataFrame, label: str, order: str = "ord", accumulate: bool = True,
                        labels=None) -> DataFrame:
    """(account, period, net) of a quarterly book report through the label map.

    Several labels of one account add up, or the last row wins. Cells that are not numbers
    (broken formulas start with #) are left out.
    """
    periods = quarter_periods(df.columns)
    mapping = df.sparkSession.createDataFrame(labels or QUARTER_LABELS, "row_label string, account string, negate boolean")
    text = df.select(F.col(order).alias("ord"), strip(F.col(f"`{label}`").cast("string")).alias("row_label"),
                     *[F.col(f"`{c}`").cast("string").alias(c) for c in periods])
    mapped = text.join(sized(mapping) if labels else F.broadcast(mapping), "row_label")  # without `labels` it is the fixed list above
    long = mapped.unpivot(["ord", "row_label", "account", "negate"], periods, "period", "cell")
    value = to_double(F.col("cell"))
    values = long.filter(value.isNotNull()).withColumn("v", F.when(F.col("negate"), -value).otherwise(value))
    total = F.sum("v") if accumulate else F.max_by("v", "ord")
    return values.groupBy("account", strip("period").alias("period")).agg(total.alias("net"))


def quarter_number(period):
    """Quarter of a period label; a label over several quarters has none."""
    return F.when(period.rlike(r"Q[1-4]$"), F.substring(period, -1, 1).cast("int"))
