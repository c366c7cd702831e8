"""Journal scans: header resolution, sheet selection, row normalisation, year guard."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import settle
from ..functions.text import READER_DATE_FORMATS, parse_date, strip, to_double, to_int
from ..schemas import (
    DEFAULT_DESCRIPTION, MAX_YEAR, MIN_YEAR, MISSING_TYPE, MONEY, SKIP_DESCRIPTIONS,
)

# Accepted headers per journal field (compared trimmed and case-insensitively,
# the first listed header present in the file wins).
HEADERS = {
    "year": ["year", "年份"],
    "description": ["description", "描述", "说明", "摘要"],
    "old_type": ["old_type", "old type", "type", "类型"],
    "amount": ["amount", "金额", "总额"],
    "date": ["date", "日期"],
    "entry_id": ["entry_id", "entry id", "id", "编号"],
    "quarter": ["quarter", "季度"],
    "notes": ["notes", "备注"],
    "income": ["收入"],
    "expense": ["支出"],
    "amount_fallback": ["理财", "金额", "变动"],
}
REQUIRED = ("entry_id", "description", "old_type", "amount", "date")
YEAR_SHEET = r"^20[0-9]{2}$"


class MissingColumns(ValueError):
    """A required journal column has no recognised header."""


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Parquet, CSV (first row is the header, all text) or JSON by extension."""
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.options(**options)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    if fmt in ("json", "jsonl"):
        return reader.json(path)
    return reader.parquet(path)


def number_rows(scan: DataFrame, name: str = "src_row") -> DataFrame:
    """0-based row numbers for a scan of files: by path, then by place in the file.

    The number does not depend on how files are split among tasks. Rows of a split are counted where they are read;
    the place of a split among the others is a small table of splits. A table that is no direct scan of files is
    numbered once and written to the shared folder, so that every later reading sees the same numbers.
    """
    try:
        rows = scan.select(F.monotonically_increasing_id().alias("_at"), F.col("_metadata.file_path").alias("_file"),
                           F.col("_metadata.file_block_start").alias("_start"), "*")
        rows.schema  # noqa: B018  resolves the columns
    except AnalysisException:
        return settle(scan.select(F.monotonically_increasing_id().alias(name), "*"), "numbered")
    splits = rows.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return rows.join(splits, ["_file", "_start"]).select((F.col("_before") + F.col("_at") - F.col("_first")).alias(name), *[f"`{c}`" for c in scan.columns])


def resolve_headers(columns: list[str], custom: dict[str, list[str]] | None = None) -> dict:
    """Field -> actual column, or None. Income/expense columns beat an amount column."""
    headers = HEADERS if custom is None else custom
    present = {c.strip().lower(): c for c in columns}

    def find(field):
        names = headers.get(field, [] if field in ("income", "expense") else [field])
        return next((present[n.strip().lower()] for n in names if n.strip().lower() in present), None)

    found = {f: find(f) for f in (*REQUIRED, "year", "quarter", "notes", "income", "expense")}
    found["amount_fallback"] = None
    if found["income"] or found["expense"]:
        found["amount"] = None
        found["amount_fallback"] = find("amount_fallback")
    missing = [f for f in REQUIRED if found[f] is None
               and not (f == "amount" and (found["income"] or found["expense"]))]
    if missing:
        raise MissingColumns(
            f"Missing required columns: {', '.join(missing)}. "
            f"Available columns: {', '.join(columns)}"
        )
    return found


def select_sheets(df: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Keep sheets named like a year; keep everything when no sheet is named so.

    `sheet` is expected to be a partition column, so the filter prunes partitions.
    """
    year_like = strip(F.col(sheet)).rlike(YEAR_SHEET)
    return df.filter(year_like) if df.filter(year_like).limit(1).count() else df


def sheet_names(df: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Sheets to process, in year order when they are years."""
    names = df.groupBy(F.col(sheet).alias("sheet")).agg(F.count(F.lit(1)).alias("n_rows"))
    return select_sheets(names).orderBy("sheet")


def signed_amount(income: Column, expense: Column, fallback: Column | None = None) -> Column:
    """Income minus expense; the fallback column only when both are empty."""
    net = F.coalesce(income, F.lit(0.0)) - F.coalesce(expense, F.lit(0.0))
    if fallback is None:
        return net
    return F.when(income.isNull() & expense.isNull(), F.coalesce(fallback, F.lit(0.0))).otherwise(net)


def parse_journal(
    df: DataFrame, src_row: str = "src_row", headers: dict[str, list[str]] | None = None,
    date_formats=READER_DATE_FORMATS, sheet: str | None = None,
) -> DataFrame:
    """One projection over the raw table: typed columns, `issue` text and `rejected`.

    `src_row` is the 0-based position in the source. Rows without an id are summary rows and
    disappear silently; rows without a type stay, marked, and also carry an issue.
    """
    cols = resolve_headers([c for c in df.columns if c not in (src_row, sheet)], headers)
    types = {f.name: f.dataType for f in df.schema.fields}

    def raw(field) -> Column:
        name = cols[field]
        if name is None:
            return F.lit(None).cast("string")
        cell = F.col(f"`{name}`")
        if isinstance(types[name], (T.DoubleType, T.FloatType)):
            cell = F.when(~F.isnan(cell), cell)
        return cell.cast("string")

    def text(field) -> Column:
        return strip(raw(field))

    date_type = types[cols["date"]]
    if isinstance(date_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        date = F.col(f"`{cols['date']}`").cast("timestamp")
    else:
        date = parse_date(raw("date"), date_formats)

    from_sides = cols["amount"] is None
    if from_sides:
        bad_side = (
            (raw("income").isNotNull() & to_double(raw("income")).isNull())
            | (raw("expense").isNotNull() & to_double(raw("expense")).isNull())
        )
        amount = signed_amount(
            to_double(raw("income")), to_double(raw("expense")),
            to_double(raw("amount_fallback")) if cols["amount_fallback"] else None,
        )
    else:
        bad_side = F.lit(False)
        amount = to_double(raw("amount"))

    row = F.concat(F.lit("Row "), (F.col("src_row") + 1).cast("string"), F.lit(": "))

    def missing(field):
        return F.concat("row_label", F.lit(f"Missing required field '{field}' (column: {cols[field]})"))

    def invalid(what, field):
        return F.concat(
            "row_label", F.lit(f"Invalid {what} in column '{cols[field]}': "), F.col(f"{field}_text"))

    # inline() of one struct: every cell is parsed once, and later filters on the parsed cells
    # cannot be rewritten into filters that parse them again.
    base = df.filter(F.col(f"`{cols['entry_id']}`").isNotNull()).select(F.inline(F.array(F.struct(
        F.col(src_row).cast("bigint").alias("src_row"),
        (F.col(sheet).cast("string") if sheet else F.lit(None).cast("string")).alias("sheet"),
        text("entry_id").alias("entry_id"),
        F.coalesce(text("description"), F.lit(DEFAULT_DESCRIPTION)).alias("description"),
        F.coalesce(text("old_type"), F.lit(MISSING_TYPE)).alias("old_type"),
        amount.try_cast(MONEY).alias("amount"),
        date.alias("date"),
        to_int(raw("quarter")).alias("quarter"),
        text("notes").alias("notes"),
        *[raw(c).alias(f"{c}_text") for c in ("amount", "date", "year", "quarter", "old_type")],
        bad_side.alias("bad_side"),
    )))).withColumns({"row_label": row, "year": F.year("date")})

    def said(c):
        return F.col(f"{c}_text").isNotNull()

    # Errors in the order in which the fields are read; the first one rejects the row.
    read_error = F.coalesce(
        F.when(F.lit(not from_sides) & said("amount") & F.col("amount").isNull(), invalid("amount", "amount")),
        F.when(~said("date"), missing("date")),
        F.when(F.col("date").isNull(), invalid("date format", "date")),
        F.when(said("year") & to_int(F.col("year_text")).isNull(), invalid("year", "year")),
        F.when(said("quarter") & F.col("quarter").isNull(), invalid("quarter", "quarter")),
        F.when(F.col("bad_side"), F.concat("row_label", F.lit("Unexpected error: could not convert string to float"))),
    )
    warning = F.when(~said("old_type"), missing("old_type"))
    # Field constraint messages.
    short = "String should have at least 1 character"
    model = F.concat_ws(
        "; ",
        F.when(F.col("entry_id") == "", F.lit(f"entry_id: {short}")),
        F.when(F.col("year") < MIN_YEAR, F.lit(f"year: Input should be greater than or equal to {MIN_YEAR}")),
        F.when(F.col("year") > MAX_YEAR, F.lit(f"year: Input should be less than or equal to {MAX_YEAR}")),
        F.when(F.col("description") == "", F.lit(f"description: {short}")),
        F.when(F.col("old_type") == "", F.lit(f"old_type: {short}")),
        F.when(F.col("amount").isNull(),
               F.lit("amount: Decimal input should be an integer, float, string or Decimal object")),
        F.when(F.col("quarter") < 1, F.lit("quarter: Input should be greater than or equal to 1")),
        F.when(F.col("quarter") > 4, F.lit("quarter: Input should be less than or equal to 4")),
    )
    error = F.coalesce(
        read_error,
        F.when(model != "", F.concat("row_label", F.lit("Validation error - "), model)),
    )
    return base.select(
        "src_row", "sheet", "entry_id", "year", "description", "old_type", "amount", "date",
        "quarter", "notes", error.isNotNull().alias("rejected"),
        F.coalesce(error, warning).alias("issue"),
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~F.col("rejected")).drop("rejected", "issue")


def row_issues(parsed: DataFrame) -> DataFrame:
    """Rejected rows and marked rows; a marked row is also among the accepted ones."""
    return parsed.filter(F.col("issue").isNotNull()).select(
        "src_row", "entry_id", F.col("issue").alias("message"), "rejected")


def skip_condition() -> Column:
    """Rows without economic substance: zero amounts and internal fund movements."""
    described = strip("description")
    cond = F.col("amount") == 0
    for mark in SKIP_DESCRIPTIONS:
        cond = cond | described.contains(mark)
    return F.coalesce(cond, F.lit(False))


def drop_skipped(entries: DataFrame) -> DataFrame:
    return entries.filter(~skip_condition())


class YearMismatch(ValueError):
    """Strict year guard: a year sheet holds rows dated in another year."""


def year_mismatch(sheet: str = "sheet") -> Column:
    name = strip(F.col(sheet))
    return name.rlike("^[0-9]{4}$") & (name.try_cast("int") != F.col("year"))


def year_guard_report(entries: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Per sheet: how many rows are dated outside the sheet's year, with five sample ids."""
    bad = entries.filter(year_mismatch(sheet))
    # row_number() <= 5 keeps five rows per sheet and input split before the shuffle.
    first = bad.withColumn("rn", F.row_number().over(W.partitionBy(sheet).orderBy("src_row")))
    samples = first.filter("rn <= 5").groupBy(sheet).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "entry_id"))),
                                 lambda s: s["entry_id"]), ", ").alias("sample_ids"))
    counts = bad.groupBy(sheet).agg(F.count(F.lit(1)).alias("n_mismatched"))
    return counts.join(samples, sheet).select(
        F.col(sheet).alias("sheet"), "n_mismatched", "sample_ids",
        F.concat(
            F.lit("工作表“"), F.col(sheet), F.lit("”中发现 "), F.col("n_mismatched").cast("string"),
            F.lit(" 条日期年份不一致的条目：条目日期年份 != "), F.col(sheet),
            F.lit("。 示例 entry_id: "), F.col("sample_ids"),
        ).alias("message"),
    )


def year_guard(entries: DataFrame, sheet: str = "sheet", strict: bool = True) -> DataFrame:
    """Strict: fail when a year sheet holds foreign rows. Lenient: drop them."""
    if strict:
        first = entries.filter(year_mismatch(sheet)).agg(F.min(sheet).alias("sheet")).first()["sheet"]
        if first is not None:
            raise YearMismatch(year_guard_report(entries.filter(F.col(sheet) == first), sheet).first()["message"])
        return entries
    return entries.filter(~F.coalesce(year_mismatch(sheet), F.lit(False)))


# Raw types of the oldest journal layout and the three-way type they become.
RAW_TYPES = {
    "OL": ["OL", "OL-D", "OL-奖学金", "OL-工资", "OL-讲师工资", "OL押金", "余利宝", "余利宝收益发放",
           "支付宝自动转入余利宝", "余利宝转出到支付宝", "对公->支付宝", "to支付宝", "/", "？", "换汇-3000刀"],
    "CR": ["工资", "组委工资", "书院工资", "运营", "书院运营", "捐赠收入", "结息"],
    "DR": ["书院学费", "书院报销", "书院", "书院住宿", "书院场地", "研讨屋", "聚餐", "播客"],
}


def parse_raw_journal(df: DataFrame, src_row: str = "src_row") -> DataFrame:
    """The oldest layout: ID, Type, 摘要, 日期, 收入, 支出 and optional 领款人 / 对方账户."""
    kind = F.col("Type").cast("string")
    mapped = F.lit("OL")
    for target, sources in RAW_TYPES.items():
        mapped = F.when(kind.isin(*sources), target).otherwise(mapped)
    described = F.coalesce(F.col("摘要").cast("string"), F.lit(DEFAULT_DESCRIPTION))
    date = F.col("日期") if dict(df.dtypes)["日期"] in ("date", "timestamp", "timestamp_ntz") \
        else parse_date(F.col("日期"))
    sides = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("领款人", "对方账户") if c in df.columns]
    return (
        df.filter(F.col("ID").isNotNull())
        .select(
            F.col(src_row).alias("src_row"),
            F.col("ID").cast("string").alias("entry_id"),
            F.to_date(date).alias("date"),
            F.when(described == "", DEFAULT_DESCRIPTION).otherwise(described).alias("description"),
            mapped.alias("old_type"),
            signed_amount(to_double(F.col("收入").cast("string")),
                          to_double(F.col("支出").cast("string"))).try_cast(MONEY).alias("amount"),
            (F.concat_ws(" | ", *sides) if sides else F.lit("")).alias("notes"),
        )
        .filter(F.col("date").isNotNull() & F.col("amount").isNotNull() & (F.col("amount") != 0))
        .select("src_row", "entry_id", F.year("date").alias("year"), "description", "old_type",
                "amount", "date", F.quarter("date").alias("quarter"), "notes")
    )
