import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.sources import journal as source


def raw(spark, columns, *rows):
    schema = "src_row bigint, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


BASIC = ["Entry ID", "年份", "描述", "TYPE ", "Amount", "date"]


def test_basic_read(spark):
    df = raw(spark, BASIC, ("JE-001", "2024", "Test Entry", "OL", "1000.50", "2024-01-15"), ("JE-002", "2024.0", "Another", "CR", "2000.75", "2024-02-20"))
    parsed = source.parse_journal(df)
    rows = source.accepted(parsed).orderBy("src_row").collect()
    assert [(r.entry_id, float(r.amount), r.year) for r in rows] == [("JE-001", 1000.5, 2024), ("JE-002", 2000.75, 2024)]
    assert source.row_issues(parsed).count() == 0


def test_missing_columns():
    with pytest.raises(source.MissingColumns, match="amount, date"):
        source.resolve_headers(["id", "描述", "类型"])
    found = source.resolve_headers(["id", "描述", "类型", "日期", "金额", "收入", "理财"])
    assert found["amount"] is None and found["income"] == "收入" and found["amount_fallback"] == "理财"


def test_custom_headers():
    names = {"entry_id": ["key"], "description": ["what"], "old_type": ["kind"], "amount": ["sum"], "date": ["day"]}
    assert source.resolve_headers(["KEY", "what", "kind", "sum", "day"], names)["entry_id"] == "KEY"


def test_defaults_and_rejections(spark):
    df = raw(spark, BASIC, ("A", None, None, "OL", "5", "2024-01-01"), ("B", None, "x", None, "5", "2024-01-01"), (None, None, "total", "x", "9", None),
             ("C", None, "x", "OL", "abc", "2024-01-01"), ("D", None, "x", "OL", "5", "someday"), ("E", None, "x", "OL", None, "2024-01-01"),
             ("F", None, "x", "OL", "5", None), ("G", "20x", "x", "OL", "5", "2024-01-01"), (" ", None, "x", "OL", "5", "1999-01-01"))
    parsed = source.parse_journal(df)
    kept = {r.entry_id: r for r in source.accepted(parsed).collect()}
    assert kept["A"].description == "无描述" and kept["B"].old_type == "__MISSING_TYPE__" and set(kept) == {"A", "B"}
    said = {r.entry_id: r.message for r in source.row_issues(parsed).collect()}
    assert said["B"] == "Row 2: Missing required field 'old_type' (column: TYPE )"
    assert said["C"] == "Row 4: Invalid amount in column 'Amount': abc"
    assert said["D"] == "Row 5: Invalid date format in column 'date': someday"
    assert said["E"].endswith("amount: Decimal input should be an integer, float, string or Decimal object")
    assert said["F"] == "Row 7: Missing required field 'date' (column: date)"
    assert said["G"] == "Row 8: Invalid year in column '年份': 20x"
    assert "entry_id: String should have at least 1 character; year: Input should be greater" in said[""]


def test_income_expense_and_fallback(spark):
    df = raw(spark, ["编号", "摘要", "类型", "收入", "支出", "理财", "日期"], ("1", "a", "t", "100", "30", None, "2024-01-01"),
             ("2", "a", "t", None, "30", "7", "2024-01-01"), ("3", "a", "t", None, None, "7.5", "2024-01-01"), ("4", "a", "t", None, None, None, "2024-01-01"))
    rows = source.accepted(source.parse_journal(df)).orderBy("src_row").collect()
    assert [float(r.amount) for r in rows] == [70.0, -30.0, 7.5, 0.0]


@pytest.mark.parametrize("value, reader, model", [
    ("2024-01-15", "2024-01-15", "2024-01-15"), ("2024/01/15", "2024-01-15", "2024-01-15"), ("03/04/2024", "2024-03-04", "2024-04-03"),
    ("25/12/2024", "2024-12-25", "2024-12-25"), ("12/25/2024", "2024-12-25", "2024-12-25"), ("nonsense", None, None)])
def test_dates(spark, value, reader, model):
    row = spark.range(1).select(text.parse_date(F.lit(value)).alias("r"), text.parse_date(F.lit(value), text.MODEL_DATE_FORMATS).alias("m")).first()
    day = lambda d: d and datetime.datetime.fromisoformat(d)
    assert (row.r, row.m) == (day(reader), day(model))


@pytest.mark.parametrize("amount, description, kept", [
    (0, "x", False), (5, "余利宝自动转入", False), (5, "余利宝-基金赎回，转账到支付宝", False), (5, "余利宝收益发放", True), (5, "支付宝余额自动转入", True)])
def test_skip_filter(make, amount, description, kept):
    assert (source.drop_skipped(make.journal(("J", "T", amount, "2024-01-01", description))).count() == 1) is kept


def test_year_guard(make):
    rows = make.journal(("A", "T", 1, "2022-05-01"), ("B", "T", 1, "2023-01-01")).withColumn("sheet", F.lit("2022"))
    with pytest.raises(source.YearMismatch, match="发现 1 条.*B"):
        source.year_guard(rows)
    assert [r.entry_id for r in source.year_guard(rows, strict=False).collect()] == ["A"]
    assert source.year_guard(rows.filter("entry_id = 'A'")).count() == 1
    assert source.year_guard(rows.withColumn("sheet", F.lit("Sheet1"))).count() == 2


def test_sheets(spark):
    df = spark.createDataFrame([("2023",), ("notes",), ("2022",), ("22",)], "sheet string")
    assert [r.sheet for r in source.sheet_names(df).collect()] == ["2022", "2023"]
    assert source.select_sheets(df.filter("sheet in ('notes', '22')")).count() == 2


def test_files(spark, tmp_path):
    rows = raw(spark, ["id", "描述", "类型", "金额", "日期"], ("J-1", "中文", "OL", "5", "2024-01-01"))
    for fmt in ("csv", "json", "parquet"):
        path = str(tmp_path / f"j.{fmt}")
        rows.write.format(fmt).option("header", True).save(path)
        df = source.number_rows(source.read_table(spark, path).drop("src_row"))
        assert source.accepted(source.parse_journal(df)).first().description == "中文"


def test_money_and_keys(spark):
    df = spark.createDataFrame([("¥1,234.50", "1100.0"), ("-5 元", " A1 "), ("none", "7"), (None, None)], "m string, k string")
    assert [tuple(r) for r in df.select(text.parse_money(F.col("m")), text.account_key(F.col("k"))).collect()] == [
        (1234.5, "1100"), (-5.0, "A1"), (0.0, "7"), (0.0, None)]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_row_numbers_do_not_depend_on_splits(spark, tmp_path, fmt):
    path = str(tmp_path / f"rows.{fmt}")
    rows = spark.range(0, 5000, 1, 3).selectExpr("CAST(id AS STRING) AS k", "repeat('x', 40) AS filler")
    rows.write.format(fmt).option("header", True).option("parquet.block.size", 16384).save(path)
    seen = []
    for size in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            numbered = source.number_rows(source.read_table(spark, path))
            seen.append({r.k: r.src_row for r in numbered.select("k", "src_row").collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and sorted(seen[0].values()) == list(range(5000))


def test_a_derived_table_is_numbered_once(spark):
    numbered = source.number_rows(spark.createDataFrame([("a",), ("b",), ("c",)], "k string").filter("k <> 'b'"))
    assert numbered.count() == 2 and numbered.collect() == numbered.collect()


@pytest.mark.parametrize("text, day", [
    ("2024/1/5", "2024-01-05"), ("2024-1-5", "2024-01-05"), ("2024-01-15T10:00:00", "2024-01-15"), ("2024-01-15 10:30", "2024-01-15"), ("2024-01-15 10:00:00.5", "2024-01-15"),
    ("20240115", "2024-01-15"), ("2024.01.15", "2024-01-15"), ("Jan 5 2024", "2024-01-05"), ("1/5/24", "2024-01-05"), ("15/1/2024", "2024-01-15"),
    ("　 2024-01-15\t", "2024-01-15"), ("2024-13-01", None), ("n/a", None)])
def test_dates_that_the_reader_takes(spark, text, day):
    from ledgerloom.functions.text import parse_date
    assert spark.range(1).select(F.date_format(parse_date(F.lit(text)), "yyyy-MM-dd")).first()[0] == day
