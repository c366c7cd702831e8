"""Account hierarchy and type-map scans."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, to_int
from ..schemas import EXTRA_ACCOUNT, MAX_YEAR, MIN_YEAR
from .journal import number_rows

REQUIRED = ("code", "name", "level", "full_path")


class InvalidAccounts(ValueError):
    """The account table cannot be used."""


def read_accounts(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Accounts from Parquet, CSV, JSON lines, or a JSON document with an `accounts` list."""
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt == "csv":
        df = spark.read.option("header", True).csv(path)
    elif fmt == "json":
        df = spark.read.option("multiLine", True).json(path)
        if "accounts" in df.columns:
            named = any(f.name == "ord" for f in df.schema["accounts"].dataType.elementType)
            df = df.select(F.posexplode("accounts").alias("_place", "_account")).select(
                "_account.*", *([] if named else [F.col("_place").alias("ord")]))
    elif fmt in ("parquet", "jsonl"):
        df = spark.read.parquet(path) if fmt == "parquet" else spark.read.json(path)
    else:
        raise InvalidAccounts(f"Unknown file type: .{fmt}. Supported: parquet, csv, json, jsonl")
    return standard_accounts(df)


def standard_accounts(df: DataFrame) -> DataFrame:
    """code, name, level, parent_code, full_path with a file order column `ord`."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise InvalidAccounts(f"Missing required columns in account hierarchy: {', '.join(missing)}")
    parent = strip("parent_code") if "parent_code" in df.columns else F.lit(None).cast("string")
    # A column `ord` names the file order; otherwise rows are numbered by file and place, however the files are split.
    rows = df if "ord" in df.columns else number_rows(df, "ord")
    return rows.select(
        F.col("ord").cast("bigint").alias("ord"), strip(F.col("code").cast("string")).alias("code"),
        F.col("name").cast("string").alias("name"), to_int(F.col("level").cast("string")).alias("level"),
        parent.alias("parent_code"), F.col("full_path").cast("string").alias("full_path"),
    )


def accounts_from_levels(df: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Accounts from a sheet with (number, name) column pairs n1/name1 .. n4/name4.

    Level is the deepest filled pair, the path joins the filled names. The parent is the first
    account one level up whose id starts with the same (level - 1) characters, else the first
    account of that level.
    """
    pairs = [(f"n{i}", f"name{i}", i) for i in (1, 2, 3, 4) if f"n{i}" in df.columns and f"name{i}" in df.columns]
    level, parts = F.lit(1), []
    for number, name, i in pairs:
        filled = F.col(number).isNotNull() & F.col(name).isNotNull()
        level = F.when(filled, i).otherwise(level)
        parts.append(F.when(filled, strip(F.col(name).cast("string"))))
    path = F.concat_ws(" > ", *parts) if parts else F.lit("")
    listed = df.filter(F.col("ledger_id").isNotNull() & F.col("ledger_name").isNotNull()).select(
        F.col(ord_col).cast("bigint").alias("ord"),
        strip(F.col("ledger_id").cast("string")).alias("code"),
        strip(F.col("ledger_name").cast("string")).alias("name"),
        level.alias("level"),
        F.when(path == "", strip(F.col("ledger_name").cast("string"))).otherwise(path).alias("full_path"),
    )
    code, name, extra_level, extra_path = EXTRA_ACCOUNT
    extra = listed.agg(
        F.coalesce(F.max("ord"), F.lit(-1)).alias("last"),
        F.coalesce(F.bool_or(F.col("name") == name), F.lit(False)).alias("present"),
    ).filter(~F.col("present")).select(
        (F.col("last") + 1).alias("ord"), F.lit(code).alias("code"), F.lit(name).alias("name"),
        F.lit(extra_level).alias("level"), F.lit(extra_path).alias("full_path"))
    all_accounts = listed.unionByName(extra)

    keyed = all_accounts.select(
        "*", (F.col("level") - 1).alias("up"), F.expr("substring(code, 1, level - 1)").alias("prefix"))
    # Each account offers itself as a parent to the level below, under its own prefix.
    offered = all_accounts.select(
        F.col("level").alias("up"), F.expr("substring(code, 1, level)").alias("prefix"), "ord", "code")
    by_prefix = offered.groupBy("up", "prefix").agg(F.min_by("code", "ord").alias("by_prefix"))
    by_level = offered.groupBy("up").agg(F.min_by("code", "ord").alias("by_level"))
    return (
        keyed.join(by_prefix, ["up", "prefix"], "left").join(F.broadcast(by_level), "up", "left")
        .select("ord", "code", "name", "level",
                F.when(F.col("level") > 1, F.coalesce("by_prefix", "by_level")).alias("parent_code"),
                "full_path")
    )


def read_type_map(df: DataFrame, ord_col: str = "ord") -> DataFrame:
    """(year, old_type) -> new_type; a later row for the same key wins."""
    rows = df.select(
        F.col(ord_col).alias("ord"), to_int(F.col("year").cast("string")).alias("year"),
        strip("old_type").alias("old_type"), strip("new_type").alias("new_type"),
    ).filter(
        F.col("year").between(MIN_YEAR, MAX_YEAR) & (F.col("old_type") != "") & F.col("new_type").isNotNull())
    return rows.groupBy("year", "old_type").agg(F.max_by("new_type", "ord").alias("new_type"))
