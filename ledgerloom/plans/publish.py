"""Published tables."""

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, audit, issue_tables, ordering, review


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, order: list | None = None) -> str:
    """One table as Parquet, CSV (with header) or JSON; range-sorted when an order is given."""
    if order:
        df = df.orderBy(*order)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def write_tables(tables: dict[str, DataFrame], directory: str, fmt: str = "parquet",
                 mode: str = "overwrite") -> dict[str, str]:
    """Several tables under one directory, each under its name."""
    return {name: write_table(df, f"{directory}/{name}", fmt, mode) for name, df in tables.items()}


def write_counted(df: DataFrame, path: str, counts: list[Column], fmt: str = "parquet") -> dict:
    """Writes a table and returns the named counts of its rows, gathered by the writing tasks: no second scan.

    The counts belong to the last stage of the write, in which a task that is repeated counts once. An empty table
    has counts too.
    """
    seen = Observation()
    write_table(df.observe(seen, *counts), path, fmt)
    return seen.get


MANIFEST = "place long, set string, name string, path string"


def _manifest(spark: SparkSession, directory: str) -> DataFrame:
    """One row per table of every published set; none where nothing was published yet."""
    try:
        return spark.read.schema(MANIFEST).json(f"{directory}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _last(rows: DataFrame):
    return rows.agg(F.max(F.struct("place", "set")).alias("last")).first()["last"]


def publish_set(spark: SparkSession, directory: str, write: Callable[[str], dict[str, str]]) -> dict[str, str]:
    """Several tables that appear together: `write(folder)` writes them aside and returns their paths by name.

    Only then does one small file name them, which readers follow (`published`). A run that breaks before leaves the
    set of the run before it as it was. Of two runs at the same time every reader takes the same one. Folders below
    `sets` that the manifest does not name, or names for an earlier set, may be removed.
    """
    name = uuid.uuid4().hex
    paths = write(f"{directory}/sets/{name}")
    last = _last(_manifest(spark, directory))
    rows = [(1 if last is None else last["place"] + 1, name, table, path.removeprefix(f"{directory}/")) for table, path in paths.items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{directory}/manifests")
    return paths


def published(spark: SparkSession, directory: str) -> dict[str, str]:
    """The paths of the last published set by name; empty where there is none."""
    rows = _manifest(spark, directory)
    last = _last(rows)
    if last is None:
        return {}
    found = rows.where((F.col("place") == last["place"]) & (F.col("set") == last["set"])).collect()
    return {r["name"]: r["path"] if "/" == r["path"][:1] or ":/" in r["path"] else f"{directory}/{r['path']}" for r in found}


def unmatched_list(unmatched: DataFrame) -> DataFrame:
    return unmatched.select("src_row", "entry_id", F.coalesce("old_type", F.lit("")).alias("old_type"),
                            "description", "date", "amount", "year")


def unified_report(ledger: DataFrame, unmatched: DataFrame, booked: DataFrame,
                   issues: DataFrame | None, accounts: DataFrame | None, directory: str,
                   fmt: str = "parquet") -> dict[str, str]:
    """Categorization, yearly summary, quarterly report, audit & review."""
    quarterly = aggregate.quarterly(ledger, accounts)
    paths = {
        "categorization": write_table(
            ordering.categorization(ledger, accounts), f"{directory}/categorization", fmt,
            partition_by=["year"], order=ordering.categorization_order()),
        "account_summary_by_year": write_table(
            aggregate.account_summary(ledger, accounts), f"{directory}/account_summary_by_year", fmt,
            order=[F.col("year").asc_nulls_last(), F.col("account_code")]),
        "quarterly_report": write_table(
            aggregate.quarter_report(quarterly, accounts), f"{directory}/quarterly_report", fmt,
            order=aggregate.report_order()),
        "audit_summary": write_table(audit.audit_summary(booked), f"{directory}/audit_summary", fmt),
        "unmatched": write_table(unmatched_list(unmatched), f"{directory}/unmatched", fmt, order=[F.col("src_row")]),
    }
    if issues is not None:
        counts = issues.groupBy("kind").agg(F.count(F.lit(1)).alias("count"))
        paths["issue_counts"] = write_table(counts, f"{directory}/issue_counts", fmt)
    return paths


def quarterly_report_set(ledger: DataFrame, accounts: DataFrame | None, directory: str, fmt: str = "parquet") -> dict:
    """Quarterly totals, account summary and statistics."""
    quarterly = aggregate.quarterly(ledger, accounts)
    return {
        "quarterly_totals": write_table(aggregate.quarter_report(quarterly, accounts), f"{directory}/quarterly_totals",
                                        fmt, order=aggregate.report_order()),
        **write_tables({
            "account_summary": aggregate.account_summary(ledger, accounts, by_year=False),
            "statistics": aggregate.ledger_statistics(ledger),
            "quarter_statistics": aggregate.quarter_statistics(ledger),
        }, directory, fmt),
    }


def review_set(booked: DataFrame, ledger: DataFrame, issues: DataFrame | None, accounts: DataFrame | None,
               directory: str, fmt: str = "parquet") -> dict[str, str]:
    """Dashboard, preview, comparison and flagged entries.

    The flags feed all four tables, so they are written first and read back.
    """
    spark = booked.sparkSession
    paths = {"flags": write_table(review.review_flags(booked, ledger, issues, accounts), f"{directory}/flags")}
    flags = spark.read.parquet(paths["flags"])
    paths |= write_tables({
        "dashboard": review.dashboard(booked, ledger, flags, issues),
        "flags_by_status": review.flags_by_status(flags),
        "preview": review.preview(ledger, flags),
        "comparison": review.comparison(booked, flags),
    }, directory, fmt)
    paths["flagged"] = write_table(review.flagged_entries(flags, ledger, booked), f"{directory}/flagged", fmt,
                                   order=review.flagged_order())
    return paths


def error_report_set(detected: DataFrame, warned: DataFrame, entries: DataFrame, directory: str,
                     fixes: DataFrame | None = None, booked: DataFrame | None = None,
                     fmt: str = "parquet") -> dict[str, str]:
    """Summary, errors, validation metrics, fixes, transformations and the original rows."""
    tables = {
        "summary": issue_tables.summary(detected, warned),
        "errors": detected.select(
            "row_number", F.coalesce("entry_id", F.lit("")).alias("entry_id"), F.coalesce("rule_id", F.lit("")).alias("rule_id"),
            "field_name", "error_type", "severity", "error_message", "actual_value",
            F.coalesce("expected_value", F.lit("")).alias("expected_value"),
            audit.yes_no(F.col("requires_review")).alias("requires_review")),
        "validation": issue_tables.validation_summary(detected, warned, entries),
        "original": entries.select("entry_id", "year", "description", "old_type", "amount", "date", "quarter",
                                   F.coalesce("notes", F.lit("")).alias("notes")),
    }
    if fixes is not None:
        tables["fixes"] = fixes
    if booked is not None:
        tables["transformations"] = audit.transformations(booked)
    return write_tables(tables, directory, fmt)


def audit_export(booked: DataFrame, directory: str, run: dict | None = None) -> dict[str, str]:
    """The five audit tables, the flat lineage as CSV and the nested records as JSON."""
    paths = write_tables(audit.audit_set(booked, run), directory)
    paths["lineage_csv"] = write_table(audit.lineage(booked, run), f"{directory}/lineage_csv", "csv")
    paths["records_json"] = write_table(audit.audit_records(booked, run), f"{directory}/records_json", "json")
    return paths
