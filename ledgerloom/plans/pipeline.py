"""The whole run: journal, rules and accounts to published tables and statistics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import audit as audit_tables
from ..operators import ledger as booking
from ..operators import quality_input, quality_rules, typing
from ..sources import journal as journal_source
from . import publish


def prepare(journal: DataFrame, rules: DataFrame, type_map: DataFrame | None = None) -> DataFrame:
    """Typed rows: remapped types (not for rules that name raw types), then inferred types.

    Inference comes before skipped rows are dropped.
    """
    entries = journal if type_map is None else typing.remap_types(journal, type_map)
    return typing.infer_types(entries, rules)


def booked(journal: DataFrame, rules: DataFrame, accounts: DataFrame | None = None,
           type_map: DataFrame | None = None) -> DataFrame:
    """The booked rows of a run as one lazy plan."""
    entries = journal_source.drop_skipped(prepare(journal, rules, type_map))
    return booking.book(entries, quality_rules.valid_rules(rules), accounts)


def counts() -> list[Column]:
    """Rows, ledger lines (without placeholders) and unmatched rows."""
    return [
        F.count(F.lit(1)).alias("journal_entries"),
        F.coalesce(F.sum(F.size(booking.line_numbers())), F.lit(0)).cast("bigint").alias("ledger_entries"),
        F.count_if("no_match").alias("unmatched_entries")]


def skipped_count() -> list[Column]:
    """Of typed rows, those that booking skips."""
    return [F.count_if(journal_source.skip_condition()).alias("journal_entries_skipped")]


def issue_counts() -> list[Column]:
    """Errors and warnings of an issue table."""
    return [F.count_if(F.col("kind") == "error").alias("validation_errors"),
            F.count_if(F.col("kind") == "warning").alias("validation_warnings")]


def statistics(entries: DataFrame, booked_rows: DataFrame, rules: DataFrame, issues: DataFrame) -> DataFrame:
    """One row of run statistics over tables at hand; `entries` are the typed rows before skipping."""
    return booked_rows.agg(*counts()).withColumns({
        "journal_entries_skipped": entries.agg(F.count_if(journal_source.skip_condition())).scalar(),
        "rules_applied": rules.agg(F.count(F.lit(1))).scalar(),
        "_issues": issues.agg(F.struct(F.count_if(F.col("kind") == "error").alias("e"), F.count_if(F.col("kind") == "warning").alias("w"))).scalar(),
    }).withColumns({"validation_errors": F.col("_issues.e"), "validation_warnings": F.col("_issues.w")}).drop("_issues")


def sheet_summary(booked_rows: DataFrame) -> DataFrame:
    """Per sheet: rows, lines and unmatched rows; all sheets in one job."""
    return booked_rows.groupBy("sheet").agg(*counts())


def run(journal: DataFrame, rules: DataFrame, accounts: DataFrame | None, directory: str, as_of: Column,
        type_map: DataFrame | None = None, run_arguments: dict | None = None, fmt: str = "parquet") -> dict:
    """Publish every table of a run under `directory` and return paths and statistics.

    Booked rows and issues feed many tables: each is written once to the (shared) output directory
    and read back, which also cuts the lineage for executors that are lost later. The statistics are counted
    while these tables are written. All tables appear together (`publish.published`); a broken run shows none.
    """
    spark = journal.sparkSession
    numbers: dict = {}

    def write(folder: str) -> dict[str, str]:
        paths = {name: f"{folder}/{name}" for name in ("entries", "records", "issues")}
        skipped = publish.write_counted(prepare(journal, rules, type_map), paths["entries"], skipped_count())
        kept = journal_source.drop_skipped(spark.read.parquet(paths["entries"]))
        usable = quality_rules.valid_rules(rules)
        booked_rows = publish.write_counted(booking.book(kept, usable, accounts), paths["records"], counts())
        found = publish.write_counted(
            quality_input.validate_inputs(kept, rules, accounts, as_of), paths["issues"], issue_counts())
        numbers.update({**booked_rows, **skipped, "rules_applied": rules.count(), **found})
        records, issues = spark.read.parquet(paths["records"]), spark.read.parquet(paths["issues"])
        paths |= publish.unified_report(booking.ledger(records), booking.unmatched(records), records, issues, accounts, folder, fmt)
        paths["audit_metadata"] = publish.write_table(
            audit_tables.metadata(records, run_arguments), f"{folder}/audit_metadata", fmt)
        row = spark.createDataFrame([tuple(numbers.values())], ", ".join(f"{n} bigint" for n in numbers))
        paths["statistics"] = publish.write_table(row, f"{folder}/statistics", fmt)
        return paths

    return {"paths": publish.publish_set(spark, directory, write), "statistics": numbers}


def run_sheets(journal: DataFrame, rules: DataFrame, accounts: DataFrame | None, directory: str,
               strict: bool = True) -> DataFrame:
    """All year sheets in one job, partitioned by sheet; returns the per-sheet summary."""
    spark = journal.sparkSession
    chosen = journal_source.year_guard(journal_source.select_sheets(journal), strict=strict)
    records = booked(chosen, rules, accounts)
    path = publish.write_table(records, f"{directory}/records", partition_by=["sheet"])
    written = spark.read.parquet(path).withColumn("sheet", F.col("sheet").cast("string"))
    publish.write_table(booking.ledger(written, keep=["sheet"]), f"{directory}/ledger", partition_by=["sheet"])
    return sheet_summary(written)
