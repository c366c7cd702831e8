"""Published tables, written to the shared folder, read back and summed up."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.staging import shared_folder
from ledgerloom.operators import issue_tables as issues
from ledgerloom.operators import quality_input as qi
from ledgerloom.plans import pipeline, publish

from .journal import event_issues
from .tables import query


def _folder(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _sums(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(F.col("year").cast("bigint").alias("year")).agg(F.count("*").alias("n_rows"), F.sum("amount").alias("total")).select(
        F.lit(name).alias("name"), "*")


@query("""SELECT 'table' AS name, CAST(year AS BIGINT) AS year, 2 * count(*) AS n_rows, CAST(2 * sum(amount) AS DOUBLE) AS total FROM entries GROUP BY year
  UNION ALL SELECT 'csv', CAST(year AS BIGINT), count(*), CAST(sum(amount) AS DOUBLE) FROM entries GROUP BY year""", "entries")
def written_tables(t):
    """A table overwritten and then appended to, and one as text."""
    rows = t.entries.select("entry_id", "year", "amount")
    path = publish.write_table(rows, f"{_folder(t, 'written')}/table")
    publish.write_table(rows, path, mode="append")
    text = publish.write_tables({"csv": rows}, _folder(t, "written"), "csv")["csv"]
    read = t.spark.read.option("header", True).csv(text).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    return _sums(t.spark.read.parquet(path), "table").unionByName(_sums(read, "csv"))


@query("""SELECT 'categorization' AS name, CAST(year AS BIGINT) AS year, count(*) AS n_rows, CAST(sum(amount) AS DOUBLE) AS total FROM ledger GROUP BY year
  UNION ALL SELECT 'unmatched', CAST(year AS BIGINT), count(*), CAST(sum(amount) AS DOUBLE) FROM records WHERE no_match GROUP BY year""", "ledger", "records")
def unified_set(t):
    paths = publish.unified_report(t.ledger, t.unmatched, t.records, None, t.accounts, _folder(t, "unified"))
    sorted_lines = t.spark.read.parquet(paths["categorization"]).withColumn("amount", F.abs("signed_amount"))
    return _sums(sorted_lines, "categorization").unionByName(_sums(t.spark.read.parquet(paths["unmatched"]), "unmatched"))


@query("""SELECT 'entries' AS name, CAST(year AS BIGINT) AS year, count(*) AS n_rows, CAST(sum(amount) AS DOUBLE) AS total FROM entries GROUP BY year
  UNION ALL SELECT 'unmatched', CAST(year AS BIGINT), count(*), CAST(sum(amount) AS DOUBLE) FROM records WHERE no_match GROUP BY year""", "entries", "records")
def published_set(t):
    """Two sets published one after the other, then one that breaks between its tables; what readers find."""
    folder, columns = _folder(t, "published"), ["year", "amount"]
    publish.publish_set(t.spark, folder, lambda f: publish.write_tables({"entries": t.journal.select(columns)}, f))
    publish.publish_set(t.spark, folder, lambda f: publish.write_tables({"entries": t.entries.select(columns), "unmatched": t.unmatched.select(columns)}, f))

    def broken(f):
        publish.write_table(t.journal.select(columns), f"{f}/entries")
        raise InterruptedError

    try:
        publish.publish_set(t.spark, folder, broken)
    except InterruptedError:
        pass
    paths = publish.published(t.spark, folder)
    return _sums(t.spark.read.parquet(paths["entries"]), "entries").unionByName(_sums(t.spark.read.parquet(paths["unmatched"]), "unmatched"))


@query("""SELECT (SELECT count(*) FROM entries) AS journal_entries, (SELECT count(*) FROM ledger) AS ledger_entries,
  (SELECT count(*) FROM records WHERE no_match) AS unmatched_entries,
  (SELECT count(*) FROM journal) - (SELECT count(*) FROM entries) AS journal_entries_skipped""", "ledger")
def counted_writes(t):
    """Run statistics gathered while the tables of a run are written."""
    folder = _folder(t, "counted")
    numbers = {**publish.write_counted(t.records, f"{folder}/records", pipeline.counts()),
               **publish.write_counted(t.journal, f"{folder}/journal", pipeline.skipped_count())}
    return t.spark.createDataFrame([tuple(numbers.values())], ", ".join(f"{n} bigint" for n in numbers))


@query("""SELECT 'errors' AS name, count(*) AS n_rows FROM events UNION ALL SELECT 'original', count(*) FROM orders
  UNION ALL SELECT 'summary', least(count(*), 1) FROM orders""")
def error_set(t):
    warned = issues.warnings(qi.business_warnings(t.journal, F.lit("2100-01-01").cast("timestamp_ntz")))
    paths = publish.error_report_set(issues.detect(event_issues(t), default="info"), warned, t.journal, _folder(t, "errors"))
    counts = [t.spark.read.parquet(paths[name]).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows") for name in ("errors", "original", "summary")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
