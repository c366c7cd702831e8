"""Profiles that help to find missing or doubtful rules."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import TOTAL
from .accounts import lookup

# Groups suggested for well-known types.
TYPE_GROUPS = {
    "OL": ["OL", "OL-D"],
    "CR": ["工资", "组委工资", "运营", "书院运营"],
    "DR": ["书院学费", "书院报销", "书院"],
    "余利宝": ["余利宝", "余利宝收益发放", "支付宝自动转入余利宝", "余利宝转出到支付宝"],
}


def unmatched_profile(unmatched: DataFrame, samples: int = 5) -> DataFrame:
    """Per (year, type): number of unmatched rows and the first sample ids.

    Counting is a partial aggregate and the rank limit acts before the shuffle, so a type that
    holds most rows is cheap.
    """
    kind = F.coalesce(strip("old_type"), F.lit(""))
    rows = unmatched.select("year", F.when(kind == "", "(blank)").otherwise(kind).alias("old_type"), "src_row", "entry_id")
    counts = rows.groupBy("year", "old_type").agg(F.count(F.lit(1)).alias("count"))
    first = rows.withColumn("rn", F.row_number().over(W.partitionBy("year", "old_type").orderBy("src_row"))).filter(
        F.col("rn") <= samples)
    ids = first.groupBy("year", "old_type").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rn", "entry_id"))), lambda s: s["entry_id"]), ", ").alias("ids"))
    more = F.when(F.col("count") > samples, " ...").otherwise("")
    return counts.join(ids, ["year", "old_type"]).select(
        "year", "old_type", "count", F.concat("ids", more).alias("sample_ids"))


def side_check(aggregates: DataFrame, accounts: DataFrame) -> DataFrame:
    """Income should be credited and expense debited: totals and verdict per account."""
    first = F.substring(strip("ledger_id"), 1, 1)
    found = lookup(aggregates, accounts).filter(first.isin("4", "5"))
    sums = found.groupBy("account_code", "account_name", first.alias("digit")).agg(
        F.sum("cr_amount").cast(TOTAL).alias("cr_amount"), F.sum("dr_amount").cast(TOTAL).alias("dr_amount"))
    cr, dr = F.col("cr_amount"), F.col("dr_amount")
    right = F.when(F.col("digit") == "4", cr >= dr).otherwise(dr >= cr)
    return sums.select(
        "account_code", "account_name", F.when(F.col("digit") == "4", "收入").otherwise("支出").alias("kind"),
        "cr_amount", "dr_amount", (cr - dr).cast(TOTAL).alias("net_amount"), right.alias("side_ok"))


def fan_out(ledger: DataFrame) -> DataFrame:
    """One row: lines per source (mean, most, least), sources with several lines, and those
    whose lines all carry the same amount."""
    per = ledger.groupBy("source_entry_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("amount").alias("lo"), F.max("amount").alias("hi"), F.sum("amount").alias("s"))
    several = F.col("n") > 1
    return per.agg(
        F.sum("s").cast(TOTAL).alias("total_amount"), F.avg("n").alias("avg_lines"), F.max("n").alias("max_lines"),
        F.min("n").alias("min_lines"), F.count_if(several).alias("multi_line_sources"),
        F.count_if(several & (F.col("lo") == F.col("hi"))).alias("same_amount_sources"))


def widest_sources(ledger: DataFrame, n: int = 10) -> DataFrame:
    """The sources with several lines, most lines first."""
    return ledger.groupBy("source_entry_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("amount").cast(TOTAL).alias("total_amount")
    ).filter("n_lines > 1").orderBy(F.desc("n_lines"), "source_entry_id").limit(n)


def top_accounts(ledger: DataFrame, n: int = 10) -> DataFrame:
    return ledger.groupBy("account_code").agg(F.sum("amount").cast(TOTAL).alias("total_amount")).orderBy(
        F.desc("total_amount"), "account_code").limit(n)


def type_distribution(journal: DataFrame) -> DataFrame:
    """Rows per type with the suggested group of well-known types."""
    group = F.lit(None).cast("string")
    for name, types in TYPE_GROUPS.items():
        group = F.when(F.col("old_type").isin(*types), name).otherwise(group)
    return journal.filter(F.col("old_type").isNotNull()).groupBy("old_type").agg(
        F.count(F.lit(1)).alias("count")).withColumn("suggested_group", group)
