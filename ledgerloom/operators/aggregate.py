"""Period, account and level aggregates of the ledger, and their tie-out checks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.issues import check, emit
from ..functions.numbering import previous_value
from ..schemas import TOLERANCE, TOTAL
from .accounts import lookup, lookup_by_code



def _money(column) -> Column:
    return column.cast(TOTAL)


def _sides() -> list[Column]:
    amount = F.col("amount")
    zero = F.lit(0).cast("decimal(18,2)")
    return [
        _money(F.sum(F.when(F.col("ledger_type") == "CR", amount).otherwise(zero))).alias("cr_amount"),
        _money(F.sum(F.when(F.col("ledger_type") == "DR", amount).otherwise(zero))).alias("dr_amount"),
        F.count(F.lit(1)).alias("entry_count"),
    ]


def _sums() -> list[Column]:
    return [_money(F.sum("cr_amount")).alias("cr_amount"), _money(F.sum("dr_amount")).alias("dr_amount"),
            F.sum("entry_count").alias("entry_count")]


def quarterly(ledger: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Credit, debit, net (CR - DR) and line count per account and quarter, in one pass.

    Level and path are looked up by account code only: an account named instead of coded
    sits at level 0 under its own name.
    """
    sums = ledger.groupBy("account_code", "quarter", "year").agg(*_sides())
    sums = sums.withColumn("total_amount", _money(F.col("cr_amount") - F.col("dr_amount")))
    if accounts is None:
        out = sums.select("*", F.col("account_code").alias("account_path"), F.lit(0).alias("level"))
    else:
        out = lookup_by_code(sums, accounts)
    return out.select("account_code", "account_path", "quarter", "year", "total_amount", "cr_amount",
                      "dr_amount", "entry_count", "level")


def level_totals(aggregates: DataFrame) -> DataFrame:
    """Per level: net over all quarters, number of account quarters, and the first period met."""
    first = F.min(F.struct("account_code", "quarter", "year"))
    return aggregates.filter(F.col("level").between(1, 4)).groupBy("level").agg(
        first.alias("f"), _money(F.sum("total_amount")).alias("total_amount"),
        F.count(F.lit(1)).alias("account_count"),
    ).select("level", "f.quarter", "f.year", "total_amount", "account_count")


def level_members(aggregates: DataFrame) -> DataFrame:
    """The account quarters behind each level total, as rows."""
    return aggregates.filter(F.col("level").between(1, 4))


def subtree_totals(aggregates: DataFrame, accounts: DataFrame) -> DataFrame:
    """Net of an account with all its descendants, per quarter (at most four levels)."""
    links = accounts.select("code", "parent_code")
    own = aggregates.groupBy("account_code", "quarter", "year").agg(F.sum("total_amount").alias("net"))
    up = own.select(F.col("account_code").alias("code"), "quarter", "year", "net", F.col("account_code").alias("node"))
    frames = [up.select("node", "quarter", "year", "net")]
    for _ in range(3):
        up = up.join(links.withColumnRenamed("code", "node"), "node").filter(
            F.col("parent_code").isNotNull()).withColumn("node", F.col("parent_code")).drop("parent_code")
        frames.append(up.select("node", "quarter", "year", "net"))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.groupBy(F.col("node").alias("account_code"), "quarter", "year").agg(
        _money(F.sum("net")).alias("subtree_amount"))


def _named(df: DataFrame, accounts: DataFrame | None) -> DataFrame:
    """ledger_id and account_name by code then name; unknown accounts show their own code."""
    if accounts is None:
        return df.select("*", F.col("account_code").alias("ledger_id"), F.col("account_code").alias("account_name"))
    return lookup(df, accounts).withColumns({
        "ledger_id": F.coalesce("ledger_id", "account_code"),
        "account_name": F.coalesce("account_name", "account_code"),
    }).drop("account_level", "account_parent", "account_full_path")


def account_summary(ledger: DataFrame, accounts: DataFrame | None = None, by_year: bool = True) -> DataFrame:
    """One row per (year and) account and a TOTAL row; the total is built from the small rows."""
    keys = ["year", "account_code"] if by_year else ["account_code"]
    base = ledger.groupBy(*keys).agg(*_sides())
    sets = base.groupingSets([keys, []], *keys).agg(*_sums(), F.grouping_id().alias("gid"))
    total = F.col("gid") != 0
    return _named(sets, accounts).select(
        F.when(total, "TOTAL").otherwise("ACCOUNT").alias("row_kind"),
        *([F.col("year")] if by_year else []),
        F.when(~total, F.col("ledger_id")).alias("ledger_id"),
        F.when(~total, F.col("account_code")).alias("account_code"),
        F.when(~total, F.col("account_name")).alias("account_name"),
        "cr_amount", "dr_amount", _money(F.col("cr_amount") - F.col("dr_amount")).alias("net_amount"),
        "entry_count",
    )


def quarter_totals(aggregates: DataFrame) -> DataFrame:
    """Per quarter: credits, debits, count and DR - CR (zero for a balanced ledger)."""
    return aggregates.groupBy("quarter", "year").agg(*_sums()).withColumn(
        "net_amount", _money(F.col("dr_amount") - F.col("cr_amount")))


def quarter_results(aggregates: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per quarter: income - expense (codes 4 and 5), its negation, change of equity (code 3)."""
    first = F.substring(strip("ledger_id"), 1, 1)
    zero = F.lit(0).cast(TOTAL)

    def result(*digits):
        return _money(F.sum(F.when(first.isin(*digits), F.col("total_amount")).otherwise(zero)))

    found = lookup(aggregates, accounts)
    return found.groupBy("quarter", "year").agg(
        result("4", "5").alias("income_minus_expense"),
        _money(-result("4", "5")).alias("expense_minus_income"), result("3").alias("equity"))


def quarter_report(aggregates: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """The quarterly report as one long table: accounts, TOTAL and three result rows per quarter."""
    columns = ["row_kind", "kind_ord", "quarter", "year", "ledger_id", "account_code", "account_name",
               "cr_amount", "dr_amount", "net_amount", "entry_count"]
    text, money, count = F.lit(None).cast("string"), F.lit(None).cast(TOTAL), F.lit(None).cast("bigint")
    detail = _named(aggregates, accounts).select(
        F.lit("ACCOUNT").alias("row_kind"), F.lit(0).alias("kind_ord"), "quarter", "year", "ledger_id",
        "account_code", "account_name", "cr_amount", "dr_amount", F.col("total_amount").alias("net_amount"),
        "entry_count")
    total = quarter_totals(aggregates).select(
        F.lit("TOTAL").alias("row_kind"), F.lit(1).alias("kind_ord"), "quarter", "year", text.alias("ledger_id"),
        text.alias("account_code"), text.alias("account_name"), "cr_amount", "dr_amount", "net_amount", "entry_count")
    out = detail.unionByName(total)
    if accounts is not None:
        results = quarter_results(aggregates, accounts).select("quarter", "year", F.explode(F.array(
            F.struct(F.lit("RESULT_INCOME_MINUS_EXPENSE").alias("row_kind"), F.lit(2).alias("kind_ord"),
                     F.col("income_minus_expense").alias("net_amount")),
            F.struct(F.lit("RESULT_EXPENSE_MINUS_INCOME").alias("row_kind"), F.lit(3).alias("kind_ord"),
                     F.col("expense_minus_income").alias("net_amount")),
            F.struct(F.lit("RESULT_EQUITY").alias("row_kind"), F.lit(4).alias("kind_ord"),
                     F.col("equity").alias("net_amount")),
        )).alias("r")).select(
            "r.row_kind", "r.kind_ord", "quarter", "year", text.alias("ledger_id"), text.alias("account_code"),
            text.alias("account_name"), money.alias("cr_amount"), money.alias("dr_amount"), "r.net_amount",
            count.alias("entry_count"))
        out = out.unionByName(results)
    return out.select(*columns)


def report_order() -> list[Column]:
    """Quarter before year: the report lists all first quarters together."""
    return [F.col(c) for c in ("quarter", "year", "kind_ord", "account_code")]


def ledger_statistics(ledger: DataFrame) -> DataFrame:
    """Lines, gross amount, distinct accounts and distinct quarters."""
    # Accounts and quarters are counted on the small (account, quarter) rows.
    small = ledger.groupBy("account_code", "quarter", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return small.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total_entries"),
        _money(F.coalesce(F.sum("amount"), F.lit(0))).alias("total_amount"),
        F.countDistinct("account_code").alias("unique_accounts"),
        F.countDistinct("quarter", "year").alias("unique_quarters"))


def quarter_statistics(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("quarter", "year").agg(
        F.count(F.lit(1)).alias("entry_count"), _money(F.sum("amount")).alias("total_amount"))


def level_account_totals(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Gross amount and count per level and account with a total per level (code then name)."""
    base = ledger.groupBy("account_code").agg(
        _money(F.sum("amount")).alias("amount"), F.count(F.lit(1)).alias("entry_count"))
    found = lookup(base, accounts).filter(F.col("account_level") > 0)
    coded = lookup_by_code(found.select("account_code", "amount", "entry_count",
                                        F.col("account_level").alias("lvl")), accounts)
    sets = coded.groupingSets([["lvl", "account_code", "account_path"], ["lvl"]],
                              "lvl", "account_code", "account_path").agg(
        _money(F.sum("amount")).alias("total_amount"), F.sum("entry_count").alias("entry_count"),
        F.grouping("account_code").alias("is_total"))
    total = F.col("is_total") == 1
    return sets.select(
        F.col("lvl").alias("level"),
        F.when(total, "TOTAL").otherwise(F.col("account_code")).alias("account_code"),
        F.when(total, F.concat(F.lit("Level "), F.col("lvl").cast("string"), F.lit(" Total")))
        .otherwise(F.col("account_path")).alias("account_path"),
        "total_amount", "entry_count")


def _children_sums(aggregates: DataFrame, accounts: DataFrame) -> DataFrame:
    """Net of the direct children per parent and quarter."""
    parents = accounts.select(F.col("code").alias("account_code"), F.col("parent_code"))
    return (
        aggregates.filter(F.col("level").between(2, 4)).join(parents, "account_code")
        .filter(F.col("parent_code").isNotNull())
        .groupBy(F.col("parent_code").alias("account_code"), "quarter", "year",
                 (F.col("level") - 1).alias("level"))
        .agg(_money(F.sum("total_amount")).alias("children_total")))


def tie_out(aggregates: DataFrame, accounts: DataFrame, strict: bool = True) -> DataFrame:
    """Accounts whose own net differs from the net of their children by more than a cent.

    Strict: an account without posted children is compared with 0. Otherwise only accounts with
    posted children are compared.
    """
    sums = _children_sums(aggregates, accounts)
    parents = aggregates.filter(F.col("level").between(1, 3))
    keys = ["account_code", "quarter", "year", "level"]
    joined = parents.join(sums, keys, "left" if strict else "inner").withColumn(
        "children_total", _money(F.coalesce("children_total", F.lit(0))))
    gap = F.abs(F.col("children_total") - F.col("total_amount"))
    return joined.filter(gap > F.lit(TOLERANCE).cast("decimal(18,2)")).select(
        *keys, "children_total", "total_amount",
        F.concat(
            F.lit("Level "), F.col("level").cast("string"), F.lit(" account "), F.col("account_code"),
            F.lit(" total mismatch: expected "), F.col("children_total").cast("string"), F.lit(", got "),
            F.col("total_amount").cast("string"), F.lit(" (Q"), F.col("quarter").cast("string"), F.lit(" "),
            F.col("year").cast("string"), F.lit(")")).alias("message"))


def duplicate_aggregates(aggregates: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Aggregate keys that occur again, one issue per occurrence after the first."""
    keys = ["account_code", "quarter", "year"]
    rows = previous_value(aggregates, keys, ord_col, "total_amount")
    where = F.concat(F.lit("Q"), F.col("quarter").cast("string"), F.lit(" "), F.col("year").cast("string"))
    return emit(rows, [check(
        ~F.col("is_first"), "duplicate_aggregation", "quarterly_totals",
        F.concat(F.lit("Duplicate aggregation for account "), F.col("account_code"), F.lit(" in "), where,
                 F.lit(": total "), F.col("previous").cast("string"), F.lit(" and "),
                 F.col("total_amount").cast("string")),
        F.concat(F.lit("account="), F.col("account_code"), F.lit(", quarter="), F.col("quarter").cast("string"),
                 F.lit(", year="), F.col("year").cast("string")))], F.lit(None).cast("string"), F.col(ord_col))
