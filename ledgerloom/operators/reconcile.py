"""Reconciliation of our totals with independently kept books."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Our category, then the labels the books use for it.
NAME_ALIASES = [
    ("组委工资", ["组委工资", "讲师组委工资", "讲师工资", "8月工资", "a-1-2 8月工资", "工资"]),
    ("捐赠收入", ["捐赠收入"]),
    ("投资收益", ["投资收入", "投资收益"]),
    ("投资收入", ["投资收入", "投资收益"]),
    ("运营费用", ["运营费用", "业务活动费用", "组织管理费用"]),
]
# Accounts listed in the quarterly comparison.
QUARTER_ACCOUNTS = ["捐赠收入", "投资收益", "收入SC", "收入OL", "管理费用", "组委工资", "宣传推广", "社群维护",
                    "支出SC运营", "支出OL讲师", "银行存款", "应付税款", "短期借款"]


def by_id(ours: DataFrame, theirs: DataFrame, keys=("account",), tolerance: float = 0.01,
          fields=("cr", "dr", "net")) -> DataFrame:
    """One row per difference beyond the tolerance, and per account known to one side only."""
    left = ours.select(*keys, F.struct(*fields).alias("o"))
    right = theirs.select(*keys, F.struct(*fields).alias("r"))
    both = left.join(right, list(keys), "full_outer")

    def total(side):
        out = F.lit(0.0)
        for f in fields:
            out = out + F.col(f"{side}.{f}")
        return out

    def entry(field, mine, theirs_, diff, text):
        return F.struct(F.lit(field).alias("field"), mine.cast("double").alias("ours"),
                        theirs_.cast("double").alias("reference"), diff.cast("double").alias("diff"), text.alias("message"))

    none = F.lit(None)
    per_field = [
        F.when(F.abs(F.col(f"o.{f}") - F.col(f"r.{f}")) > tolerance,
               entry(f, F.col(f"o.{f}"), F.col(f"r.{f}"), F.col(f"o.{f}") - F.col(f"r.{f}"),
                     F.format_string(f"{f.upper()}: ours=%.2f, ref=%.2f, diff=%.2f", F.col(f"o.{f}"), F.col(f"r.{f}"),
                                     F.col(f"o.{f}") - F.col(f"r.{f}"))))
        for f in fields]
    alone = [
        F.when(F.col("r").isNull(), entry("all", total("o"), none, none, F.lit("In our output only (not in reference)"))),
        F.when(F.col("o").isNull(), entry("all", none, total("r"), none, F.lit("In reference only (missing in our output)"))),
    ]
    return both.select(*keys, F.explode(F.array_compact(F.array(*alone, *per_field))).alias("d")).select(*keys, "d.*")


def alias_table(spark, aliases=None) -> DataFrame:
    """(our_name, group_ord, cand, cand_ord): the first alias group that mentions a name decides."""
    rows = []
    for g, (category, labels) in enumerate(aliases or NAME_ALIASES):
        cands = [category, *labels]
        rows += [(name, g, cand, i) for name in dict.fromkeys(cands) for i, cand in enumerate(cands)]
    return spark.createDataFrame(rows, "our_name string, group_ord int, cand string, cand_ord int")


def by_name(ours: DataFrame, theirs: DataFrame, tolerance: float = 0.01, aliases=None) -> DataFrame:
    """Our net per account name against the books, through the alias groups.

    `ours` and `theirs` have (account, net) with unique accounts.
    """
    table = aliases or NAME_ALIASES
    spark = ours.sparkSession
    cands = alias_table(spark, table)
    first = cands.groupBy("our_name").agg(F.min("group_ord").alias("group_ord"))
    cands = cands.join(first, ["our_name", "group_ord"]).select(
        F.col("our_name").alias("account"), "cand", "cand_ord")
    # The alias table is a fixed list of a few dozen rows.
    mine = ours.select("account", "net").join(F.broadcast(cands), "account", "left").select(
        "account", "net", F.coalesce("cand", "account").alias("cand"), F.coalesce("cand_ord", F.lit(0)).alias("cand_ord"))
    found = mine.join(theirs.select(F.col("account").alias("cand"), F.col("net").alias("ref")), "cand", "left")
    best = found.groupBy("account", "net").agg(
        F.min_by("ref", F.when(F.col("ref").isNotNull(), F.col("cand_ord"))).alias("ref"))
    unknown = best.filter(F.col("ref").isNull()).select(
        "account", F.lit("net").alias("field"), F.col("net").alias("ours"), F.lit(None).cast("double").alias("reference"),
        F.lit(None).cast("double").alias("diff"), F.lit("Category not in reference (or add alias)").alias("message"))
    differs = best.filter(F.abs(F.col("net") - F.col("ref")) > tolerance).select(
        "account", F.lit("net").alias("field"), F.col("net").alias("ours"), F.col("ref").alias("reference"),
        (F.col("net") - F.col("ref")).alias("diff"),
        F.format_string("net: ours=%.2f, ref=%.2f", F.col("net"), F.col("ref")).alias("message"))
    # A label is covered when it is one of our names, or an alias of a category that we have.
    categories = spark.createDataFrame([(c, label) for c, labels in table for label in labels], "category string, label string")
    covered = ours.select("account").unionByName(
        ours.select(F.col("account").alias("category")).join(F.broadcast(categories), "category").select(
            F.col("label").alias("account"))).distinct()
    theirs_only = theirs.join(covered, "account", "left_anti").filter(
        ~F.col("account").isin("项目名称", "备注", "nan", "") & (F.abs("net") > tolerance)).select(
        "account", F.lit("net").alias("field"), F.lit(None).cast("double").alias("ours"), F.col("net").alias("reference"),
        F.lit(None).cast("double").alias("diff"), F.lit("In reference only (no matching our category)").alias("message"))
    return unknown.unionByName(differs).unionByName(theirs_only)


def by_quarter(published: DataFrame, books: DataFrame, listed: list[str] | None = None) -> DataFrame:
    """Listed accounts per period: our credit, debit and net beside the book's net.

    `published` has (account, year, quarter, cr, dr, net), `books` (account, year, quarter, net).
    Accounts that neither side knows in a period are left out.
    """
    names = listed or QUARTER_ACCOUNTS
    keys = ["account", "year", "quarter"]
    ours = published.filter(F.col("account").isin(*names))
    theirs = books.filter(F.col("account").isin(*names)).select(*keys, F.col("net").alias("book_net"))
    diff = F.col("net") - F.col("book_net")
    return ours.select(*keys, "cr", "dr", "net").join(theirs, keys, "full_outer").select(
        *keys, "book_net", "cr", "dr", "net", diff.alias("diff"),
        F.when(diff.isNull(), "—").when(F.abs(diff) < 0.01, "✓").otherwise("≠").alias("mark"))


def unlisted(published: DataFrame, listed: list[str] | None = None) -> DataFrame:
    """Our accounts with a net that the quarterly comparison does not list."""
    return published.filter(~F.col("account").isin(*(listed or QUARTER_ACCOUNTS)) & (F.abs("net") > 0.01))
