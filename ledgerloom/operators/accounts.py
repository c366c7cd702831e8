"""Account lookups, hierarchy navigation and integrity."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.containment import containing_pairs
from ..functions.staging import settle
from ..functions.issues import check, emit, union_all
from ..functions.sizing import sized


def account_index(accounts: DataFrame) -> DataFrame:
    """One row per lookup key: an account by its code, else the first account of that name."""
    by_code = accounts.select(F.col("code").alias("key"), F.lit(0).alias("rank"), *accounts.columns)
    by_name = accounts.select(F.col("name").alias("key"), F.lit(1).alias("rank"), *accounts.columns)
    best = F.min(F.struct("rank", "ord", "code", "name", "level", "parent_code", "full_path"))
    return by_code.unionByName(by_name).groupBy("key").agg(best.alias("a")).select(
        "key", F.col("a.code").alias("ledger_id"), F.col("a.name").alias("account_name"),
        F.col("a.level").alias("account_level"), F.col("a.parent_code").alias("account_parent"),
        F.col("a.full_path").alias("account_full_path"))


def name_index(accounts: DataFrame) -> DataFrame:
    """One row per account name: the first account that carries it."""
    return accounts.groupBy("name").agg(
        F.min(F.struct("ord", "code", "full_path")).alias("a")
    ).select("name", F.col("a.code").alias("name_code"), F.col("a.full_path").alias("name_path"))


def lookup(df: DataFrame, accounts: DataFrame, key: str = "account_code", how: str = "left") -> DataFrame:
    """Adds ledger_id, account_name, account_level, account_parent, account_full_path."""
    index = account_index(accounts).withColumnRenamed("key", key)
    # The index holds at most two rows per account, so measuring the accounts bounds it.
    side = sized(accounts)
    return df.join(F.broadcast(index) if side is not accounts else index, key, how)


def lookup_by_code(df: DataFrame, accounts: DataFrame, key: str = "account_code") -> DataFrame:
    """Path and level by code only: an unknown code is its own path at level 0."""
    side = sized(accounts.select(F.col("code").alias(key), F.col("level").alias("_l"), F.col("full_path").alias("_p")))
    return df.join(side, key, "left").select(
        *df.columns, F.coalesce("_p", key).alias("account_path"), F.coalesce("_l", F.lit(0)).alias("level"))


def children(accounts: DataFrame) -> DataFrame:
    """Every (parent, child) link."""
    parent = accounts.select(F.col("code").alias("parent_code"), F.col("name").alias("parent_name"))
    return accounts.select("parent_code", F.col("code").alias("child_code"), F.col("name").alias("child_name"),
                           F.col("level").alias("child_level")).join(parent, "parent_code")


def by_level(accounts: DataFrame, level: int) -> DataFrame:
    return accounts.filter(F.col("level") == level)


def hierarchy_issues(accounts: DataFrame) -> DataFrame:
    """Duplicate codes, parents that do not exist, parents on the wrong level."""
    codes = accounts.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("level", "ord").alias("parent_level"))
    nothing = F.lit(None).cast("bigint")
    duplicate = emit(codes, [check(
        F.col("n") > 1, "duplicate_code", "code",
        F.concat(F.lit("Duplicate account code: "), F.col("code")), F.col("code"))], "code", nothing)
    below = accounts.filter((F.col("level") > 1) & F.col("parent_code").isNotNull())
    linked = below.join(codes.select(F.col("code").alias("parent_code"), "parent_level"), "parent_code", "left")
    parent = emit(linked, [
        check(F.col("parent_level").isNull(), "missing_parent", "parent_code",
              F.concat(F.lit("Account "), F.col("code"), F.lit(" references non-existent parent: "),
                       F.col("parent_code")), F.col("parent_code")),
        check(F.col("parent_level") != F.col("level") - 1, "parent_level", "parent_code",
              F.concat(F.lit("Account "), F.col("code"), F.lit(" (level "), F.col("level").cast("string"),
                       F.lit(") has invalid parent level: "), F.col("parent_level").cast("string")),
              F.col("parent_code")),
    ], "code", F.col("ord"))
    return union_all([duplicate, parent])


# Fragments of old account labels and the account name they stand for,
# tried in this order after code, name and mutual containment.
LEGACY_FRAGMENTS = [
    (["银行存款", "銀行存款", "1002"], "银行存款"),
    (["其他货币资金", "其他貨幣資金", "1009"], "其他货币资金"),
    (["收入OL", "OL收入", "4301"], "收入OL"),
    (["收入SC", "SC收入", "4201"], "收入SC"),
    (["捐赠收入", "捐贈收入", "4101"], "捐赠收入"),
    (["投资收益", "投資收益", "4601"], "投资收益"),
    (["支出OL讲师", "OL讲师工资", "讲师工资", "5401", "5501", "core讲师工资"], "支出OL讲师"),
    (["支出OL组委", "组委工资", "5601"], "支出OL组委"),
    (["支出SC运营", "SC运营", "5001", "5101", "业务活动成本"], "支出SC运营"),
    (["支出SC讲师"], "支出SC讲师"),
    (["支出SC组委"], "支出SC组委"),
    (["支出内容运营", "内容运营"], "支出内容运营"),
    (["管理费用", "管理費用", "5201"], "管理费用"),
    (["社群维护"], "社群维护"),
    (["宣传推广"], "宣传推广"),
    (["应付OL押金", "OL押金", "2301"], "应付OL押金"),
    (["应付OL奖助", "OL奖助", "2302"], "应付OL奖助"),
    (["应付SC押金", "SC押金", "2201"], "应付SC押金"),
    (["应付SC奖助", "SC奖助", "2202"], "应付SC奖助"),
    (["应付税款", "应交税金", "2206", "2209", "其他应付款", "其他應付款"], "应付税款"),
    (["短期借款", "2101"], "短期借款"),
    (["权益变动"], "权益变动"),
]


def map_legacy_codes(df: DataFrame, accounts: DataFrame, key: str = "old_code") -> DataFrame:
    """(old_code, code, match_rank): code, name, mutual containment, fragment table, unchanged.

    Works on the distinct labels. Containment goes both ways through `containing_pairs`.
    """
    labels = settle(df.select(strip(F.col(key).cast("string")).alias("old_code")).filter(
        F.col("old_code") != "").distinct(), "labels")
    names = settle(accounts.groupBy("name").agg(F.min(F.struct("ord", "code")).alias("a")).select(
        "name", F.col("a.ord").alias("ord"), F.col("a.code").alias("code")), "names")

    exact = labels.join(accounts.select(F.col("code").alias("old_code"), F.col("code")), "old_code").select(
        "old_code", F.lit(1).alias("match_rank"), F.lit(0).cast("bigint").alias("ord"), "code")
    named = labels.join(names.withColumnRenamed("name", "old_code"), "old_code").select(
        "old_code", F.lit(2).alias("match_rank"), "ord", "code")
    columns = ["old_code", F.lit(3).alias("match_rank"), "ord", "code"]
    inside = containing_pairs(labels, "old_code", "old_code", names, "name").select(*columns)
    around = containing_pairs(names, "name", "name", labels, "old_code").join(names, "name").select(*columns)
    fragment = F.array_compact(F.array(*[
        F.when(
            F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.col("old_code").contains(p)),
            F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(target).alias("name")))
        for i, (patterns, target) in enumerate(LEGACY_FRAGMENTS)
    ]))
    patterned = labels.select("old_code", F.explode(fragment).alias("f")).select(
        "old_code", F.col("f.i").alias("i"), F.col("f.name").alias("name")
    ).join(names, "name").select("old_code", F.lit(4).alias("match_rank"), F.col("i").alias("ord"), "code")

    candidates = exact.unionByName(named).unionByName(inside).unionByName(around).unionByName(patterned)
    best = candidates.groupBy("old_code").agg(F.min(F.struct("match_rank", "ord", "code")).alias("b"))
    return labels.join(best, "old_code", "left").select(
        "old_code", F.coalesce("b.code", "old_code").alias("code"),
        F.coalesce("b.match_rank", F.lit(5)).alias("match_rank"))
