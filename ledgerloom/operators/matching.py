"""Rule matching: which rules hold for a journal row, and which one per side is applied."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.conditions import entry_fields, entry_parts, holds, way_holds, way_parts
from ..functions.sizing import MAX_BYTES, compact, fits, spread
from ..functions.staging import settle
from ..schemas import DEPOSIT_ACCOUNT
from ..sources.rules import split_condition
from .accounts import account_index, name_index

RULE_FIELDS = (
    "rule_id", "condition", "account_code", "description", "priority", "generates_multiple",
    "ledger_type",
)
ACCOUNT_FIELDS = ("known", "path", "name_code", "name_path", "split_path")
# Sides of a rule; a rule without side is used when nothing else holds.
SIDES = {"cr": "CR", "dr": "DR", "free": None}
MAX_RULES = 20_000
#: Rules without a type in one block; every journal row is held against every block.
RULES_PER_BLOCK = 1_000
#: Ways to hold in one block of a type; a row is held against the blocks whose intervals it meets.
WAYS_PER_BLOCK = 64
MATCH = ("rule_ord", "priority", "ledger_type", "rule_id", "condition")
#: A type is dealt to several tasks if it has more rows than this part of a task's share.
HOT_PART = 0.5


def prepare_rules(rules: DataFrame, accounts: DataFrame | None = None, ways: bool = False) -> DataFrame:
    """Rules with their equality keys and with their account resolved.

    Accounts are looked up once per rule, here, so that no journal row ever needs the lookup:
    `known` / `path` follow code then name, `name_code` / `name_path` follow the name only.
    `split_path` is the path of the deposit account.
    """
    out = split_condition(rules, ways)
    if accounts is None:
        return out.select(
            "*", F.lit(True).alias("known"), F.col("account_code").alias("path"),
            *[F.lit(None).cast("string").alias(c) for c in ("name_code", "name_path", "split_path")])
    small = fits(accounts)
    if small:
        accounts = compact(accounts)
    index = account_index(accounts).select(
        F.col("key").alias("account_code"), F.col("account_full_path").alias("path"))
    names = name_index(accounts).withColumnRenamed("name", "account_code")
    deposit = accounts.filter(F.col("name") == DEPOSIT_ACCOUNT).agg(
        F.min_by("full_path", "ord").alias("split_path"))
    if small:
        index, names = F.broadcast(index), F.broadcast(names)
    return out.join(index, "account_code", "left").join(names, "account_code", "left").select(
        "*", deposit.scalar().alias("split_path"), F.col("path").isNotNull().alias("known"))


def _order() -> list[Column]:
    return [(-F.col("priority")).alias("by_priority"), F.col("rule_ord")]


def _is_side(name: str) -> Column:
    side = F.col("ledger_type")
    return side.isNull() if SIDES[name] is None else side == SIDES[name]


def _holds(rule: Column) -> Column:
    """Whether a rule holds for the row, which has one of its types."""
    return (
        (rule["match_year"].isNull() | (rule["match_year"] == F.col("year")))
        & (rule["match_keyword"].isNull() | F.col("description").contains(rule["match_keyword"]))
        & holds(rule["tests"], F.col("_entry")))


class _Plan:
    """A rule set made ready: measured, its conditions read and its accounts resolved, written once.

    Rules are found by the types that their condition names; the others are held against every row.
    """

    def __init__(self, rules: DataFrame, accounts: DataFrame | None, max_rules: int):
        self.small = fits(rules, max_rules)
        self.rules = settle(prepare_rules(compact(rules) if self.small else spread(rules, "rule_ord"), accounts, not self.small), "rules")
        self.typed = self.rules.filter(F.col("types").isNotNull()).withColumn("old_type", F.explode("types"))
        self.other = self.rules.filter(F.col("types").isNull())

    def hint(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def candidates(self, journal: DataFrame) -> DataFrame:
        """Adds `held`, the rules that hold for the row, without shuffling the journal."""
        rule = F.collect_list(F.struct(*_order(), "ledger_type", "match_year", "match_keyword", "tests"))
        typed = self.typed.groupBy("old_type").agg(rule.alias("_typed"))
        out = journal.join(F.broadcast(typed), "old_type", "left").withColumns(
            {"_other": self.other.agg(rule).scalar(), "_entry": entry_fields(journal.columns)})
        asked = F.concat(F.coalesce("_typed", F.array().cast(typed.schema["_typed"].dataType)), "_other")
        return out.withColumn("held", F.transform(F.filter(asked, _holds), lambda r: F.struct(r["by_priority"], r["rule_ord"], r["ledger_type"]))).drop(
            "_typed", "_other", "_entry")

    def pick(self, journal: DataFrame) -> DataFrame:
        """Journal columns with cr_ord and dr_ord, the best rule per side."""
        if self.small:
            of_side = lambda name: (lambda r: r["ledger_type"].isNull() if SIDES[name] is None else r["ledger_type"] == SIDES[name])
            best = {s: F.array_min(F.filter("held", of_side(s)))["rule_ord"] for s in SIDES}
            picked = self.candidates(journal).select(*journal.columns, *[b.alias(f"{s}_ord") for s, b in best.items()])
        else:
            first = F.struct(*_order())
            sides = [F.min(F.when(_is_side(s), first))["rule_ord"].alias(f"{s}_ord") for s in SIDES]
            held = self.matches(journal, ("rule_ord", "priority", "ledger_type"))
            picked = journal.join(held.groupBy("src_row").agg(*sides), "src_row", "left")
        neither = F.col("cr_ord").isNull() & F.col("dr_ord").isNull()
        return picked.select(*journal.columns, "cr_ord", F.when(neither, F.col("free_ord")).otherwise(F.col("dr_ord")).alias("dr_ord"))

    def matches(self, journal: DataFrame, wanted: tuple[str, ...] = MATCH) -> DataFrame:
        """(src_row, wanted columns of the rule) per rule that holds."""
        columns = ["src_row", *wanted]
        slim = journal.select("src_row", "old_type", "year", "description", entry_fields(journal.columns).alias("_entry"))
        if self.small:
            rule = self.typed.select("old_type", F.struct("match_year", "match_keyword", "tests").alias("_rule"), *wanted)
            met = slim.join(F.broadcast(rule), "old_type").filter(_holds(F.col("_rule"))).select(*columns)
        else:
            met = _dealt(slim, self.typed, columns)
        return met.unionByName(self._untyped(slim, columns))

    def _untyped(self, slim: DataFrame, columns: list[str]) -> DataFrame:
        """Rules without a type are a stated set that every row is held against, block by block; no row is copied or moved.

        As many blocks as fit a broadcast are held against a row at a time.
        """
        width = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in self.other.columns])))
        size = self.other.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")).first()
        rounds = -(-(size["bytes"] or 0) // MAX_BYTES)
        blocks = max(1, -(-size["n"] // RULES_PER_BLOCK))
        packed = F.struct("match_year", "match_keyword", "tests", *columns[1:])
        parts = self.other.withColumns({
            "_round": F.pmod(F.xxhash64("rule_ord"), F.lit(max(1, rounds))), "_block": F.pmod(F.xxhash64(F.lit("block"), "rule_ord"), F.lit(blocks))}).groupBy(
                "_round", "_block").agg(F.collect_list(packed).alias("_part"))
        out = slim.limit(0).select("src_row", *[F.lit(None).cast(self.other.schema[c].dataType).alias(c) for c in columns[1:]])
        for k in range(rounds):
            asked = slim.join(F.broadcast(parts.filter(F.col("_round") == k).select("_part")))
            out = out.unionByName(asked.select("src_row", F.explode(F.filter("_part", _holds)).alias("r")).select("src_row", *[f"r.{c}" for c in columns[1:]]))
        return out

    def details(self, name: str) -> DataFrame:
        """The attributes of the rules under the prefix of a side."""
        return self.rules.select(
            F.col("rule_ord").alias(f"{name}_ord"), *[F.col(c).alias(f"{name}_{c}") for c in RULE_FIELDS + ACCOUNT_FIELDS])


def _dealt(slim: DataFrame, typed: DataFrame, columns: list[str]) -> DataFrame:
    """The rules that hold, found by type and year in a shuffle in which no type fills a task.

    Rows are counted by type first. A type that has more than a part of a task's share is dealt by row into pieces
    below that part, and its rules, few beside its rows, go to each piece. Hot types are fewer than pieces.
    """
    pieces = int(int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")) / HOT_PART)
    counts = slim.groupBy("old_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    hot = counts.filter(F.col("n") * pieces > total).select("old_type", F.ceil(F.col("n") * pieces / total).cast("int").alias("_pieces"))
    hot = F.broadcast(hot)
    rows = slim.join(hot, "old_type", "left").withColumn("_piece", F.pmod(F.xxhash64("src_row"), F.coalesce("_pieces", F.lit(1))).cast("int")).drop("_pieces")
    way = F.col("_way")
    parts = way_parts(way)
    ways = typed.select("old_type", F.col("match_year").alias("year"), *columns[1:], "match_keyword", F.explode("ways").alias("_way")).select(
        "*", *[way[c].alias(c) for c in ("place", "low", "high", "tests")], *[c.alias(name) for name, c in parts.items()]).drop("_way")
    # What a way asks of the type is decided here, since rows meet their type's ways only.
    ways = ways.filter((F.col("same_old_type").isNull() | (F.col("same_old_type") == F.col("old_type"))) & ~F.col("other_old_type").eqNullSafe(F.col("old_type"))).drop(
        "same_old_type", "other_old_type")
    optional = ["match_keyword", *[c for c in parts if c in ways.columns]]
    kinds = ways.groupBy(F.col("year").isNotNull().alias("dated"), F.col("tests").isNotNull().alias("tested")).agg(
        *[F.max(F.col(c).isNotNull()).alias(c) for c in optional]).collect()
    found = []
    for kind in kinds:  # apart, since ways without tests are decided by compiled code
        keys = ["old_type", "_piece", "year"] if kind["dated"] else ["old_type", "_piece"]
        asked = {c for c in optional if kind[c]}
        part = ways.filter((F.col("year").isNotNull() == kind["dated"]) & (F.col("tests").isNotNull() == kind["tested"]))
        part = part.drop(*[c for c in optional if c not in asked], *([] if kind["tested"] else ["tests"]))
        part = part.join(hot, "old_type", "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)))
        found.append(_met(rows, _blocks(part, keys), keys, asked, kind["tested"]).select(*columns))
    none = slim.limit(0).select("src_row", *[F.lit(None).cast(typed.schema[c].dataType).alias(c) for c in columns[1:]])
    return reduce(DataFrame.unionByName, found, none)


def _blocks(ways: DataFrame, keys: list[str]) -> DataFrame:
    """The ways of a key in blocks by the number that they need and its least value, with the block's interval; ways that
    need one value share blocks with their like only."""
    point = F.when(F.col("low") == F.col("high"), F.col("low"))
    near = W.partitionBy(*keys).orderBy("place", "_point", "low", "high")
    packed = F.struct(*[c for c in ways.columns if c not in ("old_type", "year", "place", "_pieces", "_piece")])
    blocked = ways.withColumn("_point", point).select(*keys, F.col("place").alias("_place"), "_point", "low", "high", packed.alias("_way"), F.floor(
        F.row_number().over(near) / F.lit(WAYS_PER_BLOCK)).alias("_block"))
    return blocked.groupBy(*keys, "_place", "_point", "_block").agg(
        F.min("low").alias("_low"), F.max("high").alias("_high"), F.collect_list("_way").alias("_part"))


def _met(rows: DataFrame, blocks: DataFrame, keys: list[str], asked: set[str], tested: bool) -> DataFrame:
    """Rows beside the ways that hold for them, whose columns become columns; no two ways of a rule hold for a row.

    A row's fields are taken from `_entry` once per block, so that a way costs a few plain comparisons.
    """
    number, anywhere = F.get("_entry.numbers", F.col("_place")), F.col("_place").isNull()
    # Blocks are rules in arrays, far larger than their files: never broadcast.
    near = rows.join(blocks.hint("merge"), keys).filter(anywhere | ((number >= F.col("_low")) & (number <= F.col("_high"))))
    own = [c.alias(name) for name, c in entry_parts(F.col("_entry")).items()]
    near = near.select("src_row", F.col("description").alias("_description"), "_entry", anywhere.alias("_anywhere"), number.alias("_number"), *own, "_part")
    met = near.select(*near.columns[:-1], F.inline("_part"))
    held = [F.col("_anywhere") | ((F.col("_number") >= F.col("low")) & (F.col("_number") <= F.col("high"))), *way_holds(asked)]
    if "match_keyword" in asked:
        held.append(F.col("match_keyword").isNull() | F.col("_description").contains(F.col("match_keyword")))
    met = met.filter(reduce(lambda a, b: a & b, held))
    return met.filter(holds(F.col("tests"), F.col("_entry"))) if tested else met


def pick_rules(journal: DataFrame, rules: DataFrame, accounts: DataFrame | None = None,
               max_rules: int = MAX_RULES) -> DataFrame:
    """Adds the structs cr_rule and dr_rule: highest priority, then file order.

    A side without rule has NULL fields. Without a rule for either side the first rule of no side
    is taken as the debit.

    Measured-small rule sets: the rules of a type travel as sorted arrays in a broadcast and
    the row decides alone, so the journal is not shuffled. Larger rule sets: equality joins on
    type and year, then one partially aggregated minimum per row and side. Rule attributes are
    joined to the decision afterwards, so only those that are used travel at all.
    """
    plan = _Plan(rules, accounts, max_rules)
    out = plan.pick(journal)
    for side in ("cr", "dr"):
        out = out.join(plan.hint(plan.details(side)), f"{side}_ord", "left")

    def rule(side):
        return F.struct(F.col(f"{side}_ord").alias("rule_ord"),
                        *[F.col(f"{side}_{c}").alias(c) for c in RULE_FIELDS + ACCOUNT_FIELDS]).alias(f"{side}_rule")

    return out.select(*journal.columns, rule("cr"), rule("dr"))


def has_rule(side: str) -> Column:
    """Whether a booked row has a rule for the side ("cr" or "dr")."""
    return F.col(f"{side}_rule.rule_id").isNotNull()


def applied_rules() -> Column:
    """The rules of a booked row as rows `r` (NULL for a side without rule)."""
    return F.explode(F.array(*[F.when(has_rule(s), F.col(f"{s}_rule")) for s in ("cr", "dr")])).alias("r")


def rule_mismatches(booked: DataFrame, rules: DataFrame, max_rules: int = MAX_RULES) -> DataFrame:
    """(src_row, entry_id, rule_id, condition) of applied rules whose condition does not hold."""
    plan = _Plan(rules, None, max_rules)
    if plan.small:
        held = plan.candidates(booked).select("src_row", "entry_id", F.transform("held", lambda r: r["rule_ord"]).alias("held"), applied_rules())
        return held.filter(F.col("r").isNotNull() & ~F.array_contains("held", F.col("r.rule_ord"))).select(
            "src_row", "entry_id", "r.rule_id", "r.condition")
    applied = booked.select("src_row", "entry_id", applied_rules()).filter("r is not null").select(
        "src_row", "entry_id", "r.rule_ord", "r.rule_id", "r.condition")
    found = applied.join(plan.matches(booked).select("src_row", "rule_ord"), ["src_row", "rule_ord"], "left_anti")
    return found.select("src_row", "entry_id", "rule_id", "condition")


def matches(journal: DataFrame, rules: DataFrame, max_rules: int = MAX_RULES, wanted: tuple[str, ...] = MATCH) -> DataFrame:
    """(src_row, wanted columns of the rule) for every rule that holds for a row."""
    return _Plan(rules, None, max_rules).matches(journal, wanted)
