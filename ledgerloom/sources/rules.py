"""Mapping rule scans: long rule tables, wide rule sheets and rules made from old types."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import read, read_ways
from ..functions.issues import any_failed, check, emit
from ..functions.numbering import running_number
from ..functions.text import strip, to_int, truthy
from ..operators.accounts import map_legacy_codes

REQUIRED = ("rule_id", "condition", "account_code", "priority")
OPTIONAL = ("old_type", "new_type", "description", "generates_multiple", "ledger_type")
DEFAULT_PRIORITY, KEYWORD_PRIORITY = 10, 20


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED if c not in df.columns]


def missing_column_issues(df: DataFrame) -> DataFrame:
    """A rule table without a required column yields issues instead of rules."""
    rows = [("error", None, 0, c, "missing_column", f"Required column '{c}' is missing", None, None)
            for c in missing_columns(df)]
    return df.sparkSession.createDataFrame(
        rows, "kind string, src_row bigint, row_number bigint, field_name string, "
              "issue_type string, message string, actual_value string, entry_id string")


def _parse(df: DataFrame, ord_col: str) -> DataFrame:
    def text(name) -> Column:
        return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")

    whole = text("priority").try_cast("double")
    flag = text("generates_multiple")
    if "generates_multiple" in df.columns and isinstance(df.schema["generates_multiple"].dataType, T.BooleanType):
        multiple = F.coalesce(F.col("generates_multiple"), F.lit(False))
    else:
        multiple = F.coalesce(truthy(flag), F.lit(False))
    return df.select(
        F.col(ord_col).cast("bigint").alias("rule_ord"),
        text("rule_id").alias("rule_id"),
        strip(text("condition")).alias("condition"),
        text("account_code").alias("account_code"),
        text("priority").alias("priority_text"),
        F.when(whole == F.floor(whole), whole.try_cast("int")).alias("priority"),
        text("old_type").alias("old_type"), text("new_type").alias("new_type"),
        text("description").alias("description"), multiple.alias("generates_multiple"),
        F.when(text("ledger_type") != "", text("ledger_type")).alias("ledger_type"),
    )


def _checks() -> list:
    # Field constraint messages.
    required = "Field required"
    short = "String should have at least 1 character"
    empty_type = "Value error, Type cannot be an empty string. Use None instead."
    row = F.col("rule_ord") + 2
    out = []
    for name in ("rule_id", "condition", "account_code"):
        out += [
            check(F.col(name).isNull(), "missing", name, required, F.lit("N/A"), row_number=row),
            check(F.col(name) == "", "string_too_short", name, short, F.col(name), row_number=row),
        ]
    out += [
        check(F.col("priority_text").isNull(), "missing", "priority", required, F.lit("N/A"), row_number=row),
        check(F.col("priority_text").isNotNull() & F.col("priority").isNull(), "int_parsing", "priority",
              "Input should be a valid integer", F.col("priority_text"), row_number=row),
        check(F.col("priority") < 1, "greater_than_equal", "priority",
              "Input should be greater than or equal to 1", F.col("priority_text"), row_number=row),
    ]
    for name in ("old_type", "new_type"):
        out.append(check(strip(name) == "", "value_error", name, empty_type, F.col(name), row_number=row))
    return out


def read_rules(df: DataFrame, ord_col: str = "rule_ord") -> DataFrame:
    """Valid rules of a long rule table, unknown columns dropped; `ord_col` is the 0-based row."""
    return _parse(df, ord_col).filter(~any_failed(_checks())).select(
        "rule_ord", "rule_id", "condition", "account_code", "priority",
        strip("old_type").alias("old_type"), strip("new_type").alias("new_type"),
        "description", "generates_multiple", "ledger_type",
    )


def rule_issues(df: DataFrame, ord_col: str = "rule_ord") -> DataFrame:
    """Why rules of a long rule table were refused."""
    if missing_columns(df):
        return missing_column_issues(df)
    owner = F.coalesce("rule_id", F.concat(F.lit("ROW-"), (F.col("rule_ord") + 2).cast("string")))
    return emit(_parse(df, ord_col), _checks(), owner, "rule_ord")


def _sides(cr: Column, dr: Column) -> Column:
    return F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("CR").alias("ledger_type"), cr.alias("account_code")),
        F.struct(F.lit(1).alias("pos"), F.lit("DR").alias("ledger_type"), dr.alias("account_code")),
    )).alias("side")


def rules_from_pairs(df: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Wide rows (year, old_type, new_type, cr, dr, keyword) to CR/DR rule pairs.

    Keyword rows get priority 20 and a description test. Of the rows without keyword only the
    first per (year, type) counts, with priority 10.
    """
    year = to_int(F.col("year").cast("string"))
    wide = df.select(
        F.col(ord_col).cast("bigint").alias("ord"), year.alias("year"),
        strip("old_type").alias("old_type"), strip("new_type").alias("new_type"),
        strip("cr").alias("cr"), strip("dr").alias("dr"),
        F.when(strip("keyword") != "", strip("keyword")).alias("keyword"),
    ).filter(
        F.col("year").isNotNull() & F.col("old_type").isNotNull()
        & (F.col("cr") != "") & (F.col("dr") != "")
        & (F.coalesce("new_type", "cr") != "/")
    )
    # One row per (year, type): an aggregate, so a hot type is combined before the shuffle.
    defaults = wide.filter(F.col("keyword").isNull())
    first = defaults.groupBy("year", "old_type").agg(
        F.min(F.struct("ord", "new_type", "cr", "dr")).alias("d"),
    ).select(F.col("d.ord"), "year", "old_type", "d.new_type", "d.cr", "d.dr",
             F.lit(None).cast("string").alias("keyword"))
    kept = wide.filter(F.col("keyword").isNotNull()).unionByName(first)
    condition = F.concat(
        F.lit('old_type == "'), F.col("old_type"), F.lit('" and year == '), F.col("year").cast("string"),
        F.coalesce(F.concat(F.lit(' and "'), F.col("keyword"), F.lit('" in description')), F.lit("")),
    )
    return kept.select("*", condition.alias("condition"), _sides(F.col("cr"), F.col("dr"))).select(
        (F.col("ord") * 2 + F.col("side.pos")).alias("rule_ord"),
        F.concat(F.lit("JTL-"), (F.col("ord") + 2).cast("string"), F.lit("-"), F.col("side.ledger_type")).alias("rule_id"),
        "condition", F.col("side.account_code").alias("account_code"),
        F.when(F.col("keyword").isNull(), DEFAULT_PRIORITY).otherwise(KEYWORD_PRIORITY).alias("priority"),
        "old_type", "new_type",
        F.concat(F.lit("From journal_to_ledger: "), F.col("old_type"), F.lit(" -> "),
                 F.col("side.ledger_type"), F.lit(" "), F.col("side.account_code")).alias("description"),
        F.lit(False).alias("generates_multiple"), F.col("side.ledger_type").alias("ledger_type"),
    )


def _numbered_rules(rows: DataFrame) -> DataFrame:
    """(ord, match_type, cr, dr) to rules with running ids R-001-CR, R-002-DR, ..."""
    sides = rows.select("ord", "match_type", _sides(F.col("cr"), F.col("dr"))).select(
        "ord", "match_type", "side.pos", "side.ledger_type", strip("side.account_code").alias("account_code"),
    ).filter((F.col("account_code") != "") & (F.col("account_code") != "nan"))
    numbered = running_number(sides, "ord", "pos")
    return numbered.select(
        F.col("number").alias("rule_ord"),
        F.format_string("R-%03d-%s", F.col("number"), F.col("ledger_type")).alias("rule_id"),
        F.concat(F.lit('old_type == "'), F.col("match_type"), F.lit('"')).alias("condition"),
        "account_code", F.lit(DEFAULT_PRIORITY).alias("priority"),
        F.col("match_type").alias("old_type"), F.col("match_type").alias("new_type"),
        F.concat(F.lit("Map "), F.col("match_type"), F.lit(" to "), F.col("account_code"),
                 F.lit(" ("), F.col("ledger_type"), F.lit(")")).alias("description"),
        F.lit(False).alias("generates_multiple"), "ledger_type",
    )


def rules_from_wide(df: DataFrame, ord_col: str = "ord") -> DataFrame:
    """NEW section of a wide sheet to long rules; OLD ledgers fill a missing NEW ledger."""
    rows = df.filter(
        F.coalesce(F.col("new_type") != "", F.lit(False))
        & (F.coalesce(F.col("new_cr") != "", F.lit(False)) | F.coalesce(F.col("new_dr") != "", F.lit(False)))
    ).select(
        F.col(ord_col).cast("bigint").alias("ord"), strip("new_type").alias("match_type"),
        F.coalesce(F.when(F.col("new_cr") != "", F.col("new_cr")), F.col("old_cr")).alias("cr"),
        F.coalesce(F.when(F.col("new_dr") != "", F.col("new_dr")), F.col("old_dr")).alias("dr"),
    )
    return _numbered_rules(rows)


def rules_from_old_types(df: DataFrame, accounts: DataFrame | None = None, ord_col: str = "ord") -> DataFrame:
    """OLD section of a wide sheet to long rules, ledgers mapped to account codes."""
    rows = df.filter(
        F.coalesce(F.col("old_type") != "", F.lit(False))
        & (F.coalesce(F.col("old_cr") != "", F.lit(False)) | F.coalesce(F.col("old_dr") != "", F.lit(False)))
    ).select(F.col(ord_col).cast("bigint").alias("ord"), strip("old_type").alias("match_type"),
             strip("old_cr").alias("cr"), strip("old_dr").alias("dr"))
    if accounts is not None:
        used = rows.select(F.explode(F.array("cr", "dr")).alias("old_code"))
        mapped = map_legacy_codes(used, accounts).select("old_code", "code")
        for side in ("cr", "dr"):
            new = mapped.select(F.col("old_code").alias(side), F.col("code").alias(f"{side}_code"))
            rows = rows.join(new, side, "left").withColumn(side, F.coalesce(f"{side}_code", side)).drop(f"{side}_code")
    return _numbered_rules(rows.select("ord", "match_type", "cr", "dr"))


def split_condition(rules: DataFrame, ways: bool = False) -> DataFrame:
    """Adds types / match_year / match_keyword, wherever they stand among the top conjuncts, and `tests`.

    The first three become equality joins and a text search; `tests` are what remains of the condition, null when
    nothing does. With `ways`, rules that name types have their ways to hold instead of the tests.
    """
    known = rules.withColumn("_read", (read_ways if ways else read)(F.col("condition")))
    return known.select(
        *rules.columns, "_read.types", "_read.match_year", "_read.match_keyword", "_read.tests", *(["_read.ways"] if ways else []))


def upsert_rules(rules: DataFrame, deletes: DataFrame, additions: DataFrame) -> DataFrame:
    """Delete listed rules by key `ord`, then add rules whose (year, old_type) is absent."""
    kept = rules.join(deletes.select("ord").distinct(), "ord", "left_anti")
    keys = kept.select("year", "old_type").distinct()
    fresh = additions.join(keys, ["year", "old_type"], "left_anti")
    # Of several additions for one key only the first is absent when its turn comes.
    firsts = fresh.groupBy("year", "old_type").agg(F.min("ord").alias("ord"))
    fresh = fresh.join(firsts, ["year", "old_type", "ord"], "left_semi")
    return kept.unionByName(fresh.select(*kept.columns))


def duplicate_keys(rules: DataFrame) -> DataFrame:
    """(year, old_type) pairs that still occur more than once."""
    return rules.filter(F.col("year").isNotNull() & F.col("old_type").isNotNull()).groupBy(
        "year", "old_type").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
