"""Checks of the journal before it is booked."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.issues import any_failed, check, emit, union_all
from ..functions.sizing import sized
from ..functions.staging import settle
from ..functions.text import READER_DATE_FORMATS, blank, parse_date, to_double, to_int
from ..schemas import LARGE_AMOUNT, MAX_YEAR, MIN_YEAR, MONEY
from .quality_rules import rule_table_issues, valid_rules

REQUIRED = ("year", "description", "old_type", "amount", "date")


def structure_issues(df: DataFrame) -> DataFrame:
    """One issue per required column that the table lacks."""
    rows = [("error", None, 0, c, "missing_column", f"Required column '{c}' is missing", None, None)
            for c in REQUIRED if c not in df.columns]
    return df.sparkSession.createDataFrame(
        rows, "kind string, src_row bigint, row_number bigint, field_name string, "
              "issue_type string, message string, actual_value string, entry_id string")


def null_issues(df: DataFrame, src_row: str = "src_row") -> DataFrame:
    """One issue per empty required cell."""
    number = F.col(src_row) + 2
    return emit(df, [
        check(F.col(c).isNull(), "null_value", c, f"Required field '{c}' is null or empty", row_number=number)
        for c in REQUIRED if c in df.columns], "entry_id" if "entry_id" in df.columns else F.lit(None), src_row)


def correct_year(year: Column, date: Column) -> Column:
    """Out-of-range year: the year of the date, else clamped. No year: the year of the date."""
    outside = (year < MIN_YEAR) | (year > MAX_YEAR)
    clamped = F.greatest(F.lit(MIN_YEAR), F.least(year, F.lit(MAX_YEAR)))
    return F.when(outside, F.coalesce(F.year(date), clamped)).otherwise(F.coalesce(year, F.year(date)))


def _typed(df: DataFrame, entry_id_column: str, src_row: str) -> DataFrame:
    def text(name):
        return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")

    is_date = dict(df.dtypes).get("date") in ("date", "timestamp", "timestamp_ntz")
    date = F.col("date").cast("timestamp") if is_date else parse_date(text("date"), READER_DATE_FORMATS)
    year = to_double(text("year"))
    return df.select(
        F.col(src_row).cast("bigint").alias("src_row"), text(entry_id_column).alias("entry_id"),
        text("year").alias("year_text"), text("description").alias("description"),
        text("old_type").alias("old_type"), text("amount").alias("amount_text"),
        text("date").alias("date_text"), text("quarter").alias("quarter_text"), text("notes").alias("notes"),
        date.alias("date"), correct_year(year.try_cast("int"), date).alias("year"),
        to_double(text("amount")).try_cast(MONEY).alias("amount"), to_int(text("quarter")).alias("quarter"),
    )


def _field_checks() -> list:
    # Field constraint messages.
    n = F.col("src_row") + 2
    short = "String should have at least 1 character"
    number = "Decimal input should be an integer, float, string or Decimal object"
    out = []
    for name in ("entry_id", "description", "old_type"):
        out += [
            check(F.col(name).isNull(), "string_type", name, "Input should be a valid string", F.lit("None"), row_number=n),
            check(F.col(name) == "", "string_too_short", name, short, F.col(name), row_number=n),
        ]
    return out + [
        check(F.col("year").isNull(), "int_type", "year", "Input should be a valid integer",
              F.coalesce("year_text", F.lit("None")), row_number=n),
        check(F.col("amount").isNull(), "decimal_type", "amount", number,
              F.coalesce("amount_text", F.lit("None")), row_number=n),
        check(F.col("date").isNull(), "value_error", "date",
              F.concat(F.lit("Value error, Invalid date format: "), F.coalesce("date_text", F.lit("None")),
                       F.lit(". Expected formats: YYYY-MM-DD, YYYY/MM/DD, etc.")),
              F.coalesce("date_text", F.lit("None")), row_number=n),
        check(F.col("quarter_text").isNotNull() & F.col("quarter").isNull(), "int_parsing", "quarter",
              "Input should be a valid integer, unable to parse string as an integer", F.col("quarter_text"), row_number=n),
        check(F.col("quarter") < 1, "greater_than_equal", "quarter",
              "Input should be greater than or equal to 1", F.col("quarter_text"), row_number=n),
        check(F.col("quarter") > 4, "less_than_equal", "quarter",
              "Input should be less than or equal to 4", F.col("quarter_text"), row_number=n),
    ]


def field_issues(df: DataFrame, entry_id_column: str = "entry_id", src_row: str = "src_row") -> DataFrame:
    """Type and range problems of a raw journal table, several per row if need be."""
    return emit(_typed(df, entry_id_column, src_row), _field_checks())


def valid_rows(df: DataFrame, entry_id_column: str = "entry_id", src_row: str = "src_row") -> DataFrame:
    """The rows without such problems, typed, with the year corrected."""
    typed = _typed(df, entry_id_column, src_row)
    return typed.filter(~any_failed(_field_checks())).select(
        "src_row", "entry_id", "year", "description", "old_type", "amount", "date", "quarter", "notes")


COMPOSITE = ["year", "description", "date", "amount"]


def _with_group_key(entries: DataFrame) -> DataFrame:
    """Adds a digest of (year, description, date, amount), so that long texts are not shuffled to count."""
    parts = [F.col(c).cast("string") for c in COMPOSITE]
    return entries.withColumn("group_key", F.sha2(F.concat_ws("\u0001", *parts), 256))


def duplicate_groups(entries: DataFrame) -> DataFrame:
    """(year, description, date, amount) shared by more than one row: digest and size."""
    return _with_group_key(entries).groupBy("group_key").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")


def duplicate_members(entries: DataFrame) -> DataFrame:
    """Every row of every duplicate group, as rows: the complete list behind the messages."""
    return _with_group_key(entries).join(duplicate_groups(entries), "group_key").select(
        "group_key", "group_size", "src_row", "entry_id", *COMPOSITE)


def duplicate_row_issues(entries: DataFrame) -> DataFrame:
    """One issue per row of a duplicate group, named by the group's size and key.

    The other rows of the group are those of `duplicate_members` with that key.
    """
    others = F.concat((F.col("group_size") - 1).cast("string"), F.lit(" rows of group "), F.col("group_key"))
    return emit(duplicate_members(entries), [check(
        F.lit(True), "duplicate_entry", "composite_key",
        F.concat(F.lit("Duplicate entry found. Same (year, description, date, amount) as other entries: "), others),
        F.concat(F.lit("year="), F.col("year").cast("string"), F.lit(", description="), F.col("description"),
                 F.lit(", date="), F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.lit(", amount="),
                 F.col("amount").cast("string")))])


def duplicate_id_issues(entries: DataFrame) -> DataFrame:
    """One issue per occurrence of an entry id after its first.

    The first row per id is a partially aggregated minimum, so a hot id never sits in one window. Repeated ids are
    written once, so that the entries are not shuffled again where these are few.
    """
    again = settle(entries.groupBy("entry_id").agg(
        F.min("src_row").alias("first_row"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated")
    rows = entries.join(again, "entry_id").filter(F.col("src_row") > F.col("first_row"))
    return emit(rows, [check(
        F.lit(True), "duplicate_entry", "entry_id",
        F.concat(F.lit("Duplicate entry ID '"), F.col("entry_id"), F.lit("'. Each entry must have a unique ID.")),
        F.col("entry_id"))])


def _business_checks(as_of: Column) -> list:
    return [
        check(F.col("amount") == 0, "zero_amount", "amount",
              "Amount is zero. Please verify this is intentional.", F.col("amount"), "warning"),
        check(F.abs("amount") > LARGE_AMOUNT, "large_amount", "amount",
              F.concat(F.lit("Amount "), F.col("amount").cast("string"),
                       F.lit(" is very large (> 1 billion). Please verify this is correct.")),
              F.col("amount"), "warning"),
        check(F.col("date") > as_of, "future_date", "date",
              F.concat(F.lit("Date "), F.date_format("date", "yyyy-MM-dd"),
                       F.lit(" is in the future. Please verify this is correct.")),
              F.date_format("date", "yyyy-MM-dd HH:mm:ss"), "warning"),
    ]


def business_warnings(entries: DataFrame, as_of: Column) -> DataFrame:
    """Zero amounts, amounts above a billion, dates after `as_of`."""
    return emit(entries, _business_checks(as_of))


def _blank_checks() -> list:
    return [
        check(blank(F.col("description")), "missing_field", "description", "Description cannot be empty", F.col("description")),
        check(blank(F.col("old_type")), "missing_field", "old_type", "Old type cannot be empty", F.col("old_type")),
    ]


def blank_issues(entries: DataFrame) -> DataFrame:
    return emit(entries, _blank_checks())


def mixed_period_warnings(entries: DataFrame) -> DataFrame:
    """One table-level warning when rows span several years, one for several quarters.

    The sets are bounded: at most 101 years and 4 quarters.
    """
    sets = entries.select("year", "quarter").distinct().agg(F.sort_array(F.collect_set("year")).alias("years"),
                       F.sort_array(F.collect_set("quarter")).alias("quarters"))

    def spans(field, column, kind):
        listed = F.concat(F.lit("["), F.array_join(F.col(column).cast("array<string>"), ", "), F.lit("]"))
        return check(F.size(column) > 1, kind, field,
                     F.concat(F.lit(f"Entries span multiple {column}: "), listed,
                              F.lit(". Please verify this is intentional.")), listed, "warning")

    return emit(sets, [spans("year", "years", "mixed_years"), spans("quarter", "quarters", "mixed_quarters")],
                F.lit(None), F.lit(None))


def _with_named_type(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds whether a rule names the type; always true when there are no rules to compare with."""
    types = rules.filter(F.col("old_type").isNotNull()).select("old_type").distinct().withColumn("named", F.lit(True))
    no_rules = rules.agg(F.count(F.lit(1)) == 0).scalar()
    return entries.join(sized(types), "old_type", "left").withColumn("named", F.coalesce("named", no_rules))


def _unmatched_type_check() -> tuple:
    return check(
        ~F.col("named"), "unmatched_type", "old_type",
        F.concat(F.lit("Old type '"), F.col("old_type"),
                 F.lit("' in entry does not match any mapping rule. Entry may not be processed correctly.")),
        F.col("old_type"))


def unmatched_type_issues(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """One issue per entry whose type no rule names."""
    return emit(_with_named_type(entries, rules), [_unmatched_type_check()])


def validate_inputs(entries: DataFrame, rules: DataFrame, accounts: DataFrame | None, as_of: Column) -> DataFrame:
    """All input checks as one issue table; the input is valid when it holds no errors.

    The checks that look at one row share a scan; repeated ids and mixed periods aggregate.
    """
    checks = [*_business_checks(as_of), *_blank_checks(), _unmatched_type_check()]
    return union_all([
        rule_table_issues(rules, accounts), emit(_with_named_type(entries, valid_rules(rules)), checks),
        duplicate_id_issues(entries), mixed_period_warnings(entries),
    ])


def is_valid(issues: DataFrame) -> bool:
    return issues.filter(F.col("kind") == "error").limit(1).count() == 0


def processed_counts(issues: DataFrame, entries: DataFrame, rules: DataFrame,
                     entry_prefix: str = "JE-", rule_prefix: str = "R-") -> DataFrame:
    """Valid rows plus issues that name an entry or a rule by its prefix, and issue counts."""
    error = F.col("kind") == "error"
    n_entries = entries.agg(F.count(F.lit(1))).scalar()
    n_rules = rules.agg(F.count(F.lit(1))).scalar()
    return issues.agg(
        F.count_if(error & F.startswith("entry_id", F.lit(entry_prefix))).alias("e"),
        F.count_if(error & F.startswith("entry_id", F.lit(rule_prefix))).alias("r"),
        F.count_if(error).alias("error_count"), F.count_if(~error).alias("warning_count"),
    ).select((F.col("e") + n_entries).alias("entries_processed"), (F.col("r") + n_rules).alias("rules_processed"),
             "error_count", "warning_count")
