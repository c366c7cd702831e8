"""Fix suggestions for mistyped journal types and account codes, by equality joins."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that are taken for one another.
CONFUSED_FROM, CONFUSED_TO = "0152", "OISZ"
MASK = "\u0001"


def _unified(text: Column) -> Column:
    return F.translate(F.upper(text), CONFUSED_FROM, CONFUSED_TO)


def _differences(a: Column, b: Column) -> Column:
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda acc, d: acc + d)


def type_fixes(values: DataFrame, known_types: DataFrame) -> DataFrame:
    """(value) -> the first known type that differs in case, or in one confusable character.

    `known_types` has (ord, known_type). Both kinds of difference vanish in upper case with the
    confusable characters unified, so candidates come from one equality join.
    """
    wanted = values.select("value").distinct().withColumn("unified", _unified(F.col("value")))
    known = known_types.withColumn("unified", _unified(F.col("known_type")))
    pairs = wanted.join(known, "unified").filter(F.col("value") != F.col("known_type")).withColumn(
        "n_diff", _differences(F.upper("value"), F.upper("known_type"))).filter(
        (F.col("n_diff") == 0) | ((F.col("n_diff") == 1) & (F.char_length("value") == F.char_length("known_type"))))
    best = pairs.groupBy("value").agg(F.min(F.struct("ord", "known_type", "n_diff")).alias("b"))
    case_only = F.col("b.n_diff") == 0
    quoted = F.concat(F.lit("'"), F.col("value"), F.lit("' should be '"), F.col("b.known_type"), F.lit("'"))
    return best.select(
        "value", F.col("b.known_type").alias("suggested_value"), F.lit("high").alias("confidence"),
        F.concat(F.when(case_only, "Case mismatch: ").otherwise("Likely typo: "), quoted).alias("fix_reason"))


def case_fixes(values: DataFrame, known_types: DataFrame) -> DataFrame:
    """(value) -> the first known type that differs in case only, for any other field."""
    wanted = values.select("value").distinct().withColumn("u", F.upper("value")).withColumn("l", F.lower("value"))
    known = known_types.withColumn("u", F.upper("known_type")).withColumn("l", F.lower("known_type"))
    best = wanted.join(known, ["u", "l"]).filter(F.col("value") != F.col("known_type")).groupBy("value").agg(
        F.min_by("known_type", "ord").alias("suggested_value"))
    return best.select(
        "value", "suggested_value", F.lit("medium").alias("confidence"),
        F.concat(F.lit("Case mismatch: standardize to '"), F.col("suggested_value"), F.lit("'")).alias("fix_reason"))


def _masks(text: Column) -> Column:
    """The text with each character hidden in turn: equal masks mean at most one difference."""
    places = F.sequence(F.lit(1), F.char_length(text))
    return F.transform(places, lambda i: F.concat(
        F.substr(text, F.lit(1), i - 1), F.lit(MASK), F.substr(text, i + 1)))


def account_fixes(values: DataFrame, accounts: DataFrame) -> DataFrame:
    """(value) -> a code that differs in case (high), else the only code one character away (medium).

    Several close codes give no suggestion. Closeness is an equality join on masked texts. Masks are a row per character,
    which no estimate of a plan foresees, so these joins are sorted, never broadcast.
    """
    wanted = values.select("value").distinct()
    codes = accounts.groupBy("code").agg(F.min("ord").alias("ord"))
    cased = wanted.withColumn("u", F.upper("value")).join(codes.withColumn("u", F.upper("code")).hint("merge"), "u").filter(
        F.col("value") != F.col("code")).groupBy("value").agg(F.min_by("code", "ord").alias("cased"))

    def masked(df, column):
        return df.withColumn("mask", F.explode(_masks(F.lower(column))))

    close = masked(wanted.filter("value != ''"), "value").join(masked(codes, "code").hint("merge"), "mask").select(
        "value", "code").distinct().groupBy("value").agg(
        F.count(F.lit(1)).alias("n_close"), F.min("code").alias("only"))
    found = wanted.join(cased, "value", "left").join(close, "value", "left")
    pick = F.coalesce(F.col("cased"), F.when(F.col("n_close") == 1, F.col("only")))
    by_case = F.col("cased").isNotNull()
    reason = F.when(by_case, F.concat(F.lit("Case mismatch: '"), F.col("value"), F.lit("' should be '"), pick, F.lit("'"))) \
        .otherwise(F.concat(F.lit("Close match found: '"), F.col("value"), F.lit("' is similar to '"), pick,
                            F.lit("' (typo likely)")))
    return found.withColumn("suggested_value", pick).filter(F.col("suggested_value").isNotNull()).select(
        "value", "suggested_value", F.when(by_case, "high").otherwise("medium").alias("confidence"),
        reason.alias("fix_reason"))


def suggest_fixes(detected: DataFrame, known_types: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Suggestions per detected issue. Type fields try types, then any field tries case, then accounts."""
    field = F.lower("field_name")
    texts = detected.filter(F.coalesce(F.col("actual_value") != "", F.lit(False)))
    wanted = texts.select(F.col("actual_value").alias("value"))

    def tagged(df, rank):
        return df.select(F.col("value").alias("actual_value"), F.struct(
            F.lit(rank).alias("rank"), "suggested_value", "confidence", "fix_reason").alias(f"f{rank}"))

    out = texts.join(tagged(type_fixes(wanted, known_types), 1), "actual_value", "left").join(
        tagged(case_fixes(wanted, known_types), 2), "actual_value", "left")
    options = [F.when(field.contains("type"), F.col("f1")), F.col("f2")]
    if accounts is not None:
        coded = texts.filter(field.contains("account_code")).select(F.col("actual_value").alias("value"))
        out = out.join(tagged(account_fixes(coded, accounts), 3), "actual_value", "left")
        options.append(F.when(field.contains("account_code"), F.col("f3")))
    return out.withColumn("fix", F.coalesce(*options)).filter(F.col("fix").isNotNull()).select(
        "src_row", "entry_id", "rule_id", "field_name", F.col("actual_value").alias("before_value"),
        F.col("fix.suggested_value").alias("after_value"), F.col("fix.confidence").alias("confidence"),
        F.col("fix.fix_reason").alias("fix_reason"), F.lit(True).alias("requires_approval"),
        F.lit("Pending").alias("approval_status"))
