"""Journal types: remapping by year and inference from rule keywords."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.conditions import KEYWORD
from ..functions.containment import containing_pairs
from ..functions.staging import settle
from ..functions.sizing import fits
from ..schemas import MISSING_TYPE, REMAP_FLOOR_YEAR

AUTO_CONFIDENCE = 0.8
SINGLE_KEYWORD_CONFIDENCE = 0.65
MAX_KEYWORDS = 500
HINT = "[型别建议/Type suggestion:"


def remap_types(journal: DataFrame, type_map: DataFrame, floor_year: int = REMAP_FLOOR_YEAR) -> DataFrame:
    """New type of the same year, else of the latest earlier year from the floor on, else unchanged.

    The map keeps one array of at most 101 years per type, so the journal is matched by type and
    the year is found inside the row.
    """
    years = type_map.groupBy(F.col("old_type").alias("raw_type")).agg(
        F.sort_array(F.collect_list(F.struct("year", "new_type")), asc=False).alias("by_year"))
    side = F.broadcast(years) if fits(type_map) else years

    def usable(m):
        return (m["year"] == F.col("year")) | (
            (m["year"] < F.col("year")) & (m["year"] >= floor_year))

    found = F.get(F.filter("by_year", usable), F.lit(0))["new_type"]
    columns = [F.coalesce(found, F.col("old_type")).alias("old_type") if c == "old_type" else F.col(c)
               for c in journal.columns]
    return journal.withColumn("raw_type", strip("old_type")).join(side, "raw_type", "left").select(*columns)


def keyword_index(rules: DataFrame) -> DataFrame:
    """(keyword, old_type, kw_ord, type_ord) in the order in which the rules introduce them."""
    found = rules.filter(
        (strip("old_type") != "") & (strip("old_type") != MISSING_TYPE)
    ).select(
        strip("old_type").alias("old_type"), "rule_ord",
        F.posexplode(F.regexp_extract_all("condition", F.lit(KEYWORD), F.lit(1))).alias("pos", "keyword"),
    ).withColumn("keyword", strip("keyword")).filter(F.col("keyword") != "")
    at = F.struct("rule_ord", "pos")
    types = found.groupBy("keyword", "old_type").agg(F.min(at).alias("type_ord"))
    keywords = found.groupBy("keyword").agg(F.min(at).alias("kw_ord"))
    return types.join(keywords, "keyword")


def _reason(words: Column) -> Column:
    more = F.when(F.size(words) > 3, F.concat(F.lit(" 等（共 "), F.size(words).cast("string"), F.lit(" 个）")))
    return F.concat(F.lit("关键词匹配 / Keyword match: "), F.array_join(F.slice(words, 1, 3), "、"),
                    F.coalesce(more, F.lit("")))


def _suggestion(best: Column, total: Column) -> Column:
    """Struct of the winning type; a single keyword is never confident."""
    share = best["votes"] / total
    words = F.transform(best["hits"], lambda h: h["keyword"])
    return F.when(best.isNotNull(), F.struct(
        best["old_type"].alias("suggested_type"), best["votes"].alias("votes"), total.alias("total_votes"),
        F.when(best["votes"] == 1, F.least(share, F.lit(SINGLE_KEYWORD_CONFIDENCE))).otherwise(share).alias("confidence"),
        words.alias("matched_keywords"), _reason(words).alias("reason")))


def suggest(df: DataFrame, index: DataFrame, max_keywords: int = MAX_KEYWORDS, only: Column | None = None) -> DataFrame:
    """Adds `suggestion` (NULL without any keyword, or where `only` is false): most votes, then the keyword that comes first.

    A measured-small keyword index travels to the rows as one value and every row votes alone.
    A larger one is joined to the distinct descriptions, which are named by digest.
    """
    if fits(index, max_keywords):
        return _suggest_in_row(df, index, F.lit(True) if only is None else only)
    return _suggest_by_join(df, index, F.lit(True) if only is None else only)


def _hit() -> Column:
    return F.struct("kw_ord", "type_ord", "keyword")


def _suggest_in_row(df: DataFrame, index: DataFrame, only: Column) -> DataFrame:
    per_type = index.groupBy("old_type").agg(F.sort_array(F.collect_list(_hit())).alias("keywords"))
    ballot = per_type.agg(F.collect_list(F.struct("old_type", "keywords")))

    def count(t):
        hits = F.filter(t["keywords"], lambda k: F.col("description").contains(k["keyword"]))
        return F.struct(
            (-F.size(hits)).alias("by_votes"), F.get(hits, F.lit(0)).alias("first_seen"), t["old_type"].alias("old_type"),
            F.size(hits).cast("bigint").alias("votes"), hits.alias("hits"))

    votes = F.when(only, F.filter(F.transform("_ballot", count), lambda v: v["votes"] > 0))
    rows = df.withColumn("_ballot", ballot.scalar()).withColumn("_votes", votes).drop("_ballot")
    total = F.aggregate("_votes", F.lit(0).cast("bigint"), lambda acc, v: acc + v["votes"])
    rows = rows.withColumns({"_best": F.array_min("_votes"), "_total": total}).drop("_votes")
    return rows.withColumn("suggestion", _suggestion(F.col("_best"), F.col("_total"))).drop("_best", "_total")


def _suggest_by_join(df: DataFrame, index: DataFrame, only: Column) -> DataFrame:
    rows = df.withColumn("_digest", F.when(only, F.sha2("description", 256)))
    texts = settle(rows.filter("_digest is not null").groupBy("_digest").agg(F.first("description").alias("description")), "texts")
    needles = index.select("keyword").distinct()
    pairs = containing_pairs(texts, "_digest", "description", needles, "keyword")
    votes = pairs.join(index, "keyword").groupBy("_digest", "old_type").agg(
        F.count(F.lit(1)).alias("votes"), F.sort_array(F.collect_list(_hit())).alias("hits"))
    best = votes.groupBy("_digest").agg(
        F.sum("votes").alias("total"),
        F.min(F.struct((-F.col("votes")).alias("by_votes"), F.get("hits", F.lit(0)).alias("first_seen"),
                       "old_type", "votes", "hits")).alias("best"))
    found = best.select("_digest", _suggestion(F.col("best"), F.col("total")).alias("suggestion"))
    return rows.join(found, "_digest", "left").drop("_digest")


def is_missing_type() -> Column:
    return strip("old_type") == MISSING_TYPE


def infer_types(journal: DataFrame, rules: DataFrame, max_keywords: int = MAX_KEYWORDS) -> DataFrame:
    """Confident suggestions become the type; the others become a hint in the notes.

    Only rows without a type vote; the others pass untouched, in the same pass.
    """
    index = keyword_index(rules)
    confidence, kind = F.col("suggestion.confidence"), F.col("suggestion.suggested_type")
    hint = F.concat(
        F.lit(f"{HINT} "), kind, F.lit(" ("), F.format_string("%.0f%%", F.bround(confidence * 100, 0)),
        F.lit(") — "), F.col("suggestion.reason"), F.lit("]"))
    noted = F.when(F.coalesce(F.col("notes") == "", F.lit(True)), hint).otherwise(F.concat_ws(" ", hint, "notes"))

    rows = suggest(journal, index, max_keywords, is_missing_type())
    return rows.select(*[
        F.when(confidence >= AUTO_CONFIDENCE, kind).otherwise(F.col("old_type")).alias("old_type") if c == "old_type"
        else F.when(confidence < AUTO_CONFIDENCE, noted).otherwise(F.col("notes")).alias("notes") if c == "notes"
        else F.col(c)
        for c in journal.columns])
