"""Removal of boilerplate lines that spread over many sites.

Lines are compared without white space at their ends, A-Z as a-z, by a 128-bit hash. Per line hash a HyperLogLog
sketch of sites is built by aggregation (tasks send partial sketches, so a line that fills a third of all rows is
as cheap as any). Sketches that put a line clearly beyond or below `min_sites` decide; lines near the threshold get
their sites counted exactly. A lower bar can be set for long lines, which recur by no chance. The first occurrence of a boilerplate line, by document id and place, is kept, so that
no text leaves the corpus altogether.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: A line on this many sites is boilerplate.
MIN_SITES = 10
#: A line of this many words or more, by white space, is a passage. On how many sites it is boilerplate is `passage_sites`.
PASSAGE_WORDS = 20
#: Base-2 logarithm of a sketch's registers; the relative error is about 1.04 / sqrt(2^this).
PRECISION = 12


def line_key(line: Column) -> Column:
    """What lines are compared by."""
    return F.translate(F.btrim(line, F.lit(" \t\r\f\x0b")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores until no column has it."""
    while name in df.columns:
        name += "_"
    return name


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int, passage_sites: int | None) -> DataFrame:
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("version"), F.col(site_col).cast("string").alias("site"),
        F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))
    key = line_key(F.col("line"))
    bar = F.lit(min_sites)
    if passage_sites is not None:
        bar = F.when(F.size(F.split(key, r"\s+")) >= PASSAGE_WORDS, passage_sites).otherwise(bar)
    return rows.where(key != "").select("id", "version", "site", "place", F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"), bar.alias("bar"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, precision: int = PRECISION) -> DataFrame:
    """(a, b, id, place): line hashes on `bar` sites or more, and the first occurrence of each.

    No bar is above `min_sites`. Sites without a name count as none.
    """
    spread = lines.groupBy("a", "b").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", precision)).alias("sites"), F.min(F.struct("id", "place")).alias("first"), F.min("bar").alias("bar"))
    margin = max(2, math.ceil(min_sites * 4 * 1.04 / math.sqrt(1 << precision)))
    spread = stage(spread.where(F.col("sites") >= F.col("bar") - margin), "spread")
    near = spread.where(F.col("sites") <= F.col("bar") + margin)
    exact = (lines.join(near.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b", "site").agg(F.lit(1))
             .groupBy("a", "b").agg(F.count("site").alias("counted")))
    sure = spread.where(F.col("sites") > F.col("bar") + margin).select("a", "b", "first")
    found = sure.union(near.join(exact, ["a", "b"]).where(F.col("counted") >= F.col("bar")).select("a", "b", "first"))
    return found.select("a", "b", F.col("first.id").alias("id"), F.col("first.place").alias("place"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                       min_sites: int = MIN_SITES, precision: int = PRECISION, passage_sites: int | None = None) -> DataFrame:
    """`docs` with boilerplate lines taken out of the text, and `n_lines`, `n_removed` (with underscores if taken).

    Lines end at newlines; blank lines stay. A null text stays null with no lines; a text of which all lines go
    becomes empty. With `passage_sites`, this many sites are enough for a line of PASSAGE_WORDS. Rows that repeat an id and a text lose the same lines. Rows without id take part like others.
    """
    passage_sites = None if passage_sites is None else min(passage_sites, min_sites)
    lines = _lines(docs, id_col, text_col, site_col, min_sites, passage_sites)
    known = stage(boilerplate(lines, min_sites, precision), "boilerplate").select(
        "a", "b", F.col("id").alias("first_id"), F.col("place").alias("first_place"))
    gone = (lines.join(known, ["a", "b"]).where(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("place") == F.col("first_place"))))
            .groupBy("id", "version").agg(F.collect_set("place").alias("gone")))
    n_lines, n_removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("version", F.xxhash64("text"))
    met = rows.alias("r").join(gone.alias("g"), F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.version") == F.col("g.version")), "left")
    parts = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    report = [F.coalesce(F.size(parts), F.lit(0)).cast("long").alias(n_lines), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(n_removed)]
    columns = [clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return met.select(*columns, F.when(F.col("text").isNull(), 0).otherwise(report[0]).cast("long").alias(n_lines),
                      F.when(F.col("gone").isNull(), 0).otherwise(report[1]).cast("long").alias(n_removed))
