"""Document fingerprints of spot signatures.

Common words are anchors. The chain of up to CHAIN content words that follows an anchor before the next one, with
the anchor, is a signature; a text's fingerprint is the set of their hashes. A long stretch without anchors, or a
text without any chain, gives its words instead, a text without words itself. Fingerprints are compared by Jaccard similarity; sets are partitioned by
their length, and only partitions whose lengths allow the threshold meet.

Everything is built-in functions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

#: Content words of a signature at most.
CHAIN = 3
#: Characters between two anchors from which a stretch gives its words.
STRETCH = 100

# Common words of English, German, French and Spanish.
ANCHORS = sorted(set((
    "the of and to in is was that it with on by at for from be or an a are this which as not but had his they have were "
    "der die das und in zu den ist von mit für auf ein eine im sich nicht als auch dem des es an werden aus er hat dass sie nach wird bei um am sind noch wie einem über "
    "de la le et les des en un du une que est pour qui dans par sur pas au avec ce il sont se ne plus "
    "el que los y las del se por con una su para es al lo como más o sus le ha no").split()))


def _alternatives(words) -> str:
    """A pattern of the words, those with the same first letter together."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" if rest != [""] else first for first, rest in by_first.items())


def signatures(text: Column, anchors=None, chain: int = CHAIN) -> Column:
    """Sorted distinct hashes of a text's signatures; empty for an empty text."""
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    marked = F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), f" ({_alternatives(ANCHORS if anchors is None else anchors)})(?= )", "\x01$1")
    parts = F.split(marked, "\x01", -1)

    def of_part(part: Column, number: Column) -> Column:
        chained = F.rtrim(F.substring_index(part, " ", chain + 1))
        return (F.when(F.length(part) > STRETCH, F.split(part, " ", -1)).when((number > 0) & (F.instr(chained, " ") > 0), F.array(chained))
                .otherwise(F.array().cast("array<string>")))
    found = F.array_distinct(F.transform(F.filter(F.flatten(F.transform(parts, of_part)), lambda c: c != ""), lambda c: F.hash(c)))
    plain = F.array_distinct(F.transform(F.filter(F.split(words, " ", -1), lambda w: w != ""), lambda w: F.hash(w)))
    plain = F.when(F.size(plain) > 0, plain).when(text != "", F.array(F.hash(text))).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.when(F.size(found) > 0, found).otherwise(plain))


def fingerprint(signs: Column) -> Column:
    """The signatures as one string."""
    return F.array_join(signs.cast("array<string>"), ",")


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Likeness of two sets of signatures, 1 for two empty ones; 0 without comparing where lengths rule out `least`."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    whole = shared / (F.size(a) + F.size(b) - shared).cast("double")
    return F.when(large == 0, 1.0).when((small == 0) | (small < least * large), 0.0).otherwise(whole)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(x, y, likeness): pairs of classes of equal fingerprints, named by their smallest id, at least `threshold` alike.

    Lengths fall into partitions so wide that only neighbours can reach the threshold. In each a set is listed under
    the first signatures by hash that any partner must share with it; whoever meets there is compared. Empty texts
    and rows without id have no partner.
    """
    sets = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), signatures(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("signs"))
    sets = stage(sets.where(F.size("signs") > 0).groupBy("signs").agg(F.min("id").alias("id")), "signatures")
    size = F.size("signs")
    band = F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / threshold)) + F.lit(1e-9))
    first = F.slice(F.sort_array(F.transform("signs", lambda s: F.hash(F.lit(1), s))), 1, size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1)
    listed = sets.select("id", size.alias("n"), F.explode(F.array(band, band + 1)).alias("band"), first.alias("first"))
    listed = listed.select("id", "n", "band", F.explode("first").alias("sign"))
    # all sets of a list meet each other where lengths allow it
    a, b = listed.select("band", "sign", F.col("id").alias("x"), F.col("n").alias("nx")), listed.select("band", "sign", F.col("id").alias("y"), F.col("n").alias("ny"))
    met = a.join(b, ["band", "sign"]).where((F.col("x") < F.col("y")) & (F.least("nx", "ny") >= F.lit(threshold) * F.greatest("nx", "ny"))).select("x", "y").distinct()
    pairs = met.join(sets.select(F.col("id").alias("x"), F.col("signs").alias("sx")), "x").join(sets.select(F.col("id").alias("y"), F.col("signs").alias("sy")), "y")
    return pairs.select("x", "y", jaccard(F.col("sx"), F.col("sy"), threshold).alias("likeness")).where(F.col("likeness") >= threshold)


def following(sizes: DataFrame) -> DataFrame:
    """(id, next): every id of `sizes` (distinct) with the next larger one, the smallest after the largest.

    Ranges of ids are sorted apart; the first ids of ranges, one row each, link them.
    """
    ranged = stage(sizes.select("id").repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ids")
    heads = ranged.groupBy("part").agg(F.min("id").alias("head"))
    every = W.partitionBy(F.lit(0)).orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(every), F.min("head").over(W.partitionBy(F.lit(0)))).alias("after"))
    within = ranged.withColumn("next", F.lead("id").over(W.partitionBy("part").orderBy("id")))
    return within.join(F.broadcast(heads), "part").select("id", F.coalesce("next", "after").alias("next"))  # a row per range


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """(id, text, signs, edited, next_signs) per row: the last 1/`share` of the characters replaced by as many (or all)
    first ones of the next document by id, and the signatures of the text and of the next one.

    A null text is empty. Rows that share an id have the same next document; among rows of the next id the smallest
    text counts. Rows without id have none, their edited text is only cut.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    cut = lambda c: F.floor(F.length(c) / share).cast("int")
    sizes = stage(base.where("id is not null").groupBy("id").agg(F.max(cut("text")).alias("take")), "sizes")
    order = following(sizes)
    wanted = stage(order.join(sizes, "id").select(F.col("next").alias("source"), F.col("id").alias("target"), "take"), "wanted")
    # Both sides of the last join read the same rows by id, so texts are signed and shuffled once.
    signed = base.where("id is not null").withColumn("signs", signatures(F.col("text")))
    sent = signed.join(wanted, F.col("id") == F.col("source")).select("target", F.struct(F.substring("text", F.lit(1), F.col("take")).alias("begin"), F.col("signs").alias("next_signs")).alias("sent"))
    sent = sent.groupBy("target").agg(F.min("sent").alias("sent"))
    rows = signed.join(sent, F.col("id") == F.col("target"), "left")
    kept = F.substring("text", F.lit(1), F.length("text") - cut("text"))
    edited = F.concat(kept, F.substring(F.coalesce(F.col("sent.begin"), F.lit("")), F.lit(1), cut("text")))
    found = rows.select("id", "text", "signs", edited.alias("edited"), F.col("sent.next_signs").alias("next_signs"))
    alone = base.where("id is null").select("id", "text", signatures(F.col("text")).alias("signs"), kept.alias("edited"), F.lit(None).cast("array<int>").alias("next_signs"))
    return found.union(alone)
