"""Join on "the long text contains the short text" without comparing all pairs.

Every needle is looked up by one of its pieces, the one that the fewest texts have. How many have it is counted first, for
pieces of needles only. Where even the rarest piece of three characters is in too many texts, the needle's pieces grow
to six, twelve, ... characters, at last to the whole needle, whose texts are those to be found.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizing import fits, sized
from .staging import settle

GRAM = 3
#: A piece of a needle that more texts have grows, as long as the needle allows.
HOT = 256


def _with_pieces(df: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """A row per row and different piece `_piece` of these numbers of characters.

    Pieces are made of pairs of shorter ones, so that a text is read from its start only once.
    """
    out, made, columns = df.withColumn("_chars1", F.split(F.col(text), "")), [1], df.columns

    def grow(size: int) -> None:
        nonlocal out
        if size in made:
            return
        if 2 * max(m for m in made if m < size) < size:
            grow(-(-size // 2))
        half = max(m for m in made if m < size)
        shift, short = size - half, F.col(f"_chars{half}")
        n = F.greatest(F.size(short) - shift, F.lit(0))
        out = out.withColumn(f"_chars{size}", F.zip_with(
            F.slice(short, F.lit(1), n), F.slice(short, F.lit(shift + 1), n),
            lambda a, b: F.concat(a, F.substring(b, half - shift + 1, shift))))
        made.append(size)

    for size in sorted(sizes):
        grow(size)
    pieces = F.array_distinct(F.concat(*[F.col(f"_chars{size}") for size in sizes]))
    return out.select(*columns, F.explode(pieces).alias("_piece")).filter(F.col("_piece") != "")


def _own_size(needle: str, size: int) -> Column:
    return F.least(F.char_length(needle), F.lit(size))


def _chosen(texts: DataFrame, text: str, needles: DataFrame, needle: str, hot: int) -> tuple[DataFrame, list[int]]:
    """(needle, _piece, _texts) and the sizes of the pieces. Tables of needles are written once, so joins know their size."""
    pending = settle(needles.select(needle).filter(F.char_length(needle) > 0).distinct(), "needles")
    chosen = pending.limit(0).select(needle, F.lit(None).cast("string").alias("_piece"), F.lit(None).cast("bigint").alias("_texts"))
    size, used = GRAM, set()
    sizes = pending.agg(F.collect_set(_own_size(needle, size))).first()[0]
    while sizes:
        asked = settle(_with_pieces(pending, needle, sizes).filter(F.char_length("_piece") == _own_size(needle, size)), "pieces")
        wanted = asked.select("_piece").distinct()
        counts = _with_pieces(texts.select(text), text, sizes).join(F.broadcast(wanted) if fits(asked) else wanted, "_piece", "left_semi")
        counts = counts.groupBy("_piece").agg(F.count(F.lit(1)).alias("_texts"))
        best = asked.join(counts, "_piece", "left").groupBy(needle).agg(
            F.min(F.struct("_texts", "_piece")).alias("best"), F.min(F.col("_texts").isNotNull()).alias("possible"))
        rated = settle(best.filter("possible").select(needle, "best.*"), "rated")
        grows = (F.col("_texts") > hot) & (F.char_length(needle) > size)
        chosen = chosen.unionByName(rated.filter(~grows).select(needle, "_piece", "_texts"))
        pending = rated.filter(grows).select(needle)
        size *= 2
        row = rated.agg(F.collect_set(F.when(~grows, F.char_length("_piece"))), F.collect_set(F.when(grows, _own_size(needle, size)))).first()
        used |= set(row[0])
        sizes = row[1]
    return chosen, sorted(used)


def rarest_pieces(texts: DataFrame, text: str, needles: DataFrame, needle: str, hot: int = HOT) -> DataFrame:
    """(needle, _piece, _texts): the piece by which each needle is looked up and how many texts have it.

    Needles that no text can contain are left out.
    """
    return _chosen(texts, text, needles, needle, hot)[0]


def candidate_pairs(texts: DataFrame, key: str, text: str, needles: DataFrame, needle: str, hot: int = HOT) -> DataFrame:
    """(key, needle) wherever a text has the piece by which the needle is looked up."""
    chosen, sizes = _chosen(texts, text, needles, needle, hot)
    if not sizes:
        return texts.select(key).join(chosen.select(needle), F.lit(False))
    return _with_pieces(texts.select(key, text), text, sizes).select(key, "_piece").join(sized(chosen), "_piece").select(key, needle)


def containing_pairs(texts: DataFrame, key: str, text: str, needles: DataFrame, needle: str, hot: int = HOT) -> DataFrame:
    """(key, columns of `needles`) for every needle inside a text; texts are unique by key.

    Candidates come from an equality join on one piece of each needle, without the texts; contains() then decides on
    each. A null or empty needle, and a null text, is in no pair.
    """
    needle_key = f"_needle_{needle}"
    own = needles.select(F.col(needle).alias(needle_key))
    found = candidate_pairs(texts.select(key, F.col(text).alias("_text")), key, "_text", own, needle_key, hot)
    found = found.join(texts.select(key, F.col(text).alias("_text")), key).filter(F.col("_text").contains(F.col(needle_key)))
    return found.select(key, needle_key).join(needles, F.col(needle_key) == F.col(needle)).select(key, *needles.columns)
