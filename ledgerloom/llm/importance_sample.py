"""Quality selection by importance resampling.

Two generative models of hashed n-grams are counted: one of target texts, one of all raw texts. A document's weight
is the log-ratio of the probabilities that they give to its different n-grams. Adding Gumbel noise and keeping the
largest sums draws documents without replacement in proportion to their weights.

Most buckets differ between the models by chance only. A bucket counts where its target count is further than
CERTAIN standard deviations from what the raw model expects; the others say nothing.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_values, mix, stage, uniform, word_bounds, word_hashes

#: Hash buckets.
BUCKETS = 1 << 20
#: Words in a row that make an n-gram: 1 for words and signs alone, 2 for pairs of words too.
LONGEST = 1
#: Added to every count.
SMOOTH = 1.0
#: Standard deviations from which a difference of the models counts.
CERTAIN = 2.5
SEED = 20
#: Target texts that are used at most, on average.
TARGETS = 1 << 19

_IS_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_IS_SPACE = np.array([b <= 32 or b == 127 for b in range(256)])
_IS_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_VALUES = byte_values(11)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def gram_buckets(column, longest: int = LONGEST):
    """(row, buckets) of each text: a bucket for every word, run of signs and, with `longest` 2, pair of words.

    A word is a run of letters, digits and anything beyond ASCII; A-Z count as a-z, but a word whose second letter
    is a capital is another one.
    """
    for row, data, offsets in blocks(column):
        starts, ends, first = word_bounds(data, offsets, ~_IS_WORD)
        words = word_hashes(data, starts, ends, _VALUES)
        second = np.minimum(starts + 1, ends - 1)
        words = np.where(_IS_CAPITAL[data[second]] & (second > starts), mix(words + np.uint64(1)), words)
        signs, sign_ends, first_sign = word_bounds(data, offsets, _IS_WORD | _IS_SPACE)
        found = [(first, _bucket(words)), (first_sign, _bucket(mix(word_hashes(data, signs, sign_ends, _VALUES) + np.uint64(2))))]
        if longest > 1:
            pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
            found.append((np.maximum(first - 1, 0), _bucket(pairs)))
        for i in range(len(offsets) - 1):
            yield row + i, np.concatenate([x[f[i]:f[i + 1]] for f, x in found])


def _counted(longest: int):
    """Counts by bucket of a task's raw and target texts."""
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def run(batches):
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            held: tuple[list, list] = ([], [])
            for row, buckets in gram_buckets(batch.column(0), longest):
                held[int(wanted[row])].append(buckets)
                if len(held[0]) + len(held[1]) >= 500:
                    _add(raw, target, held)
                    held = ([], [])
            _add(raw, target, held)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], schema=schema)
    return run


def _add(raw: np.ndarray, target: np.ndarray, held) -> None:
    for parts, models in ((held[0], (raw,)), (held[1], (raw, target))):
        if parts:
            buckets, counts = np.unique(np.concatenate(parts), return_counts=True)
            for model in models:
                model[buckets] += counts


def log_ratios(docs: DataFrame, is_target: Column, text_col: str = "text", longest: int = LONGEST) -> np.ndarray:
    """log(p_target / p_raw) of each bucket, from all texts; zeros where it is not certain or there is no target text."""
    rows = docs.select(F.col(text_col).cast("binary").alias("text"), F.coalesce(is_target, F.lit(False)).alias("target"))
    counts = rows.mapInArrow(_counted(longest), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    target[counts.column("bucket").to_numpy()] = counts.column("target").to_numpy()
    raw[counts.column("bucket").to_numpy()] = counts.column("raw").to_numpy()
    if not target.any():
        return np.zeros(BUCKETS)
    expected = raw * (target.sum() / raw.sum())
    certain = np.abs(target - expected) >= CERTAIN * np.sqrt(expected + SMOOTH)
    return np.where(certain, np.log((target + SMOOTH) / (expected + SMOOTH)), 0.0)


def _weighed(ratios, longest: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_grams", pa.int64()), ("log_weight", pa.float64())])

    def run(batches):
        table = ratios.value
        for batch in batches:
            size, weight = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch))
            for row, buckets in gram_buckets(batch.column(1), longest):
                own = np.unique(buckets)
                size[row] = len(own)
                weight[row] = table[own].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(weight)], schema=schema)
    return run


def weights(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_grams, log_weight) per row: different n-grams and the sum of their log-ratios; 0 for a null or empty text."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_weighed(sent, longest), "doc_id long, n_grams long, log_weight double")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on the key and the seed only."""
    return -F.log(-F.log(uniform(key, seed)))


def largest(rows: DataFrame, column: str, k: int, tie: str = "doc_id") -> DataFrame:
    """The k rows with the largest numbers, equal ones by `tie`; nothing is sorted as a whole.

    Numbers become integers (steps of 2^-20, within 2^40 of 0), whose leading bits are counted 16 at a time to find
    the k-th. A null number counts as the least.
    """
    number = F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(None)), F.lit(-(2.0 ** 40)))
    place = F.floor(F.greatest(F.least(number, F.lit(2.0 ** 40)), F.lit(-(2.0 ** 40))) * F.lit(float(1 << 20))) + F.lit(1 << 61)
    rows = stage(rows.withColumn("_place", place.cast("long")), "ranked")
    known, left = rows, k
    for shift in (48, 32, 16, 0):
        counts = {r["digit"]: r["n"] for r in known.groupBy(F.shiftright("_place", shift).alias("digit")).agg(F.count("*").alias("n")).collect()}
        for digit in sorted(counts, reverse=True):
            if counts[digit] >= left:
                break
            left -= counts[digit]
        else:
            return rows.drop("_place")  # there are no more than k
        known = rows.where(F.shiftright("_place", shift) == digit)
    ties = known.orderBy(tie).limit(left) if counts[digit] > left else known
    return rows.where(F.col("_place") > digit).union(ties).drop("_place")


def sample(docs: DataFrame, targets: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, key): the k rows drawn, their log-weights and these with noise.

    `targets` names the target texts by id; at most TARGETS of them on average, chosen by hash, train the target
    model, so that they are found by a broadcast of bounded size. The raw model counts every text. Without target
    texts all weights are 0 and the draw is even. Rows that repeat an id get the same noise.
    """
    ids = targets.select(F.col(id_col).cast("long").alias("_target")).where("_target is not null").distinct()
    share = min(1.0, TARGETS / max(1, ids.count()))
    ids = ids.where(F.pmod(F.xxhash64(F.lit("target"), "_target"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("_target"), "left")
    ratios = log_ratios(marked, F.col("_target").isNotNull())
    weighed = weights(rows, ratios).withColumn("key", F.col("log_weight") + gumbel(F.coalesce("doc_id", F.lit(0)), seed))
    return largest(weighed, "key", k)
