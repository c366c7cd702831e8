"""Importance resampling towards a target distribution, on CRC buckets of word windows.

Texts are lower-cased in ASCII and cut into words with offsets by an untrained pre-tokenizer, a regular expression split.
Windows of neighbouring offset pairs are the features; the CRC-32 of a feature names its bucket. The buckets of all
documents and of all target texts are counted; a bucket's gain is the logarithm of the smoothed ratio of its shares, and a
document's weight is the mean gain of its features. Weights with Gumbel noise draw documents without replacement.

Each text is read once: its buckets are written to the shared folder, and both counting and weighing start from there.
"""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

BUCKETS = 10_000
#: Words of the longest feature.
LONGEST = 1
SEED = 2024
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
#: Hundredths of the documents with enough words that are drawn.
PERCENT = 10
#: Fixed value: what a word is made of.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a text that are split at a time, to the end of a word.
AT_ONCE = 1 << 18
#: Bytes of answers that go together, and features whose bucket a task remembers.
TOGETHER, REMEMBERED = 1 << 22, 400_000

#: What stands between words, before the text is in lower case.
_BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
READ = "doc_id long, n_words long, n_features long, buckets binary"


def _portions(data: bytes):
    """A text in lower case, in portions that end between words."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > AT_ONCE:
            found = _BETWEEN.search(data, at + AT_ONCE)
            end = found.start() if found else end
        yield data[at:end].lower().decode("utf-8", "replace")
        at = end


class Features:
    """Buckets of the features of texts."""

    def __init__(self, longest: int = LONGEST, buckets: int = BUCKETS):
        from tokenizers import Regex, pre_tokenizers
        self.split = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
        self.longest, self.buckets = longest, buckets
        self.known: dict[str, int] = {}

    def _bucket(self, feature: str) -> int:
        found = self.known[feature] = zlib.crc32(feature.encode()) % self.buckets
        return found

    def of(self, data: bytes) -> tuple[int, np.ndarray]:
        """(words, buckets of all features) of a text in UTF-8."""
        n_words, out, carried = 0, [], []
        for text in _portions(data):
            words = [text[start:end] for _, (start, end) in self.split.pre_tokenize_str(text)]
            n_words += len(words)
            words = carried + words
            for size in range(1, self.longest + 1):
                # Windows that end in this portion; shorter ones within the carried words are counted already.
                first = max(0, len(carried) - size + 1)
                windows = words[first:] if size == 1 else [" ".join(words[i:i + size]) for i in range(first, len(words) - size + 1)]
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                get = self.known.get
                out.append(np.array([b if (b := get(w)) is not None else self._bucket(w) for w in windows], dtype="<u4"))
            carried = words[max(0, len(words) - self.longest + 1):]
        return n_words, np.concatenate(out) if out else np.zeros(0, dtype="<u4")


def _read(longest: int, buckets: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())])

    def run(batches):
        features = Features(longest, buckets)
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                n_words, found = features.of(text.as_py() or b"")
                rows.append((doc.as_py(), n_words, len(found), found.tobytes()))
                held += 4 * len(found)
                if held >= TOGETHER:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def features(texts: DataFrame, id_col: str, text_col: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets) per row; `buckets` holds a little-endian 32-bit number per feature."""
    rows = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_read(longest, buckets), READ)


def _histogram(buckets: int):
    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_py(), dtype="<u4"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some), "n": pa.array(total[some])})
    return run


def histogram(read: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket over all rows; tasks send one count per bucket."""
    counts = read.where("n_features > 0").select("buckets").mapInArrow(_histogram(buckets), "bucket long, n long")
    found = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of a bucket's smoothed shares of the target and of the source, rounded down."""
    size, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_source + size) / ((s + 1.0) * (all_target + size))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def _weighed(gain: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches):
        for batch in batches:
            sums = [int(gain[np.frombuffer(v.as_py(), dtype="<u4")].sum()) for v in batch.column(3)]
            weights = [s // n if n else 0 for s, n in zip(sums, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], schema=schema)
    return run


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of standard Gumbel noise, rounded down, from the seed and the id; a null id is the empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def numbered(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """The rows with 1, 2, 3, ... in an order without ties, by ranges: no window holds more than one range's count."""
    place = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_place", 33)
    sizes = place.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row per range
    inside = F.col("_place") - F.shiftleft(part, 33)
    return place.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + inside + 1).drop("_part", "_place", "_before")


def draw(scored: DataFrame, k: int) -> DataFrame:
    """(_row, rank) of the k rows with the highest `score`, equal ones by `doc_id`, then by `_row`, which is unique."""
    counts = scored.groupBy("score").agg(F.count("*").alias("n"))
    reached = F.sum("n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1))  # a row per score: logarithms of counts
    bar = counts.withColumn("above", F.coalesce(reached, F.lit(0))).where(F.col("above") < k).agg(F.min("score")).first()[0]
    chosen = scored.where(F.col("score") >= F.lit(bar).cast("long")).select("score", "doc_id", "_row")
    return numbered(chosen, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]).where(F.col("rank") <= k).select("_row", "rank")


def sample(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
           longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) per document; `rank` is null where it is not drawn.

    A null or empty text has no words, no features and weight 0. Rows that repeat an id have the same noise; where all else
    is equal too, any order of them is a right one. A null id is ranked after others of its score. Without documents
    there are no rows, without target texts the weights favour rare buckets. Further columns are not read.
    """
    read = stage(features(docs, id_col, text_col, longest, buckets), "features")
    aim = features(targets.select(F.lit(None).cast("long").alias("_none"), target_text_col), "_none", target_text_col, longest, buckets)
    gain = gains(histogram(read, buckets), histogram(aim, buckets))
    weighed = read.mapInArrow(_weighed(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = stage(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("_row", F.monotonically_increasing_id()), "scored")
    enough = scored.where(F.col("n_words") >= least_words)
    ranks = draw(enough, percent * enough.count() // 100)
    return scored.join(ranks, "_row", "left").drop("_row")
