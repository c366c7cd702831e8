"""Periodic runs of words by an online sparse diagonal DP.

A run with period q is a stretch of words in which words q apart are identical. Reading a text word by word, every
earlier occurrence of the word at hand lies on a diagonal, its lag, and adds one to the match length of this lag; a lag
whose word differs ends, and if its length suffices a run is emitted there and then.

The table of active lags is sparse. A match at lag q makes a run of at least `shortest` words and two periods only if
it lasts max(q, shortest - q) words, so a lag enters the table only where an earlier occurrence of that many words in
a row stands at this distance. These occurrences are found by names of windows: equal numbers for equal windows of k
words, k doubling, each made from two shorter names; no hash, so no collision. Lags from k to 2k are looked up among
equal windows of k words. Windows that repeat themselves within k / 2 form a chain; all but the first of a chain
continue a shorter lag and open none, so that the table holds no more lags than there are runs around a word, and a
text of one repeated word costs no more than another.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the shortest run.
SHORTEST = 12
#: Bytes of text that are answered together.
TOGETHER = 1 << 22
RUNS = "array<struct<start:long,length:long,period:long>>"


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, 0, 1, ... in order of appearance."""
    first: dict[bytes, int] = {}
    return np.fromiter((first.setdefault(w, len(first)) for w in words), dtype=np.int64, count=len(words))


def _names(shorter: np.ndarray, shift: int) -> np.ndarray:
    """Names of longer windows, each made of two shorter ones `shift` words apart."""
    left, right = shorter[:len(shorter) - shift], shorter[shift:]
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]


def _repeats(names: np.ndarray) -> bool:
    return len(names) > 0 and int(names.max()) + 1 < len(names)


def _near(ids: np.ndarray, names: np.ndarray, size: int, shortest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first word, lag) of sufficient matches at the lags below 2 * size."""
    out = []
    for lag in range(1, min(2 * size, len(names))):
        x = np.flatnonzero(names[lag:] == names[:-lag]) + lag
        need = max(lag, shortest - lag)
        x = x[x + need <= len(ids)]
        x = x[names[x + need - size] == names[x + need - size - lag]]
        x = x[(x == lag) | (ids[x - 1] != ids[x - lag - 1])]
        out.append((x, np.full(len(x), lag)))
    return out


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, member) for every member of the ranges low .. high - 1."""
    sizes = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(low)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner]


def _far(ids: np.ndarray, names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, lag) of sufficient matches at the lags from size to 2 * size - 1."""
    n = len(ids)
    place = np.argsort(names, kind="stable")
    name = names[place]
    opens = np.ones(len(place), dtype=bool)
    opens[1:] = (name[1:] != name[:-1]) | (place[1:] - place[:-1] > size // 2)
    chain, key = np.cumsum(opens), name * (n + 1) + place
    first = np.flatnonzero(opens)
    at, base = place[first], name[first] * (n + 1)
    lags_before = _ranges(np.searchsorted(key, base + np.maximum(at - 2 * size + 1, 0)), np.searchsorted(key, base + at - size, side="right"))
    lags_after = _ranges(np.searchsorted(key, base + np.minimum(at + size, n)), np.searchsorted(key, base + np.minimum(at + 2 * size - 1, n), side="right"))
    later = np.concatenate([first[lags_before[0]], lags_after[1]])
    earlier = np.concatenate([lags_before[1], first[lags_after[0]]])
    apart = chain[later] != chain[earlier]
    x, y = place[later[apart]], place[earlier[apart]]
    lag = x - y
    fits = x + lag <= n
    x, y, lag = x[fits], y[fits], lag[fits]
    fits = (names[x + lag - size] == names[x - size]) & ((y == 0) | (ids[x - 1] != ids[y - 1]))
    pairs = np.unique(x[fits] * (n + 1) + lag[fits])
    return pairs // (n + 1), pairs % (n + 1)


def _entering(ids: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """(word, lag) where a match begins that lasts long enough for a run, by word."""
    size = (shortest + 1) // 2
    if len(ids) < shortest:
        return []
    names, reach = ids, 1
    while reach < size:
        step = min(reach, size - reach)
        names, reach = _names(names, step), reach + step
    if not _repeats(names):
        return []
    found = _near(ids, names, size, shortest)
    size *= 2
    while 2 * size <= len(ids):
        names = _names(names, size // 2)
        if not _repeats(names):
            break
        found.append(_far(ids, names, size))
        size *= 2
    x, lag = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((lag, x))
    return list(zip(x[order].tolist(), lag[order].tolist()))


def runs(ids: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of a sequence of `word_ids`, by start, then period.

    `shortest` is 2 at least. A stretch is listed with its smallest period only.
    """
    entering = _entering(ids, shortest)
    if not entering:
        return []
    words, out, active, following = ids.tolist(), [], {}, 0
    i = entering[0][0]
    while active or following < len(entering):
        if not active:
            i = entering[following][0]
        ended = [lag for lag in active if i == len(words) or words[i] != words[i - lag]]
        if ended:
            emitted = set()
            for lag in sorted(ended):  # of lags that end together the smallest is the period of their stretch
                length = active.pop(lag) + lag
                if i - length not in emitted:
                    emitted.add(i - length)
                    out.append((i - length, length, lag))
        for lag in active:
            active[lag] += 1
        while following < len(entering) and entering[following][0] == i:
            active[entering[following][1]] = 1
            following += 1
        i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run contains after its first period."""
    if found:
        kept = np.ones(len(words), dtype=bool)
        for start, length, period in found:
            kept[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def _found(shortest: int):
    fields = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct(fields))), ("collapsed", pa.binary())])

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                words = (text.as_py() or b"").split()
                found = runs(word_ids(words), shortest) if len(words) >= shortest else []
                rows.append((doc.as_py(), len(words), [dict(zip(("start", "length", "period"), r)) for r in found], collapse(words, found)))
                held += len(rows[-1][3])
                if held >= TOGETHER:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row: the text's maximal runs and the text without their repetitions.

    Words are what stands between ASCII white space (`bytes.split`). A null text has no words and an empty collapsed
    text. Rows are answered one by one: null and repeated ids stay as they are, further columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = rows.mapInArrow(_found(shortest), f"doc_id long, n_words long, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def repeated_tails(doc_id: Column, text: Column) -> Column:
    """The texts that the query examines: of one id in ten (by checksum) the words from some place on are made periodic.

    With h the CRC-32 of the decimal id and g = h div 10, where h is a multiple of ten the words from a = g mod n repeat
    the first 1 + (n - a) div (3 + g mod 8) of them. A null id changes nothing.
    """
    words = F.array_remove(F.split(text, r"[ \x09-\x0D]+", -1), "")
    h = F.crc32(doc_id.cast("long").cast("string").cast("binary"))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
    as_int = lambda c: c.cast("int")
    block = F.slice(words, as_int(a + 1), as_int(p))
    tail = F.slice(F.flatten(F.array_repeat(block, as_int(F.ceil((n - a) / p)))), F.lit(1), as_int(n - a))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), as_int(a)), tail), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), made).otherwise(text)
