"""Benchmark decontamination by an Aho-Corasick automaton over normalised test items.

Words are runs of digits, letters and anything beyond ASCII; A-Z count as a-z. Every window of `width` consecutive
item words is a pattern, an item of fewer words is one pattern itself. A document is normalised to its words with
single spaces between and around them, scanned once, and every hit mapped back to the words and to the
original text. Items are a stated query set: they go to the executors in blocks of bounded size, one automaton
each.
"""

import uuid
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, stage, tenant, text_place

WIDTH = 10
#: Bytes of normalised item text in one automaton; `width` times as many nodes at most.
BLOCK_BYTES = 1 << 20

# Bytes of words are 0-9, a-z and everything from 0x80 on; the others become spaces.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SPAN = T.StructType().add("first", "long").add("last", "long").add("start", "long").add("end", "long")
_SPAN = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(text: bytes, width: int) -> set[bytes]:
    """Patterns of an item: its windows with a space on either side."""
    words = words_of(text)
    if not words:
        return set()
    return {b" " + b" ".join(words[i:i + width]) + b" " for i in range(max(1, len(words) - width + 1))}


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """Items as (id, text) in blocks; the driver holds one block at a time."""
    part, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("binary")).where(f"{item_col} is not null and {text_col} is not null")
    for item, text in rows.toLocalIterator():
        part.append((item, bytes(text)))
        size += len(text)
        if size >= block_bytes:
            yield part
            part, size = [], 0
    if part or not size:
        yield part


_automata: dict[tuple, object] = {}


def build(items: list[tuple[int, bytes]], width: int):
    """The automaton of some items, or None without a pattern; bytes are matched as Latin-1 characters."""
    import ahocorasick
    owners = defaultdict(set)
    for item, text in items:
        for window in windows(text, width):
            owners[window].add(item)
    automaton = ahocorasick.Automaton()
    for window, who in owners.items():
        automaton.add_word(window.decode("latin-1"), (len(window), tuple(sorted(who))))
    if not owners:
        return None
    automaton.make_automaton()
    return automaton


def _kept(items, width: int, name: str):
    """A worker builds the automaton of a block once and keeps the last one; `name` tells blocks apart."""
    key = (name, width)
    if key not in _automata:
        _automata.clear()
        _automata[key] = build(items.value, width)
    return _automata[key]


def _spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as places in the original text, in code points."""
    data = np.frombuffer(text.translate(_NORMAL), dtype=np.uint8)
    inside = data != 32
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
    run = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return [(int(a), int(b), int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1))]


def scan(automaton, text: bytes) -> tuple[int, list[int], list[tuple]]:
    """Number of words, items with occurring windows, and runs of hit words with their place in the text."""
    words = words_of(text)
    if automaton is None or not words:
        return len(words), [], []
    normal = (b" " + b" ".join(words) + b" ").decode("latin-1")
    ranges, found = [], set()
    for last, (length, who) in automaton.iter(normal):
        ranges.append((last - length + 1, last))
        found.update(who)
    if not ranges:
        return len(words), [], []
    hit, at, word = np.zeros(len(words), dtype=bool), 0, 0
    for first, last in sorted(ranges):
        word += normal.count(" ", at, first)
        at = first
        hit[word:word + normal.count(" ", first + 1, last + 1)] = True
    return len(words), sorted(found), _spans(text, hit)


def _scanned(items, width: int, inside: int | None = None):
    """Scans rows; the text stands beside the carried row, or is its field number `inside`."""
    name = uuid.uuid4().hex

    def run(batches):
        tenant("decontaminate", _automata.clear)
        automaton = _kept(items, width, name)
        for batch in batches:
            column = batch.column(1) if inside is None else batch.column(0).field(inside).cast(pa.binary())
            found = [scan(automaton, text.as_py() or b"") for text in column]
            spans = [[dict(zip(("first", "last", "start", "end"), s)) for s in f[2]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array(spans, _SPAN)],
                names=["row", "n_words", "items", "spans"])
        release()
    return run


def _numbered(batches):
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + len(batch))), batch.column(0), batch.column(1)], names=["number", "row", "text"])
        number += len(batch)


def _merged(batches):
    """One list of spans from those that the blocks of items found in a row."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            joined: list[dict] = []
            for s in sorted(spans, key=lambda s: (s["first"], s["last"])):
                if joined and s["first"] <= joined[-1]["last"]:
                    if s["last"] > joined[-1]["last"]:
                        joined[-1] |= {"last": s["last"], "end": s["end"]}
                else:
                    joined.append(dict(s))
            out.append(joined)
        at = batch.schema.get_field_index("spans")
        yield batch.set_column(at, "spans", pa.array(out, _SPAN))


def mark_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
              width: int = WIDTH, block_bytes: int = BLOCK_BYTES, carry: Column | None = None) -> DataFrame:
    """(row, n_words, n_hit, items, spans): each row of `docs` whole, or what `carry` makes of it, and its hits.

    Words inside any occurrence of an item's window are hit; `items` are the ids of items with occurring windows,
    ascending; `spans` are runs of hit words: number of the first word and of the one after the last, and their
    place in the original text in code points. A null text has no words, a null item no window.
    """
    spark = docs.sparkSession
    source = docs.select((F.struct("*") if carry is None else carry).alias("row"), F.col(text_col).cast("binary").alias("text"))
    items = [spark.sparkContext.broadcast(part) for part in _blocks(benchmark, item_col, item_text_col, block_bytes)]
    schema = lambda row: T.StructType([row]).add("n_words", "long").add("items", T.ArrayType(T.LongType())).add("spans", T.ArrayType(SPAN))
    if len(items) == 1:
        inside = text_place(docs, text_col) if carry is None else None
        if inside is not None:  # a text goes to Python once, within its row
            source = source.select("row")
        found = source.mapInArrow(_scanned(items[0], width, inside), schema(source.schema["row"]))
    else:  # a row's finds come from several passes and meet by its number
        source = stage(source.mapInArrow(_numbered, T.StructType().add("number", "long").add(source.schema["row"]).add("text", "binary")), "numbered")
        asked = source.select(F.col("number").alias("row"), "text")
        found = reduce(DataFrame.union, [asked.mapInArrow(_scanned(part, width), schema(asked.schema["row"])) for part in items])
        found = found.groupBy("row", "n_words").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
        found = found.mapInArrow(_merged, schema(T.StructField("number", T.LongType()))).join(source.select("number", "row"), "number")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select("row", "n_words", n_hit.alias("n_hit"), "items", "spans")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) per row."""
    found = mark_rows(docs, benchmark, carry=F.struct(F.col(id_col).cast("long").alias("doc_id")), **options)
    return found.select("row.doc_id", "n_words", "n_hit", "items", "spans")
