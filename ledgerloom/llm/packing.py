"""Packing documents into token sequences of a fixed length by a grouping genetic algorithm.

Texts become token ids, only longer documents are cut, and a full piece is a sequence of its own. The other
pieces are dealt by hash into blocks of bounded size. Each block is solved by several islands: an island keeps a
few packings, starting from best-fit decreasing. Crossover injects whole well-filled bins of one parent into the
other, drops the bins that hold the same pieces, and best-fits the pieces so displaced. Between two rounds every
island hands its best packing to the next. An island stops where a packing needs no more bins than the sum of
lengths does. Bins of all blocks that stay loose are dissolved and their pieces packed together once more.
"""

import math
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage, tenant

#: Tokens of a sequence.
LIMIT = 4096
#: Pieces of a block, on average.
BLOCK = 8192
ISLANDS, ROUNDS, POPULATION, GENERATIONS = 2, 2, 4, 6
#: Bins filled less than this are packed anew across blocks.
LOOSE = 0.97
#: Words whose ids a task remembers; beyond it starts anew.
REMEMBERED = 200_000
#: A comma or full stop before a space, but after another sign, which the tokenizer keeps together with it.
_SIGNS_MEET = re.compile(r"[.,] (?<=(?:[^\w \n\t\r]|[_İ])[.,] )")
#: Composed Latin letters have one lower case each, which is composed again; other texts are left to the tokenizer.
_SAME_IN_LOWER_CASE = re.compile(r"[\x00-\u012f\u2000-\u20cf]*")
#: Lower-case letters that are composed already, and words of them with printable ASCII signs.
_LETTERS = re.compile("[a-zß-öø-į]+")
_PLAIN = re.compile("[!-@\\[-~ß-öø-į]+")
# The pieces that the tokenizer file's pre-tokenizer makes of such words.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-į]+|[0-9]|[^a-zß-öø-į0-9]+")
_UNPRINTED = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
#: Bytes that do not print are written as the signs from U+0100 on, in order.
_SIGN_OF_BYTE = {b: 256 + i for i, b in enumerate(_UNPRINTED)}
#: Characters of texts that are encoded together.
TOGETHER = 1 << 18

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


class _Known(dict):
    """Ids of words; what is not known yet is learned when asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


class WordEncoder:
    """Token ids of texts as little-endian bytes, word by word.

    The tokenizer lower-cases and never joins characters across white space, nor letters with a comma or full stop
    after them; so a text's ids are those of its parts, and each distinct part is encoded once. What a word is made of
    follows `word_bpe_49k.json`; a file that normalises or takes words apart otherwise needs its own `_PIECE`.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = _Known(self._learn)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        ids = self.known.__getitem__
        return [b"".join(map(ids, _parts(t))) for t in texts]

    def _learn(self, word: str) -> bytes:
        """A word that normalisation leaves as it is goes to the model piece by piece, another through the whole tokenizer."""
        if _LETTERS.fullmatch(word) and word.islower():
            return self._piece(word)
        if _PLAIN.fullmatch(word) and word == word.lower() and "<|" not in word:
            return b"".join([self.known.get(p) or self._piece(p) for p in _PIECE.findall(word)])
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of what the pre-tokenizer does not take apart; it writes bytes as signs, printable ASCII as itself."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_SIGN_OF_BYTE)
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)


def _parts(text: str) -> list[str]:
    """Parts of a text that are encoded apart: between white space, and commas and full stops at the end of a word."""
    text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
    if _SIGNS_MEET.search(text) is None:
        text = text.replace(", ", " , ").replace(". ", " . ")
    if "<|" not in text and (text.isascii() or _SAME_IN_LOWER_CASE.fullmatch(text) is not None):
        text = text.lower()
    return text.split(" ")


_encoders: dict[str, WordEncoder] = {}


def _pieces(tokenizer: str, limit: int, end: int):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    last = np.array([end], dtype="<u4").tobytes()

    def path() -> str:
        if "/" in tokenizer:
            return tokenizer
        import public_tokenizers
        return public_tokenizers.path(tokenizer)

    def run(batches):
        tenant("packing", _encoders.clear)
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordEncoder(path())
        encoder, row = _encoders[tokenizer], TaskContext.get().partitionId() << 40

        def cut(ids, texts):
            nonlocal row
            out = []
            for doc, data in zip(ids, encoder.encode(texts)):
                data += last
                for k, at in enumerate(range(0, len(data), 4 * limit)):
                    part = data[at:at + 4 * limit]
                    out.append((row, doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    row += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc.as_py())
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= TOGETHER:
                    yield cut(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield cut(ids, texts)
        encoder.known.clear()
        release()
    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json",
           limit: int = LIMIT, end: int = 1) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): every document's ids, `end` last, in pieces of at most `limit`.

    `tokenizer` is a path, or the name of a file of the installed public tokenizers. A null text is empty: its
    only id is `end`. `row` numbers pieces without order.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_pieces(tokenizer, limit, end), PIECES)


# --- one island -------------------------------------------------------------------------------

def best_fit(lengths: np.ndarray, items: np.ndarray, room: list[int], limit: int) -> list[int]:
    """Bin of each item, taken in the given order: the fullest bin with room, or a new one. `room` is changed."""
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    some = 0
    for b, r in enumerate(room):
        by_room[r].append(b)
        some |= 1 << r
    out = []
    for need in lengths[items].tolist():
        fit = some >> need
        if fit:
            r = (fit & -fit).bit_length() - 1 + need
            b = by_room[r].pop()
            if not by_room[r]:
                some ^= 1 << r
        else:
            b, r = len(room), limit
            room.append(limit)
        left = r - need
        room[b] = left
        by_room[left].append(b)
        some |= 1 << left
        out.append(b)
    return out


def fitness(lengths: np.ndarray, bins: np.ndarray, limit: int) -> tuple[int, float]:
    """Fewer bins are better, then unevenly filled ones. Smaller is better."""
    fill = np.bincount(bins, weights=lengths)
    return len(fill), -float(np.mean((fill / limit) ** 2))


def crossover(lengths: np.ndarray, receiver: np.ndarray, donor: np.ndarray, limit: int, rng) -> np.ndarray:
    """The receiver with whole well-filled bins of the donor; what they displace is best-fitted, longest first."""
    fill = np.bincount(donor, weights=lengths)
    chosen = (fill >= np.quantile(fill, rng.uniform(0.2, 0.8))) & (rng.random(len(fill)) < rng.uniform(0.3, 0.9))
    injected = chosen[donor]
    gone = np.zeros(int(receiver.max()) + 1, dtype=bool)
    gone[receiver[injected]] = True
    gone |= (np.bincount(receiver, weights=lengths) < limit * LOOSE) & (rng.random(len(gone)) < 0.5)
    displaced = np.flatnonzero(gone[receiver] & ~injected)
    child = np.where(injected, donor + len(gone), receiver)
    kept = np.ones(len(lengths), dtype=bool)
    kept[displaced] = False
    names, child[kept] = np.unique(child[kept], return_inverse=True)
    room = (limit - np.bincount(child[kept], weights=lengths[kept], minlength=len(names))).astype(int).tolist()
    order = displaced[np.argsort(-lengths[displaced] + rng.uniform(0, 1) * rng.integers(0, 64, len(displaced)), kind="stable")]
    child[order] = best_fit(lengths, order, room, limit)
    return child


def evolve(lengths: np.ndarray, seeds: list[np.ndarray], limit: int, population: int, generations: int, rng) -> np.ndarray:
    """The best packing that an island finds; lengths descend."""
    least = -(-int(lengths.sum()) // limit)
    everything = np.arange(len(lengths))
    packings = list(seeds) or [np.array(best_fit(lengths, everything, [], limit))]
    rated = lambda: sorted(packings, key=lambda b: fitness(lengths, b, limit))
    if fitness(lengths, rated()[0], limit)[0] <= least:
        return rated()[0]
    while len(packings) < population:
        order = np.argsort(-lengths * rng.uniform(0.8, 1.0, len(lengths)), kind="stable")
        bins = np.empty(len(lengths), dtype=np.int64)
        bins[order] = best_fit(lengths, order, [], limit)
        packings.append(bins)
    for _ in range(generations):
        for _ in range(population):
            a, b = rng.choice(len(packings), 2, replace=False)
            packings.append(crossover(lengths, packings[a], packings[b], limit, rng))
        packings = rated()[:population]
        if fitness(lengths, packings[0], limit)[0] <= least:
            break
    return packings[0]


# --- islands on Spark -------------------------------------------------------------------------

ELITE = "block long, island int, bins long, loose double, packing binary"


def _sorted(block: pa.Table) -> pa.Table:
    return block.sort_by([("length", "descending"), ("row", "ascending")])


def _island(limit: int, population: int, generations: int, turn: int):
    schema = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("bins", pa.int64()), ("loose", pa.float64()), ("packing", pa.binary())])

    def run(key: tuple, block: pa.Table, elites: pa.Table) -> pa.Table:
        lengths = _sorted(block)["length"].to_numpy()
        seeds = [np.frombuffer(p.as_py(), dtype=np.int32).astype(np.int64) for p in elites["packing"]]
        number, island = (k.as_py() for k in key)
        rng = np.random.default_rng([turn, number, island])
        best = evolve(lengths, seeds, limit, population, generations, rng)
        bins, loose = fitness(lengths, best, limit)
        return pa.table([[number], [island], [bins], [loose], [best.astype(np.int32).tobytes()]], schema=schema)
    return run


def _placed(key: tuple, block: pa.Table, elites: pa.Table) -> pa.Table:
    block = _sorted(block)
    lengths = block["length"].to_numpy()
    bins = np.frombuffer(elites["packing"][0].as_py(), dtype=np.int32).astype(np.int64)
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    offset = np.empty_like(lengths)
    offset[order] = before - (np.cumsum(fill) - fill)[bins[order]]
    return block.append_column("bin", pa.array(bins)).append_column("fill", pa.array(fill[bins])).append_column("offset", pa.array(offset))


def _packed(small: DataFrame, blocks: int, seed: int, limit: int, islands: int, rounds: int) -> DataFrame:
    """The pieces with block, bin, fill of the bin and offset."""
    dealt = small.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(blocks)))
    on_islands = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).groupBy("block", "island")
    elites = small.sparkSession.createDataFrame([], ELITE)
    for turn in range(rounds):
        handed = elites.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
        elites = stage(on_islands.cogroup(elites.union(handed).groupBy("block", "island"))
                       .applyInArrow(_island(limit, POPULATION, GENERATIONS, turn), ELITE), "elites")
    best = elites.groupBy("block").agg(F.min_by("packing", F.struct("bins", "loose", "island")).alias("packing"))
    schema = f"{PIECES}, block long, bin long, fill long, offset long"
    return dealt.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(_placed, schema)


def pack(cut: DataFrame, limit: int = LIMIT, block: int = BLOCK, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """Pieces with sequence_id and offset: pieces of one sequence follow each other without gap from 0.

    A full piece fills a sequence alone. Sequence numbers are unique and say nothing more. No piece, no row.
    """
    cut = stage(cut, "pieces")
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = cut.where(F.col("length") >= limit).select(*out, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    small = cut.where(F.col("length") < limit)
    number = lambda level: (F.lit(level << 56) + F.shiftleft(F.col("block"), 24) + F.col("bin")).alias("sequence_id")
    blocks = max(1, math.ceil(small.count() / block))
    first = _packed(small, blocks, 1, limit, islands, rounds)
    if blocks == 1:
        return whole.union(first.select(*out, number(0), "offset"))
    first = stage(first, "packed")
    tight = F.col("fill") >= limit * LOOSE
    again = first.where(~tight).select("row", *out)
    second = _packed(again, max(1, math.ceil(again.count() / block)), 2, limit, islands, rounds)
    return whole.union(first.where(tight).select(*out, number(0), "offset")).union(second.select(*out, number(1), "offset"))
