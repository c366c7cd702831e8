"""Language identification: script ranges narrow candidates, Viterbi over per-word scores labels spans.

A word is a run of letters. Its score in a language is the log-probability of its character pairs and
four-grams (with the word's edges), counted from labelled texts in hashed buckets. A language is a candidate for a
word only if the word's script is in use in its labelled texts, as far as any is. The best path through a text's
words, where a change of language costs `switch`, gives spans of one language each. The text's language is the one
with most letters.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, tenant, text_place

BUCKETS = 1 << 16
#: Labelled texts used of each language, on average; the same ones every time.
ROWS_PER_LANGUAGE = 4000
#: The languages with most labelled texts are learned, so many at most.
LANGUAGES = 256
#: Cost of a change of language between words, in natural logs of probability.
SWITCH = 25.0
#: A script counts as a language's own from this share of its letters on.
SCRIPT_SHARE = 0.005
#: Characters scored at a time with four languages; fewer with more.
CHARACTERS = 1 << 19

# First and last code points of blocks by script, as in the Unicode character database.
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Latin", 0x2C60, 0x2C7F), ("Latin", 0xA720, 0xA7FF), ("Latin", 0xFF21, 0xFF5A),
    ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x0400, 0x052F), ("Cyrillic", 0x2DE0, 0x2DFF), ("Cyrillic", 0xA640, 0xA69F),
    ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x077F), ("Arabic", 0x08A0, 0x08FF), ("Arabic", 0xFB50, 0xFDFF),
    ("Arabic", 0xFE70, 0xFEFF), ("Syriac", 0x0700, 0x074F), ("Thaana", 0x0780, 0x07BF), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF),
    ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Oriya", 0x0B00, 0x0B7F), ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F),
    ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F), ("Sinhala", 0x0D80, 0x0DFF), ("Thai", 0x0E00, 0x0E7F), ("Lao", 0x0E80, 0x0EFF),
    ("Tibetan", 0x0F00, 0x0FFF), ("Myanmar", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Hangul", 0xAC00, 0xD7AF),
    ("Ethiopic", 0x1200, 0x139F), ("Khmer", 0x1780, 0x17FF), ("Mongolian", 0x1800, 0x18AF), ("Kana", 0x3040, 0x30FF), ("Kana", 0x31F0, 0x31FF),
    ("Han", 0x3400, 0x9FFF), ("Han", 0xF900, 0xFAFF), ("Han", 0x20000, 0x3FFFF),
]
SCRIPT_NAMES = ["none", "other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]

#: Texts turned into Python strings at a time.
ROWS = 512

_tables: list[np.ndarray] = []


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: number of the script (0 for what is no letter) and lower case."""
    if not _tables:
        script = np.zeros(0x110000, dtype=np.uint8)
        script[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
        for name, first, last in SCRIPTS:
            part = script[first:last + 1]
            part[part > 0] = SCRIPT_NAMES.index(name)
        lower = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x1F000):
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
        _tables.extend((script, lower))
    return _tables[0], _tables[1]


class Words:
    """The words of some texts and the buckets of their character grams."""

    def __init__(self, texts: list[str]):
        script, lower = _characters()
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        kind = script[codes]
        letter = kind > 0
        edge = np.zeros(len(codes) + 1, dtype=bool)  # before a character: a text or a word begins or ends
        edge[1:-1] = letter[1:] != letter[:-1]
        edge[self.offsets] = True
        edge[-1] = True
        cut = np.flatnonzero(edge)
        begins = cut[:-1][letter[cut[:-1]]] if len(codes) else cut[:0]
        self.starts = begins
        self.ends = cut[np.searchsorted(cut, begins, side="right")] if len(begins) else begins
        self.first = np.searchsorted(self.starts, self.offsets)  # first word of each text, and one past the last
        self.script = kind[self.starts]
        self.letters = self.ends - self.starts
        size = self.letters + 1  # the last position of a word is its end
        self.at = np.concatenate(([0], np.cumsum(size)))[:-1].astype(np.int64)
        total = int(size.sum())
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(total) - self.at[word]
        source = self.starts[word] + place
        chars = lower[codes[np.minimum(source, max(0, len(codes) - 1))]].astype(np.uint64) if total else np.zeros(0, dtype=np.uint64)
        chars[place == self.letters[word]] = 32

        def back(k):
            out = np.full(total, 32, dtype=np.uint64)
            out[k:] = chars[:total - k] if k else chars
            out[place < k] = 32
            return out
        one, two, three = back(1), back(2), back(3)
        pair = chars * np.uint64(0x9E3779B97F4A7C15) + one * np.uint64(0xC2B2AE3D27D4EB4F)
        four = pair + two * np.uint64(0x165667B19E3779F9) + three * np.uint64(0x27D4EB2F165667C5) + np.uint64(0x85EBCA77C2B2AE63)
        self.buckets = [((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) for x in (pair, four)]


def _lots(ids, texts, most: int):
    """Lists of (ids, texts) with some `most` characters each; a longer text is a lot of its own."""
    some, held = ([], []), 0
    for i, text in zip(ids, texts):
        if held and held + len(text) > most:
            yield some
            some, held = ([], []), 0
        some[0].append(i)
        some[1].append(text)
        held += len(text)
    if some[0]:
        yield some


# --- learning ---------------------------------------------------------------------------------

def _counted(languages: list[str]):
    schema = pa.schema([("lang", pa.int32()), ("bucket", pa.int32()), ("count", pa.int64())])
    number = {lang: i for i, lang in enumerate(languages)}

    def run(batches):
        for batch in batches:
            for langs, texts in _lots(batch.column(0).to_pylist(), batch.column(1).to_pylist(), CHARACTERS):
                words = Words(texts)
                lang = np.repeat([number[x] for x in langs], np.diff(words.first)).astype(np.int64)
                of = np.repeat(lang, words.letters + 1)
                keys = [of * (BUCKETS + 256) + b for b in words.buckets]
                keys.append(np.repeat(lang * (BUCKETS + 256) + BUCKETS + words.script, words.letters))
                key, count = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key // (BUCKETS + 256)).astype(np.int32)), pa.array((key % (BUCKETS + 256)).astype(np.int32)), pa.array(count.astype(np.int64))], schema=schema)
    return run


class Model:
    """Log-probabilities by bucket and language, and the scripts of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=0, keepdims=True)
        self.score = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).astype(np.float32)
        self.own = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(axis=0, keepdims=True))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """A model of the languages in `docs`, from its rows with text and language.

    Of a language with more than `rows_per_language` rows that number is used on average, chosen by a hash of the id.
    """
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = labelled.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPT_NAMES), 0)))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, rows_per_language / r["n"])))])[F.col(lang_col)]
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.where(place < share).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    found = chosen.mapInArrow(_counted(languages), "lang int, bucket int, count long").groupBy("lang", "bucket").agg(F.sum("count").alias("count")).toArrow()
    lang, bucket, count = (found.column(c).to_numpy() for c in ("lang", "bucket", "count"))
    counts = np.zeros((BUCKETS + 256, len(languages)))
    counts[bucket, lang] = count
    return Model(languages, counts[:BUCKETS], counts[BUCKETS:BUCKETS + len(SCRIPT_NAMES)])


# --- the best path ----------------------------------------------------------------------------

def _together(scores: np.ndarray, first: np.ndarray, length: np.ndarray, switch: float, label: np.ndarray) -> None:
    """Best paths of texts of similar length, step by step for all at once; lengths descend."""
    n, k = len(first), scores.shape[1]
    steps = int(length[0])
    running = np.searchsorted(-length, -np.arange(steps), side="left")  # texts longer than t
    came = np.zeros((steps, n, k), dtype=np.uint8 if k < 256 else np.uint16)
    best = scores[first].copy()
    rows = np.arange(n)
    own = np.arange(k)
    for t in range(1, steps):
        m = running[t]
        now = best[:m]
        top = now.argmax(axis=1)
        leave = (now[rows[:m], top] - switch)[:, None]
        change = leave > now
        came[t, :m] = np.where(change, top[:, None], own)
        best[:m] = np.where(change, leave, now) + scores[first[:m] + t]
    state = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        m = running[t]
        label[first[:m] + t] = state[:m]
        if t:
            state[:m] = came[t, rows[:m], state[:m]]


def _alone(scores: np.ndarray, first: int, length: int, switch: float, label: np.ndarray) -> None:
    """The best path of one text."""
    best, came = scores[first].tolist(), []
    for row in scores[first + 1:first + length].tolist():
        top = max(best)
        at = best.index(top)
        leave = top - switch
        came.append([at if leave > b else i for i, b in enumerate(best)])
        best = [(leave if leave > b else b) + s for b, s in zip(best, row)]
    state = best.index(max(best))
    out = [state]
    for back in reversed(came):
        state = back[state]
        out.append(state)
    label[first:first + length] = out[::-1]


def label_words(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Language of each word on the best path of its text; `first` bounds the words of texts."""
    label = np.zeros(len(scores), dtype=np.int64)
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    at = 0
    while at < len(order):
        longest = int(length[order[at]])
        end = at + int(np.searchsorted(-length[order[at:]], -(longest / 2), side="left"))
        end = max(at + 1, end)
        some = order[at:end]
        if len(some) < 10 and scores.shape[1] <= 32:
            for d in some:
                _alone(scores, int(first[d]), int(length[d]), switch, label)
        else:
            _together(scores, first[:-1][some], length[some], switch, label)
        at = end
    return label


SPAN = T.StructType().add("start", "long").add("end", "long").add("lang", "string")


def _labelled(model, switch: float, inside: int | None = None):
    """Labels rows; the text stands beside the carried row, or is its field number `inside`."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def labelled(carried, texts, m):
        words, k = Words(texts), len(m.languages)
        n = len(texts)
        letters = np.zeros((n, max(1, k)))
        total = np.bincount(np.repeat(np.arange(n), np.diff(words.first)), weights=words.letters, minlength=n)
        if k and len(words.starts):
            scores = np.add.reduceat(m.score[words.buckets[0]] + m.score[words.buckets[1]], words.at, axis=0)
            own = m.own[words.script]
            scores = np.where(own | ~own.any(axis=1, keepdims=True), scores, scores - 1000.0 * words.letters[:, None]).astype(np.float32)
            label = label_words(scores, words.first, switch)
            text = np.repeat(np.arange(n), np.diff(words.first))
            np.add.at(letters, (text, label), words.letters)
            new = np.ones(len(label), dtype=bool)
            new[1:] = (label[1:] != label[:-1]) | (text[1:] != text[:-1])
            begin = np.flatnonzero(new)
            last = np.append(begin[1:], len(label)) - 1
            base = words.offsets[text[begin]]
            spans = pa.StructArray.from_arrays(
                [pa.array(words.starts[begin] - base), pa.array(words.ends[last] - base), pa.array(np.array(m.languages, dtype=object)[label[begin]], pa.string())], fields=list(span))
            bounds = np.concatenate(([0], np.cumsum(np.bincount(text[begin], minlength=n))))
        else:
            spans, bounds = pa.array([], span), np.zeros(n + 1, dtype=np.int64)
        known = (total > 0) & (k > 0)
        pred = np.where(known, np.array([*m.languages, "und"], dtype=object)[letters.argmax(axis=1)], "und")
        score = np.where(known, letters.max(axis=1) / np.maximum(total, 1), 0.0)
        return pa.RecordBatch.from_arrays(
            [carried, pa.array(pred, pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans)],
            names=["row", "lang_pred", "score", "spans"])

    def run(batches):
        tenant("language_id")
        m = model.value
        most = CHARACTERS * 4 // max(4, len(m.languages))
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                column = batch.column(1) if inside is None else batch.column(0).field(inside)
                texts = [t or "" for t in column.slice(at, ROWS).to_pylist()]
                for some, parts in _lots(range(at, at + len(texts)), texts, most):
                    yield labelled(batch.column(0).slice(some[0], len(some)), parts, m)
        release()
    return run


def label_rows(docs: DataFrame, model: Model, text_col: str = "text", switch: float = SWITCH, carry: Column | None = None) -> DataFrame:
    """(row, lang_pred, score, spans): each row of `docs` whole, or what `carry` makes of it, and its language.

    `lang_pred` is a learned language, or `und` for a text that is null or has no letter (then `score` is 0 and there
    are no spans); `score` is the share of letters in spans of that language; equal shares go to the first language by
    name. `spans` hold start and end in code points.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select((F.struct("*") if carry is None else carry).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"]]).add("lang_pred", "string").add("score", "double").add("spans", T.ArrayType(SPAN))
    inside = text_place(docs, text_col) if carry is None else None
    if inside is not None:  # a text goes to Python once, within its row
        rows = rows.select("row")
    return rows.mapInArrow(_labelled(sent, switch, inside), schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans) per row; `held_out` tells rows that learning is to leave alone."""
    out = label_rows(docs, model, text_col, switch, F.struct(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out")))
    return out.select("row.*", "lang_pred", "score", "spans")


def held_out(id_col: str = "doc_id"):
    """Rows kept out of learning: crc32 of the id as text leaves 2 when divided by 4. A null id is not kept out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
