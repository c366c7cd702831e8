"""Token counts of texts of any length, huge ones by overlapping chunks that are resynchronised.

A piece model merges neighbouring symbols, the best pair of the whole text first, into pieces of its vocabulary. A text
of up to `chunk` characters is encoded at once. A longer one is encoded in chunks with offsets; each begins at a token
boundary of the one before, `overlap` characters before its end, and the two are spliced at a boundary that both have.

A common boundary is proven stable when the token before it (of the earlier chunk) and the token after it (of the later
one), encoded as a text of their own, give these two tokens again. This suffices: merges inside a stretch of text happen
in the same order whatever lies around it, as long as none crosses its ends; so if any merge of the whole text crossed a
token boundary, the first to do so would also happen between the two tokens alone. A sequence of tokens all of whose
neighbours pass this test is therefore the encoding of the whole text, and neighbours of one chunk pass it.

Where no common boundary is proven the overlap doubles; where it reaches the last splice the earlier chunk is encoded anew,
twice as long, until in the end the rest of the text is one chunk.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens beyond which a document is over the limit.
LIMIT = 4096
#: Characters of a chunk, and of the first overlap of two.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Characters of short texts that are encoded together.
TOGETHER = 1 << 18
COUNTS = "doc_id long, n_bytes long, n_tokens long, n_chunks long"


class _Chunk:
    """The tokens of text[start:end]: ids, and where in the text each begins and ends."""

    def __init__(self, processor, text: str, start: int, end: int):
        self.start, self.end = start, min(end, len(text))
        found = processor.encode(text[start:end], return_type="offset_mapping")
        spans = np.array(found["offsets"], dtype=np.int64).reshape(-1, 2) + start
        self.ids, self.begins, self.ends = found["ids"], spans[:, 0], spans[:, 1]
        whole = self.ends > self.begins  # bytes of a character that is no piece share its place
        #: Number of the token that begins at each boundary between two tokens of whole characters.
        self.cuts = np.flatnonzero(whole[1:] & whole[:-1]) + 1

    def number_at(self, place: int) -> int:
        return int(np.searchsorted(self.begins, place))


class TokenCounter:
    """Counts tokens as the model encodes whole texts, without begin or end tokens."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        if not path.endswith(".model"):
            raise ValueError(f"Not a piece model: {path}")
        self.chunk, self.overlap = chunk, overlap
        with open(path, "rb") as file:
            data = file.read()
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=data)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(data)
        spec = model.normalizer_spec
        #: Chunks need a model of merges that leaves characters as they are.
        self.merges = (model.trainer_spec.model_type == model.trainer_spec.BPE and not spec.precompiled_charsmap
                       and not spec.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix)
        spec.add_dummy_prefix = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def _proven(self, text: str, before: tuple[int, int], after: tuple[int, int], end: int) -> bool:
        """Whether two neighbouring tokens, each (begin, id), stay two when encoded alone."""
        return self.inner.encode(text[before[0]:end]) == [before[1], after[1]]

    def _splice(self, text: str, earlier: _Chunk, later: _Chunk, after: int) -> int | None:
        """A proven common boundary beyond `after`, from the middle of the overlap outwards."""
        places = np.append(later.begins[later.cuts], later.start)
        places = np.intersect1d(places, earlier.begins[earlier.cuts])
        places = places[places > after]
        middle = (later.start + earlier.end) // 2
        for place in places[np.argsort(np.abs(places - middle), kind="stable")].tolist():
            a, b = earlier.number_at(place) - 1, later.number_at(place)
            if later.ends[b] > later.begins[b] and (earlier.begins[a] > 0 or a > 0) and self._proven(
                    text, (int(earlier.begins[a]), earlier.ids[a]), (place, later.ids[b]), int(later.ends[b])):
                return place
        return None

    def count_long(self, text: str) -> tuple[int, int]:
        """(tokens, chunks encoded) of a text longer than a chunk."""
        done, cut, last, chunks = 0, 0, None, 1
        earlier = _Chunk(self.whole, text, 0, self.chunk)
        while earlier.end < len(text):
            overlap, place = self.overlap, None
            while place is None:
                starts = earlier.begins[earlier.cuts]
                starts = starts[(starts > cut) & (starts <= earlier.end - overlap)]
                if len(starts) == 0:
                    break
                later = _Chunk(self.inner, text, int(starts[-1]), int(starts[-1]) + self.chunk)
                if later.end <= earlier.end:  # an overlap as long as a chunk
                    later = _Chunk(self.inner, text, int(starts[-1]), earlier.end + self.chunk)
                chunks += 1
                place = self._splice(text, earlier, later, cut)
                overlap *= 2
            if place is None:
                size = 2 * (earlier.end - cut)
                earlier = _Chunk(self.inner if cut else self.whole, text, cut, cut + size)
                chunks += 1
                if last is not None and not self._proven(text, last, (cut, earlier.ids[0]), int(earlier.ends[0])):
                    return len(self.whole.encode(text, return_type="numpy")), chunks + 1
                continue
            number = earlier.number_at(place)
            done += number - earlier.number_at(cut)
            last = (int(earlier.begins[number - 1]), earlier.ids[number - 1])
            cut, earlier = place, later
        return done + len(earlier.ids) - earlier.number_at(cut), chunks

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, chunks encoded) of each text."""
        long = [self.merges and len(t) > self.chunk for t in texts]
        short = iter(self.whole.encode([t for t, is_long in zip(texts, long) if not is_long], return_type="numpy", num_threads=1))
        return [self.count_long(t) if is_long else (len(next(short)), 1) for t, is_long in zip(texts, long)]


def _path(tokenizer: str) -> str:
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers
    return public_tokenizers.path(tokenizer)


def _counted(tokenizer: str, chunk: int, overlap: int):
    schema = pa.schema([(name, pa.int64()) for name in ("doc_id", "n_bytes", "n_tokens", "n_chunks")])

    def run(batches):
        counter = TokenCounter(_path(tokenizer), chunk, overlap)

        def answer(ids, sizes, texts):
            tokens, chunks = zip(*counter.count(texts))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, sizes, tokens, chunks)], schema=schema)

        for batch in batches:
            ids, sizes, texts, held = [], [], [], 0
            for doc, value in zip(batch.column(0), batch.column(1)):
                data = value.as_py() or b""
                ids.append(doc.as_py())
                sizes.append(len(data))
                texts.append(data.decode("utf-8", "replace"))
                held += len(texts[-1])
                if held >= TOGETHER:
                    yield answer(ids, sizes, texts)
                    ids, sizes, texts, held = [], [], [], 0
            if ids:
                yield answer(ids, sizes, texts)
    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "piece_bpe_32k.model",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_chunks) per row: UTF-8 length, tokens of the whole text, chunks that were encoded.

    `tokenizer` is a path, or the name of a file of the installed public tokenizers. A null text is empty and has no
    token. Rows are answered one by one: null and repeated ids stay as they are, further columns are not read. Models
    that change characters before they merge are given whole texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_counted(tokenizer, chunk, overlap), COUNTS)
