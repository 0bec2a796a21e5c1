"""Token counts for texts of any length (operator 7).

Short texts go to the tokenizer whole. A huge text is cut into chunks that overlap; each chunk
is encoded with offsets, and neighbouring chunks are spliced at a common boundary that is proven
stable. Where an overlap holds no such boundary it is widened and encoded again.

Why a boundary is proven stable: the model joins neighbouring symbols only into pieces of its
vocabulary, and no piece holds a word mark after another character (checked against the vocabulary
when the model is loaded). So no merge ever crosses the place between a character that is neither
space nor word mark and a following space or word mark; what stands left of it is encoded the same
whatever stands right of it, and the other way round. Both encodings must also show a token edge
there, or the splice counts as failed.

Defined results: null text counts as empty (0 bytes, 0 tokens); a null doc_id is passed through;
repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerstone.llm.common import batches, small_batches, tokenizer_file

#: Texts of more characters than this are cut into chunks of this many.
CHUNK_CHARS = 1 << 15
#: Characters that two neighbouring chunks share at first.
OVERLAP_CHARS = 256
TOKEN_LIMIT = 4096

SPACE, MARK = " ", "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PieceModel:
    """A sentencepiece model with the byte width of each piece in the marked text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.width = [1 if self.model.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)]
        plain = [p for i, p in enumerate(pieces) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        #: True if no piece joins a character to a word mark after it.
        self.stable_at_marks = not any(MARK in p.lstrip(MARK) for p in plain)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def edges(self, ids: list[int]) -> list[int]:
        """Where each token begins, in bytes of the marked chunk without its leading mark."""
        out, at = [], -len(MARK.encode())
        for i in ids:
            out.append(at)
            at += self.width[i]
        return out


@functools.lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def boundaries(text: str, low: int, high: int) -> Iterator[int]:
    """Stable places p with low < p < high, left to right."""
    for p in range(low + 1, high):
        if text[p] in (SPACE, MARK) and text[p - 1] not in (SPACE, MARK):
            yield p


def marked_bytes(text: str) -> int:
    return len(text.replace(SPACE, MARK).encode())


def encode_long(model: PieceModel, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, widened: Callable[[int], None] = lambda n: None) -> list[int]:
    """The ids of the whole text, from overlapping chunks spliced at stable boundaries."""
    if len(text) <= chunk or not model.stable_at_marks:
        return model.encode(text)
    overlap = max(2, min(overlap, chunk // 2))
    out: list[int] = []
    start, skip = 0, 0  # of the open chunk; skip: its tokens that stand before the last splice
    end, ids = chunk, model.encode(text[:chunk])
    while end < len(text):
        shared = overlap
        while True:
            right = max(start + 1, end - shared)
            stop = min(len(text), right + chunk)
            following = model.encode(text[right:stop])
            at = splice(model, text, (start, end, ids), (right, following), skip)
            if at:
                break
            # no common stable boundary: let the open chunk reach further and share more
            shared *= 2
            widened(shared)
            end = min(len(text), end + shared)
            ids = model.encode(text[start:end])
            if end == len(text):
                return out + ids[skip:]
        out += ids[skip : at[0]]
        start, end, ids, skip = right, stop, following, at[1]
    return out + ids[skip:]


def splice(model: PieceModel, text: str, left: tuple[int, int, list[int]], right: tuple[int, list[int]], skip: int) -> tuple[int, int] | None:
    """Token counts left and right of the last stable boundary that both chunks show as a token edge."""
    start, end, ids = left
    begin, following = right
    edges, after = model.edges(ids), model.edges(following)
    for p in reversed([*boundaries(text, begin, end)]):
        x, y = marked_bytes(text[start:p]), marked_bytes(text[begin:p])
        i, j = bisect.bisect_left(edges, x), bisect.bisect_left(after, y)
        if skip < i < len(edges) and edges[i] == x and j < len(after) and after[j] == y:
            return i, j
    return None


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = TOKEN_LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than limit tokens), by the public piece model unless model_path names another. One pass, no shuffle."""
    model_path = model_path or tokenizer_file("piece_bpe_32k.model")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for whole in parts:
            for part in batches(whole):
                texts = [t or "" for t in part.column(1).to_pylist()]
                short = [t for t in texts if len(t) <= chunk]
                counts = iter(map(len, model.model.encode(short, num_threads=1)) if short else ())
                tokens = [next(counts) if len(t) <= chunk else len(encode_long(model, t, chunk, overlap)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
