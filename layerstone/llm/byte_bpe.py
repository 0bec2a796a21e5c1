"""Byte-level BPE encoding and decoding (operator 9).

The tiktoken library encodes Arrow batches by the ranks of a rank file; every match of the split
pattern is encoded separately. Its regular expressions overflow on very long runs of white space, so
texts with a run of SPACES go to the tokenizers library, whose BPE model is built from the same ranks:
each byte becomes one printable character (the byte table), each rank a vocabulary entry, and each
entry of two or more bytes the merge that yields it. Both give the same ids.
Decoding looks up each id's bytes through the reversed byte table and joins bytes, so a character
that is split over several tokens comes back whole; only whole texts are turned into strings.

Defined results: null text counts as empty (no ids, hashes of no bytes); a null doc_id is passed
through; repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerstone.llm.common import batches, small_batches, tokenizer_file, trimmed

#: Bytes of texts that are encoded at once, and characters from which a text is cut; the tokenizers library needs some fifty times as much.
BATCH, PIECE = 1 << 19, 1 << 18
#: White space in a row that tiktoken is not given; it fails somewhere between 100,000 and 300,000.
SPACES = 1 << 12
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


def byte_table() -> dict[int, str]:
    """A printable character for each byte: itself where printable, else the next free one from 256 up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, free = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(free)
            free += 1
    return table


def rank_file(path: str | None) -> str:
    return path or tokenizer_file("byte_bpe_50k.tiktoken")


def split_pattern() -> str:
    """The split pattern of the public rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge yields a token: merge by rank with what ranks below the token until two parts are left."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if ranks.get(parts[best] + parts[best + 1], 1 << 60) >= ranks[token]:
            return None  # not reachable by merges; it is only met as a whole match
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


@functools.lru_cache(maxsize=4)
def tokenizer_json(path: str) -> str:
    """The tokenizers library's own description of the model in a rank file."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, table = read_ranks(path), byte_table()
    spell = lambda token: "".join(map(table.__getitem__, token))
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        if len(token) > 1 and (pair := halves(token, ranks)):
            merges.append((spell(pair[0]), spell(pair[1])))
    tokenizer = Tokenizer(models.BPE({spell(t): i for t, i in ranks.items()}, merges, cache_capacity=0, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(split_pattern()), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer.to_str()


#: Where one match of the pattern ends and another begins whatever stands around: between a letter and a space
#: before a letter, after a line feed between letters, between a full stop of Chinese or Japanese and a letter.
_EDGE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])|(?<=[A-Za-z]\n)(?=[A-Za-z])|(?<=[。！？，、])(?=[\u4e00-\u9fa5\u3041-\u3096])")


def pieces(text: str, size: int | None = None) -> Iterator[str]:
    """A text in pieces of about size characters, cut only where matches of the pattern meet; whole where they never surely do."""
    size, start = size or PIECE, 0
    while len(text) - start > size and (edge := _EDGE.search(text, start + size)):
        yield text[start : edge.start()]
        start = edge.start()
    yield text[start:]


_LONG_SPACE = re.compile(rf"(?<!\s)\s{{{SPACES}}}")


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, description: str):
        import tiktoken

        self.description = description
        back = {c: b for b, c in byte_table().items()}
        ranks = {bytes(map(back.__getitem__, token)): i for token, i in json.loads(description)["model"]["vocab"].items()}
        self.plain = tiktoken.Encoding("plain", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token

    @functools.cached_property
    def tokenizer(self):
        """The same model in the tokenizers library; few workers ever need it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.description)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._ids(t) if len(t) <= PIECE else [i for p in pieces(t) for i in self._ids(p)] for t in texts]

    def _ids(self, text: str) -> list[int]:
        if len(text) >= SPACES and _LONG_SPACE.search(text):
            return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return self.plain.encode_ordinary(text)

    def offsets(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Where each token begins and ends, in bytes of the text."""
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64) if ids else np.zeros(0, np.int64)
        return np.concatenate(([0], ends[:-1])) if ids else ends, ends

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; characters split over tokens are whole again once joined."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(description: str) -> Codec:
    return Codec(description)


def _texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, rank_path: str | None = None) -> DataFrame:
    """doc_id, ids, and each token's byte offsets in the text. One pass, no shuffle."""
    description = docs.sparkSession.sparkContext.broadcast(tokenizer_json(rank_file(rank_path)))  # bounded by the vocabulary

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(description.value)
        for whole in parts:
            for part in batches(whole, BATCH):
                ids = c.encode([t or "" for t in part.column(1).to_pylist()])
                spans = [c.offsets(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), *(pa.array([s[k] for s in spans], pa.list_(pa.int32())) for k in (0, 1))], names=["doc_id", "ids", "starts", "ends"])

    return _texts(docs).mapInArrow(trimmed(run), ENCODED)


def decode(encoded: DataFrame, rank_path: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes of ids."""
    description = encoded.sparkSession.sparkContext.broadcast(tokenizer_json(rank_file(rank_path)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(description.value)
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.decode(x or []) for x in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, decoded binary")


def digests(docs: DataFrame, rank_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded bytes; the ids too, if asked for. One pass, no shuffle."""
    description = docs.sparkSession.sparkContext.broadcast(tokenizer_json(rank_file(rank_path)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(description.value)
        for whole in parts:
            for part in batches(whole, BATCH):
                ids = c.encode([t or "" for t in part.column(1).to_pylist()])
                packed = [np.array(x, "<u4") for x in ids]
                columns = [
                    part.column(0),
                    pa.array(map(len, ids), pa.int64()),
                    pa.array((hashlib.sha256(x.tobytes()).hexdigest() for x in packed), pa.string()),
                    pa.array((hashlib.sha256(c.decode(x)).hexdigest() for x in ids), pa.string()),
                ]
                if with_ids:
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(packed).view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])
        codec.cache_clear()  # workers go on to other operators' tasks; it is made again in a fraction of a second

    return _texts(docs).mapInArrow(trimmed(run), DIGESTS + ", ids array<int>" * with_ids)
