"""Language identification by compression (operator 2).

Each language has a zstandard raw-content dictionary made of its own training texts. A text is
encoded once per dictionary, and the language whose dictionary gives the fewest bytes wins. Where
the runner-up is close, the answer is marked as rejected.

Learning uses a bounded sample of the labelled rows: of each language the ROWS_PER_LANGUAGE rows with
the smallest hash of doc_id and text among those of at most ROW_BYTES, equal rows once, whole texts,
until a dictionary holds DICTIONARY_BYTES. So at most 8 MB a language reach the driver. Lines that the
sample shows in more than one language (licence lines and the like) tell nothing and are left out.

Defined results: a null text, an empty text and a text without a letter give 'und', score 0 and
rejected; with no labelled row at all every text gives 'und'; equal sizes go to the language with
more training rows, then to the smaller name; a null doc_id counts as the text 'null' when rows are
held out; repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerstone.llm.common import batches, materialize, small, small_batches

#: Bounds of what is learned from.
ROWS_PER_LANGUAGE, ROW_BYTES = 128, 64 << 10
#: Buckets of a language whose rows are ranked apart first.
BUCKETS = 64
DICTIONARY_BYTES = 112 << 10
LEVEL = 9
#: Languages closer than this share of the runner-up's bytes are not told apart.
MIN_MARGIN = 0.01
FOLDS, HELD_OUT_FOLD = 3, 1
UNDETERMINED = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


@functools.cache
def _not_letters():
    import regex

    return regex.compile(r"[^\p{L}\p{M}]+")


def normalise(text: str | None) -> bytes:
    """Lower-cased words of letters and marks, one space between; empty where no letter is."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return _not_letters().sub(" ", text.lower()).strip().encode()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % FOLDS == HELD_OUT_FOLD


def sample(train: DataFrame, rows: int = ROWS_PER_LANGUAGE, row_bytes: int = ROW_BYTES) -> DataFrame:
    """lang, rank, text, rows_in: the rows that are learned from, and how many rows of the language there are."""
    mark = F.xxhash64("doc_id", F.col("text"))
    order = Window.partitionBy("lang").orderBy("mark", "key")
    # one row of equal ones; only keys go through the window, texts are fetched for the chosen keys
    light = train.filter(F.octet_length("text") <= row_bytes).select("lang", mark.alias("mark"), F.col("doc_id").alias("key")).distinct()
    # of each bucket first, so that what one task ranks of a language is bounded however many partitions there are
    bucket = Window.partitionBy("lang", F.pmod("mark", F.lit(BUCKETS))).orderBy("mark", "key")
    light = light.withColumn("place", F.row_number().over(bucket)).filter(F.col("place") <= rows).drop("place")
    ranked = light.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows)
    chosen = materialize(ranked.select(F.col("lang").alias("lang_of"), F.col("mark").alias("mark_of"), F.col("key").alias("key_of"), "rank"), "chosen", 1)
    counts = train.groupBy(F.col("lang").alias("counted")).agg(F.count("*").alias("rows_in"))
    own = train.withColumn("mark", mark).join(small(chosen), (F.col("lang") == F.col("lang_of")) & (F.col("mark") == F.col("mark_of")) & (F.col("doc_id") == F.col("key_of")))
    once = own.select("lang", "rank", "text").distinct().join(counts, F.col("lang") == F.col("counted"))
    return once.select("lang", "rank", "text", "rows_in")


def dictionaries(train: DataFrame, rows: int = ROWS_PER_LANGUAGE, size: int = DICTIONARY_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary), most training rows first; train has doc_id, text, lang without nulls.

    The driver receives at most rows texts of ROW_BYTES a language.
    """
    lines: dict[str, list[bytes]] = defaultdict(list)
    seen_in: dict[bytes, set[str]] = defaultdict(set)
    n: dict[str, int] = {}
    for r in sorted(sample(train, rows).collect(), key=lambda r: (r["lang"], r["rank"], r["text"])):
        n[r["lang"]] = r["rows_in"]
        lines[r["lang"]] += []
        for line in r["text"].split("\n"):
            if clean := normalise(line):
                lines[r["lang"]].append(clean)
                seen_in[clean].add(r["lang"])
    own = {lang: b" ".join(x for x in some if len(seen_in[x]) == 1)[:size] for lang, some in lines.items()}
    return sorted(own.items(), key=lambda x: (-n[x[0]], x[0]))


class Compressors:
    def __init__(self, learned: list[tuple[str, bytes]], level: int):
        import zstandard

        self.languages = [lang for lang, _ in learned]
        self.compress = []
        for _, content in learned:
            options = {"level": level, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
            if len(content) >= 8:
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                dictionary.precompute_compress(level=level)
                options["dict_data"] = dictionary
            self.compress.append(zstandard.ZstdCompressor(**options).compress)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the margin: the share of bytes that the best saves against the runner-up."""
        data = normalise(text)
        if not data or not self.languages:
            return UNDETERMINED, 0.0
        sizes = [len(c(data)) for c in self.compress]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
        return self.languages[best], 1.0 if rest is None else (rest - sizes[best]) / rest


def classify(docs: DataFrame, learned: list[tuple[str, bytes]], level: int = LEVEL, min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every whole text. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # at most DICTIONARY_BYTES a language

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(shared.value, level)
        for whole in parts:
            for part in batches(whole):
                found = [compressors.predict(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[1] < min_margin for f in found], pa.bool_())],
                    names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return texts.mapInArrow(run, SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of the training folds that have a language, then classify every row."""
    train = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return classify(docs, dictionaries(train.select("doc_id", "text", "lang")))
