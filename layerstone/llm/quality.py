"""Quality classifier by an interpolated modified Kneser-Ney model (operator 3).

The model is over 4-grams of UTF-16 units, which needs no word list and serves any script. It is
trained on all trusted text (labelled quality 1 and not toxic): 4-gram counts are taken over whole
texts, added up sharded by 4-gram, and lower orders are continuation counts. Joins sharded by n-gram
give every n-gram of the trusted text its interpolated probability and every context its back-off
weight; with both, any other 4-gram's probability follows. So the model is bounded by the trusted
text, whatever the corpus holds.

A document's perplexity is the mean over its 4-grams. A model of at most MODEL_ROWS rows is broadcast
(16 bytes a row) and documents are scored in one pass without a shuffle. A larger one stays sharded:
the documents' 4-grams, counted by document, are joined with the probabilities of the distinct ones,
which are looked up order by order. Both ways give the same perplexity.

A document is rejected where its perplexity is over a high quantile of trusted documents of its
language and length band, widened by MARGIN. Quantiles of few documents are unsure, so each counts
with its number of documents against WEIGHT of the next wider one: of the band against the language,
of the language against all (means of logarithms). No language is too small to have its own.

Defined results: a null or empty text has a null perplexity and is rejected; with no trusted text
there is no model: all perplexities are null and nothing but empty texts is rejected; a null
language is a language of its own; a null doc_id is scored but never trusted; a doc_id that labels
holds twice is trusted if no row of it says otherwise; repeated rows give repeated results; an empty
table gives no rows; extra columns are ignored by classify() and kept by accepted().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerstone.llm.common import batches, fresh, materialize, small, small_batches, trimmed

ORDER = 4
#: Rows of a model that is broadcast, and trusted ids that are.
MODEL_ROWS, BROADCAST_IDS = 4_000_000, 1_000_000
#: Units of text that are counted at once, and that are looked up at once.
BLOCK, LOOK_UP = 1 << 19, 1 << 16
QUANTILE, MARGIN, WEIGHT = 0.995, 1.1, 50
#: Length bands, in UTF-16 units.
BANDS = (64, 256, 1024)


class Units:
    """The UTF-16 units of texts in one array, each text after ORDER - 1 zeros."""

    def __init__(self, texts: list[str | None]):
        pad = b"\0\0" * (ORDER - 1)
        each = [(t or "").encode("utf-16-le", "surrogatepass") for t in texts]
        self.lengths = np.array([len(x) // 2 for x in each], np.int64)
        self.units = np.frombuffer(pad + pad.join(each), "<u2") if each else np.zeros(0, "<u2")
        self.spans = self.lengths + ORDER - 1
        self.begins = begins = np.cumsum(self.spans) - self.spans
        self.inside = np.ones(len(self.units), bool)
        for k in range(ORDER - 1):
            self.inside[begins + k] = False

    def blocks(self, size: int = BLOCK) -> Iterator[tuple[slice, np.ndarray]]:
        """The places of units within texts and the 4-grams that end there, block by block."""
        for a in range(ORDER - 1, len(self.units), size):
            part = slice(a, min(a + size, len(self.units)))
            x = self.units[a - ORDER + 1 : part.stop].astype(np.uint64)
            n = part.stop - a
            grams = x[:n]
            for k in range(1, ORDER):
                grams = grams << np.uint64(16) | x[k : k + n]
            yield part, grams

    def sums(self, log_p: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Each text's sum of the log probabilities of its 4-grams."""
        total = np.zeros(len(self.lengths))
        for part, grams in self.blocks(LOOK_UP):
            inside = self.inside[part]
            found = np.zeros(len(grams))
            found[inside] = log_p(grams[inside])
            first, last = np.searchsorted(self.begins, (part.start, part.stop - 1), "right") - 1
            begins = self.begins[first : last + 1]
            total[first : last + 1] += np.add.reduceat(found, np.maximum(begins - part.start, 0))
        return total


class Backoff:
    """A model in memory: by order, sorted n-grams with log probabilities and sorted contexts with log back-off weights."""

    def __init__(self, kinds: np.ndarray, codes: np.ndarray, values: np.ndarray):
        order = np.lexsort((codes, kinds))
        kinds, codes, values = kinds[order], codes[order], values[order]
        cut = lambda k: slice(*np.searchsorted(kinds, (k, k + 1)))
        self.parts = {k: (codes[cut(k)], values[cut(k)]) for k in range(2 * ORDER + 2)}
        self.floor = float(self.parts[0][1][0])

    def look_up(self, kind: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, values = self.parts[kind]
        if not len(codes):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        return codes[at] == wanted, values[at]

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        out, todo, spent = np.zeros(len(grams)), np.arange(len(grams)), np.zeros(len(grams))
        for k in range(ORDER, 0, -1):
            hit, value = self.look_up(2 * k, grams)
            out[todo[hit]] = spent[hit] + value[hit]
            todo, grams, spent = todo[~hit], grams[~hit], spent[~hit]
            known, weight = self.look_up(2 * k + 1, grams >> np.uint64(16))
            spent = spent + np.where(known, weight, 0.0)
            grams = grams & np.uint64((1 << 16 * (k - 1)) - 1)
        out[todo] = spent + self.floor
        return out


def gram_counts(texts: DataFrame) -> DataFrame:
    """code, c: how often each 4-gram is in the column text. Each block is counted before the shuffle."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in batches(whole, 1 << 20, 0):
                units = Units(part.column(0).to_pylist())
                for place, grams in units.blocks():
                    codes, n = np.unique(grams[units.inside[place]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

    return small_batches(texts).select(F.col("text").cast("string")).mapInArrow(trimmed(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("c"))


def _suffix(code: Column, order: int) -> Column:
    return code.bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1).cast("long"))


def _context(code: Column) -> Column:
    return F.shiftrightunsigned(code, 16)


def _discounts(grams: DataFrame) -> list[float]:
    """The discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    n = [x or 0 for x in grams.agg(*[F.sum((F.col("c") == k).cast("long")) for k in (1, 2, 3, 4)]).first()]
    if not n[0] or not n[1]:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.05) if n[k - 1] else k / 2 for k in (1, 2, 3)]


def model(trusted: DataFrame) -> DataFrame | None:
    """kind, code, value: kind 2k the log probability of an n-gram of order k, 2k + 1 the log back-off weight of a context of order k, 0 that of what is unknown at order 1. None without trusted text."""
    grams = {ORDER: materialize(gram_counts(trusted), "grams")}
    n = grams[ORDER].count()
    if not n:
        return None
    for k in range(ORDER - 1, 0, -1):
        grams[k] = materialize(grams[k + 1].groupBy(_suffix(F.col("code"), k + 1).alias("code")).agg(F.count("*").alias("c")), "grams", n)
    out, lower = [], None
    for k in range(1, ORDER + 1):
        d = _discounts(grams[k])
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        if k == 1:
            total, spare, kinds = grams[k].agg(F.sum("c"), F.sum(off), F.count("*")).first()
            floor = spare / total / (kinds + 1)
            p = grams[k].select("code", ((F.col("c") - off) / total + F.lit(floor)).alias("p"))
            # not by createDataFrame, whose rows come from Python workers of a pool of their own, which each executor then keeps
            out.append(p.sparkSession.range(1).select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("code"), F.lit(float(np.log(floor))).alias("value")))
        else:
            context = grams[k].groupBy(_context(F.col("code")).alias("context")).agg(F.sum("c").alias("total"), F.sum(off).alias("spare"))
            context = materialize(context, "contexts", n)
            known = grams[k].select("code", (F.col("c") - off).alias("left"), _context(F.col("code")).alias("context"), _suffix(F.col("code"), k).alias("suffix"))
            joined = known.join(context, "context").join(lower.select(F.col("code").alias("suffix"), "p"), "suffix")
            p = joined.select("code", (F.col("left") / F.col("total") + F.col("spare") / F.col("total") * F.col("p")).alias("p"))
            out.append(context.select(F.lit(2 * k + 1).alias("kind"), F.col("context").alias("code"), F.log(F.col("spare") / F.col("total")).alias("value")))
        lower = materialize(p, "probabilities", n)
        out.append(lower.select(F.lit(2 * k).alias("kind"), "code", F.log("p").alias("value")))
    return materialize(reduce(DataFrame.unionByName, out), "model", 2 * n)


def _in_memory(spark: SparkSession, table: DataFrame):
    """The model as a broadcast; the caller has checked its rows."""
    held = table.toArrow()
    return spark.sparkContext.broadcast((held["kind"].to_numpy(), held["code"].to_numpy().view(np.uint64), held["value"].to_numpy()))


def _looked_up(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """code, log_p of distinct 4-grams (code) by joins with the model, order by order."""
    part = lambda kind, name: table.filter(F.col("kind") == kind).select(F.col("code").alias(f"{name}_of"), F.col("value").alias(name))
    rows = wanted.select("code", F.col("code").alias("now"), F.lit(0.0).alias("spent"), F.lit(None).cast("double").alias("log_p"))
    for k in range(ORDER, 0, -1):
        rows = rows.join(part(2 * k, "own"), F.col("now") == F.col("own_of"), "left").join(part(2 * k + 1, "weight"), _context(F.col("now")) == F.col("weight_of"), "left")
        rows = rows.select("code", _suffix(F.col("now"), k).alias("now"), (F.col("spent") + F.coalesce("weight", F.lit(0.0))).alias("spent"), F.coalesce("log_p", F.col("spent") + F.col("own")).alias("log_p"))
    floor = F.lit(table.filter("kind = 0").first()["value"])
    return rows.select("code", F.coalesce("log_p", F.col("spent") + floor).alias("log_p"))


def _sharded_sums(docs: DataFrame, table: DataFrame) -> DataFrame:
    """row, s: each text's sum (of row, text) by joins alone; 4-grams are counted by text before they are shuffled."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in batches(whole, 1 << 18):
                for row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    units = Units([text])
                    for place, grams in units.blocks():
                        codes, n = np.unique(grams[units.inside[place]], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), row)), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], names=["row", "code", "n"])

    counts = materialize(small_batches(docs).select("row", "text").mapInArrow(trimmed(run), "row long, code long, n long"), "counts")
    known = materialize(_looked_up(counts.select("code").distinct(), table), "known")
    return counts.join(known, "code").groupBy("row").agg(F.sum(F.col("n") * F.col("log_p")).alias("s"))


def scored(docs: DataFrame, table: DataFrame | None, keep: list[str], name: str = "perplexity", model_rows: int = MODEL_ROWS) -> DataFrame:
    """The columns keep of docs and each row's perplexity under name. No shuffle where the model is small enough to be broadcast."""
    if table is None:
        return docs.select(*keep, F.lit(None).cast("double").alias(name))
    if table.count() > model_rows:
        row, mine = fresh(docs, "scored_row"), fresh(docs, "scored_sum")
        held = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        text = F.col("text").cast("string")
        sums = _sharded_sums(held.select(F.col(row).alias("row"), text.alias("text")).filter("length(text) > 0"), table).select(F.col("row").alias("row_of"), F.col("s").alias(mine))
        joined = held.join(sums, held[row] == sums["row_of"], "left")
        units = F.octet_length(F.encode(text, "UTF-16LE")) / 2
        return joined.select(*keep, F.exp(-F.col(mine) / units).alias(name))
    shared = _in_memory(docs.sparkSession, table)
    text, kept = docs.columns.index("text"), [docs.columns.index(c) for c in keep]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backoff = Backoff(*shared.value)
        for whole in parts:
            for part in batches(whole, 1 << 20, text):
                units = Units(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(units.sums(backoff.log_p)), pa.array(units.lengths)], names=[str(i) for i in range(len(kept) + 2)])

    k = len(kept)
    fields = [*(docs.schema[i] for i in kept), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())]
    rows = small_batches(docs).mapInArrow(trimmed(run), T.StructType([T.StructField(str(i), f.dataType) for i, f in enumerate(fields)]))
    return rows.select(*[F.col(str(i)).alias(c) for i, c in enumerate(keep)], F.when(F.col(str(k + 1)) > 0, F.exp(-F.col(str(k)) / F.col(str(k + 1)))).alias(name))


def _trusted_ids(labels: DataFrame) -> DataFrame:
    good = F.coalesce(F.col("quality") == 1, F.lit(False)) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("trusted_id")).agg(F.min(good.cast("int")).alias("good")).filter("good = 1").select("trusted_id")


def _band(length: Column) -> Column:
    return sum((F.when(length >= b, 1).otherwise(0) for b in BANDS), F.lit(0))


def thresholds(scores: DataFrame, ids: DataFrame, quantile: float = QUANTILE, weight: float = WEIGHT) -> DataFrame:
    """g, language, band, threshold from scores (doc_id, language, band, perplexity): g is 0 for a band of a language, 1 for a language, 3 for all; each is drawn towards the next wider one by its number of documents."""
    known = scores.join(small(ids), scores["doc_id"] == ids["trusted_id"], "left_semi").filter("perplexity is not null")
    high = F.log(F.percentile_approx("perplexity", quantile, 10_000)).alias("own")
    cube = materialize(known.cube("language", "band").agg(high, F.count("*").alias("n"), F.grouping_id().alias("g")).filter("g != 2"), "quantiles", 1)
    drawn = lambda wider: ((F.col("own") * F.col("n") + F.col(wider) * weight) / (F.col("n") + F.lit(weight)))
    every = cube.filter("g = 3").select(F.col("own").alias("all"))
    language = cube.filter("g = 1").join(F.broadcast(every)).select("language", drawn("all").alias("wider"))  # one row
    band = cube.filter("g = 0").join(language, "language").select("language", "band", drawn("wider").alias("level"))
    level = lambda df, g, log, *keys: df.select(F.lit(g).alias("g"), *[F.col(k) if k in keys else F.lit(None).cast(t).alias(k) for k, t in (("language", "string"), ("band", "int"))], F.exp(log).alias("threshold"))
    return level(band, 0, "level", "language", "band").unionByName(level(language, 1, "wider", "language")).unionByName(level(every, 3, "all"))


def _judged(docs: DataFrame, labels: DataFrame, keep: list[str], names: dict[str, str]) -> DataFrame:
    ids = materialize(_trusted_ids(labels), "trusted", labels.count())
    trusted = docs.join(small(ids, BROADCAST_IDS), docs["doc_id"] == ids["trusted_id"], "left_semi").select("text")
    table = model(trusted)
    extra = {names["language"]: F.coalesce(F.col("lang").cast("string"), F.lit("")), names["band"]: F.when(F.length("text") > 0, _band(F.length("text")))}
    rows = scored(docs.withColumns(extra), table, [*keep, *extra], names["perplexity"])
    rows = materialize(rows, "scored")
    own = rows.select(*[F.col(names[c] if c in names else c).alias(c) for c in ("doc_id", "language", "band", "perplexity")])
    limits = materialize(thresholds(own, ids), "thresholds", 1)
    # at most (languages + 1) * (bands + 1) rows: checked before they are broadcast
    beside = (lambda x: F.broadcast(x)) if limits.count() <= 10_000 else (lambda x: x)
    limit = lambda g, *on: limits.filter(f"g = {g}").select(*[F.col(c).alias(f"{names[c]}{g}") for c in on], F.col("threshold").alias(f"{names['threshold']}{g}"))
    exact, language, overall = limit(0, "language", "band"), limit(1, "language"), limit(3)
    rows = rows.join(beside(exact), (rows[names["language"]] == exact[f"{names['language']}0"]) & (rows[names["band"]] == exact[f"{names['band']}0"]), "left")
    rows = rows.join(beside(language), rows[names["language"]] == language[f"{names['language']}1"], "left")
    top = overall.first()
    of = [F.col(f"{names['threshold']}{g}") for g in (0, 1)]
    rows = rows.withColumn(names["threshold"], F.coalesce(*of, F.lit(top[0] if top else None).cast("double")) * F.lit(MARGIN))
    if table is None:
        return rows.withColumn(names["rejected"], F.col(names["band"]).isNull())
    return rows.withColumn(names["rejected"], F.coalesce(F.col(names["perplexity"]) > F.col(names["threshold"]), F.col(names["perplexity"]).isNull()))


def _names(docs: DataFrame) -> dict[str, str]:
    return {n: fresh(docs, f"quality_{n}") for n in ("language", "band", "perplexity", "threshold", "rejected")}


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, perplexity, threshold, rejected of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    n = _names(docs)
    rows = _judged(docs, labels, ["doc_id"], n)
    return rows.select("doc_id", *[F.col(n[c]).alias(c) for c in ("perplexity", "threshold", "rejected")])


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    n = _names(docs)
    return _judged(docs, labels, docs.columns, n).filter(~F.col(n["rejected"])).select(*docs.columns)
