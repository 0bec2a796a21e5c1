"""The corpus pipeline against plain Python, stage by stage, and on awkward tables."""

import ctypes
import hashlib
import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from layerstone.llm import byte_bpe, mixing, pii, quality, simhash
from layerstone.llm.common import materialize, small_batches, trimmed
from tests.llm.test_text_operators import AWKWARD, documents, union_find


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors(rows):
    """Of each group of texts linked by similarity 0.8 the smallest doc_id, by comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if alike(sets[a], sets[b])]
    return {r for r in union_find(ids, links).values()}


def test_run_equals_plain_python(spark, data):
    docs, stages = spark.read.parquet(f"{data}/documents.parquet"), dict(corpus_pipeline.STAGES)
    after = {}
    for name in ("quality", "near_duplicates", "personal_data", "mixing"):
        before, docs = docs, materialize(stages[name](spark, docs, data), name)
        assert docs.columns == before.columns
        after[name] = docs.collect()
    verdicts = quality.classify(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")).collect()
    assert {r["doc_id"] for r in after["quality"]} == {r["doc_id"] for r in verdicts if not r["rejected"]}
    kept = [(r["doc_id"], r["text"]) for r in after["quality"]]
    assert sorted(r["doc_id"] for r in after["near_duplicates"]) == sorted(survivors(kept))
    texts = dict(kept)
    assert [r["doc_id"] for r in after["personal_data"] if r["n_chars"] != len(r["text"] or "")] == []
    private = re.compile(r"[\w.]+@mail\d|\+1 \(\d{3}\) 555|AKIA[0-9A-Z]{16}")
    for r in after["personal_data"]:
        assert not set(private.findall(texts[r["doc_id"]])) & set(private.findall(r["text"])) - {"+1 (555) 555"}
    before = spark.createDataFrame([(r["doc_id"], r["source"], r["text"]) for r in after["personal_data"]], "doc_id long, source string, text string")
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(before).collect() if r["taken"]}
    mixed = Counter(r["doc_id"] for r in after["mixing"])
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in after["personal_data"]}
    assert {d: n for d, n in mixed.items() if size[d]} == taken
    plain = tiktoken.Encoding("plain", pat_str=byte_bpe.split_pattern(), mergeable_ranks=byte_bpe.read_ranks(byte_bpe.rank_file(None)), special_tokens={})
    want = Counter((r["doc_id"], len(plain.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in after["mixing"])
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, data).collect()) == want


def test_near_duplicates_equal_brute_force_by_band(spark, data):
    """All of sf0.01: what stays is what comparing all pairs leaves."""
    docs = spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, data)
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(survivors([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))


@pytest.mark.parametrize("hot", [False, True])
def test_shingles_of_many_sets_are_split_and_lose_no_pair(spark, hot):
    """Large groups of one shingle, of many sizes and roots: the pairs are those of groups that are not split, wherever the split is made."""
    rng = random.Random(8)
    rows = [(k, i, rng.randrange(4, 40), 0, i if k < 2 else 7) for k in range(4) for i in range(60)] + [(9, i, 10, 0, i) for i in range(3)]
    index = spark.createDataFrame(rows, "key long, id long, size int, place int, root long")
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[4] != b[4] and min(a[2], b[2]) >= 0.8 * max(a[2], b[2])}
    keys = np.array([0, 2] if hot else [], np.int64)
    for cap, tile in ((1000, 1000), (16, 5), (2, 2)):
        got = {(r["a"], r["b"]) for r in simhash._set_links(index, 0.8, keys, cap, tile).collect()}
        assert got == want
    assert simhash._set_links(index.limit(0), 0.8, keys, 2, 2).count() == 0


def test_near_duplicates_of_split_shingles_equal_brute_force(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join("x%d" % rng.randrange(5) if rng.random() < rate else w for w in base) for rate in (0, 0.01, 0.02, 0.04, 0.1) for _ in range(12)]
    texts += [" ".join([*base[:k], *(f"y{rng.randrange(10**6)}" for _ in range(10))]) for k in (20, 60, 100, 119)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    out = simhash.without_near_duplicates(docs, cap=4, tile=3)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(survivors(list(enumerate(texts))))


def test_unlike_sets_of_a_common_passage_are_no_candidates(spark):
    """Sets that share a passage but too little of the rest are told apart where they meet; every similar pair is a candidate."""
    rng = random.Random(10)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, blocks = words(20), [words(25) for _ in range(8)]
    texts = [" ".join([*passage, *(w for k in sorted(rng.sample(range(8), 4)) for w in blocks[k])]) for _ in range(200)]
    texts += [" ".join([*t.split()[:-k], *words(k)]) for t in texts[:20] for k in (2, 8)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    common = simhash._common_shingles(rows, 5)
    assert common.shape[1]
    index = simhash._prefixes(rows, 5, 0.8, common).withColumn("root", F.col("id"))
    sets = [shingles(t) for t in texts]
    alike = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    for hot, cap in ((np.zeros(0, np.int64), 1000), (np.zeros(0, np.int64), 8), (common[0], 8)):
        got = {(r["a"], r["b"]) for r in simhash._set_links(index, 0.8, hot, cap, 5).collect()}
        assert alike <= got and len(got) < 6000  # 12,523 pairs meet


def test_workers_give_memory_back_after_a_task():
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "malloc_trim"):
        pytest.skip("not glibc")
    libc.malloc.restype, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_void_p]
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10
    pinned = []

    def run(parts):
        blocks = [libc.malloc(64 << 10) for _ in range(3000)]
        for block in blocks:
            ctypes.memset(block, 1, 64 << 10)
        pinned.append(blocks.pop())  # what was taken last stays in use, so free() alone gives nothing back
        for block in blocks:
            libc.free(block)
        yield from parts

    before = held()
    assert list(trimmed(run)(iter([1, 2]))) == [1, 2]
    after = held()
    libc.free(pinned[0])
    assert after - before < 60


def test_model_needs_no_second_pool_of_workers(spark, monkeypatch):
    """Rows given to createDataFrame come from Python workers apart from those of mapInArrow; executors would keep both."""
    texts = spark.range(20).selectExpr("concat('some trusted text ', id) as text")

    def refuse(*args, **named):
        raise AssertionError("createDataFrame was called")

    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    rows = quality.model(texts).filter("kind = 0").collect()
    assert [(r["code"], r["value"] < 0) for r in rows] == [(0, True)]


def test_arrow_batches_are_small(spark):
    docs = small_batches(spark.range(4000, numPartitions=1).selectExpr("id as doc_id", "repeat('some text ', 200) as text"))

    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.nbytes])], names=["n"])

    found = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 8_000_000 and max(found) < 1_200_000


def test_workers_drop_the_codec_after_a_task(spark):
    docs = spark.range(40, numPartitions=4).selectExpr("id as doc_id", "'some text' as text")

    def left(parts):
        time.sleep(0.5)  # so that each task has a worker of its own, as those before had
        for _ in parts:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([byte_bpe.codec.cache_info().currsize])], names=["n"])

    assert byte_bpe.digests(docs).count() == 40
    assert byte_bpe.digests(docs).agg(F.sum("n_tokens")).first()[0] == 80
    assert {r["n"] for r in docs.mapInArrow(left, "n long").collect()} == {0}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_take_awkward_tables(spark, data, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = documents(spark, AWKWARD).withColumn("text", F.when(F.col("doc_id") == 5, F.lit("mail me@x.example.org")).otherwise(F.col("text")))
    out = stage(spark, docs, data)
    assert out.columns == docs.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    if name == "personal_data":
        assert ids == Counter(d for d, *_ in AWKWARD)
        assert "me@x.example" not in out.filter("doc_id = 5").first()["text"]
    if name == "near_duplicates":
        assert ids == Counter([1, None, 4, 5, 6])  # null and empty are alike, and the repeated row goes
    if name == "quality":
        assert not {1, 2} & set(ids)
    assert stage(spark, docs.limit(0), data).count() == 0


def test_last_stage_takes_awkward_tables(spark, data):
    docs = documents(spark, AWKWARD)
    out = corpus_pipeline.encoding_stage(spark, docs, data).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(d for d, *_ in AWKWARD)
    assert all(r["n_tokens"] == len(r["ids"]) for r in out)
    assert corpus_pipeline.encoding_stage(spark, docs.limit(0), data).count() == 0


def test_key_of_the_session_is_used(spark, data):
    docs = documents(spark, [(1, "at 10.20.30.40", "en", "a")])
    assert corpus_pipeline.personal_data_stage(spark, docs, data).first()["text"] == pii.pseudonymise(docs, pii.session_key(spark)).first()["text"]
