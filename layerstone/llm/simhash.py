"""SimHash near-duplicates by deletion-variant signatures (operator 1).

A fingerprint is cut into as few segments as let some segment of any two linked fingerprints differ
by at most one bit (distance 4: three segments). Each distinct fingerprint is indexed under every
segment with one bit replaced by a wildcard, 64 variants in all; two fingerprints that share a
variant meet in an equality join and are verified on all 64 bits. Copies collapse to one fingerprint
before, so groups of exact copies cost nothing.

Within one variant's group the verified links are found in vectorised comparisons, and for groups
over SMALL members only a spanning forest of them is emitted, which keeps the components. Keys
that a sample shows to be hot are set apart before the shuffle, and a group of over CAP members is
never held by a task: its rows are dealt anew by blocks of the bits outside the
segment (distance + 1 blocks, so one agrees exactly), and what is still over CAP is compared in tiles.

Defined results: null and empty texts, and texts of white space only, have the fingerprint zero and
link with one another and whatever is near zero; repeated rows share a fingerprint; a null doc_id
takes part but never becomes a component_id while a linked row has one; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerstone.llm.common import batches, fresh, materialize, small, small_batches, trimmed
from layerstone.llm.components import components

WORDS, DISTANCE, SEED = 4, 4, 42
#: Groups up to SMALL emit every link, larger ones a spanning forest; a task holds at most CAP members of a group.
SMALL, CAP, TILE = 64, 4096, 1024
#: Bytes of a text, and hashes, that are worked on at once.
TEXT_BLOCK, HASH_BLOCK = 1 << 20, 1 << 14
#: One fingerprint in so many tells which variant keys are hot.
HOT_SAMPLE = 16
#: One set in so many tells which shingles are common; shingles in at least COMMON of these, COMMONEST of them at most, are tried last.
SAMPLE, COMMON, COMMONEST = 8, 3, 200_000

#: Columns of 64 bits each that hold the parity of a set.
PARITY = ["parity0", "parity1", "parity2", "parity3"]

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(data: bytes, words: int) -> Iterator[list[bytes]]:
    """The words of a text in blocks that share words - 1 words, so that each shingle is in one block."""
    if len(data) <= TEXT_BLOCK:
        yield data.split()
        return
    carry, at = [], 0
    while at < len(data):
        cut = _SPACE.search(data, at + TEXT_BLOCK)
        end = cut.start() if cut else len(data)
        block = carry + data[at:end].split()
        at = end
        if len(block) >= words or at >= len(data):
            yield block
            carry = block[len(block) - words + 1 :] if words > 1 else []
        else:
            carry = block


def shingle_hashes(text: str | None, words: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of words, in blocks; a shorter text is one shingle, a text without words none."""
    from xxhash import xxh64_intdigest as digest

    first = True
    for block in word_blocks((text or "").encode().lower(), words):
        if len(block) < words:
            if first and block:
                yield np.array([digest(b" ".join(block), SEED)], np.uint64)
            return
        first = False
        joined = b" ".join(block)
        ends = np.cumsum(np.fromiter(map(len, block), np.int64, len(block)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(block) - words + 1].tolist()
        stops = (ends[words - 1 :] - 1).tolist()
        yield np.array([digest(joined[i:j], SEED) for i, j in zip(starts, stops)], np.uint64)


def fingerprint_batch(texts: list[str | None], words: int = WORDS) -> np.ndarray:
    """The fingerprints of texts: a bit is 1 if set in over half the shingle hashes."""
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    pieces: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        if pieces:
            hashes = np.concatenate(pieces)
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.cumsum([0, *map(len, pieces[:-1])])
            np.add.at(ones, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
            pieces.clear()
            owners.clear()

    held = 0
    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text, words):
            total[i] += len(hashes)
            for k in range(0, len(hashes), HASH_BLOCK):
                pieces.append(hashes[k : k + HASH_BLOCK])
                owners.append(i)
                held += len(pieces[-1])
                if held >= HASH_BLOCK:
                    flush()
                    held = 0
    flush()
    return np.packbits(ones * 2 > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (BIGINT) of every whole text. One pass, no shuffle."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in batches(whole):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprint_batch(part.column(1).to_pylist(), words).view(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the fewest segments of which one differs by at most one bit."""
    n = distance // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:])]


def variants(fps: DataFrame, distance: int) -> DataFrame:
    """key, fp: each fp under its 64 one-wildcard segment variants; a key is the wildcard's place and the segment's other bits."""
    keys = []
    for low, width in segments(distance):
        for bit in range(width):
            mask = ((1 << width) - 1) ^ (1 << bit)
            keys.append(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(mask).cast("long")).bitwiseOR(F.lit((low + bit) << 40).cast("long")))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _edges(keys: np.ndarray) -> np.ndarray:
    """Where the groups of sorted keys begin, and the end."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)


def _whole_groups(parts: Iterator[list[np.ndarray]], cap: int | None) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Columns sorted by the first one in blocks that cut no group (False), and rows of groups of over cap members (True), which are passed on as they come."""
    held: list[np.ndarray] | None = None
    over: int | None = None  # the key of the group that has outgrown cap
    for now in parts:
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        if over is not None:
            n = int(np.searchsorted(held[0], over, "right"))
            yield True, [c[:n] for c in held]
            held = [c[n:] for c in held]
            if not len(held[0]):
                continue
            over = None
        edge = _edges(held[0])
        if cap is not None and len(edge) > 1 and (sizes := np.diff(edge)).max() > cap:
            large = np.repeat(sizes > cap, sizes)
            yield True, [c[large] for c in held]
            if sizes[-1] > cap:
                over = int(held[0][-1])
            held = [c[~large] for c in held]
            edge = _edges(held[0])
        n = int(edge[-2]) if len(edge) > 1 and over is None else len(held[0])
        yield False, [c[:n] for c in held]
        held = [c[n:] for c in held]
    if held is not None:
        yield False, held


def _group_links(keys: np.ndarray, fps: np.ndarray, distance: int, small: int) -> np.ndarray:
    """Verified links (rows a < b) within the groups of equal, sorted keys."""
    edge = _edges(keys)
    starts, sizes = edge[:-1], np.diff(edge)
    found = []
    in_small = np.repeat((sizes > 1) & (sizes <= small), sizes)
    ends = np.repeat(edge[1:], sizes)
    at, lag = np.flatnonzero(in_small), 1
    while len(at := at[ends[at] > at + lag]):
        a, b = fps[at], fps[at + lag]
        near = np.bitwise_count(a ^ b) <= distance
        found.append(np.stack([a[near], b[near]], 1))
        lag += 1
    for i in np.flatnonzero(sizes > small):
        found += _forest(np.unique(fps[starts[i] : starts[i] + sizes[i]]), distance)
    if not found:
        return np.zeros((0, 2), np.uint64)
    links = np.sort(np.concatenate(found).view(np.int64), axis=1)
    return np.unique(links[links[:, 0] != links[:, 1]], axis=0)


def _forest(rest: np.ndarray, distance: int) -> list[np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: each is linked once, when first reached."""
    found, reached = [], []
    while len(rest):
        if not reached:
            reached.append(rest[0])
            rest = rest[1:]
        pivot = reached.pop()
        near = np.bitwise_count(rest ^ pivot) <= distance
        if near.any():
            hit = rest[near]
            found.append(np.stack([np.full(len(hit), pivot), hit], 1))
            reached.extend(hit)
            rest = rest[~near]
    return found


def _meet(rows: DataFrame, distance: int, small: int, cap: int | None) -> DataFrame:
    """a, b, key from key, fp: links with a null key, and (null, fp, key) of the groups of over cap members."""

    def out(a: np.ndarray, b: np.ndarray, key: np.ndarray | None) -> pa.RecordBatch:
        n = len(b)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if a is None else pa.array(a), pa.array(b), pa.nulls(n, pa.int64()) if key is None else pa.array(key)], names=["a", "b", "key"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large, (keys, fps) in _whole_groups(([c.to_numpy() for c in part.columns] for part in parts), cap):
            if large:
                yield out(None, fps, keys)
                continue
            links = _group_links(keys, fps.view(np.uint64), distance, small)
            if len(links):
                yield out(np.ascontiguousarray(links[:, 0]), np.ascontiguousarray(links[:, 1]), None)

    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(trimmed(run), "a long, b long, key long")


def _by_blocks(rows: DataFrame, distance: int) -> DataFrame:
    """Each row of a large group under each of distance + 1 blocks of the bits outside its segment."""
    keys = F.lit(None)
    for low, width in segments(distance):
        rest = F.col("fp").bitwiseAND(F.lit((1 << low) - 1).cast("long")).bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", low + width), low) if low + width < 64 else F.lit(0).cast("long"))
        cuts = [(64 - width) * i // (distance + 1) for i in range(distance + 2)]
        parts = F.array(*[F.xxhash64("key", F.lit(j), F.shiftrightunsigned(rest, i).bitwiseAND(F.lit((1 << (k - i)) - 1).cast("long"))) for j, (i, k) in enumerate(zip(cuts, cuts[1:]))])
        keys = F.when(F.shiftright("key", 40).between(low, low + width - 1), parts).otherwise(keys)
    return rows.select(F.explode(keys).alias("key"), "fp")


def _by_tiles(rows: DataFrame, tile: int, member: str = "fp") -> DataFrame:
    """Each row of a large group under each pair of tiles that its own tile is in; any two rows share one. rows are materialized."""
    rest = [c for c in rows.columns if c != "key"]
    n = materialize(rows.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("n")), "tiles")
    own = F.pmod(F.xxhash64(member), F.col("n"))
    tiled = rows.join(small(n), "key").select("key", *rest, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    return tiled.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *rest)


def _hot_keys(fps: DataFrame, distance: int, cap: int) -> DataFrame:
    """hot: keys that, by a sample of the fingerprints, more than cap of them have and that would fill a tenth of a task's share.

    A task's share bounds how many there can be: ten a task. What the sample misses is found in the
    task that meets it, so nothing but the way depends on it.
    """
    n, tasks = fps.count(), int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(cap, n * 64 // tasks // 10) / HOT_SAMPLE
    some = variants(fps.filter(F.pmod(F.xxhash64("fp"), F.lit(HOT_SAMPLE)) == 0), distance)
    return materialize(some.groupBy(F.col("key").alias("hot")).agg(F.count("*").alias("n")).filter(F.col("n") > least).select("hot"), "hot", 10 * tasks)


def links(fps: DataFrame, distance: int = DISTANCE, small_group: int = SMALL, cap: int = CAP, tile: int = TILE) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that differ by at most distance bits; all of them or, in groups of over small_group, a spanning forest.

    Rows of hot keys are dealt by blocks before any shuffle brings them together.
    """
    fps = materialize(fps, "prints")
    hot = _hot_keys(fps, distance, cap)
    every = variants(fps, distance)
    if any_hot := not hot.isEmpty():
        every = every.join(small(hot), F.col("key") == F.col("hot"), "left")
        early = materialize(every.filter("hot is not null").select("key", "fp"), "early")
        every = every.filter("hot is null").select("key", "fp")
    first = materialize(_meet(every, distance, small_group, cap), "links")
    found = first.filter("a is not null").select("a", "b")
    over = first.filter("a is null").select("key", F.col("b").alias("fp"))
    over = over.unionByName(early) if any_hot else over
    if not over.isEmpty():
        second = materialize(_meet(_by_blocks(over, distance), distance, small_group, cap), "links")
        found = found.unionByName(second.filter("a is not null").select("a", "b"))
        still = second.filter("a is null").select("key", F.col("b").alias("fp"))
        if not still.isEmpty():
            found = found.unionByName(_meet(_by_tiles(still, tile), distance, small_group, None).select("a", "b"))
    return found


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) of every row."""
    each = materialize(fingerprints(docs, words), "fingerprints")
    n = each.count()
    distinct = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct", n)
    roots = materialize(components(links(distinct.select("fp"), distance), n), "roots", n)
    linked = materialize(distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "first", "root"), "linked", n)
    least = materialize(linked.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component_id")), "least", n)
    own = linked.join(small(least), F.col("root") == F.col("of")).select(F.col("fp").alias("linked"), "component_id")
    of = materialize(distinct.join(own, distinct["fp"] == own["linked"], "left").select(F.col("fp").alias("fp_"), F.coalesce("component_id", "first").alias("component_id")), "of", n)
    return each.join(small(of), each["fp"] == of["fp_"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)])).view(np.int64)


def _shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """id, shingles (distinct hashes) from id, text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in batches(whole):
                sets = [_shingle_set(t, words) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["id", "shingles"])

    return small_batches(rows).select("id", "text").mapInArrow(trimmed(run), "id long, shingles array<long>")


def _parity(found: np.ndarray) -> np.ndarray:
    """For each value of a hash's lowest eight bits, whether an odd number of the set has it. Two sets differ in as many members at least as these differ in bits."""
    odd = np.bincount((found.view(np.uint64) & np.uint64(64 * len(PARITY) - 1)).astype(np.int64), minlength=64 * len(PARITY)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(rows: DataFrame, words: int, similarity: float, common: np.ndarray) -> DataFrame:
    """key (shingle), id, size, place, PARITY: the first shingles of every set of id, text, of which similar sets share one.

    Two sets of at least that Jaccard similarity share ceil(similarity * size) shingles, so of each set
    all but so many, and one, are enough, in whatever order all sets keep: here common ones (a row of
    hashes, sorted, above a row of counts) come last, so few sets meet under one shingle. Only rows of
    common ones carry the set's parity, others zeros: few sets meet under those.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in batches(whole):
                keys, sizes, takes, parities = [], [], [], []
                for text in part.column(1).to_pylist():
                    found = _shingle_set(text, words)
                    take = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1 if len(found) else 0
                    parity = np.zeros((take, len(PARITY)), np.int64)
                    if common.shape[1]:
                        at = np.minimum(np.searchsorted(common[0], found), common.shape[1] - 1)
                        met = np.where(common[0][at] == found, common[1][at], 0)
                        order = np.argsort(met, kind="stable")
                        parity[met[order[:take]] > 0] = _parity(found)
                        found = found[order]
                    keys.append(found[:take])
                    sizes.append(len(found))
                    takes.append(len(keys[-1]))
                    parities.append(parity)
                ids = np.repeat(part.column(0).to_numpy(), takes)
                places = np.concatenate([np.arange(n, dtype=np.int32) for n in takes])
                columns = [np.concatenate(keys), ids, np.repeat(np.array(sizes, np.int32), takes), places, *np.concatenate(parities).T]
                for k in range(0, len(ids), HASH_BLOCK):
                    cut = slice(k, k + HASH_BLOCK)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[cut])) for x in columns], names=["key", "id", "size", "place", *PARITY])

    return small_batches(rows).select("id", "text").mapInArrow(trimmed(run), "key long, id long, size int, place int" + "".join(f", {p} long" for p in PARITY))


def _common_shingles(rows: DataFrame, words: int) -> np.ndarray:
    """Hashes, sorted, and counts of the commonest shingles in a sample of the sets. They settle an order only, no result."""
    sample = _shingle_sets(rows.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0), words)
    counts = sample.select(F.explode("shingles").alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    top = counts.orderBy(F.desc("n"), "key").limit(COMMONEST).toArrow()
    found = np.stack([top.column(c).to_numpy() for c in ("key", "n")])
    return found[:, np.argsort(found[0])]


def _meet_sets(rows: DataFrame, similarity: float, cap: int | None) -> DataFrame:
    """a, b and nulls, from key, id, size, place, root, PARITY, hot: pairs of id that can be of that similarity; and rows (a null, b the id) of hot keys and of groups of over cap members.

    Members of a key are sorted by size, so each is compared with those up to size / similarity only.
    A pair counts under a shingle if it leaves both sets enough shingles from there on; that holds
    under the first shingle a similar pair shares. Pairs that differ in too many bits of parity are left
    out, and no similar one does. Rows of hot keys are spread by id and pass through.
    """
    names, nothing = ["a", "b", "key", "size", "place", "root", *PARITY], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.int64()] * len(PARITY)]

    def solve(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray, roots: np.ndarray, *parities: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = _edges(keys)
        if len(edge) < 2:
            return
        joined = np.repeat(np.minimum.reduceat(roots, edge[:-1]) == np.maximum.reduceat(roots, edge[:-1]), np.diff(edge))
        ends, left = np.repeat(edge[1:], np.diff(edge)), sizes - places
        at, lag = np.flatnonzero(~joined), 1
        while len(at := at[ends[at] > at + lag]):
            at = at[similarity * sizes[at + lag] <= sizes[at] + 1e-9]
            other = at + lag
            least = similarity / (1 + similarity) * (sizes[at] + sizes[other]) - 1e-9
            near = (np.minimum(left[at], left[other]) >= least) & (roots[at] != roots[other])
            one, two = at[near], other[near]
            differ = sum(np.bitwise_count((p[one] ^ p[two]).view(np.uint64)).astype(np.int64) for p in parities)
            may = differ <= (1 - similarity) / (1 + similarity) * (sizes[one] + sizes[two]) + 1e-9
            if may.any():
                a, b = ids[one[may]], ids[two[may]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *(pa.nulls(len(a), t) for t in nothing)], names=names)
            lag += 1

    def passed(columns: list[np.ndarray]) -> pa.RecordBatch:
        keys, ids, *rest = (pa.array(c) for c in columns)
        return pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), ids, keys, *rest], names=names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread: list[pa.RecordBatch] = []

        def others() -> Iterator[list[np.ndarray]]:
            for part in parts:
                *now, hot = (c.to_numpy(zero_copy_only=False) for c in part.columns)
                if hot.any():
                    spread.append(passed([c[hot] for c in now]))
                    now = [c[~hot] for c in now]
                yield now

        for large, columns in _whole_groups(others(), cap):
            yield from spread
            spread.clear()
            if large:
                yield passed(columns)
            else:
                yield from solve(*columns)

    where = F.when(F.col("hot"), F.xxhash64("id")).otherwise(F.col("key"))
    dealt = small_batches(rows).select("key", "id", "size", "place", "root", *PARITY, "hot").repartition(where).sortWithinPartitions("key", "size")
    return dealt.mapInArrow(trimmed(run), "a long, b long, key long, size int, place int, root long" + "".join(f", {p} long" for p in PARITY)).distinct()


def _by_sizes(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows of large groups under two bands of size each, so that any two sets of similar size share one. Groups whose members are all of one root go."""
    unlike = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("key")
    band = F.floor(F.log("size") / max(1.001 * math.log(1 / similarity), 0.01))
    banded = rows.join(small(materialize(unlike, "unlike")), "key").withColumn("band", F.explode(F.array(band, band + 1)))
    return banded.select(F.xxhash64("key", "band").alias("key"), "id", "size", "place", "root", *PARITY)


def _set_links(rows: DataFrame, similarity: float, hot: np.ndarray, cap: int = CAP, tile: int = TILE) -> DataFrame:
    """a, b: pairs of id that can be of that similarity, from key, id, size, place, root and, where it is known, PARITY; pairs of one root are left out.

    hot are keys to be split before any task holds their rows; other groups of over cap members are
    found by the tasks that meet them. Both are dealt by bands of size, then by tiles, which any two
    members share: the way differs, the pairs do not.
    """
    spark = rows.sparkSession
    rows = rows.withColumns({p: F.lit(0).cast("long") for p in PARITY if p not in rows.columns})
    if len(hot):  # at most COMMONEST
        known = F.broadcast(spark.createDataFrame(pa.table({"hot_key": hot})))
        rows = rows.join(known, F.col("key") == F.col("hot_key"), "left").withColumn("hot", F.col("hot_key").isNotNull())
    else:
        rows = rows.withColumn("hot", F.lit(False))
    first = materialize(_meet_sets(rows, similarity, cap), "candidates")
    found = first.filter("a is not null").select("a", "b")
    over = first.filter("a is null").select("key", F.col("b").alias("id"), "size", "place", "root", *PARITY)
    if over.isEmpty():
        return found
    tiled = _by_tiles(materialize(_by_sizes(over, similarity), "banded"), tile, "id").withColumn("hot", F.lit(False))
    return found.unionByName(materialize(_meet_sets(tiled, similarity, None).select("a", "b").distinct(), "candidates"))


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """id, size, sketch from id, text: the parity of a set's hashes by their lowest bits, twice as many bits as the set has members or more, a power of two."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in batches(whole):
                sizes, bits = [], []
                for text in part.column(1).to_pylist():
                    found = _shingle_set(text, words).view(np.uint64)
                    m = max(64, 1 << (2 * len(found)).bit_length())
                    parity = np.bincount((found & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
                    sizes.append(len(found))
                    bits.append(np.packbits(parity.astype(np.uint8)).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())], names=["id", "size", "sketch"])

    return small_batches(rows).select("id", "text").mapInArrow(trimmed(run), "id long, size int, sketch binary")


def least_difference(a: bytes, b: bytes) -> int:
    """In how many members two sets differ at least, by their sketches: a longer one is folded to the shorter's bits."""
    x, y = sorted((np.frombuffer(s, np.uint8) for s in (a, b)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _not_unlike(candidates: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The candidates (a, b) but those that their sketches show to be of less than that similarity. Loses no similar pair."""
    left, right = (sketches.select(F.col("id").alias(c), F.col("size").alias(f"{c}_size"), F.col("sketch").alias(f"{c}_sketch")) for c in ("a", "b"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            a, b, n, m, x, y = (c.to_pylist() for c in part.columns)
            may = [least_difference(p, q) <= (1 - similarity) / (1 + similarity) * (i + j) + 1e-9 for i, j, p, q in zip(n, m, x, y)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(may, pa.bool_())) for c in part.columns[:2]], names=["a", "b"])

    both = small_batches(candidates.join(left, "a").join(right, "b"))
    return both.select("a", "b", "a_size", "b_size", "a_sketch", "b_sketch").mapInArrow(trimmed(run), "a long, b long")


def _similar(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The candidates (a, b) whose shingle sets (id, shingles) are of at least that Jaccard similarity."""
    left, right = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"{c}_set")) for c in ("a", "b"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return candidates.join(left, "a").join(right, "b").filter(both >= similarity * (F.size("a_set") + F.size("b_set") - both)).select("a", "b")


def without_near_duplicates(docs: DataFrame, words: int = 5, distance: int = 7, similarity: float = 0.8, cap: int = CAP, tile: int = TILE) -> DataFrame:
    """The rows of docs less all but one of each group of near duplicates: the one with the smallest doc_id stays.

    Two texts are linked if the Jaccard similarity of their shingle sets is at least similarity. Links
    among fingerprints that differ by at most distance bits are found first, each standing for one set
    that has it, as equal fingerprints do not mean copies; an exact prefix-filter
    join of the sets then finds all others that these do not connect already, so none is missed, nor
    any that a variant group's spanning forest of SimHash links leaves out. Only equal sets collapse unseen.
    A shingle of over cap sets is split, by size and then in tiles; no task holds them all.

    Defined results: null and empty texts, and texts of white space only, have the empty set, so one of
    them all stays; of repeated rows, one; a null doc_id counts as the largest, and among equal doc_ids
    the row that is stored first stays; an empty table gives no rows; other columns are kept as they are.
    """
    names = {n: fresh(docs, f"simhash_{n}") for n in ("row", "fp", "set")}
    row, fp, own = (F.col(names[c]) for c in ("row", "fp", "set"))
    columns, text = docs.columns, docs.columns.index("text")
    fields = T.StructType([*docs.schema.fields, T.StructField(names["fp"], T.LongType()), T.StructField(names["set"], T.LongType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as digest

        for whole in parts:
            for part in batches(whole, column=text):
                texts = part.column(text).to_pylist()
                sets = np.array([digest(_shingle_set(t, words).tobytes()) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x.view(np.int64)) for x in (fingerprint_batch(texts, words), sets))], names=fields.names)

    held = materialize(small_batches(docs).select(*columns).mapInArrow(trimmed(run), fields).withColumn(names["row"], F.monotonically_increasing_id()), "fingerprinted")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), row.alias("row"), fp.alias("fp"))
    n = held.count()
    distinct = materialize(held.groupBy(own.alias("id")).agg(F.min(order).alias("first"), F.count("*").alias("n")), "distinct", n)
    texts = held.join(small(distinct.select(F.col("first.row").alias("wanted"))), row == F.col("wanted"), "left_semi").select(own.alias("id"), F.col("text").cast("string").alias("text"))

    prints = materialize(distinct.groupBy("first.fp").agg(F.min("id").alias("id")), "prints", n)

    def ends_of(candidates: DataFrame) -> DataFrame:
        ends = candidates.select(F.col("a").alias("end")).unionByName(candidates.select(F.col("b").alias("end"))).distinct()
        return texts.join(small(materialize(ends, "wanted", n)), F.col("id") == F.col("end"), "left_semi")

    def verified(candidates: DataFrame) -> DataFrame:
        """Sketches, a few bits a shingle, leave little more than the similar pairs to be compared in full."""
        sketches = materialize(_sketches(ends_of(candidates), words), "sketches")
        rest = materialize(_not_unlike(candidates, sketches, similarity), "not-unlike", n)
        sets = materialize(_shingle_sets(ends_of(rest), words), "shingles")
        return materialize(_similar(rest, sets, similarity), "verified", n)

    def rooted(found: DataFrame) -> DataFrame:
        roots = materialize(components(found, n), "roots", n)
        return distinct.join(small(roots), distinct["id"] == roots["node"], "left").select("id", "first", "n", F.coalesce("root", "id").alias("root"))

    one, other = (prints.select(F.col("fp").alias(f"{c}_fp"), F.col("id").alias(c)) for c in ("a", "b"))
    near = links(prints.select("fp"), distance, small_group=1).distinct().select(F.col("a").alias("a_fp"), F.col("b").alias("b_fp"))
    found = verified(materialize(near.join(one, "a_fp").join(other, "b_fp").select("a", "b"), "candidates", n))
    known = materialize(rooted(found).select(F.col("id").alias("of"), "root"), "known", n)
    common = _common_shingles(texts, words)
    index = _prefixes(texts, words, similarity, common)
    index = index.join(small(known), F.col("id") == F.col("of"))
    found = found.unionByName(verified(_set_links(index, similarity, common[0][common[1] * SAMPLE > cap], cap, tile)))
    known = rooted(found)
    firsts = known.groupBy("root").agg(F.min("first").alias("stays"), F.sum("n").alias("members")).filter("members > 1")
    groups = materialize(known.join(firsts, "root").select(F.col("id").alias("group"), F.col("stays.row").alias("stays")), "groups", n)
    joined = held.join(small(groups), own == F.col("group"), "left")
    return joined.filter(F.col("stays").isNull() | (F.col("stays") == row)).select(*columns)
