"""Similarity joins, components and novelty."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import ani


def _shared(df: DataFrame) -> str:
    """The folder of this session in spark.checkpoint.dir; a temporary one where that is unset (tests)."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            at = tempfile.mkdtemp(prefix="quern-checkpoint-")
        sc.setCheckpointDir(at)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """A frame without lineage, in spark.checkpoint.dir."""
    _shared(df)
    sc = df.sparkSession.sparkContext
    out = df.checkpoint()
    del df
    sc._jvm.System.gc()  # what it shuffled is deleted now, not when the driver's heap is full
    return out


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """A frame as a Parquet table in spark.checkpoint.dir, of which reads take the columns they name.

    What its plan shuffled is deleted once it is written, the table itself when the block ends.
    """
    spark, path, name = df.sparkSession, f"{_shared(df)}/table-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, was)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their place, from 0, in an order: sorted by range and numbered range by range.

    The driver sees one count a partition, and no window runs over all rows.
    """
    parts = checkpointed(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    before, start = 0, []
    for r in sorted(parts.groupBy("_part").count().collect()):
        start.append((r["_part"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(start, "_part int, _start long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + inside - 1).drop("_part", "_start")


def least_jaccard(least: float, k: int) -> float:
    """The Jaccard similarity at which the estimate reaches ``least``."""
    x = least**k
    return x / (2 - x)


#: Ranges that the 64-bit hashes of grams fall into, and grams that a step over ranges holds at least.
RANGES, STEP = 16, 4_000_000


def gram_sets(grams: DataFrame, key: str, gram: str) -> DataFrame:
    """(key, set): the 64-bit hashes of each key's grams."""
    return grams.groupBy(key).agg(F.collect_set(F.xxhash64(gram)).alias("set"))


#: Top bits of a hash that name its bucket; hashes that a task counts at once; bits of a bucket's bitmap, at most, by their logarithm.
BUCKETS, COUNTED, MOST_BITS = 8, 1 << 21, 22


def _listed(column) -> list[np.ndarray]:
    """The arrays of an Arrow column of lists of numbers."""
    ends = column.offsets.to_numpy()
    return np.split(column.values.to_numpy()[ends[0] : ends[-1]], ends[1:-1] - ends[0])


def _counted(batches):
    """(bucket, once, often): by bucket the next 32 bits of hashes that one set of a part of the task holds, or several do."""
    schema, seen, held, size = pa.schema([("bucket", pa.int32()), ("once", pa.binary()), ("often", pa.binary())]), set(), [], 0

    def parts():
        h, n = np.unique(np.concatenate(held).view(np.uint64) >> np.uint64(32 - BUCKETS), return_counts=True)
        at, low = np.searchsorted(h, np.arange((1 << BUCKETS) + 1, dtype=np.uint64) << np.uint64(32)), h.astype(np.uint32)
        rows = [(k, low[a:b], n[a:b] > 1) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], pa.int32()), *(pa.array([x[m == often].tobytes() for _, x, m in rows], pa.binary()) for often in (False, True))], schema=schema)

    for b in batches:
        for s in _listed(b.column(0)):
            if len(s) and (name := hashlib.blake2b(np.sort(s).tobytes(), digest_size=8).digest()) not in seen:
                seen.add(name)
                held.append(s)
                size += len(s)
        if size > COUNTED:
            yield parts()
            held, size = [], 0
    if held:
        yield parts()


def _bucket_bits(batches):
    """(bucket, bits): a bitmap of the hashes that two sets hold, of sixteen bits a hash if these are not too many."""
    parts: dict[int, tuple[list, list]] = {}
    for b in batches:
        for k, once, often in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for x, y in zip(parts.setdefault(k, ([], [])), (once, often), strict=True):
                x.append(np.frombuffer(y, np.uint32))
    for k in list(parts):
        once, often = (np.concatenate(x) for x in parts.pop(k))
        h, n = np.unique(np.concatenate([once, often, often]), return_counts=True)
        h = h[n > 1]
        bits = np.zeros(1 << min(MOST_BITS, max(6, int(16 * len(h)).bit_length())), bool)
        bits[h & np.uint32(len(bits) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bucket", "bits"])


class Shared:
    """Bitmaps, by bucket, of the hashes that two different sets hold; some others count as shared too, none is missed."""

    def __init__(self, sets: DataFrame):
        sets.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
        dealt = sets.select("set").where("set is not null").mapInArrow(_counted, "bucket int, once binary, often binary").repartition("bucket")
        with stored(dealt.mapInArrow(_bucket_bits, "bucket int, bits binary")) as table:
            found = {r["bucket"]: bytes(r["bits"]) for r in table.collect()}
        self.size, begin = np.ones(1 << BUCKETS, np.uint32), np.zeros(1 << BUCKETS, np.int64)
        bits, at = [b"\0"], 1
        for k, x in found.items():
            self.size[k], begin[k] = 8 * len(x), at
            bits.append(x)
            at += len(x)
        self.begin, self.bits = begin, np.frombuffer(b"".join(bits), np.uint8)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """Which hashes may be in two sets."""
        h = s.view(np.uint64) >> np.uint64(32 - BUCKETS)
        k, low = (h >> np.uint64(32)).astype(np.int64), h.astype(np.uint32)
        bit = low & (self.size[k] - np.uint32(1))
        return self.bits[self.begin[k] + (bit >> np.uint32(3))] >> (bit & np.uint32(7)).astype(np.uint8) & 1 > 0


def _ranges(sets: DataFrame, key: str, t: float) -> DataFrame:
    """(key, n, name, s0, ...): equal sets have equal names; sets that hold enough shared hashes for a
    similarity of ``t`` are cut by ranges of hashes, the others are null."""
    rows = sets.where(F.col(key).isNotNull() & F.col("set").isNotNull()).select(key, "set")
    shared, ranges = rows.sparkSession.sparkContext.broadcast(Shared(rows)), RANGES

    def cut(batches):
        for b in batches:
            all_of = [np.sort(s) for s in _listed(b.column(1))]
            may = [bool(len(s)) and int(shared.value(s).sum()) >= t * len(s) for s in all_of]
            parts = []
            for r in range(ranges):
                some = [s[s % ranges == r] if ok else s[:0] for s, ok in zip(all_of, may, strict=True)]
                ends = np.r_[0, np.cumsum([len(s) for s in some], dtype=np.int64)].astype(np.int32)
                parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(some)), mask=pa.array([not x for x in may])) if some else pa.array([], pa.list_(pa.int64())))
            names = [hashlib.sha256(s.tobytes()).digest() for s in all_of]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in all_of], pa.int32()), pa.array(names, pa.binary()), *parts], names=[key, "n", "name", *[f"s{r}" for r in range(ranges)]])

    kind = dict(rows.dtypes)[key]
    return rows.mapInArrow(cut, f"`{key}` {kind}, n int, name binary, " + ", ".join(f"s{r} array<long>" for r in range(ranges)))


def _near(part: DataFrame, t: float) -> DataFrame:
    """Pairs (left_id, right_id) of rows (_key, _set) whose sets may have a Jaccard similarity of ``t``.

    Two such sets miss few of each other's grams, so with grams ordered by how many sets
    hold them, rarest first, they share one in the first ``n - ceil(t * n) + 1`` of each. Only
    these prefixes are indexed; sizes thin the pairs.
    """
    grams = part.select("_key", F.size("_set").alias("_n"), F.explode("_set").alias("_g"))
    shared = grams.withColumn("_c", F.count("*").over(Window.partitionBy("_g"))).where("_c > 1")
    shared = shared.groupBy("_key").agg(F.first("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("_c", "_g"))).alias("_s"))
    # grams of one set only stand first in the order and meet nothing
    many = F.col("_n") - F.ceil(F.lit(t) * F.col("_n")) + 1 - (F.col("_n") - F.size("_s"))
    index = shared.where(many > 0).select("_key", "_n", F.explode(F.slice("_s", F.lit(1), many.cast("int"))["_g"]).alias("_g"))
    side = lambda name, size: index.withColumnsRenamed({"_key": name, "_n": size})
    near = side("left_id", "_a").join(side("right_id", "_b"), "_g")
    near = near.where((F.col("left_id") < F.col("right_id")) & (F.least("_a", "_b") >= F.lit(t) * F.greatest("_a", "_b")))
    return near.select("left_id", "right_id").distinct()


#: Sets and grams that a block of a family holds, and that a group of families does.
MEMBERS, GRAMS = 512, 400_000


def _dealt(near: DataFrame, sizes: DataFrame, take) -> tuple[DataFrame, DataFrame, int]:
    """Pairs (left_id, right_id, _a, _b, _k) and places (_key, _k): both ends of a pair have a place in its group _k; and the grams that move.

    Pairs join nodes to families. Small families share a group, large ones are dealt into blocks,
    and each pair of blocks is a group.
    """
    ends = take(near.select(F.col("left_id").alias("_key")).union(near.select("right_id")).distinct().join(sizes, "_key"))
    roots = take(components(ends, near, "_key").join(ends, "_key").select("_key", "_n", F.xxhash64("root").alias("_r")))
    load = roots.groupBy("_r").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("_n") / GRAMS)).cast("int").alias("_p"))
    place = take(roots.join(load, "_r").withColumn("_b", F.pmod(F.xxhash64("_key"), "_p").cast("int")))
    moved = place.agg(F.sum(F.col("_n") * F.col("_p"))).first()[0] or 0
    group = lambda i, j: F.when(F.col("_p") == 1, F.pmod("_r", F.lit(max(1, moved // GRAMS)))).otherwise(F.xxhash64("_r", F.least(i, j), F.greatest(i, j))).alias("_k")
    left, right = place.select(F.col("_key").alias("left_id"), "_r", "_p", F.col("_b").alias("_i")), place.select(F.col("_key").alias("right_id"), F.col("_b").alias("_j"))
    pairs = take(near.join(left, "left_id").join(right, "right_id").select("left_id", "right_id", "_a", "_b", group("_i", "_j")))
    places = place.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_p") - 1))).select("_key", group("_b", "_o"))
    return pairs, take(places.distinct()), moved


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(left_id, right_id, _a, _b, _i): how many hashes the sets (_k, _key, _set) of each pair have in common."""

    def count(pairs, sets):
        at = {x: i for i, x in enumerate(sets["_key"].to_pylist())}
        rows = [r for c in sets["_set"].chunks for r in _listed(c)]
        ends = np.r_[0, np.cumsum([len(r) for r in rows], dtype=np.int64)]
        words = np.unique(np.concatenate(rows), return_inverse=True)[1] if rows else np.zeros(0, np.int64)
        x, y = (np.array([at[v] for v in pairs[c].to_pylist()], np.int64) for c in ("left_id", "right_id"))
        order, out, held = np.argsort(x, kind="stable"), np.zeros(len(x), np.int64), np.zeros(int(words.max(initial=-1)) + 1, bool)
        for some in np.split(order, np.flatnonzero(np.diff(x[order])) + 1):
            if not len(some):
                continue
            mine = words[ends[x[some[0]]] : ends[x[some[0]] + 1]]
            held[mine] = True
            for begin in range(0, len(some), 256):
                part = some[begin : begin + 256]
                other = [words[ends[v] : ends[v + 1]] for v in y[part]]
                both = np.r_[0, np.cumsum(held[np.concatenate(other)])]
                stop = np.cumsum([len(v) for v in other])
                out[part] = both[stop] - both[np.r_[0, stop[:-1]]]
            held[mine] = False
        return pairs.select(["left_id", "right_id", "_a", "_b"]).append_column("_i", pa.array(out))

    kinds = dict(pairs.dtypes)
    return pairs.groupBy("_k").cogroup(sets.groupBy("_k")).applyInArrow(count, ", ".join(f"{c} {kinds[c]}" for c in ("left_id", "right_id", "_a", "_b")) + ", _i long")


def _similar(held: DataFrame, firsts: DataFrame, key: str, k: int, least: float) -> DataFrame:
    """Pairs (left_id, right_id, estimated_ani) among ``firsts``, checkpointed, whose estimate is ``least`` or more.

    ``least`` means a Jaccard similarity t. Shared grams and the union are sums over ranges of
    hashes, so sets with that similarity have it in one range at least: ranges are searched
    one step after the other, of a sixteenth of all grams when these are many. Whole sets verify the
    pairs found, again range by range: sets of one family of pairs meet in one task, so a set moves
    once, and large families in blocks.
    """
    t = least_jaccard(least, k) - 1e-9
    sizes = held.join(firsts, key, "left_semi").select(F.col(key).alias("_key"), F.col("n").alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    steps = 1
    while steps < RANGES and steps * STEP < total:
        steps *= 2
    groups = [[f"s{r}" for r in range(i, RANGES, steps)] for i in range(steps)]
    of = lambda names: held.select(key, *names).join(firsts, key, "left_semi").withColumnRenamed(key, "_key")
    with ExitStack() as tables:
        take = lambda df: tables.enter_context(stored(df))
        found = [take(_near(of(names).select("_key", F.concat(*names).alias("_set")), t)) for names in groups]
        near = reduce(DataFrame.union, found).distinct()
        near = near.join(sizes.withColumnsRenamed({"_key": "left_id", "_n": "_a"}), "left_id").join(sizes.withColumnsRenamed({"_key": "right_id", "_n": "_b"}), "right_id")
        near = take(near.where(F.least("_a", "_b") >= F.lit(t) * F.greatest("_a", "_b")))
        pairs, places, moved = _dealt(near, sizes, take)
        batches = max(1, -(-moved // (steps * STEP)))
        links = []
        for i in range(batches):
            with ExitStack() as batch:
                keep = lambda df: batch.enter_context(stored(df))  # noqa: B023, E731
                part = lambda df: df.where(F.pmod(F.xxhash64("_k"), F.lit(batches)) == i)  # noqa: B023, E731
                counts = []
                for names in groups:
                    sets = of(names).join(part(places), "_key").select("_k", "_key", F.concat(*names).alias("_set"))
                    counts.append(keep(_common(part(pairs), sets)))
                all_of = counts[0] if steps == 1 else reduce(DataFrame.union, counts).groupBy("left_id", "right_id", "_a", "_b").agg(F.sum("_i").alias("_i"))
                j = F.col("_i") / (F.col("_a") + F.col("_b") - F.col("_i"))
                links.append(take(all_of.select("left_id", "right_id", ani(j, k).alias("estimated_ani")).where(F.col("estimated_ani") >= least)))
        return checkpointed(reduce(DataFrame.union, links))


def similar_nodes(sets: DataFrame, key: str, k: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(key, first) and pairs (left_id, right_id, estimated_ani) of firsts whose sets are similar, for least > 0.

    ``sets`` has key, once each, and set, the hashes of its grams, each once. Equal sets are one
    node, its smallest key the first, so thousands of copies make no pairs among themselves.
    Sets are made twice: first to count hashes in 40 bits, of which only a bitmap of those that two
    sets hold stays, and then to keep, of eight bytes a gram until the pairs are known, only sets
    that hold enough of these. A set that misses more has no similar one.
    """
    with stored(_ranges(sets, key, least_jaccard(least, k) - 1e-9)) as held:
        own = held.groupBy("name").agg(F.min(key).alias("first"))
        members = checkpointed(held.select(key, "name").join(own, "name").select(key, "first"))
        firsts = members.where(F.col(key) == F.col("first")).join(held.where("s0 is not null").select(key), key, "left_semi").select(key)
        return members, _similar(held, firsts, key, k, least)


def similar_pairs(sets: DataFrame, key: str, k: int, least: float) -> DataFrame:
    """Pairs (left_id, right_id, estimated_ani) of keys whose sets are similar, copies with each other too."""
    members, pairs = similar_nodes(sets, key, k, least)
    of = lambda name, first: members.select(F.col(key).alias(name), F.col("first").alias(first))
    apart = pairs.withColumnsRenamed({"left_id": "_x", "right_id": "_y"}).join(of("_l", "_x"), "_x").join(of("_r", "_y"), "_y")
    apart = apart.select(F.least("_l", "_r").alias("left_id"), F.greatest("_l", "_r").alias("right_id"), "estimated_ani")
    equal = of("left_id", "_x").join(of("right_id", "_x"), "_x").where(F.col("left_id") < F.col("right_id"))
    return apart.union(equal.select("left_id", "right_id", F.lit(1.0)))


def self_join(grams: DataFrame, key: str, gram: str, k: int, least: float) -> DataFrame:
    """Pairs (left_id, right_id, estimated_ani) of keys whose grams are similar, for least > 0."""
    return similar_pairs(gram_sets(grams, key, gram), key, k, least)


def set_clusters(nodes: DataFrame, sets: DataFrame, key: str, k: int, least: float) -> DataFrame:
    """(key, root): single-linkage clusters of sets, by the smallest key of each."""
    members, pairs = similar_nodes(sets, key, k, least)
    roots = components(members.select(F.col("first").alias("_f")).distinct(), pairs, "_f")
    of = members.select(F.col(key).alias("_k"), F.col("first").alias("_f")).join(roots, "_f").select("_k", "root")
    return nodes.select(key).join(of, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("root", key).alias("root"))


def clusters(nodes: DataFrame, grams: DataFrame, key: str, gram: str, k: int, least: float) -> DataFrame:
    """(key, root): single-linkage clusters of keys by their grams."""
    return set_clusters(nodes, gram_sets(grams, key, gram), key, k, least)


def components(nodes: DataFrame, edges: DataFrame, node: str, rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node of each component.

    Labels go to the smallest neighbour's and then jump to their label's label, so rounds
    grow with the logarithm of a chain's length; each round is checkpointed.
    """
    both = checkpointed(edges.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).union(edges.select("right_id", "left_id")))
    label = checkpointed(nodes.select(F.col(node).alias("v"), F.col(node).alias("root")))
    for _ in range(rounds):
        near = both.join(label, both.b == label.v).groupBy("a").agg(F.min("root").alias("m"))
        low = label.join(near, label.v == near.a, "left").select("v", F.least("root", F.coalesce("m", "root")).alias("low"), "root")
        jump = low.select(F.col("v").alias("w"), F.col("low").alias("far"))
        new = checkpointed(low.join(jump, low.low == jump.w, "left").select("v", F.least("low", F.coalesce("far", "low")).alias("root"), F.col("root").alias("old")))
        if new.where("root <> old").isEmpty():
            return new.select(F.col("v").alias(node), "root")
        label = new.select("v", "root")
    raise RuntimeError("components did not settle")


def cluster_labels(membership: DataFrame, node: str) -> DataFrame:
    """Roots in order as cluster_00001, ..., with each cluster's size."""
    roots = numbered(membership.groupBy("root").agg(F.count("*").alias("cluster_size")), [F.col("root")], "_place")
    named = roots.select("root", "cluster_size", F.format_string("cluster_%05d", F.col("_place") + 1).alias("cluster_id"))
    return membership.join(named, "root").select(node, "cluster_id", "cluster_size")


def nearest(pairs: DataFrame, queries: DataFrame, query: str) -> DataFrame:
    """For each query the greatest similarity and its reference, ties to the smallest; 0 and null without one.

    ``pairs`` has query_id, reference_id and similarity.
    """
    best = pairs.groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("reference_id")).alias("o"))).alias("m"))
    return queries.join(best, queries[query] == best.query_id, "left").select(query, F.coalesce("m.similarity", F.lit(0.0)).alias("maximum"), (-F.col("m.o")).alias("nearest"))


#: Bits of a word of a profile's bitmap; profiles that a block holds, and that meet at once in a task.
_WORD, BLOCK, CHUNK = 62, 32768, 1024
#: Profiles of a slab, of a window of its orders, and how often rows are dealt anew into slabs.
SLAB, WINDOW, DEALS = 1 << 18, 512, 8


def _bitmaps(profiles: DataFrame, profile: str, width: int) -> DataFrame:
    """Adds the words of a profile's bitmap (features from 1 to ``width``)."""
    bits = lambda w: F.aggregate(F.filter(profile, lambda x: F.floor((x - 1) / _WORD) == w), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), ((x - 1) % _WORD).cast("int"))))
    return profiles.withColumns({f"_w{w}": bits(w) for w in range(max(1, -(-width // _WORD)))})


def _bits(rows: np.ndarray) -> np.ndarray:
    """The bits of rows of words, a byte each."""
    return np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1), axis=1)


def greatest_jaccard(a: np.ndarray, b: np.ndarray, apart: bool) -> np.ndarray:
    """For each row of ``a`` the greatest Jaccard similarity to a row of ``b``, both rows of words; -1 without one.

    Matrix products count shared bits; among rows of one size the most shared bits are the
    greatest similarity, so quotients are taken once a size. With ``apart`` equal rows don't meet.
    """
    size_a, size_b = (np.bitwise_count(x.view(np.uint64)).sum(1).astype(np.int64) for x in (a, b))
    by_a, by_b = np.argsort(size_a, kind="stable"), np.argsort(size_b, kind="stable")
    a, b, size_a, size_b = a[by_a], b[by_b], size_a[by_a], size_b[by_b]
    shares = np.unpackbits((np.bitwise_or.reduce(a, axis=0) & np.bitwise_or.reduce(b, axis=0)).view(np.uint8)).astype(bool)
    start = np.flatnonzero(np.r_[True, size_b[1:] != size_b[:-1]][: len(b)]).tolist()
    best = np.full(len(a), -1.0)
    for i in range(0, len(a), CHUNK):
        left, n, mine = _bits(a[i : i + CHUNK])[:, shares].T.astype(np.float32), size_a[i : i + CHUNK], best[i : i + CHUNK]
        for begin, end in zip(start, [*start[1:], len(b)], strict=True):
            m, most = size_b[begin], np.full(len(n), -1.0, np.float32)
            low, high = np.searchsorted(n, [m, m + 1])
            for j in range(begin, end, CHUNK):
                shared = _bits(b[j : min(j + CHUNK, end)])[:, shares].astype(np.float32) @ left
                if apart and low < high:
                    same = shared[:, low:high]
                    same[same == m] = -1
                np.maximum(most, shared.max(0), out=most)
            count = most.astype(np.int64)
            union = n + m - count
            np.maximum(mine, np.where(count < 0, -1.0, np.where(union == 0, 1.0, count / np.maximum(union, 1))), out=mine)
    out = np.empty(len(best))
    out[by_a] = best
    return out


def some_jaccard(rows: np.ndarray, orders: int, seed: int) -> np.ndarray:
    """For each row of words a Jaccard similarity to another row, its greatest or less; -1 without one.

    Rows are put into some orders, each by the bits of other columns first, in which similar rows
    often stand close, and meet the rows of their window.
    """
    best, rng, n = np.full(len(rows), -1.0), np.random.default_rng(seed), len(rows)
    held = np.bitwise_or.reduce(rows, axis=0)
    vary = np.flatnonzero([held[k // _WORD] >> (k % _WORD) & 1 for k in range(_WORD * rows.shape[1])])
    columns = _bits(held[None])[0].astype(bool)
    at = np.arange(-(-n // WINDOW) * WINDOW) % n  # the last window begins again
    for _ in range(orders):
        order = np.zeros(n, np.int64)
        for k in rng.permutation(vary)[:_WORD]:
            order = order << 1 | rows[:, k // _WORD] >> (k % _WORD) & 1
        for some in np.argsort(order)[at].reshape(-1, WINDOW):
            bits = _bits(rows[some])[:, columns].astype(np.float32)
            size, shared = np.maximum(bits.sum(1), np.float32(0.5)), bits @ bits.T
            union = size[:, None] + size
            union -= shared
            near = shared / union
            near[near == 1] = -1  # equal rows
            to = near.argmax(1)
            first = np.arange(WINDOW), to
            found = np.where(near[first] < 0, -1.0, shared[first].astype(np.float64) / union[first])
            np.maximum.at(best, some, found)
    return best


def _greatest(left: DataFrame, right: DataFrame, name: str, width: int, apart: bool) -> DataFrame:
    """(name, similarity): for each row of ``left`` the greatest Jaccard similarity to a row of ``right``.

    Both sides are dealt into blocks, a row each, of the words of their bitmaps; each pair of blocks
    is compared in one task, and only maxima move on. With ``apart`` rows of equal bits don't
    meet. Every pair is compared, by the bits they share.
    """
    words = [f"_w{w}" for w in range(max(1, -(-width // _WORD)))]
    parts = lambda n: max(1, -(-n // BLOCK), min(8, -(-n // 1024)))
    many = parts(left.count()), parts(right.count())

    def blocks(df, mine, other, n, m, side):
        rows = df.where(F.col(words[0]).isNotNull()).groupBy(F.pmod(F.xxhash64(*words), F.lit(n)).cast("int").alias(mine)).agg(F.collect_list(F.array(*words)).alias("_rows"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select("_i", "_j", F.lit(side).alias("_side"), "_rows")

    def compare(table):
        of = {0: [], 1: []}
        for side, rows in zip(table["_side"].to_pylist(), table["_rows"].combine_chunks(), strict=True):
            of[side] = rows.values.flatten().to_numpy().reshape(-1, len(words))
        a = of[0] if len(of[0]) and len(of[1]) else np.zeros((0, len(words)), np.int64)
        best = greatest_jaccard(a, of[1], apart) if len(a) else np.zeros(0)
        return pa.table({**{w: pa.array(a[:, k]) for k, w in enumerate(words)}, "similarity": pa.array(best)})

    both = blocks(left, "_i", "_j", *many, 0).union(blocks(right, "_j", "_i", many[1], many[0], 1))
    met = both.repartition(min(many[0] * many[1], 2048), "_i", "_j").groupBy("_i", "_j").applyInArrow(compare, ", ".join(f"{w} long" for w in words) + ", similarity double")
    most = met.where("similarity >= 0").groupBy(*words).agg(F.max("similarity").alias("similarity"))
    return left.join(most, words).select(name, "similarity")


def maximum_jaccard(queries: DataFrame, reference: DataFrame, key: str, profile: str, width: int) -> DataFrame:
    """The greatest Jaccard similarity of each profile to one of the reference; 0 if that is empty.

    Equal profiles are compared once.
    """
    asked, there = (checkpointed(_bitmaps(x.select(profile).distinct(), profile, width)) for x in (queries, reference))
    most = _greatest(asked, there, profile, width, False)
    return queries.join(most, profile, "left").select(key, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def leave_one_out(profiles: DataFrame, profile: str, width: int) -> DataFrame:
    """For each different profile its greatest similarity to another one; 1 if it is the only one."""
    one = checkpointed(_bitmaps(profiles.select(profile).distinct(), profile, width))
    return one.select(profile).join(_greatest(one, one, profile, width, True), profile, "left").select(profile, F.coalesce("similarity", F.lit(1.0)).alias("similarity"))


def _some(one: DataFrame, count: int, width: int) -> DataFrame:
    """(words, low): a similarity of each row of bitmaps to another one, its greatest or less."""
    words = [f"_w{w}" for w in range(max(1, -(-width // _WORD)))]
    slabs, orders = -(-count // SLAB), min(6, 1 + count // (1 << 16))

    def near(table):
        deal = table["_d"][0].as_py()
        rows = table["_rows"].combine_chunks().values.flatten().to_numpy().reshape(-1, len(words))
        return pa.table({**{w: pa.array(rows[:, k]) for k, w in enumerate(words)}, "low": pa.array(some_jaccard(rows, orders, deal))})

    dealt = one.where(F.col(words[0]).isNotNull()).select(*words, F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("_d"))
    dealt = dealt.groupBy("_d", F.pmod(F.xxhash64(*words, "_d"), F.lit(slabs)).cast("int").alias("_s")).agg(F.collect_list(F.array(*words)).alias("_rows"))
    met = dealt.repartition(min(DEALS * slabs, 2048), "_d", "_s").groupBy("_d", "_s").applyInArrow(near, ", ".join(f"{w} long" for w in words) + ", low double")
    return met.where("low >= 0").groupBy(*words).agg(F.max("low").alias("low"))


def _at(rows: DataFrame, column: str, place: int) -> float:
    """The value at a place, from 0, in order; similarities have no more values than pairs of sizes."""
    for value, n in sorted(rows.groupBy(column).count().collect()):
        place -= n
        if place < 0:
            return value
    raise IndexError("beyond the last row")


def least_alike(profiles: DataFrame, profile: str, width: int, quantile: float) -> DataFrame:
    """As ``leave_one_out``, exact for all profiles that a quantile of the similarities, or one below it, depends on.

    The others get a similarity to one of the profiles which is not below that quantile, so the
    quantile is the exact one. A similarity of each profile to another one, found in windows of
    some orders, bounds its greatest from below. Those lowest by this bound are compared with all
    profiles, which bounds the quantile from above, and then all the others whose own bound is below that.
    """
    one = checkpointed(_bitmaps(profiles.select(profile).distinct(), profile, width))
    words, count = one.columns[1:], one.count()
    exact = lambda some: checkpointed(some.select(profile).join(_greatest(some, one, profile, width, True), profile, "left").select(profile, F.coalesce("similarity", F.lit(1.0)).alias("similarity")))
    if count <= BLOCK:
        return exact(one)
    low = checkpointed(one.join(_some(one, count, width), words, "left").withColumn("low", F.coalesce("low", F.when(F.col(words[0]).isNull(), 1.0).otherwise(0.0))))
    last = min(int(quantile * (count - 1)) + 1, count - 1)
    first = _at(low, "low", min(last + max(last // 4, WINDOW), count - 1))
    lowest = exact(low.where(F.col("low") <= first))
    most = _at(lowest, "similarity", last)
    unsure = (F.col("low") > first) & (F.col("low") < most)
    rest = low.where((F.col("low") > first) & (F.col("low") >= most)).select(profile, F.col("low").alias("similarity"))
    return lowest.union(exact(low.where(unsure))).union(rest)


def novelty_floor(similarities: DataFrame, column: str, quantile: float) -> DataFrame:
    """The exact, linearly interpolated quantile."""
    return similarities.agg(F.percentile(column, F.lit(quantile)).alias("floor"))
