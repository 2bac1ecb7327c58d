"""MinHash near-dedup: universal hash minima, banding, verification, components by alternating stars.

1. Each text gives its set of 5-word shingles (64-bit hashes), 125 minima under universal hash functions, 25 bands
   of five minima, and a bit of each minimum as signature (two longs).  Below 85 % bands are shorter (``banding``).
2. Equal sets are one class; its smallest document represents it, so exact copies cost one row each.
3. Members of a bucket meet a leader, never each other, so candidates are linear in the bucket.  Leaders are drawn
   by one order for all bands, so most bands give the same pairs.  The signatures must agree, then the sets decide.
4. Components by alternating large-star and small-star.  In buckets that still hold several components, the members
   outside the largest one meet all members of others: as pairs where they are few or the bucket is small, and
   inside a join that gives out links only where they are many.  So no pair of a bucket goes uncompared unless its
   documents are joined already.  That join works in blocks of some ``BLOCK`` members a side, dealt to tasks as they
   are, so a task holds a few blocks, however large their buckets are.

Two texts with similarity 0.85 share no band with probability (1 - 0.85**5)**25 < 1e-6, and their signatures fall
below the floor with a probability of at most 1e-7, in buckets of any size: pairs that leave the join have signatures of
125 bits, those compared inside it of 512, each with the floor that this bound needs.  Which way a bucket takes
(``crowd``) changes its cost alone.  Links are confirmed on whole sets of 64-bit hashes.
Nulls, empty texts: no shingles, alone.  Very long texts: sets of any size.  Other columns are ignored.  Fewer than five words: one shingle of all words.  Rows that share a
doc_id are one document each; component ids are doc_ids.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, Words, distinct_per_doc, long_array, materialize, mix, slices, unused

SHINGLE = 5
BANDS, ROWS = 25, 5
#: Bits of the longer signature of documents in crowded buckets.
LONG = 512
#: Members of a crowded bucket on each side of a block of its comparison.
BLOCK = 1_024


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_607)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * U(2) + U(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and where each document's begin."""
    n, k = len(words.hash), SHINGLE
    grams = np.zeros(n, np.uint64)
    whole = words.grams(k)
    grams[: len(whole)] = whole
    use = words.whole(k)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    for i in short:  # the whole sequence is the shingle
        a, b = words.word_off[i], words.word_off[i + 1]
        h = np.array([b - a], dtype=np.uint64)
        for w in words.hash[a:b]:
            h = mix(h * U(0x9E3779B97F4A7C15) + w)
        grams[a], use[a] = h[0], True
    return distinct_per_doc(words.doc[use], grams[use], words.n_docs)


def _minima(value: np.ndarray, begins: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least hash of each set under each hash function; begins: where the sets begin, none of them empty."""
    out = np.zeros((len(begins), len(a)), dtype=np.uint64)
    if len(begins):
        for j in range(len(a)):
            x = value * a[j]
            x += b[j]
            x ^= x >> U(32)
            out[:, j] = np.minimum.reduceat(x, begins)
    return out


def banding(percent: int) -> tuple[int, int]:
    """Bands, and minima of each: a pair at ``percent`` shares no band with probability below 1e-6."""
    rows = ROWS
    while True:
        bands = math.ceil(math.log(1e-6) / math.log1p(-((min(percent, 99) / 100) ** rows)))
        if bands <= 30 or rows == 1:
            return max(BANDS, bands), rows
        rows -= 1


def allowed(bits: int, percent: int) -> int:
    """Signature bits that alike sets may differ in: a pair at ``percent`` exceeds them with probability of at most 1e-7."""
    p = (1 - percent / 100) / 2
    over, k = 1.0, -1
    while over > 1e-7 and k < bits:
        k += 1
        over = math.fsum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(k + 1, bits + 1))
    return k


def _band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    keys = np.zeros((len(minima), minima.shape[1] // rows), dtype=np.uint64)
    for r in range(rows):
        keys = mix((keys + minima[:, r::rows]) * U(0x9E3779B97F4A7C15))
    return keys


SKETCH = "doc_id long, n_shingles long, set1 long, set2 long, s1 long, s2 long, bands array<long>"


def _sketch(bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    used = min(128, bands * rows)  # bits of the signature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(bands * rows)
        for batch in slices(batches):
            words = Words(batch.column(1), lower=True)
            value, off = shingle_sets(words)
            size = np.diff(off)
            some = np.flatnonzero(size)
            minima = _minima(value, off[some], a, b)
            s1, s2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            if len(some):
                s1[some] = np.add.reduceat(mix(value * U(3)), off[some])
                s2[some] = np.bitwise_xor.reduceat(mix(value * U(5) + U(1)), off[some])
            keys = _band_keys(minima, rows)
            bits = np.zeros((len(size), 128), dtype=np.uint8)
            bits[some, :used] = mix(minima[:, :used].copy()) & U(1)
            sign = np.packbits(bits, axis=1).view(np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size > 0)]) * bands, pa.int32()), long_array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), long_array(size), long_array(s1), long_array(s2), pa.array(sign[:, 0].copy()), pa.array(sign[:, 1].copy()), lists], names=["doc_id", "n_shingles", "set1", "set2", "s1", "s2", "bands"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to their sets, the hashes one after the other."""
    for batch in slices(batches):
        value, off = shingle_sets(Words(batch.column(1), lower=True))
        raw = value.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([raw[8 * x : 8 * y] for x, y in zip(off[:-1], off[1:], strict=True)], pa.binary())], names=["doc_id", "shingles"])


def _arrays(bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with shingles to their sets as arrays, a signature of ``LONG`` bits and their band keys."""
        long_, short = _coefficients(LONG), _coefficients(bands * rows)
        for batch in slices(batches):
            value, off = shingle_sets(Words(batch.column(1), lower=True))
            some = np.flatnonzero(np.diff(off))
            sign = np.packbits((mix(_minima(value, off[some], *long_)) & U(1)).astype(np.uint8), axis=1).view(np.int64)
            keys = _band_keys(_minima(value, off[some], *short), rows)
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * m.shape[1], pa.int32()), long_array(m.reshape(-1)))
            sets = pa.ListArray.from_arrays(pa.array(np.append(off[some], off[-1]), pa.int32()), long_array(value))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(pa.array(some)), sets, lists(sign), lists(keys)], names=["rep", "x", "sign", "keys"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n, m = len(x) // 8, len(y) // 8
                if 100 * min(n, m) < percent * max(n, m):
                    keep.append(False)
                    continue
                both = np.sort(np.frombuffer(x + y, np.uint64))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (n + m - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for each node with an edge.

    Alternating large-star and small-star; every round is written to the shared folder.  Each star is an
    aggregation (partial before its shuffle) and a join on the node, which Spark may split where a node is hot.
    Rounds end when all edges are stars: no node has two edges up, and no centre hangs on another.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.isEmpty():
        return now.toDF("node", "root")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the neighbours below a node, and the node, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        now = materialize(small, "edges")
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where("up > 1 or (up = 1 and low = 0)").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_links(docs: DataFrame, percent: int = 85, crowd: int = 64) -> tuple[DataFrame, DataFrame]:
    """Classes of documents and confirmed links between class representatives.

    The first frame has a row for each row of ``docs``: doc_id, n_shingles, rep (null without shingles).  The
    second has (a, b).  Links that are not needed to connect their component may be missing.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bands, rows = banding(percent)
    same, key = ["n_shingles", "set1", "set2"], ["band", "key"]
    sketch = materialize(docs.mapInArrow(_sketch(bands, rows), SKETCH), "sketch")
    reps = materialize(sketch.where("n_shingles > 0").groupBy(same).agg(F.min("doc_id").alias("rep")), "reps")
    classes = sketch.select("doc_id", *same).join(reps, same, "left").select("doc_id", "n_shingles", "rep")
    own = sketch.join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", *same], "left_semi").dropDuplicates(["doc_id", *same])
    buckets = materialize(own.select(F.col("doc_id").alias("rep"), "s1", "s2", F.posexplode("bands").alias("band", "key")), "bands")

    def candidates(met: DataFrame) -> DataFrame:
        """Pairs of (rep, s1, s2) and (rep2, t1, t2) whose signatures agree."""
        off = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2")))
        return met.where((F.col("rep") != F.col("rep2")) & (off <= allowed(min(128, bands * rows), percent))).select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sets are alike enough."""
        needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        # texts are dealt by id at every size of ``needed``; only those of candidates go on as sets
        sets = materialize(docs.join(needed.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles binary"), "sets")
        alike = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return materialize(alike.mapInArrow(_linked(percent), "a long, b long"), "links")

    def compared(open_: DataFrame) -> DataFrame:
        """Links between the members of a bucket outside its largest component and all others, decided inside the join:
        signatures, then whole sets.  Only links leave it."""
        needed = open_.select(F.col("rep").alias("doc_id")).distinct()
        sets = materialize(docs.join(needed.hint("merge"), "doc_id", "left_semi").mapInArrow(_arrays(bands, rows), "rep long, x array<long>, sign array<long>, keys array<long>"), "sets")
        every = materialize(open_.join(sets, "rep"), "open")
        words = range(LONG // 64)
        block = lambda m: F.ceil(F.col(m) / BLOCK).cast("int")
        one_of = lambda m: F.pmod(F.xxhash64("rep"), block(m)).cast("int")
        each_of = lambda m: F.explode(F.sequence(F.lit(0), block(m) - 1))
        a = every.where("root != main").select(*[F.col(k).alias(f"{k}_") for k in key], one_of("rest").alias("i_"), each_of("members").alias("j_"), F.col("rep").alias("a"), F.col("root").alias("ra"), F.col("keys").alias("ka"), F.col("x").alias("xa"), *[F.get("sign", F.lit(i)).alias(f"p{i}") for i in words])
        b = every.select(*key, each_of("rest").alias("i"), one_of("members").alias("j"), F.col("rep").alias("b"), "root", (F.col("root") == F.col("main")).alias("of_main"), "keys", "x", *[F.get("sign", F.lit(i)).alias(f"q{i}") for i in words])
        off = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"q{i}"))) for i in words), F.lit(0))
        both = F.size(F.array_intersect("x", "xa"))
        # a pair is compared in the first bucket it shares: those before were compared as well
        first = F.array_position(F.zip_with("keys", "ka", lambda p, q: p == q), F.lit(True)) == F.col("band") + 1
        # both stands once: Spark computes what stands twice ahead, for pairs that fail the tests before it as well
        alike = (off <= allowed(LONG, percent)) & first & ((100 + percent) * both >= percent * (F.size("x") + F.size("xa")))
        on = reduce(Column.__and__, [F.col(k) == F.col(f"{k}_") for k in (*key, "i", "j")])
        on = on & (F.col("root") != F.col("ra")) & (F.col("of_main") | (F.col("a") < F.col("b"))) & alike
        # dealt by block here, as Spark would split both sides of a block again and make a task of each pair of parts
        a, b = a.repartition(*[f"{k}_" for k in (*key, "i", "j")]), b.repartition(*key, "i", "j")
        return materialize(a.join(b, on).select("a", "b").distinct(), "links")

    # one order for all bands; written before its join, so that Spark may split a bucket that many documents share
    lead = F.min(F.struct(F.xxhash64("rep").alias("h"), F.col("rep").alias("rep2"), F.col("s1").alias("t1"), F.col("s2").alias("t2")))
    leaders = materialize(buckets.groupBy(key).agg(lead.alias("l"), F.count("*").alias("n")).where("n > 1").select(*key, "n", "l.rep2", "l.t1", "l.t2"), "leaders")
    met = materialize(buckets.join(leaders, key), "met")
    tried = materialize(candidates(met), "pairs")
    links = confirmed(tried)
    root = components(links)
    left = met.where("n > 2").select("rep", "s1", "s2", *key, "n")
    named = materialize(left.join(root.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "named")
    sizes = named.groupBy(*key, "root").agg(F.count("*").alias("c")).groupBy(key).agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("members"), F.count("*").alias("roots"))
    several = materialize(sizes.where("roots > 1").select(*key, F.col("main.root").alias("main"), "members", (F.col("members") - F.col("main.c")).alias("rest")), "several")
    left = materialize(named.join(several, key), "open")
    few = (F.col("n") <= crowd) | (F.col("rest") <= crowd // 8)
    whole, large = left.where(few), left.where(~few)
    other = whole.select(*key, F.col("root").alias("root2"), F.col("rep").alias("rep2"), F.col("s1").alias("t1"), F.col("s2").alias("t2"), (F.col("root") == F.col("main")).alias("of_main"))
    pairs = candidates(whole.where("root != main").join(other, key).where("root != root2 and (of_main or rep < rep2)"))
    links = links.unionByName(confirmed(materialize(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")))
    if not large.isEmpty():
        links = links.unionByName(compared(large))
    return classes, links


def near_dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``; rows without an id have no component and stay."""
    classes, links = near_links(docs, percent)
    root = components(links)
    found = classes.join(root.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs, with all their columns, of the smallest doc_id of each component; rows without an id stay."""
    gone = near_dedup(docs.where("doc_id is not null"), percent).where("not kept").select("doc_id").distinct()
    gone = gone.withColumnRenamed("doc_id", name := unused("gone"))
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
