"""Exact top-k search by inner product with a pivot-distance index.

Inner products become distances: a vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm,
a query gets 0 there, and |q - x|^2 = |q|^2 + M^2 - 2 q.x.  Pivots come from a bounded sample.  Every vector is
keyed by its nearest pivot and its distance to it; keys of one pivot are cut into annuli by distance.

Search expands annuli: a query's distance to a pivot and an annulus' bounds give, by the triangle inequality,
the least distance any of its vectors can have.  A first bound for a query's k-th best comes from the sample
and its nearest annulus; annuli that cannot beat it are never visited, the others are visited in blocks, a
matrix product each, keeping k rows for each query.  Scores are exact integers; the bounds carry a slack for
rounding, so the result is exact.

Annuli with many vectors (copies of one vector have one key) are dealt by a hash of the id into parts of about
``PART`` rows, queries into blocks of about ``QUERIES`` by their nearest pivot (one pivot's, or those of several that
have few), so that a block visits few annuli; a part goes to the blocks that visit its annulus and no others, and a task holds one part and one block.  A third of
all rows in one key is many parts.

Components become floor(scale * x).  Vectors that are null, empty or hold null or non-finite components, and
rows without an id take no part.  Components are exact below 2^100 after scaling and scores as far as a long holds
them; what lies beyond is an error, not dropped.  Vectors of another length than the query's don't meet it.  Equal rows
are one row.  With fewer than k candidates all are returned; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sampled

PIVOTS = 32
SAMPLE = 4_096
ANNULI = 8
PART = 16_384
QUERIES = 16_384
_EXACT = 2.0**52
_MOST = 2.0**100


def quantise(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not x.is_valid or not len(x) or x.values.null_count:
                    continue
                x = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    if np.abs(x).max() * scale >= _MOST:
                        raise OverflowError(f"vector {i} has a component beyond 2^100 after scaling")
                    ids.append(i)
                    raw.append(np.floor(scale * x).astype("<f8"))
            norm = [float(np.dot(v, v)) for v in raw]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array(norm, pa.float64()), pa.array([len(v) for v in raw], pa.int32())], names=["vec_id", "q", "norm", "dim"])

    return run


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Whole numbers, as doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; by floats where those are exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object)
    return whole(a) @ whole(b).T


@dataclass
class Index:
    """Pivots (with the extra component), annulus bounds of each, and the sample for first bounds."""

    dim: int
    top: float  # M^2
    pivots: np.ndarray
    edges: np.ndarray  # inner bounds of the annuli of each pivot
    sample: np.ndarray
    sample_ids: np.ndarray

    @classmethod
    def fit(cls, ids: np.ndarray, vectors: np.ndarray, top: float, pivots: int, annuli: int) -> Index:
        x = cls.lifted(vectors, top)
        rng = np.random.default_rng(5)
        chosen = [int(rng.integers(len(x)))]
        near = ((x - x[chosen[0]]) ** 2).sum(1)
        while len(chosen) < min(pivots, len(x)) and near.max() > 0:
            chosen.append(int(rng.choice(len(x), p=near / near.sum())))
            near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
        p = x[chosen]
        for _ in range(5):  # k-means steps: tighter cells
            cell = cls.distances(x, p).argmin(1)
            p = np.stack([x[cell == c].mean(0) if (cell == c).any() else p[c] for c in range(len(p))])
        d = cls.distances(x, p)
        cell = d.argmin(1)
        edges = np.stack([np.quantile(d[cell == c, c], np.arange(1, annuli) / annuli) if (cell == c).any() else np.zeros(annuli - 1) for c in range(len(p))])
        return cls(vectors.shape[1], top, p, edges, vectors, ids)

    @staticmethod
    def lifted(v: np.ndarray, top: float) -> np.ndarray:
        f = v.astype(np.float64)
        return np.concatenate([f, np.sqrt(np.maximum(0, top - (f * f).sum(1)))[:, None]], axis=1)

    @staticmethod
    def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T))

    def key(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Annulus (pivot * annuli + place) and distance of each vector."""
        d = self.distances(self.lifted(v, self.top), self.pivots)
        cell = d.argmin(1)
        r = d[np.arange(len(d)), cell]
        return cell * (self.edges.shape[1] + 1) + (self.edges[cell] < r[:, None]).sum(1), r

    def slack(self) -> float:
        return 1e-6 * (1 + self.top**0.5)

    def visits(self, ids: np.ndarray, q: np.ndarray, annuli: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each query the annuli (places in ``annuli``) that may hold one of its k best."""
        f = np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], axis=1)
        d = self.distances(f, self.pivots)[:, annuli // (self.edges.shape[1] + 1)]
        least = np.maximum(0, np.maximum(d - hi, lo - d) - self.slack())
        known = products(q, self.sample)
        norm = (f * f).sum(1)
        for i in range(len(q)):
            scores = np.sort(known[i][self.sample_ids != ids[i]].astype(np.float64))
            far = np.sqrt(max(0.0, norm[i] + self.top - 2 * scores[-k])) + self.slack() if len(scores) >= k else np.inf
            yield i, np.flatnonzero(least[i] <= far)


def _keyed(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, r = index.key(matrix(batch.column(1), index.dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a.astype(np.int32)), pa.array(r)], names=["vec_id", "q", "annulus", "r"])

    return run


def _visits(index: Index, annuli: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                ids, q = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1), index.dim)
                lists = [annuli[some].tolist() for _, some in index.visits(ids, q, annuli, lo, hi, k)]
                cell = index.distances(index.lifted(q, 0.0), index.pivots).argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "q", "cell", "annuli"])

    return run


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k and scores.dtype != object:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
    else:
        some = np.arange(len(scores))
    if scores.dtype == object:
        return np.array(sorted(some.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _compare(dim: int, k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if vectors.num_rows and queries.num_rows:
            ids, v = vectors["vec_id"].to_numpy(), matrix(vectors["q"], dim)
            who, q = queries["query_id"].to_numpy(), matrix(queries["q"], dim)
            for at in range(0, len(q), 256):
                s = products(q[at : at + 256], v)
                for i in range(len(s)):
                    own = ids != who[at + i]
                    best = best_of(ids[own], s[i][own], k)
                    if s.dtype == object and any(not -(2**63) <= x < 2**63 for x in s[i][own][best]):
                        raise OverflowError(f"a score of query {who[at + i]} doesn't fit in a long")
                    out.append(pa.table([np.full(len(best), who[at + i]), ids[own][best], s[i][own][best].astype(np.int64)], schema=RESULT))
        return pa.concat_tables(out) if out else RESULT.empty_table()

    return run


def query_blocks(counts: list[int]) -> tuple[list[int], list[int]]:
    """Of each pivot with so many queries: its first block, and how many it has.  Pivots with few queries share one."""
    first, n, at, held = [], [], 0, 0
    for c in counts:
        if held and held + c > QUERIES:
            at, held = at + 1, 0
        first.append(at)
        n.append(-(-c // QUERIES))
        if c > QUERIES:
            at += n[-1]
        else:
            held += c
    return first, n


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, pivots: int = PIVOTS, sample: int = SAMPLE, annuli: int = ANNULI, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row of vectors where ``queries`` holds.

    vectors: (vec_id, embedding).
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(quantise(scale), "vec_id long, q binary, norm double, dim int")
    whole = materialize(rows.distinct(), "vectors")
    result = None
    for dim, top, n in sorted(tuple(r) for r in whole.groupBy("dim").agg(F.max("norm"), F.count("*")).collect()):
        mine = whole.where(F.col("dim") == dim)
        taken = sampled(mine.select("vec_id", "q"), ["vec_id", "q"], sample, n).toArrow()
        index = Index.fit(taken["vec_id"].to_numpy(), matrix(taken["q"], dim), top, pivots, annuli)
        keyed = materialize(mine.select("vec_id", "q").mapInArrow(_keyed(index), "vec_id long, q binary, annulus int, r double"), "index")
        # a row for each annulus: pivots times annuli at most
        bounds = sorted(tuple(r) for r in keyed.groupBy("annulus").agg(F.min("r"), F.max("r"), F.count("*")).collect())
        names, lo, hi, count = (np.array(c) for c in zip(*bounds, strict=True))
        parts = -(-count // part)
        table = lambda pairs: F.create_map(*[F.lit(int(x)) for pair in pairs for x in pair])
        deal = lambda c, m: F.pmod(F.xxhash64(c), m).cast("int")
        n_parts = table(zip(names, parts, strict=True))
        asked = materialize(mine.where(queries).select("vec_id", "q").mapInArrow(_visits(index, names, lo, hi, k), "query_id long, q binary, cell int, annuli array<int>"), "visits")
        # a row for each pivot at most
        cells = sorted(tuple(r) for r in asked.groupBy("cell").agg(F.count("*")).collect())
        if not cells:
            continue
        first, n_blocks = (table(zip([c for c, _ in cells], x, strict=True)) for x in query_blocks([n for _, n in cells]))
        visits = asked.select("query_id", "q", (first[F.col("cell")] + deal("query_id", n_blocks[F.col("cell")])).alias("block"), F.explode("annuli").alias("annulus"))
        visitors = visits.select("annulus", "block").distinct().groupBy("annulus").agg(F.collect_list("block").alias("blocks"))
        held = keyed.select("vec_id", "q", "annulus", deal("vec_id", n_parts[F.col("annulus")]).alias("part")).join(visitors, "annulus").withColumn("block", F.explode("blocks")).drop("blocks")
        visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), n_parts[F.col("annulus")] - 1)))
        place = ["annulus", "part", "block"]
        found = held.groupBy(*place).cogroup(visits.groupBy(*place)).applyInArrow(_compare(dim, k), "query_id long, vec_id long, score long")
        result = found if result is None else result.unionByName(found)
    if result is None:
        result = spark.createDataFrame([], "query_id long, vec_id long, score long")
    # k rows at most of each part
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
