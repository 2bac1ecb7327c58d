"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Items and texts become words: runs of letters and digits, A-Z in lower case.  An item's n-grams are its seeds,
without those far more common in the corpus than the item's others (more than ``rare`` documents and more than
four times the item's median), which say little about it.  Documents are scanned for seeds; around the hits
of an item the passage is aligned with the item by Smith-Waterman over words, which accepts edits, insertions
and losses.  The similarity is the alignment score by the score of the item with itself.

Items are handled in blocks of at most ``BLOCK_BYTES``, so what goes to the tasks has a fixed bound and any
number of items is scanned for.  A passage is skipped before alignment only if the words it shares with the
item could not reach the threshold.  Nothing is shuffled but the results.

Null and empty texts and items match nothing.  Items shorter than ``n`` words use all their words as one seed.
Rows that repeat give one row each for each item found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, gram_hash, slices, where_text

N = 4
BLOCK_BYTES = 8 << 20
MATCH, MISS, GAP = 2, -1, -1


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two sequences, and where it ends in b; a row at a time."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    ramp = np.arange(len(b) + 1) * -GAP
    best, end = 0, 0
    for x in a:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(b == x, MATCH, MISS), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + ramp) - ramp
        top = int(new.argmax())
        if new[top] > best:
            best, end = int(new[top]), top
        row = new
    return best, end


@dataclass
class Block:
    """Items of a block: their words, and seeds as sorted hashes with the items (and places) that have them."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray
    owners: list[list[tuple[int, int]]]
    sizes: list[int]

    @classmethod
    def of(cls, rows: list[tuple[int, str]], n: int) -> Block:
        w = Words(pa.array([t for _, t in rows], pa.string()), lower=True, letters=True)
        words = [w.hash[a:b] for a, b in zip(w.word_off[:-1], w.word_off[1:], strict=True)]
        where: dict[int, list[tuple[int, int]]] = {}
        for i, x in enumerate(words):
            for j, h in enumerate(gram_hash(x, min(n, len(x))).tolist() if len(x) else []):
                where.setdefault(h ^ min(n, len(x)), []).append((i, j))
        seeds = np.array(sorted(where), dtype=np.uint64)
        return cls([r[0] for r in rows], words, seeds, [where[s] for s in seeds.tolist()], sorted({min(n, len(x)) for x in words if len(x)}))

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word places of the batch and seeds found there."""
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        seen = np.zeros(1 << 20, dtype=bool)
        seen[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for k in self.sizes:
            h = gram_hash(w.hash, k) ^ np.uint64(k)
            some = np.flatnonzero(seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            some = some[w.whole(k)[: len(h)][some]]
            at = np.minimum(np.searchsorted(self.seeds, h[some]), len(self.seeds) - 1)
            ok = self.seeds[at] == h[some]
            places.append(some[ok])
            found.append(at[ok])
        return np.concatenate(places), np.concatenate(found)

    def without_common(self, frequency: np.ndarray, rare: int) -> Block:
        own: dict[int, list[int]] = {}
        for s, places in enumerate(self.owners):
            for i, _ in places:
                own.setdefault(i, []).append(int(frequency[s]))
        cut = {i: max(rare, 4 * float(np.median(f))) for i, f in own.items()}
        owners = [[p for p in places if frequency[s] <= cut[p[0]]] for s, places in enumerate(self.owners)]
        keep = [s for s, places in enumerate(owners) if places]
        return Block(self.ids, self.words, self.seeds[keep], [owners[s] for s in keep], self.sizes)


def passages(block: Block, w: Words, threshold: float) -> Iterator[tuple[int, int, float, int]]:
    """(document, item, similarity, hits) of the batch; the best passage of each item in each document."""
    place, seed = block.hits(w)
    if not len(place):
        return
    doc = np.searchsorted(w.word_off, place, side="right") - 1
    near: dict[tuple[int, int], list[int]] = {}
    for d, p, s in zip(doc.tolist(), place.tolist(), seed.tolist(), strict=True):
        for i, j in block.owners[s]:
            near.setdefault((d, i), []).append(p - j)  # where the item would begin
    for (d, i), begins in near.items():
        item = block.words[i]
        need = threshold * MATCH * len(item)
        slack = len(item) // 2 + 4
        begins.sort()
        best, a = 0, 0
        while a < len(begins):
            b = a
            while b + 1 < len(begins) and begins[b + 1] - begins[b] <= slack:
                b += 1
            lo, hi = max(int(w.word_off[d]), begins[a] - slack), min(int(w.word_off[d + 1]), begins[b] + len(item) + slack)
            text = w.hash[lo:hi]
            if MATCH * np.isin(item, text).sum() >= max(need, best + 1):
                best = max(best, smith_waterman(item, text)[0])
            a = b + 1
        if best >= need:
            yield d, i, best / (MATCH * len(item)), len(begins)


FOUND = "doc_id long, item_id long, similarity double, n_seeds long"


def rare_blocks(docs: DataFrame, items: DataFrame, n: int = N, rare: int = 50) -> Iterator[Block]:
    """Blocks of items with the seeds that are rare in docs."""
    items = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct()
        block = Block.of(sorted((r.item_id, r.text) for r in mine.collect()), n)  # of the order of BLOCK_BYTES
        if not len(block.seeds):
            continue

        def frequencies(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(block.seeds), dtype=np.int64)
            for batch in slices(batches):
                w = Words(batch.column(0), lower=True, letters=True)
                place, seed = block.hits(w)
                pair = np.unique((np.searchsorted(w.word_off, place, side="right") - 1) * len(total) + seed)
                total += np.bincount(pair % len(total), minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["seed", "n"])

        counted = docs.select("text").mapInArrow(frequencies, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()  # a row for each seed of the block
        frequency = np.zeros(len(block.seeds), dtype=np.int64)
        for r in counted:
            frequency[r.seed] = r.n
        yield block.without_common(frequency, rare)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, n: int = N, rare: int = 50) -> DataFrame:
    """doc_id, item_id, similarity, n_seeds for each item that a document holds to ``threshold`` or more."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    result = None
    for block in rare_blocks(docs, items, n, rare):

        def match(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                w = Words(batch.column(1), lower=True, letters=True)
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], block.ids[i], s, n) for d, i, s, n in passages(block, w, threshold)]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "n_seeds"])

        found = chosen.mapInArrow(match, FOUND)
        result = found if result is None else result.unionByName(found)
    return docs.sparkSession.createDataFrame([], FOUND) if result is None else result


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.5, n: int = N, rare: int = 50) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item to ``threshold``."""
    for block in rare_blocks(docs, items, n, rare):

        def clean(text: pa.Array, block: Block = block) -> np.ndarray:
            keep = np.ones(len(text), dtype=bool)
            for d, *_ in passages(block, Words(text, lower=True, letters=True), threshold):
                keep[d] = False
            return keep

        docs = where_text(docs, clean)
    return docs
