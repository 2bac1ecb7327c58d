"""Substring dedup: suffix automata of reference shards, matching statistics, maximal spans cut.

The reference is the corpus itself (a window goes if it starts in a document with a smaller id), so one
automaton of it has no size bound and cannot be broadcast.  It is cut into shards first, in a way that keeps
every pair of equal windows in one shard:

* the anchor of a window is the least hash of its 16-word grams, so equal windows have equal anchors, and the
  consecutive windows of one anchor form a segment (some 18 windows);
* anchors of a single document need no further look; of the others, equal segments are one, which its smallest
  document owns: copies cost one row each, however many there are;
* the distinct segments of an anchor are a reference shard: a task builds its suffix automaton, whose states know the
  smallest document they occur in, and streams the segments through it.  The matching statistics give each window's
  first document, in runs, and each document's segments are joined to the runs of theirs, which are one row, so that
  this join makes no more rows than there are segments;
* an anchor with more than ``hot`` distinct segments, or 32 words for each of those, is too much for one automaton:
  its windows are compared by digests, one row for each that a segment has, pre-aggregated before the shuffle, so that
  no group meets in one task.

Windows compare by words in the automata; segments, and windows of large anchors, by 128 hash bits: those of the anchor
and those of a content hash that derives from another hash of each word.  Nulls and empty texts have no words; equal
doc_ids count as one document; rows without a doc_id stay whole; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, gram_hash, long_array, materialize, slices, sliding_min, span_hash

GRAM = 16
_SEG = 0xC2B2AE3D27D4EB4F
NOBODY = (1 << 63) - 1


class SuffixAutomaton:
    """Generalised suffix automaton over token sequences; each state keeps the smallest owner of its occurrences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owner = [NOBODY]

    def _state(self, length: int, owner: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.link) - 1

    def _split(self, p: int, c: object, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = self._state(length[p] + 1, self.owner[q], dict(nxt[q]), link[q])
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def add(self, tokens: list, owner: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in tokens:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                if owner < self.owner[last]:
                    self.owner[last] = owner
                continue
            cur, p = self._state(length[last] + 1, owner, {}, 0), last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur

    def close(self) -> None:
        """Pass owners on to the shorter suffixes."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0 and self.owner[v] < self.owner[self.link[v]]:
                self.owner[self.link[v]] = self.owner[v]

    def first_owners(self, tokens: list, window: int) -> list[int]:
        """For each window of ``tokens``: the smallest owner of a sequence that holds it (NOBODY: none)."""
        nxt, link, length, out = self.next, self.link, self.length, []
        v, n = 0, 0
        for i, c in enumerate(tokens):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v, n = nxt[v][c], n + 1
            if i + 1 >= window:
                u = v
                if n >= window:
                    while length[link[u]] >= window:
                        u = link[u]
                out.append(self.owner[u] if n >= window else NOBODY)
        return out


def _segments(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """Anchor, document, first window (in the document), windows and content hash of each segment."""
    least = sliding_min(words.grams(GRAM), window - GRAM + 1)
    if not len(least):
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z, z, z.view(np.uint64)
    ok = words.whole(window)[: len(least)]
    doc = words.doc[: len(least)]
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    # a segment ends where the next one starts or where windows stop being whole
    stop = np.flatnonzero(ok & ~np.concatenate([ok[1:] & ~new[1:], [False]])) + 1
    content = span_hash(words.second, start, stop + window - 1, _SEG)
    return least[start], doc[start], start - words.word_off[doc[start]], stop - start, content


SEGMENTS = "anchor long, doc_id long, tkey long, start int, windows int, content long"


def _index(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column(1))
            anchor, doc, start, n, content = _segments(words, window)
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False)[doc] for i in (0, 2))
            yield pa.RecordBatch.from_arrays([long_array(anchor), long_array(ids), long_array(keys), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), long_array(content)], names=["anchor", "doc_id", "tkey", "start", "windows", "content"])

    return run


PIECES = "anchor long, content long, owner long, most long, words string, digests array<struct<digest:long,at:array<int>>>"


def _texts(window: int):
    """Rows (text, list of segments) to the segments' words; if hot, to the digests of their windows, with the windows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column(0))
            second = words.second
            out: list[tuple] = []
            for i, segments in enumerate(batch.column(1).to_pylist()):
                base = words.word_off[i]
                for s in segments:
                    a, n = base + s["start"], s["windows"]
                    z = a + n + window - 2
                    text = digests = None
                    if s["hot"]:
                        digest, place = np.unique(gram_hash(second[a : z + 1], window).view(np.int64), return_inverse=True)
                        at = np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place))[:-1])
                        digests = [{"digest": d, "at": x.tolist()} for d, x in zip(digest.tolist(), at, strict=True)]
                    else:
                        text = b" ".join(words.data[words.start[a] : words.end[z]].tobytes().split()).decode()
                    out.append((s["anchor"], s["content"], s["owner"], s["most"], text, digests))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("digest", pa.int64()), ("at", pa.list_(pa.int32()))])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "content", "owner", "most", "words", "digests"])

    return run


def shard_runs(rows: dict[int, tuple[int, int, str]], window: int) -> list[tuple[int, int, int, int]]:
    """Distinct segments of one anchor, content to (owner, most, words), to runs (content, first window, end, first
    document) of windows that a document below ``most``, the largest that has the segment, has first."""
    automaton = SuffixAutomaton()
    tokens = {content: words.encode().split() for content, (_, _, words) in rows.items()}
    for content, (owner, _, _) in rows.items():
        automaton.add(tokens[content], owner)
    automaton.close()
    out = []
    for content, (_, most, _) in rows.items():
        first = np.array(automaton.first_owners(tokens[content], window), dtype=np.int64)
        edge = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(first)]])
        out += [(content, a, b, int(first[a])) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if first[a] < most]
    return out


RUNS = "anchor long, content long, runs array<struct<a:int,b:int,first:long>>"


def _shards(window: int):
    """Rows sorted by anchor to runs; the distinct segments of one anchor at a time are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [[]] * 3
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("first", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "content", "runs"])

        def runs_of(anchor: int, group: dict) -> list[tuple]:
            """A row for each segment that has runs."""
            by_content = itertools.groupby(shard_runs(group, window), key=lambda r: r[0])
            return [(anchor, content, [{"a": a, "b": b, "first": first} for _, a, b, first in some]) for content, some in by_content]

        at, group, found = None, {}, []
        for batch in batches:
            for anchor, content, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if anchor != at:
                    if group:
                        found += runs_of(at, group)
                    at, group = anchor, {}
                group[content] = tuple(row)
            if len(found) > 5_000:
                yield done(found)
                found = []
        if group:
            found += runs_of(at, group)
        yield done(found)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, so that rows that share a doc_id are told apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tkey"))


def repeated_spans(docs: DataFrame, window: int = 50, hot: int = 4096) -> DataFrame:
    """(doc_id, tkey, spans): word ranges (s, e) of ``keyed`` documents covered by windows that a smaller doc_id has too.

    A document has a row for each of its segments that has such windows.
    """
    row, same = ["doc_id", "tkey"], ["anchor", "content"]
    index = materialize(docs.mapInArrow(_index(window), SEGMENTS), "segments")
    shared = index.groupBy("anchor").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most")).where("owner < most").select("anchor")
    found = materialize(index.join(shared, "anchor"), "shared")
    # distinct segments, each at its smallest document
    at = F.min(F.struct("doc_id", "tkey", "start", "windows"))
    distinct = materialize(found.groupBy(same).agg(at.alias("at"), F.max("doc_id").alias("most")).select(*same, "at.*", "most"), "distinct")
    words = F.sum(F.col("windows") + (window - 1))
    large = distinct.groupBy("anchor").agg(F.count("*").alias("n"), words.alias("words")).where((F.col("n") > hot) | (F.col("words") > 32 * hot)).select("anchor", F.lit(True).alias("hot"))
    marked = distinct.join(large, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    lists = marked.groupBy(*row).agg(F.collect_list(F.struct(*same, "start", "windows", F.col("doc_id").alias("owner"), "most", "hot")).alias("segments"))
    pieces = materialize(docs.where("text is not null").join(lists, row).select("text", "segments").mapInArrow(_texts(window), PIECES), "pieces")
    cold = pieces.where("words is not null").select(*same, "owner", "most", "words")
    by_shard = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards(window), RUNS)
    digests = pieces.where("digests is not null").select(*same, "owner", "most", F.explode("digests").alias("d")).select(*same, "owner", "most", "d.digest", "d.at")
    owners = digests.groupBy("anchor", "digest").agg(F.min("owner").alias("first"), F.max("most").alias("last")).where("first < last").drop("last")
    single = F.transform("at", lambda a: F.struct(a.alias("a"), (a + 1).alias("b"), F.col("first")))
    by_digest = digests.join(owners, ["anchor", "digest"]).where("first < most").select(*same, single.alias("runs")).groupBy(same).agg(F.flatten(F.collect_list("runs")).alias("runs"))
    covered = found.join(by_shard.unionByName(by_digest), same).withColumn("runs", F.filter("runs", lambda r: r["first"] < F.col("doc_id")))
    span = lambda r: F.struct((F.col("start") + r["a"]).alias("s"), (F.col("start") + r["b"] + (window - 1)).alias("e"))
    return covered.where(F.size("runs") > 0).select(*row, F.transform("runs", span).alias("spans"))


def keep_mask(n: int, spans: list[dict] | None) -> np.ndarray:
    """Whether each of n words stays."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for s in spans or ():
        edge[s["s"]] += 1
        edge[s["e"]] -= 1
    return np.cumsum(edge)[:n] == 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = (text or "").encode().split()
            keep = keep_mask(len(words), spans)
            left = words if keep.all() else [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            joined = b" ".join(left)
            out.append((doc, len(words), len(words) - len(left), hashlib.sha256(joined).hexdigest(), joined.decode() if len(left) < len(words) else text))
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(docs: DataFrame, window: int = 50, hot: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and kept_text.

    ``kept_text`` is the text itself where nothing is removed, else the kept words joined by one space.
    Rows that share a doc_id don't cut each other, only smaller doc_ids do.  Rows without a doc_id stay whole.
    """
    docs = keyed(docs)
    spans = repeated_spans(docs.where("doc_id is not null"), window, hot).groupBy("doc_id", "tkey").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return docs.join(spans, ["doc_id", "tkey"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
