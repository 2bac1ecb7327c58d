"""Packing: vector bin packing with the dot-product heuristic.

A document's ids are cut into pieces of at most ``limit`` tokens.  Whole pieces are sequences of their own; the
rest of each document is an item with a size in several dimensions: tokens, segments (one each) and loss-bearing
tokens (all but the first, which nothing predicts, or the share that a column says).  Into the open sequence goes, of
the items that fit in every dimension, the one whose sizes have the largest dot product with the room left.  When none
fits, with ``fill`` the item with the largest product among those that may be cut is cut to the room left (no piece
under ``LEAST`` tokens), its rest stays an item; otherwise the sequence closes.  With ``fill`` the last sequence of a
group is cut into powers of two, which need no padding.

Groups are runs of ``GROUP`` items of one input partition, so nothing is shuffled, no key can be hot and a task holds
one group.  Sequence ids are the partition and a running number: a task that runs again gives the same rows.  Input
straight from a shuffle, whose rows may come in another order then, should be written first.

Null text is empty and gives the end token alone.  Repeated rows, and rows without a doc_id, are packed once each.
Other columns are ignored.  Texts are tokenised whole; ids of one group are held at a time.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TOKENS = 1024
#: Segments of a sequence: two tokens each fill it.
SEGMENTS = 512
END = 0
#: Items of a group; and tokens, whichever is reached first.
GROUP, GROUP_TOKENS = 20_000, 8 << 20
#: No cut leaves a piece below this, so that is what a sequence lacks at most.
LEAST = 8


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """Ids of a text under the byte-level BPE of a tokenizers file (``.json``).

    The merges run in tiktoken, which gives the same ids at a fifth of the time: it takes the file's vocabulary as
    ranks (merged entries are numbered in merge order) and the pattern that comes with the vocabulary files.
    """
    import public_tokenizers
    import tiktoken

    spec = json.load(open(vocabulary, encoding="utf-8"))  # noqa: SIM115
    before = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or spec["normalizer"] is not None or before["type"] != "ByteLevel" or before["add_prefix_space"]:
        raise ValueError(f"{vocabulary} isn't a plain byte-level BPE")
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    made = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: made.encode(text, allowed_special="all") if any(s in text for s in special) else made.encode_ordinary(text)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Stock:
    """Items by size; items of one size are alike, so the heuristic chooses among distinct sizes."""

    def __init__(self, sizes: np.ndarray, cap: np.ndarray):
        kinds, inverse = np.unique(sizes, axis=0, return_inverse=True) if len(sizes) else (sizes.reshape(0, len(cap)), np.zeros(0, np.int64))
        self.cap, self.used = cap, len(kinds)
        room = max(64, 2 * self.used)
        self.kinds, self.scaled, self.live = np.zeros((room, len(cap)), np.int64), np.zeros((room, len(cap))), np.zeros(room, bool)
        self.kinds[: self.used], self.scaled[: self.used], self.live[: self.used] = kinds, kinds / cap, True
        parts = np.split(np.argsort(inverse.ravel(), kind="stable"), np.cumsum(np.bincount(inverse.ravel()))[:-1]) if len(sizes) else []
        #: Of each kind the items, and how many of their tokens are placed already.
        self.items: list[list[tuple[int, int]]] = [[(int(i), 0) for i in m[::-1]] for m in parts]
        self.place = {tuple(k): i for i, k in enumerate(kinds.tolist())}
        self.left = len(sizes)

    def best(self, allowed: np.ndarray, room: np.ndarray) -> int:
        """The allowed kind with the largest dot product with the room, -1 without one."""
        some = np.flatnonzero(allowed)
        return int(some[np.argmax(self.scaled[some] @ (room / self.cap))]) if len(some) else -1

    def fitting(self, room: np.ndarray) -> int:
        n = self.used
        return self.best(self.live[:n] & (self.kinds[:n] <= room).all(axis=1), room)

    def cuttable(self, room: np.ndarray, least: int) -> int:
        """A kind of which a piece of all the tokens left fits, and leaves enough."""
        n, r = self.used, int(room[0])
        k = self.kinds[:n]
        some = self.live[:n] & (k[:, 0] >= r + least) & (-(-k[:, 2] * r // np.maximum(k[:, 0], 1)) <= room[2])
        return self.best(some, room)

    def take(self, k: int) -> tuple[int, int]:
        item = self.items[k].pop()
        self.live[k] = bool(self.items[k])
        self.left -= 1
        return item

    def put(self, size: tuple[int, ...], item: tuple[int, int]) -> None:
        k = self.place.get(size, self.used)
        if k == self.used:
            if k == len(self.kinds):
                self.kinds, self.scaled = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kinds, self.scaled))
                self.live = np.concatenate([self.live, np.zeros(k, bool)])
            self.kinds[k], self.scaled[k] = size, np.array(size) / self.cap
            self.place[size] = k
            self.items.append([])
            self.used += 1
        self.items[k].append(item)
        self.live[k] = True
        self.left += 1


def place(sizes: np.ndarray, limits: tuple[int, ...], least: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(item, its tokens before, tokens, bin, offset) of each piece.

    sizes: a row for each item: tokens, segments (1) and loss-bearing tokens.  least: cut items to fill bins, into
    pieces of at least so many tokens; 0: don't.  An item larger than the limits, if not cut, is alone in its bin.
    """
    cap = np.array(limits, dtype=np.float64)
    stock = Stock(sizes, cap)
    out: list[tuple[int, int, int, int, int]] = []
    current, at, room = -1, 0, np.zeros(len(cap))
    while stock.left:
        k = stock.fitting(room) if current >= 0 else -1
        if k >= 0:
            size = tuple(stock.kinds[k].tolist())
            item, before = stock.take(k)
        elif least and room[0] >= least and room[1] >= 1 and (k := stock.cuttable(room, least)) >= 0:
            n, _, loss = stock.kinds[k].tolist()
            r = int(room[0])
            size = (r, 1, -(-loss * r // n))
            item, before = stock.take(k)
            stock.put((n - r, 1, loss - size[2]), (item, before + r))
        else:
            current, at, room = current + 1, 0, cap.copy()
            if stock.fitting(room) >= 0 or least and stock.cuttable(room, least) >= 0:
                continue
            k = int(np.flatnonzero(stock.live)[0])  # larger than any sequence: alone
            size = tuple(stock.kinds[k].tolist())
            item, before = stock.take(k)
            room = np.zeros(len(cap))
            out.append((item, before, size[0], current, 0))
            continue
        out.append((item, before, size[0], current, at))
        at += size[0]
        room = room - size
    return out


def by_powers(pieces: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The pieces of one bin dealt to bins of powers of two, the largest first."""
    out, total = [], sum(p[2] for p in pieces)
    now = pieces[0][3] if pieces else 0
    room, at = (1 << total.bit_length()) >> 1, 0
    for item, before, n, _, _ in pieces:
        while n:
            part = min(n, room - at)
            out.append((item, before, part, now, at))
            before, n, at, total = before + part, n - part, at + part, total - part
            if at == room:
                now, at, room = now + 1, 0, (1 << total.bit_length()) >> 1
    return out


def pack_group(sizes: np.ndarray, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset (in the first dimension) of each item, without cuts."""
    bins, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for item, _, _, b, at in place(sizes, limits):
        bins[item], offset[item] = b, at
    return bins, offset


_OUT = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
OUT = ", ".join(f"{c} long" for c in _OUT)


class _Task:
    """Items of a task until a group is full; rows of what is placed."""

    def __init__(self, limits: tuple[int, ...], fill: bool):
        self.limits, self.fill, self.next = limits, fill, TaskContext.get().partitionId() << 40
        self.rows: list[tuple] = []
        self.items: list[tuple] = []
        self.held = 0

    def add(self, doc: int | None, ids: np.ndarray, bears: float | None) -> None:
        """bears: share of the ids that bear loss, None for all that something comes before."""
        limit = self.limits[0]
        for a in range(0, len(ids), limit):
            piece = ids[a : a + limit]
            if len(piece) == limit:
                self.row(doc, a, piece, len(ids), self.next, 0)
                self.next += 1
            else:
                loss = len(piece) - 1 if bears is None else round(len(piece) * min(1.0, max(0.0, bears)))
                self.items.append((doc, a, piece, len(ids), loss))
                self.held += len(piece)
        if len(self.items) >= GROUP or self.held >= GROUP_TOKENS:
            self.pack()

    def row(self, doc: int | None, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> None:
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))

    def pack(self) -> None:
        sizes = np.array([(len(i[2]), 1, i[4]) for i in self.items], dtype=np.int64).reshape(-1, 3)
        pieces = place(sizes, self.limits, LEAST if self.fill else 0)
        if self.fill and pieces:
            final = pieces[-1][3]
            pieces = [p for p in pieces if p[3] != final] + by_powers([p for p in pieces if p[3] == final])
        for item, before, n, b, at in pieces:
            doc, start, ids, total, _ = self.items[item]
            self.row(doc, start + before, ids[before : before + n], total, self.next + b, at)
        self.next += max((p[3] for p in pieces), default=-1) + 1
        self.items, self.held = [], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        while self.rows:
            rows, self.rows = self.rows[:50_000], self.rows[50_000:]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=list(_OUT))


def pack(docs: DataFrame, limit: int = TOKENS, segments: int = SEGMENTS, loss_tokens: int | None = None, loss: str | None = None, vocabulary: str | None = None, fill: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    segments, loss_tokens: further limits of a sequence.  loss: a column with the share of a row's tokens that bear
    loss.  vocabulary: a tokenizers file.  fill: cut documents elsewhere than at multiples of ``limit`` too.
    """
    limits = (limit, segments, loss_tokens or limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary or default_vocabulary()), _Task(limits, fill)
        for batch in slices(batches):
            share = batch.column(2).to_pylist() if loss else [None] * batch.num_rows
            for doc, text, bears in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), share, strict=True):
                task.add(doc, np.array([*encode(text or ""), END], dtype="<u4"), 1.0 if loss and bears is None else bears)
            yield from task.batches()
        task.pack()
        yield from task.batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(loss).cast("double")] if loss else [])).mapInArrow(run, OUT)
