"""LM scoring: prediction by partial matching over bytes, and a unigram base score.

Training text (lower-cased A-Z) is counted once: byte grams of ``ORDER`` + 1 bytes, and words.  Both counts are
tables that Spark sums, partial before the shuffle, so they cover every training row and grow with the corpus.

The trie holds every context that was counted.  Of orders 3 and 4 those seen most (``CONTEXTS``, a fixed bound), of
the orders below all (their number is bounded by the alphabet) go to every task as rows of log probabilities.  Grams
in other contexts are joined to the counts, which stay tables, so how many are at hand changes the way and not the
result.  A context never seen is coded in its longest suffix that was.  A symbol seen in a context has probability
n / (T + q), T symbols seen there, q of them distinct; the escape has q / (T + q) (method C).  After an escape
the symbols of the longer context are excluded from the shorter one's counts.  Those of a context are among its
suffix's, so what an escape leads to depends on the context alone and each context becomes one row of log
probabilities; a document's code length is a sum of table entries, without a loop over bytes in Python.  A
document starts in a run of marks and ends with one, which is coded too.

Words for the base score: the most frequent ``HEAD`` counts go to every task (a fixed bound); the occurrences of
all other words are joined to the count table by hash, and sums return by document.  Words are told apart by
64 bits of hash.

Null text is empty: its end alone is scored.  Without training rows the model is uniform over bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, long_array, materialize, slices

ORDER = 4
MARK = 255  # never in UTF-8
#: Contexts of orders 3 and 4 that go to every task, at most.
CONTEXTS = (30_000, 70_000)
HEAD = 1 << 17
_HOLD = 3_000_000


def marked(words: Words, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with marks around each document; places of the coded symbols; where each document's begin among those."""
    n, m = words.n_docs, len(words.data)
    size = np.diff(words.doc_off)
    out = np.full(m + n * (order + 1), MARK, dtype=np.uint8)
    shift = np.repeat(np.arange(n) * (order + 1) + order, size)
    out[np.arange(m) + shift] = words.data
    coded = np.ones(len(out), dtype=bool)
    begins = words.doc_off[:-1] + np.arange(n) * (order + 1)
    for j in range(order):
        coded[begins + j] = False
    return out, np.flatnonzero(coded), words.doc_off[:-1] + np.arange(n)


def grams(out: np.ndarray, places: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The symbol at each place in the low byte, above it the bytes before, nearest first."""
    key = out.astype(np.uint64)
    full = key.copy()
    for j in range(1, order + 1):
        full[j:] |= key[:-j] << np.uint64(8 * j)
    return full[places]


class _Sums:
    """Counts by key, merged when many."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, values: np.ndarray) -> None:
        k, c = np.unique(values, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.held += len(k)
        if self.held > 2 * _HOLD:
            self.keys, self.counts = map(lambda x: [x], self.total())
            self.held = len(self.keys[0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        k, c = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[first], np.add.reduceat(c, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = {0: _Sums(), 1: _Sums()}

    def rows() -> Iterator[pa.RecordBatch]:
        for kind, s in sums.items():
            k, c = s.total()
            for a in range(0, len(k), 500_000):
                part = k[a : a + 500_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), long_array(part), pa.array(c[a : a + 500_000])], names=["kind", "key", "n"])

    for batch in slices(batches):
        words = Words(batch.column(0), lower=True)
        sums[0].add(words.hash)
        out, places, _ = marked(words)
        sums[1].add(grams(out, places))
        for kind in (0, 1):
            if sums[kind].held > _HOLD:  # a partition without end is sent on in parts
                yield from rows()
                sums = {0: _Sums(), 1: _Sums()}
    yield from rows()


class Model:
    """Rows of natural log probabilities, one for each kept context, and the way from bytes to rows."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], order: int = ORDER, whole: tuple[bool, bool] = (True, True)):
        """levels: for order 0 and on, (context, symbol, count) of the kept contexts; contexts as in ``grams``.

        whole: whether all contexts of orders 3 and 4 are kept; those of the orders below are.
        """
        self.whole = whole
        ctx0, sym0, n0 = levels[0]
        seen = np.unique(sym0)
        q0 = len(seen)
        self.classes = np.full(256, q0, dtype=np.int64)
        self.classes[seen] = np.arange(q0)
        a = self.width = q0 + 1
        self.order = order
        row_of: list[dict[int, int]] = [{0: 0}]
        first = np.zeros((1, a))
        counts = np.zeros((1, a))
        counts[0, self.classes[sym0]] = n0
        rest = np.zeros((1, a))  # distribution after the escape from order 0
        rest[0, q0] = 1 / max(1, 256 - q0)
        first = self._row(counts, rest)
        tables, contexts, base = [first], [np.zeros(1, np.int64)], 1
        for k in range(1, order + 1):
            ctx, sym, n = levels[k] if k < len(levels) else (np.zeros(0, np.int64),) * 3
            parents = row_of[-1]
            offset = base - len(contexts[-1])  # first row of the order below
            suffix = (1 << (8 * (k - 1))) - 1
            kept = sorted(c for c in set(ctx.tolist()) if (c & suffix) in parents)
            here = {c: i for i, c in enumerate(kept)}
            use = np.array([c in here for c in ctx.tolist()], dtype=bool) if len(ctx) else np.zeros(0, bool)
            mine = np.zeros((len(kept), a), dtype=np.float32)
            if len(kept):
                at = np.array([here[c] for c in ctx[use].tolist()])
                mine[at, self.classes[sym[use]]] = n[use]
                up = np.array([parents[c & suffix] for c in kept])
                after = np.empty_like(mine)
                for i in range(0, len(kept), 8192):
                    mine_i, p = mine[i : i + 8192], up[i : i + 8192]
                    new = np.where(mine_i > 0, 0, counts[p])
                    t, q = new.sum(1, keepdims=True), (new > 0).sum(1, keepdims=True)
                    total = np.maximum(t + q, 1)
                    down = np.where(q > 0, q / total, 1.0)
                    after[i : i + 8192] = np.where(new > 0, new / total, down * rest[p])
                tables.append(self._row(mine, after))
            else:
                after = np.zeros((0, a), np.float32)
            if k == 2:  # what the grams of contexts that are not at hand end in
                self.counts2, self.rest2 = mine, after
                self.total2 = np.zeros(len(kept), np.int64)
                if len(kept):
                    np.add.at(self.total2, at, n[use])
            contexts.append(np.array(kept, dtype=np.int64))
            row_of.append(here)
            counts, rest = mine, after
            base += len(kept)
            del offset
        self.logp = np.log(np.maximum(np.concatenate(tables), 1e-30)).astype(np.float32)
        self.starts = starts = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        # rows of orders 0 to 3 by the classes of the last three bytes
        three = np.zeros((a, a, a), dtype=np.int32)
        for k in range(1, min(3, order) + 1):
            for i, c in enumerate(contexts[k].tolist()):
                path = [int(self.classes[(c >> (8 * j)) & 255]) for j in range(k)]  # nearest first
                three[(slice(None),) * (3 - k) + tuple(reversed(path))] = starts[k] + i
            if k == 2:
                self.two = three[0].reshape(-1).copy()
        self.three = three.reshape(-1)
        below = int(starts[min(4, len(starts) - 1)])
        self.four = np.repeat(np.arange(below, dtype=np.int32)[:, None], a, axis=1)
        if order >= 4:
            for i, c in enumerate(contexts[4].tolist()):
                self.four[starts[3] + row_of[3][c & 0xFFFFFF], self.classes[c >> 24]] = starts[4] + i
        self.four = self.four.reshape(-1)

    @staticmethod
    def _row(counts: np.ndarray, rest: np.ndarray) -> np.ndarray:
        t, q = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        total = np.maximum(t + q, 1)
        escape = np.where(q > 0, q / total, 1.0)
        return np.where(counts > 0, counts / total, escape * rest).astype(np.float32)

    def score(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each document without the grams whose context isn't at hand; document and key of those."""
        out, places, begins = marked(words, self.order)
        c = self.classes[out]
        a = self.width
        row = self.three[(c[places - 3] * a + c[places - 2]) * a + c[places - 1]]
        row = self.four[row.astype(np.int64) * a + c[places - 4]]
        logp = self.logp[row, c[places]].astype(np.float64)
        away = np.zeros(0, np.int64)
        if not all(self.whole):  # a context of order 4 was seen only if its suffixes were
            away = np.flatnonzero((row < self.starts[4]) & (row >= self.starts[3 if self.whole[0] else 2]))
            logp[away] = 0
        doc = np.searchsorted(begins, away, side="right") - 1
        return np.add.reduceat(logp, begins) / np.log(10) if len(begins) else np.zeros(0), doc, grams(out, places[away], self.order)

    def lower(self, keys: np.ndarray) -> list[np.ndarray]:
        """Of the order-2 contexts of grams, all at hand: count of the symbol, its probability there and after an
        escape from there; symbols seen, and how many distinct ones."""
        symbol, near, far = (self.classes[(keys >> (8 * j)) & 255] for j in range(3))
        row = self.two[far * self.width + near]
        at = row - self.starts[2]
        return [self.counts2[at, symbol].astype(np.float64), np.exp(self.logp[row, symbol].astype(np.float64)), self.rest2[at, symbol].astype(np.float64), self.total2[at], (self.counts2[at] > 0).sum(1)]


def most_frequent(df: DataFrame, count: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those with the highest counts.

    A histogram of the counts' logarithms (a few hundred rows) gives the least count to keep, so no task has to
    rank the candidates of all others.  Rows that tie at the limit all stay or all go.
    """
    step = F.floor(F.log2(F.col(count)) * 16).cast("int")
    held, least = 0, None
    for b, n in sorted(((r.b, r.n) for r in df.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True):
        if held + n > limit:
            break
        held, least = held + n, b
    return df.where(step >= least) if least is not None else df.limit(0)


def _levels(counted: DataFrame, contexts: tuple[int, int]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], tuple[bool, bool], DataFrame]:
    """(context, symbol, count) of the contexts to have at hand, for each order; whether those are all of orders 3 and
    4; and the counts of the grams of order 3."""
    levels, whole = [], []
    of = counted.where("kind = 1").select("key", "n")
    for k in range(ORDER, -1, -1):
        if k < ORDER:  # the longest are counted already
            of = shorter(of, k)
        if k == 3:
            of = three = materialize(of, "grams")
        split = of.select(F.shiftright("key", 8).alias("context"), F.col("key").bitwiseAND(F.lit(255)).alias("symbol"), "n")
        if k >= 3:
            seen = split.groupBy("context").agg(F.sum("n").alias("all"))
            most = materialize(most_frequent(seen, "all", contexts[k - 3]).select("context"), "most")
            whole.append(seen.count() == most.count())
            split = split.join(F.broadcast(most), "context")  # as many rows as contexts are at hand, a fixed number
        rows = split.select("context", "symbol", "n").toArrow()
        levels.append(tuple(rows.column(i).to_numpy().astype(np.int64) for i in range(3)))
    return levels[::-1], (whole[1], whole[0]), three


def shorter(of: DataFrame, order: int) -> DataFrame:
    """(key, n) of the grams of ``order``, summed from longer ones."""
    return of.groupBy(_last(order).alias("key")).agg(F.sum("n").alias("n"))


def _last(order: int) -> Column:
    return F.col("key").bitwiseAND(F.lit((1 << (8 * (order + 1))) - 1))


def gram_logs(keys: DataFrame, four: DataFrame, three: DataFrame, lower) -> DataFrame:
    """(key, log): log10 probability of each gram of order 4 by all counts of orders 4 and 3, (key, n) each.

    lower: adds to keys what ``Model.lower`` says.
    """

    def contexts(high: DataFrame, low: DataFrame, k: int) -> DataFrame:
        """Of each context: symbols seen, distinct ones, and how often its suffix saw those."""
        met = high.withColumn("short", _last(k - 1)).join(low.toDF("short", "m"), "short")
        return met.groupBy(F.shiftright("key", 8).alias(f"c{k}")).agg(F.sum("n").alias(f"t{k}"), F.count("*").alias(f"q{k}"), F.sum("m").alias(f"lost{k}"))

    asked = keys.mapInArrow(lower, "key long, n2 double, p2 double, r2 double, t2 long, q2 long").withColumns({"k3": _last(3), "c4": F.shiftright("key", 8), "c3": F.shiftright(_last(3), 8)})
    rows = asked.join(four.toDF("key", "n4"), "key", "left").join(contexts(four, three, 4), "c4", "left")
    rows = rows.join(three.toDF("k3", "n3"), "k3", "left").join(contexts(three, shorter(three, 2), 3), "c3", "left")
    c = F.col

    def escape(k: int) -> tuple[Column, Column]:
        """After an escape from order k: what counts are divided by, and the chance of another escape."""
        q = c(f"q{k - 1}") - c(f"q{k}")
        over = F.greatest(c(f"t{k - 1}") - c(f"lost{k}") + q, F.lit(1))  # 0 where nothing is left, which no gram uses
        return over, F.when(q > 0, q / over).otherwise(1.0)

    def at(k: int, rest: Column, unseen: Column) -> Column:
        over = c(f"t{k}") + c(f"q{k}")
        return F.when(c(f"t{k}").isNull(), unseen).when(c(f"n{k}") > 0, c(f"n{k}") / over).otherwise(c(f"q{k}") / over * rest)

    (over3, on3), (over4, on4) = escape(3), escape(4)
    rows = rows.withColumn("r3", F.when(c("n2") > 0, c("n2") / over3).otherwise(on3 * c("r2")))
    rows = rows.withColumn("r4", F.when(c("n3") > 0, c("n3") / over4).otherwise(on4 * c("r3")))
    p = at(4, c("r4"), at(3, c("r3"), c("p2")))
    return rows.select("key", F.log10(F.greatest(p, F.lit(1e-30))).alias("log"))


def _lists(of: np.ndarray, key: np.ndarray, n: int) -> pa.Array:
    """For each of n documents the distinct keys and how often they occur; of: the document of each key."""
    line = np.lexsort((key, of))
    key, of = key[line], of[line]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.concatenate([first, [len(key)]]))
    off = np.searchsorted(of[first], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays([long_array(key[first]), long_array(tf)], names=["key", "tf"]))


SCORED = "doc_id long, tkey long, n_tokens long, head_known long, head_score double, score double, tail array<struct<key:long,tf:long>>, away array<struct<key:long,tf:long>>"


def ppm_score(docs: DataFrame, training: Column, contexts: tuple[int, int] = CONTEXTS, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row.

    training: which rows (doc_id, text) are learned from.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = chosen.where(training)
    counted = materialize(train.select("text").mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    rows = train.count()
    vocabulary = counted.where("kind = 0").select("key", "n")
    words, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_all, distinct = total + rows, words + (rows > 0)
    norm = float(np.log10(n_all + 0.1 * (distinct + 1)))
    top = most_frequent(vocabulary, "n", head).toArrow()
    keys, freq = top.column(0).to_numpy().astype(np.int64).view(np.uint64), top.column(1).to_numpy().astype(np.int64)
    order = np.argsort(keys)
    levels, whole, three = _levels(counted, contexts)
    model = spark.sparkContext.broadcast((Model(levels, whole=whole), keys[order], np.log10(freq[order] + 0.1) - norm))
    end = float(np.log10(rows + 0.1)) - norm

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm, known, logs = model.value
        for batch in slices(batches):
            w = Words(batch.column(1), lower=True)
            doc, n = w.doc, w.n_docs
            at = np.minimum(np.searchsorted(known, w.hash), max(0, len(known) - 1))
            hit = known[at] == w.hash if len(known) else np.zeros(len(w.hash), bool)
            score = np.bincount(doc[hit], weights=logs[at[hit]], minlength=n) + end
            count = np.bincount(doc[hit], minlength=n) + (rows > 0)
            tail = _lists(doc[~hit], w.hash[~hit], n)
            coded, of, away = ppm.score(w)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), long_array(w.counts + 1), long_array(count), pa.array(score), pa.array(coded), tail, _lists(of, away, n)],
                names=["doc_id", "tkey", "n_tokens", "head_known", "head_score", "score", "tail", "away"],
            )

    scored = materialize(chosen.select("doc_id", "text", F.xxhash64("text").alias("tkey")).mapInArrow(run, SCORED), "scored")
    repeat = (words > head or not all(whole)) and docs_repeat(scored)

    def told(column: str) -> DataFrame:
        """(doc_id, tkey, key, tf); rows that repeat have one list, which is summed once and joined to each of them."""
        rows = scored.select("doc_id", "tkey", F.explode(column).alias("t")).select("doc_id", "tkey", "t.key", "t.tf")
        return rows.groupBy("doc_id", "tkey", "key").agg(F.max("tf").alias("tf")) if repeat else rows

    def with_sums(rows: DataFrame, sums: DataFrame) -> DataFrame:
        sums = sums.withColumnsRenamed({"doc_id": "d", "tkey": "k"})
        return rows.join(sums, rows["doc_id"].eqNullSafe(sums["d"]) & (rows["tkey"] == sums["k"]), "left").drop("d", "k")

    if words <= head:  # every word was at hand
        none = F.log10(F.lit(0.1)) - norm
        tail = F.aggregate("tail", F.lit(0).cast("long"), lambda s, x: s + x["tf"])
        found = scored.select("*", F.lit(0).cast("long").alias("known"), (tail * none).alias("more"))
    else:
        c = F.coalesce("n", F.lit(0))
        found = with_sums(scored, told("tail").join(vocabulary, "key", "left").groupBy("doc_id", "tkey").agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("known"), F.sum(F.col("tf") * (F.log10(c + 0.1) - norm)).alias("more")))
    if all(whole):  # every context was at hand
        found = found.withColumn("coded", F.lit(0.0))
    else:

        def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ppm = model.value[0]
            for batch in batches:
                n2, p2, r2, t2, q2 = ppm.lower(batch.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n2), pa.array(p2), pa.array(r2), long_array(t2), long_array(q2)], names=["key", "n2", "p2", "r2", "t2", "q2"])

        asked = scored.select(F.explode("away.key").alias("key")).distinct()
        logs = materialize(gram_logs(asked, counted.where("kind = 1").select("key", "n"), three, lower), "logs")
        found = with_sums(found, told("away").join(logs, "key").groupBy("doc_id", "tkey").agg(F.sum(F.col("tf") * F.col("log")).alias("coded")))
    return found.select(
        "doc_id", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("head_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("coded", F.lit(0.0))).alias("score")
    )


def docs_repeat(scored: DataFrame) -> bool:
    """Whether any (doc_id, tkey) stands twice."""
    return bool(scored.groupBy("doc_id", "tkey").count().where("count > 1").limit(1).count())


def in_training() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
