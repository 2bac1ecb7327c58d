"""What the training-data operators share: table access, shared scratch tables and vectorised text hashing.

Word hashing works on the Arrow buffers of a batch (no Python object per word), so its cost is a few
nanoseconds a byte.  Hashes are 64-bit polynomials over bytes or over word hashes, finished with an
avalanche step, and do not depend on the process (unlike ``hash()``).
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Bytes of text that are hashed at once; working arrays are some 60 times as large.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_OTHER = np.ones(256, dtype=bool)
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_GRAM = 0xD6E8FEB86659FD93


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Where it is unset, one of our own, but only in a local session: on a cluster that would lose data, so it is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: a folder that all executors share is needed")
    return (root or "/tmp/checkpoints").rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session may be gone; the folder is scratch space
            continue


atexit.register(_clean)


def written(spark: SparkSession, path: str) -> str:
    """The path, which goes when the process ends."""
    _written.append((spark, path))
    return path


#: Shuffles of a statement go when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it: cuts the lineage and survives lost executors.

    Nothing reads the shuffles behind the table again, so they go once it is written.
    """
    spark = df.sparkSession
    path = written(spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def sampled(df: DataFrame, columns: list[str], most: int, total: int | None = None) -> DataFrame:
    """At most ``most`` rows, those with the least hashes of ``columns``; some 10 % more than that are ranked, not all."""
    total = df.count() if total is None else total
    h = F.xxhash64(*columns)
    if total > most:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int(min(1.0, (1.1 * most + 50) / total) * (1 << 30)))
    return df.orderBy(F.pmod(h, F.lit(1 << 30)), *columns).limit(most)


def unused(tag: str) -> str:
    """A column name that no table has."""
    return f"{tag}_{uuid.uuid4().hex}"


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche step; in place."""
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n (base odd)."""
    if base not in _powers or len(_powers[base][0]) < n:
        m = max(n, SLICE_BYTES + 4096)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(m, U(b))
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = (made[0], made[1])
    p, q = _powers[base]
    return p[:n], q[:n]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[starts:ends] for each span, whatever stands before it."""
    return cut_hash(running_hash(values, base), starts, ends, base)


def running_hash(values: np.ndarray, base: int) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=total[1:])
    return total


def cut_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    out = (total[ends] - total[starts]) * powers(base, len(total))[1][starts]
    out += (ends - starts).astype(np.uint64) * U(0xA0761D6478BD642F)
    return mix(out)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some documents: hash, document (index in the batch) and byte range of each.

    lower: A-Z to lower case.  letters: runs of letters, digits and bytes above 127 instead; lower then also
    takes À-Þ to lower case.
    """

    def __init__(self, text: pa.Array, lower: bool = False, letters: bool = False):
        text = pc.fill_null(text, "").cast(pa.large_string())
        n = len(text)
        off = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(text.buffers()[2], dtype=np.uint8)[off[0] : off[-1]] if n and text.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.n_docs, self.doc_off = n, off - off[0]
        self.data = _LOWER[raw] if lower else raw
        if lower and letters and len(raw):
            accented = np.flatnonzero(raw[:-1] == 0xC3) + 1
            accented = accented[(raw[accented] >= 0x80) & (raw[accented] <= 0x9E) & (raw[accented] != 0x97)]
            self.data[accented] += 0x20
        word = ~(_OTHER if letters else _SPACE)[self.data]
        m = len(raw)
        if not m:
            self.start = self.end = np.zeros(0, np.int64)
        else:
            first = np.zeros(m + 1, dtype=bool)
            first[self.doc_off] = True
            begin = word.copy()
            begin[1:] &= ~word[:-1] | first[1:m]
            stop = word.copy()
            stop[:-1] &= ~word[1:] | first[1:m]
            self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self._running = running_hash(self.data.astype(np.uint64) + U(1), _BASE) if m else np.zeros(1, np.uint64)
        self.hash = cut_hash(self._running, self.start, self.end, _BASE) if m else np.zeros(0, np.uint64)
        #: Words of document i are word_off[i] to word_off[i + 1].
        self.word_off = np.searchsorted(self.start, self.doc_off)
        self.counts = np.diff(self.word_off)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    @property
    def second(self) -> np.ndarray:
        """Another hash of each word, by place and byte, that tells apart what ``hash`` may not."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        off = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(off[-1]) - np.repeat(off[:-1], size)
        value = mix((at.astype(np.uint64) << U(8)) + self.data[at + np.repeat(self.start, size)] + U(0x9E3779B97F4A7C15))
        return mix(np.add.reduceat(value, off[:-1]) + size.astype(np.uint64))

    def prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of more than k bytes, and the hash of their first k bytes."""
        at = np.flatnonzero(self.end - self.start > k)
        return at, cut_hash(self._running, self.start[at], self.start[at] + k, _BASE)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; meaningless where the document ends before."""
        return gram_hash(self.hash, k)

    def whole(self, k: int) -> np.ndarray:
        """Whether k words of the same document start here."""
        return np.arange(len(self.hash)) + k <= np.repeat(self.word_off[1:], self.counts)


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] for each i with i + k <= len(h), by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, have, power, length = None, 0, h, 1
    mult = lambda e: U(pow(_GRAM, e, 1 << 64))
    while length <= k:
        if k & length:
            if out is None:
                out = power
            else:
                m = len(h) - have - length + 1
                out = out[:m] + mult(have) * power[have : have + m]
            have += length
        if length * 2 <= k:
            power = power[: len(power) - length] + mult(length) * power[length:]
        length *= 2
    return mix(out.copy())


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i+width] for each whole window."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    step, m = 1, values
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[:n], m[width - step : width - step + n])


def distinct_per_doc(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, one after the other, and n + 1 bounds.  doc ascends; value is overwritten."""
    off = np.searchsorted(doc, np.arange(n + 1))
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        value[a:b].sort()
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.concatenate([[0], np.cumsum(new)])[off]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``limit`` bytes of text (a longer single text stands alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64, copy=False))


def where_text(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows, with all columns, whose text ``keep`` marks; it gets the texts of a slice of rows."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "text"):
                yield part.filter(pa.array(keep(part.column(at))))

    return docs.mapInArrow(run, docs.schema)
