"""Toxicity: a factorization machine over hashed terms.

Terms are runs of letters, digits and bytes above 127, A-Z in lower case, and the beginnings of the longer ones
(stems, which carry over to words not seen before), hashed to 64 bits.  The model is
sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>) over the distinct terms of a text that it knows; the pair
term lets two terms count together that are harmless alone.  It is fitted on a sample of labelled rows, of
``SAMPLE`` rows at most (the bound is a parameter; the rows with the least hashes of their ids), so what
reaches the driver has a fixed bound; scoring is one pass over the documents.

Known terms: those whose frequency differs between the two labels (by ``LEAST_Z`` standard errors, in three texts at
least; the ``TERMS`` that differ most), and words that are harmless alone: of the ``WORDS`` most frequent words, those in
a pair whose texts are labelled otherwise than either word's and than both words' together would say (by ``PAIR_Z``
standard errors).  Fitted on all hashed terms instead, the machine takes chance pairs for rules (README has figures).

Null and empty texts have no terms and score the base rate.  Rows without a label or with a null id, and ids labelled
both ways, are not used to fit; with no labels at all every text scores the prior 0.5.  Rows that share an id each
count with its label; equal rows score alike.  Very long texts are scored whole, one at a time.  No label, id, lang or
source enters a score; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, distinct_per_doc, long_array, materialize, sampled, slices, where_text

SAMPLE = 20_000
TERMS = 4_096
LEAST_Z = 4.0
WORDS = 2_048
PAIR_Z = 6.0
FACTORS = 8
#: Bytes of the word beginnings that are terms too.
STEMS = (4, 5, 6)
THRESHOLD = 0.7


def terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Document index (ascending) and hash of each term, with repeats, and the number of documents."""
    words = Words(text, lower=True, letters=True)
    doc, parts, of = words.doc, [words.hash], [words.doc]
    for k in STEMS:
        at, h = words.prefixes(k)
        parts.append(h ^ np.uint64(k))  # a stem isn't the word that reads like it
        of.append(doc[at])
    return np.concatenate(of), np.concatenate(parts), words.n_docs


@dataclass
class FactorizationMachine:
    known: np.ndarray  # sorted hashes
    w0: float
    w: np.ndarray
    v: np.ndarray

    def features(self, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and term index of the known terms."""
        if not len(self.known):
            return doc[:0], doc[:0]
        seen = np.zeros(1 << 16, dtype=bool)
        seen[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True
        some = np.flatnonzero(seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, h[some]), len(self.known) - 1)
        hit = self.known[at] == h[some]
        return doc[some[hit]], at[hit]

    def logits(self, n: int, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.bincount(doc, weights=self.w[at], minlength=n) + self.w0
        for k in range(self.v.shape[1]):
            x = self.v[at, k]
            out += 0.5 * (np.bincount(doc, weights=x, minlength=n) ** 2 - np.bincount(doc, weights=x * x, minlength=n))
        return out

    def distinct_features(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        doc, h, _ = terms(text)
        doc, at = self.features(doc, h)
        return np.divmod(np.unique(doc * max(1, len(self.known)) + at), max(1, len(self.known)))

    def score(self, text: pa.Array) -> np.ndarray:
        doc, at = self.distinct_features(text)
        return 1 / (1 + np.exp(-np.clip(self.logits(len(text), doc, at), -40, 40)))


def fit(known: np.ndarray, at_doc: np.ndarray, at: np.ndarray, label: np.ndarray, factors: int = FACTORS, epochs: int = 40, rate: float = 0.05, decay: float = 1e-4) -> FactorizationMachine:
    """known: hashes of the model's terms, sorted.  at_doc, at: text (ascending) and place in ``known`` of each
    distinct term.  label: 0 or 1 for each text."""
    label = label.astype(np.float64)
    n = len(label)
    prior = (label.sum() + 0.5) / (n + 1)
    rng = np.random.default_rng(11)
    m = FactorizationMachine(known, float(np.log(prior / (1 - prior))), np.zeros(len(known)), rng.normal(0, 0.05, (len(known), factors)))
    if not len(known):
        return m
    off = np.searchsorted(at_doc, np.arange(n + 1))
    shape = np.concatenate([[0.0], m.w, m.v.ravel()])
    first, second, step = np.zeros_like(shape), np.zeros_like(shape), 0
    size = 1024
    for _ in range(epochs):
        for begin in range(0, n, size):
            end = min(n, begin + size)
            i, d = at[off[begin] : off[end]], at_doc[off[begin] : off[end]] - begin
            g = 1 / (1 + np.exp(-np.clip(m.logits(end - begin, d, i), -40, 40))) - label[begin:end]
            g /= end - begin
            grad = np.zeros_like(shape)
            grad[0] = g.sum()
            grad[1 : 1 + len(known)] = np.bincount(i, weights=g[d], minlength=len(known)) + decay * m.w
            gv = grad[1 + len(known) :].reshape(m.v.shape)
            for k in range(factors):
                x = m.v[i, k]
                gv[:, k] = np.bincount(i, weights=g[d] * (np.bincount(d, weights=x, minlength=end - begin)[d] - x), minlength=len(known)) + decay * m.v[:, k]
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            m.w0 -= move[0]
            m.w -= move[1 : 1 + len(known)]
            m.v -= move[1 + len(known) :].reshape(m.v.shape)
    return m


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) to the number of texts of either label that have a term, and whether it is a whole word."""
    for batch in slices(batches):
        doc, h, n = terms(batch.column(0))
        whole = np.unique(h[: Words(batch.column(0), lower=True, letters=True).counts.sum()])
        label = batch.column(1).to_numpy(zero_copy_only=False)
        order = np.argsort(doc, kind="stable")
        h, off = distinct_per_doc(doc[order], h[order], n)
        values, inverse = np.unique(h, return_inverse=True)
        toxic = np.bincount(inverse, weights=np.repeat(label, np.diff(off)), minlength=len(values)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([long_array(values), pa.array(toxic), pa.array(np.bincount(inverse, minlength=len(values)) - toxic), pa.array(np.isin(values, whole))], names=["term", "toxic", "other", "word"])


def choose_terms(labelled: DataFrame, most: int = TERMS, least_z: float = LEAST_Z, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the terms whose frequencies in toxic and other texts differ most, and of the most frequent words;
    labelled: (text, label).  ``most`` and ``words`` rows at most reach the driver."""
    n = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(n) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    counted = labelled.select("text", "label").mapInArrow(_frequencies, "term long, toxic long, other long, word boolean").groupBy("term").agg(F.sum("toxic").alias("p"), F.sum("other").alias("q"), F.max("word").alias("word"))
    counted = materialize(counted.where("p + q >= 3"), "terms")
    share = (F.col("p") + F.col("q") + 0.5) / (n[0] + n[1] + 1)
    z = F.abs(F.col("p") / n[1] - F.col("q") / n[0]) / F.sqrt(share * (1 - share) * (1 / n[1] + 1 / n[0]))
    best = counted.select("term", z.alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "term").limit(most)
    frequent = counted.where("word").orderBy(F.desc(F.col("p") + F.col("q")), "term").limit(words)
    return tuple(np.sort(np.array([r.term for r in some.collect()], dtype=np.int64).view(np.uint64)) for some in (best, frequent))


def telling_pairs(n_terms: int, at_doc: np.ndarray, at: np.ndarray, label: np.ndarray, least: float = PAIR_Z, block: int = 1024) -> np.ndarray:
    """Places of the terms in a pair whose texts are labelled otherwise than the terms' own shares of toxic texts, and
    the two shares together, say.  at_doc ascends."""
    both, toxic = np.zeros((n_terms, n_terms), np.float32), np.zeros((n_terms, n_terms), np.float32)
    off = np.searchsorted(at_doc, np.arange(len(label) + 1))
    for a in range(0, len(label), block):
        b = min(len(label), a + block)
        x = np.zeros((b - a, n_terms), np.float32)
        x[at_doc[off[a] : off[b]] - a, at[off[a] : off[b]]] = 1
        both += x.T @ x
        bad = x[label[a:b] == 1]
        toxic += bad.T @ bad
    alone = (np.diag(toxic) + 0.5) / (np.diag(both) + 1)
    logit = lambda p: np.log(p / (1 - p))
    prior = (label.sum() + 0.5) / (len(label) + 1)
    together = 1 / (1 + np.exp(-(logit(alone)[:, None] + logit(alone)[None] - logit(prior))))
    z = np.full(both.shape, np.inf, np.float32)
    for p in (together, np.broadcast_to(alone, both.shape), np.broadcast_to(alone[:, None], both.shape)):
        z = np.minimum(z, np.abs(toxic - both * p) / np.sqrt(np.maximum(both * p * (1 - p), 1e-9)))
    np.fill_diagonal(z, 0)
    return np.flatnonzero(((z >= least) & (both >= 10)).any(axis=1))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> FactorizationMachine:
    """Fit on the labelled documents; usable: which rows of labels (doc_id, toxic) may be seen.

    The driver gets the chosen terms, ``TERMS`` and ``WORDS`` at most, and which of them each of the sample's texts has.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)")
    known = known.where(usable) if usable is not None else known
    label = F.col("toxic").cast("int")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most")
    # at most ``sample`` rows of 12 bytes: small enough to send to every task
    chosen = materialize(sampled(known.select("doc_id", "label"), ["doc_id"], sample), "sample")
    labelled = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"), "labelled")
    single, words = choose_terms(labelled)
    hashes = np.union1d(single, words)
    blank = FactorizationMachine(hashes, 0.0, np.zeros(len(hashes)), np.zeros((len(hashes), FACTORS)))

    def known_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, at = blank.distinct_features(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32()), pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], names=["doc_id", "terms", "label"])

    rows = labelled.mapInArrow(known_terms, "doc_id long, terms array<int>, label int").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return blank
    label = rows["label"].to_numpy()
    doc, at = np.repeat(np.arange(len(label)), pc.list_value_length(rows["terms"]).to_numpy()), pc.list_flatten(rows["terms"]).to_numpy()
    del rows

    def only(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features that are among the sorted hashes ``some``, by their place there."""
        place = np.full(len(hashes), -1, np.int32)
        place[np.searchsorted(hashes, some)] = np.arange(len(some))
        hit = place[at] >= 0
        return doc[hit], place[at[hit]]

    paired = words[telling_pairs(len(words), *only(words), label)] if len(words) else words
    used = np.union1d(single, paired)
    doc, at = only(used)
    return fit(used, doc, at.astype(np.int64), label)


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = model.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out() -> Column:
    """Rows whose labels are not seen."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; labels of held-out rows are never read."""
    return score(docs, train(docs, labels, ~held_out(), sample), threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score below ``threshold``."""
    model = train(docs, labels, ~held_out(), sample)
    return where_text(docs, lambda text: model.score(text) < threshold)
