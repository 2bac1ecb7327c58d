"""PII: base patterns, then bootstrapped contextual extraction.

Base: emails, IP addresses, card numbers and phone numbers by their written form, with validity checks.  They
are the seeds of the method, and always stay in the result.

Bootstrapping: every mention, of a seed or of any other token that has a digit or an ``@`` (neighbouring tokens of
digits are one mention), is tied to lexical patterns: the words before and after it, once with its shape and once
with any; each has a confidence of its own.  Patterns and instances (the mention's text) form a
bipartite graph that Spark scores in rounds: a pattern's confidence in a kind is the smoothed mean confidence
of its distinct instances, an instance's is one minus the chance that all of its patterns err.  Patterns above
``pattern_floor`` that at least ``support`` distinct seeds share pass their kind on to instances unseen so far;
those above ``instance_floor`` become members, which support further patterns in the next round.  Mentions of a
member that don't overlap a base span are added: all of them if it has an ``@`` or five digits, and those in a
pattern above the floor if it has less (a ``7`` isn't private wherever it stands).

Nothing but table rows moves: the graph is grouped by pattern and by instance, sums are partial before each
shuffle, and a mention is some 60 bytes (patterns are told apart by 64 bits of hash, instances by 128); texts are read
once.  Words and mentions count whole, however long; a word that touches a mention ends where the mention before it does.

Null text is empty.  Rows that share a doc_id, or have none, are told apart by a hash of their text and equal rows get
equal spans.  Other columns are ignored; ``redact`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, unused

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# the forms below start at a digit run's beginning and never give back, which finds the same leftmost matches
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_MARK = re.compile(r"[0-9@]+")
_BREAK = re.compile(r"[\x20\x09-\x0D]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LETTER = re.compile(r"[^\W\d_]")
#: Between two tokens of one number.
_GAP = re.compile(r"\)?[\x20\t]+(?:[-/][\x20\t]+)?\(?")
_EDGE = " \t\n\v\f\r.,;:!?()[]{}<>\"'|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", found.end() if found else at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base matches, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(token: str) -> str:
    """Runs of letters as a, of digits as 9, other characters as they are."""
    return re.sub(r"9+", "9", re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", token)))


class Contexts:
    """Lexical patterns of a text's mentions; each word of the text is read once, whatever its length."""

    def __init__(self, text: str, mentions: list[tuple[int, int]]):
        self.text = text
        self.words = [m.span() for m in _WORD.finditer(text)]
        self.starts = [a for a, _ in self.words]
        self.ends = [0, *sorted(b for _, b in mentions)]
        self.begins = [*sorted(a for a, _ in mentions), len(text)]
        self._known: dict[int, bytes] = {}

    def word(self, i: int) -> bytes:
        if i not in self._known:
            a, b = self.words[i]
            self._known[i] = _digest(self.text[a:b].lower(), 8)
        return self._known[i]

    def near(self, start: int, end: int) -> tuple[list[bytes], bytes]:
        """Up to two words before a mention, and the one after or nothing."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        free = self.ends[bisect_right(self.ends, start) - 1]
        touching = self.text[max(self.words[i][0], free) : start].rstrip("([{<\"'|")
        before = [self.word(k) for k in (i - 2, i - 1) if k >= 0]
        if touching:
            before = [*before[-1:], _digest(touching.lower(), 8)]
        rest = self.text[end : min(self.words[j][1], self.begins[bisect_right(self.begins, end - 1)])]
        return before, _digest(rest.lower(), 8) if rest else self.word(j + 1) if j + 1 < len(self.words) else b""

    def patterns(self, start: int, end: int) -> list[int]:
        """Contexts of a mention: two words before, the word before with the one after; each with the mention's shape and without."""
        before, after = self.near(start, end)
        out = []
        for s in (shape(self.text[start:end]).encode(), b""):
            if len(before) == 2:
                out.append(b"2" + before[0] + before[1] + s)
            if before and after:
                out.append(b"1" + before[-1] + after + s)
        return [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True) for x in out]


def _digest(text: str, size: int) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=size).digest()


def wide(text: str) -> bool:
    """Whether a mention's text says enough to be the same identifier wherever it stands."""
    return "@" in text or sum(c.isdigit() for c in text) >= 5


def other_mentions(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an ``@`` outside the base spans; tokens of digits without letters that only blanks,
    brackets or a lone dash part are one mention."""
    run: tuple[int, int] | None = None
    for start, end in _tokens(text, base):
        number = not _LETTER.search(text, start, end) and "@" not in text[start:end]
        if run and number and _GAP.fullmatch(text, run[1], start):
            run = run[0], end
            continue
        if run:
            yield run
        run = (start, end) if number else None
        if not number:
            yield start, end
    if run:
        yield run


def _tokens(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    last, i, taken = 0, 0, sorted((a, b) for a, _, b in base)
    for m in _MARK.finditer(text):
        if m.start() < last:
            continue
        start = m.start()
        while start > last and not _BREAK.match(text, start - 1):
            start -= 1
        stop = _BREAK.search(text, m.end())
        end = last = stop.start() if stop else len(text)
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if i < len(taken) and taken[i][0] < end:
            continue
        yield start, end


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = "doc_id long, tkey long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, mentions array<struct<kind:int,start:int,stop:int,instance:binary,wide:boolean,patterns:array<long>>>"
_TYPE = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("base", pa.string()), ("mentions", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("instance", pa.binary()), ("wide", pa.bool_()), ("patterns", pa.list_(pa.int64()))])))])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for doc, text, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            text = text or ""
            base = base_spans(text)
            mentions = [(k, a, b) for a, k, b in base] + [(-1, a, b) for a, b in other_mentions(text, base)]
            near = Contexts(text, [(a, b) for _, a, b in mentions]) if mentions else None
            told = [{"kind": k, "start": a, "stop": b, "instance": _digest(text[a:b].lower(), 16), "wide": wide(text[a:b]), "patterns": near.patterns(a, b)} for k, a, b in mentions]
            n = [sum(k == i for _, k, _ in base) for i in range(4)]
            line = joined(base)
            out.append((doc, key, *n, hashlib.sha256(line.encode()).hexdigest(), line, told))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _TYPE, strict=True)], schema=_TYPE)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """base and the list of added spans to all spans."""
    for batch in batches:
        lines = []
        for line, added in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            if added:
                base = [(int(a), KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in line.split(",") if x)]
                line = joined(sorted({*base, *((x["start"], x["kind"], x["stop"]) for x in added)}))
            lines.append(line)
        yield pa.RecordBatch.from_arrays([*batch.columns[: batch.num_columns - 2], pa.array(lines, pa.string())], names=[*batch.schema.names[:-2], "spans"])


def members(mentions: DataFrame, rounds: int, support: int, pattern_floor: float, instance_floor: float) -> tuple[DataFrame, DataFrame]:
    """(instance, kind) that the rounds add to the seeds, and (pattern, kind) of the last round; mentions: (kind, instance, patterns), kind -1 if none."""
    links = materialize(mentions.select("kind", "instance", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "links")
    confident = links.where("kind >= 0").select("instance", "kind").distinct().withColumn("c", F.lit(1.0))
    found = strong = None
    for _ in range(rounds):
        # mean confidence over all distinct instances of a pattern, known or not; two imaginary ones don't count
        known = links.select("pattern", "instance").join(confident, "instance").groupBy("pattern", "kind").agg(F.sum("c").alias("c"), F.count("*").alias("n"))
        of = links.groupBy("pattern").agg(F.count("*").alias("all"))
        strong = materialize(known.where(F.col("n") >= support).join(of, "pattern").withColumn("p", F.col("c") / (F.col("all") + 1)).where(F.col("p") >= pattern_floor).select("pattern", F.col("kind").alias("as"), "p"), "strong")
        unseen = links.where("kind < 0").join(strong, "pattern").groupBy("instance", "as").agg((1 - F.exp(F.sum(F.log(1.0001 - F.col("p"))))).alias("c"))
        best = unseen.groupBy("instance").agg(F.max(F.struct("c", -F.col("as"))).alias("b")).select("instance", (-F.col("b.col2")).alias("kind"), F.col("b.c").alias("c")).where(F.col("c") >= instance_floor)
        found = materialize(best, "members")
        confident = links.where("kind >= 0").select("instance", "kind").distinct().withColumn("c", F.lit(1.0)).unionByName(found)
    return found.select("instance", "kind"), strong.select("pattern", F.col("as").alias("kind"))


def _added(keyed: DataFrame, rounds: int, support: int, pattern_floor: float, instance_floor: float) -> tuple[DataFrame, DataFrame]:
    """What ``_find`` gives, and (doc_id, tkey, added) of the documents that gain spans."""
    found = materialize(keyed.mapInArrow(_find, FOUND), "found")
    mentions = found.select("doc_id", "tkey", F.explode("mentions").alias("m")).select("doc_id", "tkey", "m.*")
    more, strong = members(mentions, rounds, support, pattern_floor, instance_floor)
    others, at = mentions.where("kind < 0").drop("kind"), ["doc_id", "tkey", "start", "stop", "kind"]
    by_text = others.where("wide").join(more, "instance").select(at)
    by_place = others.where("not wide").select("*", F.explode("patterns").alias("pattern")).join(strong, "pattern").join(more, ["instance", "kind"]).select(at)
    added = by_text.unionByName(by_place).groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("added"))
    return found, added


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tkey"))


def find_pii(docs: DataFrame, rounds: int = 2, support: int = 5, pattern_floor: float = 0.7, instance_floor: float = 0.7) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row of ``docs``."""
    found, added = _added(_keyed(docs), rounds, support, pattern_floor, instance_floor)
    counts = [f"n_{k}" for k in KINDS]
    doc, key, more = unused("doc"), unused("key"), unused("added")
    added = added.toDF(doc, key, more)
    rows = found.select("doc_id", "tkey", *counts, "base_sha256", "base").join(added, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col("tkey") == F.col(key)), "left").select("doc_id", *counts, "base_sha256", "base", more)
    return rows.mapInArrow(_merge, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, rounds: int = 2, support: int = 5, pattern_floor: float = 0.7, instance_floor: float = 0.7) -> DataFrame:
    """docs with each span, base and added, replaced by its kind in brackets; a column n_chars follows the text.

    Base spans are found again in place; only added ones are joined, and those are few.
    """
    _, added = _added(_keyed(docs), rounds, support, pattern_floor, instance_floor)
    names = docs.columns
    doc, key, more = unused("doc"), unused("key"), unused("added")
    added = added.toDF(doc, key, more)
    rows = docs.join(added, docs["doc_id"].cast("long").eqNullSafe(added[doc]) & (F.xxhash64(docs["text"]) == added[key]), "left").select(*[docs[n] for n in names], more)

    def clean(text: str | None, more: list[dict] | None) -> str | None:
        if not text:
            return text
        spans = sorted({*base_spans(text), *((x["start"], x["kind"], x["stop"]) for x in more or ())})
        if not spans:
            return text
        parts, at = [], 0
        for a, kind, b in spans:
            if a >= at:
                parts += [text[at:a], f"[{KINDS[kind].upper()}]"]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(names)}
            text = column["text"].to_pylist()
            new = [clean(t, m) for t, m in zip(text, batch.column(len(names)).to_pylist(), strict=True)]
            column["text"] = pa.array(new, column["text"].type)
            if "n_chars" in column:
                n = [len(t) if t is not None and t != old else c for t, old, c in zip(new, text, column["n_chars"].to_pylist(), strict=True)]
                column["n_chars"] = pa.array(n, column["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(column.values()), names=names)

    return rows.mapInArrow(run, docs.schema)
