"""Operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from itemflow.llm import common, decontaminate, html_extract, near_dedup, packing, pii, ppm, sharding, substring_dedup, topk_search, toxicity
from pyspark.sql import functions as F

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
ODD = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, rep long, spans string, added string, label int, root long, tkey long, score double"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta the of and to Über straße x1 42".split()) + str(rng.randrange(900)) for _ in range(n)]


def fixture():
    """(doc_id, text): near and exact copies, shared passages, nulls, empty, long, repeats."""
    rng = random.Random(3)
    base = words(rng, 200)
    passage = words(rng, 70)
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:190] + words(rng, 5))), (4, None), (5, ""), (6, "   \n\t "), (7, "One two"), (8, "one TWO"), (9, " ".join(words(rng, 30) + passage + words(rng, 40)))]
    rows += [(10 + i, " ".join(words(rng, rng.randrange(60)) + passage[: rng.randrange(40, 70)] + words(rng, rng.randrange(60)))) for i in range(12)]
    rows += [(40, " ".join(["same"] * 300)), (41, " ".join(["same"] * 120)), (42, " non breaking  " + " ".join(passage[5:65])), (50, " ".join(words(rng, 40_000))), (1, " ".join(base)), (None, " ".join(base)), (60, "a" * 100_000)]
    return rows


def frame(spark, rows, extra=False):
    if extra:
        return spark.createDataFrame([(d, t, None, "s", None, 1, None, 2, "x", None, None, 3, 4, None) for d, t in rows], ODD)
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def rows():
    return fixture()


# 1


def removed(rows, window):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in sorted(((d, w) for d, w in split if d is not None), key=lambda x: x[0]):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if d is not None and first[tuple(w[k : k + window])] < d:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [4096, 2])
def test_substring_dedup(spark, rows, hot):
    got = substring_dedup.substring_dedup(frame(spark, rows, True), hot=hot).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == removed(rows, 50)
    for r in got:
        assert hashlib.sha256(b" ".join((r.kept_text or "").encode().split())).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("hot", [4096, 2])
def test_spans_stay_one_row_a_segment(spark, rows, hot, monkeypatch):
    """The join of segments and runs gives no segment twice, in however many surroundings a passage stands."""
    rng = random.Random(4)
    passages = [words(rng, 120), words(rng, 120)]
    mixed = [words(rng, rng.randrange(30)) + p[rng.randrange(40) : rng.randrange(80, 120)] + words(rng, 20) for p in passages for _ in range(40)]
    texts = rows + [(700 + i, " ".join(w)) for i, w in enumerate(mixed)]
    kept, write = {}, substring_dedup.materialize
    monkeypatch.setattr(substring_dedup, "materialize", lambda df, name: kept.setdefault(name, write(df, name)))
    spans = substring_dedup.repeated_spans(substring_dedup.keyed(frame(spark, texts)).where("doc_id is not null"), hot=hot)
    assert 0 < spans.count() <= kept["shared"].count()
    monkeypatch.undo()
    got = substring_dedup.substring_dedup(frame(spark, texts), hot=hot).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == removed(texts, 50)


def test_substring_dedup_empty(spark):
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def test_suffix_automaton():
    rng = random.Random(1)
    for _ in range(60):
        texts = [[rng.choice("ab") for _ in range(rng.randrange(1, 14))] for _ in range(rng.randrange(1, 5))]
        a = substring_dedup.SuffixAutomaton()
        for owner, t in enumerate(texts):
            a.add(t, owner)
        a.close()
        query = [rng.choice("abc") for _ in range(12)]
        for w in (1, 3):
            want = [min((o for o, t in enumerate(texts) if any(t[j : j + w] == query[k : k + w] for j in range(len(t) - w + 1))), default=substring_dedup.NOBODY) for k in range(len(query) - w + 1)]
            assert a.first_owners(query, w) == want


# 2


def test_pii_base_and_edges(spark, rows):
    extra = [(70, "mail a.b%c@x-y.co.uk, x@y, a@b.c_d@e.f, ip 1.2.3.4 999.1.1.1 1.2.3.4.5, card 4111 1111 1111 1111, 4111111111111112, phone +1 (212) 555-0100 +12"), (71, "1" * 5000), (72, "a@" * 3000), (73, "é+44 20 7946 0958é")]
    got = {r.doc_id: r for r in pii.find_pii(frame(spark, rows + extra, True)).collect()}
    assert (got[70].n_email, got[70].n_ip, got[70].n_card, got[70].n_phone) == (3, 2, 1, 1)
    assert got[73].spans == "phone:1:17"
    for d, t in rows + extra:
        spans = naive_spans(t or "")
        assert got[d].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert pii.find_pii(frame(spark, [])).count() == 0


def naive_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub(r"\D", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_bootstrapping(spark):
    """Seeds induce a context; the context finds card numbers that fail the check; other numbers stay."""
    rng = random.Random(5)

    def card(valid):
        d = [rng.randrange(10) for _ in range(15)]
        last = next(x for x in range(10) if pii.luhn("".join(map(str, d + [x]))))
        return "".join(map(str, d + [last if valid else (last + 1) % 10]))

    rows = [(i, f"please charge my card number {card(True)} today thanks {i}") for i in range(40)]
    rows += [(100 + i, f"please charge my card number {card(False)} today thanks") for i in range(3)]
    rows += [(200 + i, f"the part code {card(False)} shipped") for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.find_pii(frame(spark, rows)).collect()}
    assert all(got[100 + i].startswith("card:") for i in range(3))
    assert all(not got[200 + i] for i in range(40))
    clean = {r.doc_id: r for r in pii.redact(frame(spark, rows, True)).collect()}
    assert clean[100].text == "please charge my card number [CARD] today thanks" and clean[0].text.startswith("please charge my card number [CARD] today")
    assert clean[200].text == dict(rows)[200]
    assert pii.redact(frame(spark, rows, True)).columns == frame(spark, rows, True).columns


def test_pii_bootstrapping_other_forms(spark):
    """A context learned from phones of one form finds those of others, of several tokens, with few digits or long."""
    rows = [(i, f"please ring my desk on +1 (017) 555-{1000 + i} before noon") for i in range(40)]
    forms = {100: "(017) 555-7713", 101: "555 7", 102: "017 / 555-7713", 103: "x77", 104: "5-" * 40 + "5"}
    rows += [(d, f"please ring my desk on {x} before noon, room 555 7 or x77") for d, x in forms.items()]
    rows += [(200 + i, f"the part code {i} 55 shipped on 55{i} (today)") for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.find_pii(frame(spark, rows)).collect()}
    texts = dict(rows)
    for d, x in forms.items():
        x = x.lstrip("(")
        assert got[d] == f"phone:{texts[d].index(x)}:{texts[d].index(x) + len(x)}"
    assert all(not got[200 + i] for i in range(40))
    clean = {r.doc_id: r.text for r in pii.redact(frame(spark, rows, True)).collect()}
    assert clean[101] == "please ring my desk on [PHONE] before noon, room 555 7 or x77"


def test_pii_without_ids_and_long(spark):
    """Rows without a doc_id gain spans as others do; neighbours and mentions of any length count whole."""
    rows = [(i, f"call my desk on +1 (017) 555-{1000 + i} before noon") for i in range(30)]
    long_word = "z" * 300
    rows += [(None, "call my desk on x77 before noon"), (None, "call my desk on x77 before noon"), (None, "nothing 5 here"), (50, "call my desk on " + "7" * 400 + " before noon")]
    rows += [(100 + i, f"{long_word}a {long_word} +1 (017) 555-{2000 + i} {long_word}b") for i in range(30)] + [(200, f"{long_word}a {long_word} x78 {long_word}b"), (201, f"{long_word}c {long_word}d x78 {long_word}e")]
    got = collections.defaultdict(list)
    for r in pii.find_pii(frame(spark, rows, True)).collect():
        got[r.doc_id].append(r.spans)
    assert sorted(got[None]) == ["", "phone:16:19", "phone:16:19"] and got[50] == ["phone:16:416"]
    assert got[200] == ["phone:603:606"] and got[201] == [""]
    clean = [r.text for r in pii.redact(frame(spark, rows, True)).collect() if r.doc_id is None]
    assert sorted(clean) == ["call my desk on [PHONE] before noon"] * 2 + ["nothing 5 here"]


def test_pii_linear():
    """Many mentions in one word, and long words before them, are read once each."""
    import time

    for text in ("a@b.c," * 40_000, "w" * 200_000 + " " + "1.2.3.4," * 20_000):
        began = time.process_time()
        base = pii.base_spans(text)
        near = pii.Contexts(text, [(a, b) for a, _, b in base])
        assert base and all(near.patterns(a, b) is not None for a, _, b in base)
        assert time.process_time() - began < 10


def test_pii_members(spark):
    """The rounds on the graph, written out."""
    rng = random.Random(17)
    mentions = [(rng.choice([-1, -1, 0, 3]) if i % 40 < 30 else -1, f"i{i % 40}", [rng.randrange(12) for _ in range(rng.randrange(1, 4))]) for i in range(160)]
    kind_of = {}
    for k, i, _ in mentions:
        kind_of[i] = max(k, kind_of.get(i, -1))
    mentions = [(kind_of[i], i, p) for _, i, p in mentions]
    df = spark.createDataFrame([(k, i.encode(), p) for k, i, p in mentions], "kind int, instance binary, patterns array<long>")
    more, strong = pii.members(df, 2, 2, 0.3, 0.35)
    links = {(p, i) for _, i, ps in mentions for p in ps}
    confident = {(i, k): 1.0 for i, k in kind_of.items() if k >= 0}
    for _ in range(2):
        marks = {}
        for p in {p for p, _ in links}:
            mine = [i for q, i in links if q == p]
            for k in range(4):
                known = [confident[i, k] for i in mine if (i, k) in confident]
                if len(known) >= 2 and sum(known) / (len(mine) + 1) >= 0.3:
                    marks[p, k] = sum(known) / (len(mine) + 1)
        found = {}
        for i, k in kind_of.items():
            if k < 0:
                scores = {a: 1 - math.prod(1.0001 - c for (p, b), c in marks.items() if b == a and (p, i) in links) for a in range(4) if any(b == a and (p, i) in links for p, b in marks)}
                if scores and max(scores.values()) >= 0.35:
                    best = min(a for a in scores if scores[a] == max(scores.values()))
                    found[i] = (best, scores[best])
        confident = {(i, k): 1.0 for i, k in kind_of.items() if k >= 0} | {(i, k): c for i, (k, c) in found.items()}
    assert found and {(bytes(r.instance).decode(), r.kind) for r in more.collect()} == {(i, k) for i, (k, _) in found.items()}
    assert {(r.pattern, r.kind) for r in strong.collect()} == set(marks)


# 3


def test_toxicity(spark):
    """Words and stems alone, and a pair that is harmless apart."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        w = words(rng, 30)
        kind = rng.randrange(6)
        if kind == 0:
            w[3:3] = ["grumbok" + rng.choice(["", "ing", "ers", str(rng.randrange(99))])]
        if kind == 1:
            w[5:5] = ["those", "blorks", "vile"]
        if kind == 2:
            w[5:5] = ["blorks"]
        if kind == 3:
            w[5:5] = ["vile"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind in (0, 1))))
    rows += [(5000, None), (5001, ""), (None, "x"), (7, rows[7][1])]
    labels += [(None, 1), (6000, None), (7, labels[7][1])]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, rows, True), marks).collect()
    assert len(got) == len(rows)
    truth = {d: y for d, y in labels if y is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and (r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)) for r in got)
    none = toxicity.toxicity(frame(spark, rows), marks.limit(0)).collect()
    assert len(none) == len(rows) and all(not r.predicted for r in none)
    assert toxicity.toxicity(frame(spark, []), marks).count() == 0
    kept = toxicity.without_toxic(frame(spark, rows, True), marks)
    assert {None, 5000, 5001} <= {r.doc_id for r in kept.collect()} and kept.columns == frame(spark, [], True).columns


@pytest.mark.parametrize("rule", [lambda a, b: a and b, lambda a, b: a != b])
def test_toxicity_of_pairs(spark, rule):
    """A pair of words each harmless alone; labels that contradict each other aren't used."""
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(1500):
        w, a, b = words(rng, 30), rng.random() < 0.5, rng.random() < 0.5
        w[4:4] = ["vile"] * a
        w[9:9] = ["blorks"] * b
        rows.append((i, " ".join(w)))
        labels.append((i, int(rule(a, b))))
    rows += [(3000 + i, "vile " + rows[i][1]) for i in range(200)] + [rows[0]] * 5
    both = [(3000 + i, y) for i in range(200) for y in (0, 1)]
    got = toxicity.toxicity(frame(spark, rows, True), spark.createDataFrame(labels + both, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(rows) and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert len({r.score for r in got if r.doc_id == 0}) == 1


def test_telling_pairs():
    """Against the counts written out."""
    rng = np.random.default_rng(3)
    x = rng.random((600, 12)) < 0.4
    label = (x[:, 2] & x[:, 7] | (rng.random(600) < 0.05)).astype(int)
    doc, at = np.nonzero(x)
    got = toxicity.telling_pairs(12, doc, at, label, least=6.0, block=100).tolist()
    prior, logit, want = (label.sum() + 0.5) / 601, lambda p: math.log(p / (1 - p)), set()
    share = [(label[x[:, i]].sum() + 0.5) / (x[:, i].sum() + 1) for i in range(12)]
    for i, j in itertools.combinations(range(12), 2):
        both = x[:, i] & x[:, j]
        expected = [share[i], share[j], 1 / (1 + math.exp(-(logit(share[i]) + logit(share[j]) - logit(prior))))]
        if min(abs(label[both].sum() - both.sum() * p) / math.sqrt(both.sum() * p * (1 - p)) for p in expected) >= 6:
            want |= {i, j}
    assert got == sorted(want) and {2, 7} <= want


# 4


def test_sharding(spark, rows, tmp_path):
    docs = frame(spark, rows, True)
    got = sharding.shard(docs, 5, save_to=str(tmp_path / "map")).collect()
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == sorted((d or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    for k in range(5):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    saved = sharding.SlotMap.load(spark, str(tmp_path / "map"))
    assert saved.version == 2 and all(saved.home[r.virtual_slot] == r.shard for r in got)
    assert sharding.shard(frame(spark, []), 5).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97 * 9).cast("int")).alias("text"))
    sizes = [r.b for r in sharding.shard(many, 7).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(sizes) - min(sizes) < 0.001 * sum(sizes)


def test_sharding_versions_and_repeats(spark, tmp_path):
    """Versions stand side by side, are read back with their edits, and aren't written twice; rows alike fill no slot."""
    path = str(tmp_path / "map")
    docs = frame(spark, [(i, "x" * (i % 50)) for i in range(3000)] + [(9, "again and again")] * 5000 + [(None, None)] * 3000)
    first = sharding.shard(docs, 8, slots=512, save_to=path)
    got = first.collect()
    assert len(got) == 11_000 and max(collections.Counter(r.virtual_slot for r in got).values()) < 1500
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    size = collections.Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert max(size.values()) - min(size.values()) < 0.05 * sum(size.values()) / 8
    again = sharding.SlotMap.load(spark, path)
    grown = sharding.shard(docs, 9, slots=512, current=again, save_to=path).collect()
    third = sharding.SlotMap.load(spark, path)
    assert (again.version, third.version, len(third.edits), third.edits[0]) == (2, 3, 2, again.edits[0])
    assert {r.virtual_slot: r.shard for r in grown}.items() <= third.home.items() and {r.map_version for r in grown} == {3}
    assert all(third.home[s] == third.edits[1].get(s, k) for s, k in again.home.items())
    with pytest.raises(Exception, match="(?i)exist"):
        third.save(spark, path)


def test_slot_map_edits():
    m = sharding.SlotMap.even(4, 64)
    weight = {s: 10 + s % 3 for s in range(64)}
    a = m.rebalanced(weight)
    b = a.rebalanced(weight, 5)
    assert b.version == 3 and set(b.edits[-1].values()) <= set(range(5))
    moved = [s for s in range(64) if a.home[s] != b.home[s]]
    assert moved and sum(b.home[s] == 4 for s in moved) >= len(moved) // 2


# 5


def reference_ppm(train, text, order):
    """PPM, method C with exclusion, step by step."""
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    mark = bytes([255])
    for t in train:
        s = mark * order + t + mark
        for p in range(order, len(s)):
            for k in range(order + 1):
                counts[k][s[p - k : p]][s[p]] += 1
    s, total = mark * order + text + mark, 0.0
    for p in range(order, len(s)):
        excluded = set()
        for k in range(order, -2, -1):
            if k < 0:
                total += math.log10(1 / (256 - len(excluded)))
                break
            seen = {x: n for x, n in counts[k][s[p - k : p]].items() if x not in excluded}
            if not seen:
                continue
            size = sum(seen.values()) + len(seen)
            if s[p] in seen:
                total += math.log10(seen[s[p]] / size)
                break
            total += math.log10(len(seen) / size)
            excluded |= set(seen)
    return total


def test_ppm(spark, rows):
    rows = [(d, t) for d, t in rows if d not in (50, 60)] + [(60 + i, "The straße ended " * i + chr(200 + i)) for i in range(12)]
    got = ppm.ppm_score(frame(spark, rows, True), ppm.in_training(), head=50).collect()
    known = {r.doc_id: r for r in got if r.doc_id is not None}
    texts = {d: (t or "").encode().translate(LOW) for d, t in rows}
    train = [t.encode().translate(LOW) if t else b"" for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 10]
    c = collections.Counter(w for t in train for w in t.split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    for d, r in known.items():
        w = texts[d].split()
        want = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, 1 + sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(want, rel=1e-9)
        assert r.score == pytest.approx(reference_ppm(train, texts[d], ppm.ORDER), rel=1e-4)
    assert len(got) == len(rows)


@pytest.mark.parametrize("contexts", [(30_000, 7), (5, 7), (0, 0)])
def test_ppm_contexts_not_at_hand(spark, rows, contexts):
    """How many contexts go to the tasks doesn't change a score: all that were counted take part."""
    texts = {d: t for d, t in rows if d is not None and t and len(t) < 2000 and d not in (50, 60)}
    few = [*sorted(texts.items())[:25], (9001, "héllo 漢字 zq"), (9002, None), (9003, "abab " * 9), (9003, "abab " * 9)]
    train = [(t or "").encode().translate(LOW) for d, t in few if zlib.crc32(str(d).encode()) % 10]
    got = ppm.ppm_score(frame(spark, few, True), ppm.in_training(), contexts=contexts).collect()
    assert len(got) == len(few)
    texts = dict(few)
    for r in got:
        assert r.score == pytest.approx(reference_ppm(train, (texts[r.doc_id] or "").encode().translate(LOW), ppm.ORDER), rel=1e-5)


def test_ppm_without_training(spark):
    got = ppm.ppm_score(frame(spark, [(1, "ab"), (2, None)]), F.lit(False)).collect()
    assert {round(r.score, 6) for r in got} == {round(3 * math.log10(1 / 256), 6), round(math.log10(1 / 256), 6)}
    assert ppm.ppm_score(frame(spark, []), ppm.in_training()).count() == 0


# 6


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One  two<br>three<p>Four</article><footer>f</footer>", "T & U\nOne two three\nFour"),
        ("<body><div class=menu><a>m</a></div><div id=content><p>" + "long text " * 30 + "</p><p>more of it, and more</p><div class='comments'><p>reader says something quite long here</p></div></div><div class=sidebar>s</div></body>", ("long text " * 30).strip() + "\nmore of it, and more"),
        ("<article><p>a<script>var x='</p>';</script>b</p><form><input><p>no</p></form><!-- c --><style>p{}</style></article>", "ab"),
        ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "x\ny\n1\n2"),
        ("<main><p>&#x41;&#66;&nbsp;C</p></main>", "AB C"),
        ("no markup at all", "no markup at all"),
    ],
)
def test_html(page, text):
    assert html_extract.main_text(page) == text


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x</p></article>", 5), (2, None, None, 5), (None, "v", "<p>" * 20_000 + "deep", 5)], "page_id long, url string, html string, n_chars int")
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    assert got == {(1, "u", "x", 1), (2, None, "", 0), (None, "v", "deep", 4)}
    nested = "<div>" * 5_000 + "deep" + "</div>" * 5_000
    assert html_extract.main_text(nested) == "deep"


def test_html_names_and_references():
    para = ("Some long paragraph of the story that goes on, with words. " * 12)[:599]
    for name in ("legal", "related-work", "popular-science", "social-policy", "search-engines", "notice-of-award"):
        page = f"<body><div class=menu><a href=x>Home</a></div><div>{f'<p>{para}</p>' * 4}<div class='{name}'><p>{para}</p></div></div><div><a href=1>one thing</a><a href=2>another</a></div></body>"
        assert len(html_extract.main_text(page)) == 2999
    for name in ("cookie-notice", "sidebar left", "ad-300x250", "siteHeader", "comments-area", "main-nav"):
        page = f"<body><div class='{name}'>{para}</div><div><p>{para}</p><p>Short.</p></div></body>"
        assert html_extract.main_text(page) == f"{para}\nShort."
    assert html_extract.main_text("<p>x &am<b>p;</b></p>") == "x &amp;"
    story = f"<article><h1>T</h1><p>{para}</p><section><p>Short.</p></section></article>"
    assert html_extract.main_text(f"<body><article><p>Teaser</p><a href=x>more of it here</a></article>{story}") == f"T\n{para}\nShort."
    assert html_extract.main_text(f"<p title='a>b' x=it's>{para}</p><a") == para


@pytest.mark.parametrize("piece", ["<a ", "<header>", "</x>", "<u><div>", "<b>x", "<!--", '<a "', "<table><tr><td><p>", "<li>", "&am", "<a b='", "<p><b>"])
def test_html_hostile_pages(piece):
    """Work grows with the page's length, not its square."""
    import time

    def took(n):
        began = time.process_time()
        html_extract.main_text(piece * (n // len(piece)))
        return time.process_time() - began

    assert min(took(400_000), took(400_000)) < 6 * took(100_000) + 1


def test_html_densities():
    """Densities and sums of random pages against their definition, computed from the tree top down."""
    rng = random.Random(12)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []
        return (rng.choice(["div", "span", "a", "section"]) if depth else "p", [" ".join(words(rng, rng.randrange(1, 9)))] + kids)

    def page(t):
        return f"<{t[0]}>" + "".join(x if isinstance(x, str) else page(x) for x in t[1]) + f"</{t[0]}>"

    def every(t):
        yield t
        for x in t[1]:
            if not isinstance(x, str):
                yield from every(x)

    def chars(t):
        return sum(len(x.strip()) for n in every(t) for x in n[1] if isinstance(x, str))

    def links(t):
        """Characters and tags in links below t; a link counts itself."""
        if t[0] == "a":
            return chars(t), len(list(every(t)))
        below = [links(x) for x in t[1] if not isinstance(x, str)]
        return sum(b[0] for b in below), sum(b[1] for b in below)

    def density(t, body):
        c, tags, (lc, lt) = chars(t), len(list(every(t))) - 1, links(t)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + links(body)[0] / max(1, chars(body)) * c + math.e) + 1
        return c / max(1, tags) * math.log(max(1, c / max(1, lc) * max(1, tags) / max(1, lt))) / math.log(base)

    for _ in range(40):
        body = ("html", [tree(3) for _ in range(3)])
        _, nodes = html_extract.parse("".join(page(x) for x in body[1]))
        nodes = html_extract.take_away(nodes)
        html_extract.measure(nodes)
        flat = list(every(body))
        assert [n.tag for n in nodes] == [t[0] for t in flat]
        for n, t in zip(nodes, flat, strict=True):
            assert n.density == pytest.approx(density(t, body))
            assert n.total == pytest.approx(sum(density(k, body) for k in t[1] if not isinstance(k, str)))


# 7


def brute_components(rows):
    sets = []
    for d, t in rows:
        w = (t or "").encode().translate(LOW).split()
        sets.append((d, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations([x for x in sets if x[0] is not None], 2):
        if s and t and 100 * len(s & t) >= 85 * len(s | t):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted([(d, len(s), find(d) if d is not None else None, d is None or find(d) == d) for d, s in sets], key=repr)


def test_near_dedup(spark, rows):
    rng = random.Random(9)
    base = words(rng, 120)
    chain = [(300, base)]
    for i in range(1, 30):  # each alike to its neighbours only
        w = list(chain[-1][1])
        for _ in range(2):
            w[rng.randrange(len(w))] = f"edit{i}"
        chain.append((300 + i, w))
    all_rows = rows + [(d, " ".join(w)) for d, w in chain] + [(400 + i, " ".join(base[:-1] + [f"n{i}"])) for i in range(100)]
    got = near_dedup.near_dedup(frame(spark, all_rows, True)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute_components(all_rows)
    kept = near_dedup.without_near_copies(frame(spark, all_rows, True))
    assert kept.columns == frame(spark, [], True).columns
    want = {r[0] for r in brute_components(all_rows) if r[3]}
    assert {r.doc_id for r in kept.collect()} == want
    assert near_dedup.near_dedup(frame(spark, [])).count() == 0


def test_crowded_buckets_by_blocks(spark, rows, monkeypatch):
    """Every bucket that holds several components is compared inside the join, in blocks of three members a side."""
    rng = random.Random(10)
    base = words(rng, 150)
    own = [list(base) for _ in range(40)]
    for i, w in enumerate(own):  # alike to some, not to all
        for _ in range(1 + i % 4):
            w[rng.randrange(len(w))] = f"edit{i}"
    all_rows = rows + [(500 + i, " ".join(w)) for i, w in enumerate(own)]
    written, write = [], near_dedup.materialize
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "materialize", lambda df, name: (written.append(name), write(df, name))[1])
    classes, links = near_dedup.near_links(frame(spark, all_rows, True), crowd=0)
    root = {r.node: r.root for r in near_dedup.components(links).collect()}
    assert written.count("open") == 2  # the join was taken
    got = [(r.doc_id, r.n_shingles, None if r.doc_id is None else root.get(r.rep, r.doc_id if r.rep is None else r.rep)) for r in classes.collect()]
    assert sorted(got, key=repr) == sorted((x[:3] for x in brute_components(all_rows)), key=repr)


def test_blocks_are_not_split_again(spark, monkeypatch):
    """However small the parts are that Spark would split tables into, a block of a crowded bucket is one task's."""
    rng = random.Random(10)
    base = words(rng, 150)
    own = [list(base) for _ in range(200)]
    for i, w in enumerate(own):
        for _ in range(1 + i % 4):
            w[rng.randrange(len(w))] = f"edit{i}"
    tiny = {"skewJoin.skewedPartitionThresholdInBytes": "4k", "skewJoin.skewedPartitionFactor": "1.1", "advisoryPartitionSizeInBytes": "4k", "coalescePartitions.enabled": "false", "autoBroadcastJoinThreshold": "-1"}
    write, plans = near_dedup.materialize, []

    def planned(df, name):
        if name == "links" and "xa" in df._jdf.queryExecution().optimizedPlan().toString():
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    monkeypatch.setattr(near_dedup, "materialize", planned)
    for k, v in tiny.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    try:
        links = near_dedup.near_links(frame(spark, [(500 + i, " ".join(w)) for i, w in enumerate(own)]), crowd=0)[1].count()
    finally:
        for k in tiny:
            spark.conf.unset(f"spark.sql.adaptive.{k}")
    assert links and len(plans) == 1 and "SortMergeJoin" in plans[0]
    assert "skew=true" not in plans[0] and "skewed" not in plans[0]
    assert plans[0].split("== Initial Plan ==")[0].count("Exchange") == 3  # both sides by block, and the links


@pytest.mark.parametrize(("bits", "percent"), [(125, 85), (512, 85), (108, 80), (512, 80)])
def test_signature_allowance(bits, percent):
    p, most = (100 - percent) / 200, near_dedup.allowed(bits, percent)
    assert sum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(most + 1, bits + 1)) <= 1e-7


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b}
    assert {k: v for k, v in got.items()} == {k: find(k) for k in parent if k in got} and set(parent) - set(got) <= alone


# 8


def test_packing(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [*rows, (90, "a <|endoftext|> b"), (91, "emoji 👩‍🚀 ﷽ \r\n\t  x'll don't 12345")]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(d, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for d, t in rows]
    got = packing.pack(frame(spark, rows, True)).collect()
    want = sorted(((d, a, zlib.crc32(x[a : a + 1024].tobytes()), len(x)) for d, x in ids for a in range(0, len(x), 1024)), key=repr)
    assert sorted(((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in got), key=repr) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(frame(spark, [])).count() == 0


def pieces_of(rows):
    bins, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id, r.doc_tokens].append((r.start, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
    sizes = [sum(n for _, n in p) for p in bins.values()]
    assert max(sizes) <= 1024
    return bins, docs, sum(1024 - n for n in sizes if n & (n - 1)) / sum(sizes)


def test_packing_filled(spark, rows):
    """Each id lies in exactly one piece, sequences have next to no padding, ids are those of the tokenizer."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(4)
    many = [(10_000 + i, " ".join(words(rng, rng.randrange(220, 300)))) for i in range(400)] + [(None, "some text without an id")] * 300 + [(7, "alike")] * 300
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*rows, *many]
    got = packing.pack(frame(spark, rows, True), fill=True).collect()
    _, docs, padding = pieces_of(got)
    assert padding < 0.01
    want = {}
    for d, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault((d, len(ids)), []).append(ids)
    assert sum(n for p in docs.values() for _, n in p) == sum(len(x) for v in want.values() for x in v)
    for key, copies in want.items():
        if len({x.tobytes() for x in copies}) == 1:
            covered = collections.Counter(i for a, n in docs[key] for i in range(a, a + n))
            assert covered == {i: len(copies) for i in range(key[1])}
    for r in got:
        assert r.ids_crc32 in {zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in want[r.doc_id, r.doc_tokens]}


def test_packing_groups(spark, monkeypatch):
    """Groups end at a number of items and go on; a task that runs again gives the same rows."""
    docs = spark.createDataFrame([(None, f"row {i % 7}") for i in range(3000)], "doc_id long, text string").coalesce(2)
    first, again = (sorted(map(tuple, packing.pack(docs, fill=True).collect()), key=repr) for _ in range(2))
    assert first == again
    monkeypatch.setattr(packing, "GROUP", 50)
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))}))
    task = packing._Task((64, 20, 64), True)
    for i in range(500):
        task.add(i, np.arange(1 + i % 90, dtype="<u4"), None)
    task.pack()
    assert {r[5] >> 40 for r in task.rows} == {3} and sum(r[2] for r in task.rows) == sum(1 + i % 90 for i in range(500))
    assert max(collections.Counter(r[5] for r in task.rows).values()) <= 20


def brute_dot(sizes, limits):
    """The heuristic step by step: of all items that fit, the one with the largest product; ties by size."""
    left, bins, cap = [tuple(s) for s in sizes.tolist()], [], np.array(limits, float)
    while left:
        room, mine = cap.copy(), []
        while True:
            fits = [s for s in left if (np.array(s) <= room).all()]
            if not fits:
                break
            top = max(round(float(np.array(s) / cap @ (room / cap)), 9) for s in fits)
            s = min(s for s in fits if round(float(np.array(s) / cap @ (room / cap)), 9) == top)
            left.remove(s)
            mine.append(s)
            room = room - s
        bins.append(mine or [left.pop(0)])
    return sorted(sorted(b) for b in bins)


def test_pack_group_heuristic():
    """Against the heuristic written out, with limits on segments and loss-bearing tokens that bind."""
    rng = np.random.default_rng(3)
    for limits in ((1024, 4, 400), (300, 100, 90), (64, 2, 64)):
        sizes = np.stack([rng.integers(1, 60, 90), np.ones(90, np.int64), rng.integers(0, 40, 90)], axis=1)
        bins, _ = packing.pack_group(sizes, limits)
        assert sorted(sorted(map(tuple, sizes[bins == b].tolist())) for b in range(bins.max() + 1)) == brute_dot(sizes, limits)


def test_packing_conversations(spark, data):
    """Instruction data: only the assistant's share of a conversation bears loss; all three limits hold."""
    told = spark.read.parquet(f"{data}/conversations.parquet").where("text is not null")
    chars = F.length("text")
    share = F.coalesce(F.sum(F.when(F.col("role") == "assistant", chars)), F.lit(0)) / F.greatest(F.sum(chars), F.lit(1))
    examples = told.groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("text"), share.alias("loss"))
    shares = {r.doc_id: r.loss for r in examples.collect()}
    got = packing.pack(examples, segments=3, loss_tokens=400, loss="loss").collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.length, round(r.length * shares[r.doc_id])))
    for b in bins.values():
        assert len(b) == 1 or sum(n for n, _ in b) <= 1024 and len(b) <= 3 and sum(x for _, x in b) <= 400
    assert any(len(b) == 3 for b in bins.values())


def test_tokens_match_tokenizers(spark, data):
    """tiktoken's ids are those of the tokenizers library, on whole documents and on odd strings."""
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, encode = Tokenizer.from_file(path), packing.encoder(path)
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        assert encode(r.text or "") == tok.encode(r.text or "", add_special_tokens=False).ids

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.text(max_size=60))
    def odd(text):
        assert encode(text) == tok.encode(text, add_special_tokens=False).ids

    odd()


def test_pack_group_limits():
    rng = np.random.default_rng(1)
    sizes = np.stack([rng.integers(1, 500, 600), np.ones(600, np.int64), rng.integers(0, 300, 600)], axis=1)
    sizes[0] = (2000, 1, 5)  # larger than a sequence: alone
    limits = (1024, 4, 400)
    bins, offset = packing.pack_group(sizes, limits)
    for b in range(bins.max() + 1):
        mine = sizes[bins == b]
        assert len(mine) and (len(mine) == 1 or (mine.sum(0) <= limits).all())
    bound = max(-(-sizes[1:].sum(0) // np.array(limits)))
    assert bins.max() + 1 <= 1.2 * bound + 1


# 9


def brute_sw(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_smith_waterman():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(1, 25))
        assert decontaminate.smith_waterman(a, b)[0] == brute_sw(a.tolist(), b.tolist())


def test_decontamination(spark, rows):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, 30)) + ".") for i in range(20)] + [(30, None), (31, ""), (32, "two words"), (None, "x"), (0, "another text of item zero for ties")]
    planted = {}
    docs = list(rows)
    for i in range(10):
        w = items[i][1].split()
        for _ in range(i // 2):
            w[rng.randrange(len(w))] = "changed"
        planted[500 + i] = i
        docs.append((500 + i, " ".join(words(rng, 50) + w + words(rng, 50)).upper()))
    docs += [(600, " ".join(items[3][1].split()[:5] + words(rng, 100))), (601, " ".join(items[4][1].split()[:22]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, docs, True), bench).collect()}
    assert {(d, i) for d, i in planted.items()} | {(601, 4)} == got
    clean = decontaminate.decontaminate(frame(spark, docs, True), bench)
    assert {d for d, _ in docs} - {r.doc_id for r in clean.collect()} == {*planted, 601}
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, docs), bench.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8 << 20, 600])
def test_decontamination_brute(spark, monkeypatch, block):
    """Every document against every item: a shared seed and an alignment of half the item's own score; in one block of
    items and in several."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(13)
    items = [(i, " ".join(words(rng, rng.randrange(3, 40)))) for i in range(25)]
    docs = []
    for i in range(120):
        w = words(rng, rng.randrange(5, 60))
        for _ in range(rng.randrange(3)):
            passage = items[rng.randrange(25)][1].split()
            for _ in range(rng.randrange(len(passage))):
                k = rng.randrange(len(passage))
                passage[k : k + 1] = rng.choice([[], ["edit"], [passage[k], "more"]])
                if not passage:
                    break
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (3, docs[3][1]), (None, items[0][1]), (502, items[1][1] + " " + "filler word " * 3000 + items[2][1])]
    split = lambda t: re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (t or "").lower())
    want = []
    for d, t in docs:
        b = split(t)
        for i, x in items:
            a = split(x)
            n = min(4, len(a))
            seeds = {tuple(a[k : k + n]) for k in range(len(a) - n + 1)}
            if seeds & {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} and brute_sw(a, b) >= len(a):
                want.append((d, i, round(brute_sw(a, b) / (2 * len(a)), 6)))
    got = [(r.doc_id, r.item_id, round(r.similarity, 6)) for r in decontaminate.contaminated(frame(spark, docs, True), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert len(want) > 30 and sorted(got, key=repr) == sorted(want, key=repr)


# 10


def test_topk(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # one vector many times
    rows += [(2000, None), (2001, [0.1, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, []), (None, [0.1] * 8), (2100, [1.0, 2.0]), (2200, [3.0, 1.0]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    valid = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            valid[i] = np.floor(1024 * np.array(v)).astype(np.int64)
    want = []
    for q in valid:
        if q % 100 == 0:
            scored = sorted((-int(valid[q] @ v), i) for i, v in valid.items() if i != q and len(v) == len(valid[q]))[:10]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    for part, sample in ((topk_search.PART, topk_search.SAMPLE), (64, 50)):
        got = topk_search.top_k(df, F.col("vec_id") % 100 == 0, part=part, sample=sample, pivots=6).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_query_blocks(monkeypatch):
    monkeypatch.setattr(topk_search, "QUERIES", 10)
    assert topk_search.query_blocks([3, 4, 5, 25, 2, 10]) == ([0, 0, 1, 2, 5, 6], [1, 1, 1, 3, 1, 1])
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = rng.integers(1, 40, 20).tolist()
        first, n = topk_search.query_blocks(counts)
        held = collections.Counter()
        for c, f, k in zip(counts, first, n, strict=True):
            for i in range(k):
                held[f + i] += c / k
        assert max(held.values()) <= 10 and sorted(held) == list(range(len(held)))


def test_topk_blocks_and_large_values(spark, monkeypatch):
    """Many blocks of queries; components whose products pass 2^62 take part; scores that no long holds are an error."""
    monkeypatch.setattr(topk_search, "QUERIES", 7)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 4).tolist()) for i in range(400)] + [(1000, [2.0**41, 0.0, 0.0, 0.0]), (1001, [-(2.0**41), 3.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = []
    for q in (i for i in whole if i % 10 == 0 and i < 1000):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    asked = (F.col("vec_id") % 10 == 0) & (F.col("vec_id") < 1000)
    got = topk_search.top_k(df, asked, k=5, part=50, sample=60, pivots=5).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    for far in (2.0**50, 2.0**95):
        with pytest.raises(Exception, match="doesn't fit|beyond"):
            topk_search.top_k(df.union(spark.createDataFrame([(2000, [far] * 4)], df.schema)), F.col("vec_id") == 1000, k=5).collect()


def test_words_match_python():
    import pyarrow as pa

    texts = ["a b  c\td", "", None, "x", "\x0b\x0c\r\n", "é ß  y", "same same"]
    w = common.Words(pa.array(texts))
    seen = collections.defaultdict(set)
    for a, b, h, k in zip(w.start, w.end, w.hash.tolist(), w.second.tolist(), strict=True):
        seen[bytes(w.data[a:b])].add((h, k))
    assert all(len(v) == 1 for v in seen.values()) and len({k for v in seen.values() for _, k in v}) == len(seen) == len({h for v in seen.values() for h, _ in v})
    assert w.counts.tolist() == [len((t or "").encode().split()) for t in texts]
