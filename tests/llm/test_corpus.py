"""The whole pipeline on documents whose fate is known from their making, and its edge cases."""

import collections
import random
import zlib

import corpus_pipeline
import numpy as np
from itemflow.llm.common import table


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=5):
    """Documents of every kind that a stage decides on: doc_id, text and the text that should come out (None: gone)."""
    rng = random.Random(seed)
    draw = lambda n: [rng.choice("river stone cloud maple sofa train lamp quiet amber delta".split()) + str(rng.randrange(700)) for _ in range(n)]
    items = [(i, " ".join(draw(25))) for i in range(6)]
    rows = []
    for i in range(240):
        w = draw(40)
        if i % 6 == 0:
            w[7:7] = ["grumbok"]
        rows.append((i, " ".join(w), None if i % 6 == 0 else " ".join(w)))
    for i in range(20):  # 0.85, 0.81 and 0.75 of the shingles in common
        w, n = draw(100), (8, 10, 14)[i % 3]
        rows += [(300 + 2 * i, " ".join(w), " ".join(w)), (301 + 2 * i, t := " ".join(w[:-n] + draw(n)), t if n == 14 else None)]
    same = " ".join(draw(60))
    rows += [(400 + i, same, same if i == 0 else None) for i in range(30)]
    for i in range(6):
        rows.append((500 + i, " ".join(draw(20)) + " " + items[i][1] + " " + " ".join(draw(20)), None))
    for i in range(8):
        a, b = " ".join(draw(12)), " ".join(draw(12))
        rows.append((600 + i, f"{a} write to some.one{i}@mail.example.org or 10.0.{i}.7 {b}", f"{a} write to [EMAIL] or [IP] {b}"))
    long = " ".join(draw(9000))
    rows += [(700, long, long), (701, None, None), (702, "", ""), (703, "  ", "  "), (704, "two words", "two words")]
    return rows, items


def store(spark, path, docs, items, labels):
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_whole_pipeline(spark, tmp_path):
    """What comes out, against what each document should become, told by its making."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, items = corpus()
    labels = [(d, 1, int("grumbok" in t)) for d, t, _ in rows[:240]]
    root = store(spark, tmp_path, [(d, t, "en", "s", len(t) if t is not None else None) for d, t, _ in rows], items, labels)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = collections.defaultdict(dict)
    for r in corpus_pipeline.run(spark, root).collect():
        assert r.start not in pieces[r.doc_id]
        pieces[r.doc_id][r.start] = (r.length, r.ids_crc32)
    want = {d: out for d, t, out in rows if out is not None or t is None}
    assert set(pieces) == set(want)
    for d, text in want.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for start, (n, crc) in sorted(pieces[d].items()):
            assert start == at and crc == zlib.crc32(ids[start : start + n].tobytes())
            at += n
        assert at == len(ids)


def test_pipeline_edges(spark, tmp_path):
    """Nulls in every column, repeated rows, columns that clash with those inside the operators, empty tables."""
    rows, items = corpus(6)
    some = [(d, t, None, None, None) for d, t, _ in rows[:60]] + [(None, None, None, None, None), (None, "a text without an id", None, None, None)] + [(9000, "a row that repeats itself", "en", "s", 1)] * 3
    root = store(spark, tmp_path / "a", some, [*items, (None, None), (None, "x")], [(d, None, None) for d, _, _ in rows[:20]] + [(None, None, 1)])
    got = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, root).where("start = 0").collect())
    assert got[None] == 2 and got[9000] == 3  # rows of one id are one document
    docs = table(spark, root, "documents")
    odd = docs.selectExpr("*", "1 AS key", "2 AS band", "3 AS tkey", "4 AS spans", "5 AS rep", "6 AS label", "7 AS start", "8 AS anchor", "9 AS node", "10 AS root", "11 AS added", "12 AS predicted")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, root)
        assert kept.columns == odd.columns, name
        assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in stage(spark, docs, root).collect())
    none = store(spark, tmp_path / "b", [], [], [])
    assert corpus_pipeline.run(spark, none).count() == 0
    unlabelled = store(spark, tmp_path / "c", some, [], [])
    assert corpus_pipeline.run(spark, unlabelled).where("start = 0").count() > 50
