"""The pipeline against brute-force versions of its stages, over the smallest tables."""

import zlib

import corpus_pipeline as P
from spotweave.llm import decontamination as D
from spotweave.llm import language_id as L

from .test_ngram_join import brute as near

DIR = "/root/testdata/sf0.001"


def cut(rows, w=50):
    """Text of each document without bytes in strings of w that also start in an earlier one."""
    first = {}
    for i, t in sorted(rows):
        b = t.encode()
        for k in range(len(b) - w + 1):
            first.setdefault(b[k : k + w], i)
    out = {}
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - w + 1):
            if first[b[k : k + w]] < i:
                gone[k : k + w] = b"\1" * w
        out[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    judge = L.Judge(L.learn(docs.where(docs.doc_id.isin([i for i in rows if zlib.crc32(str(i).encode()) % 3 != 1]))))
    text = {i: r.text for i, r in rows.items() if not judge(r.text)[2]}
    wants = [dict(text)]
    text = {i: text[i] for i, group, *_ in near(list(text.items())) if i == group}
    wants.append(dict(text))
    text = cut(list(text.items()))
    wants.append(dict(text))
    text = {i: t for i, t in text.items() if not D.brute(t, items)[-1]}
    wants.append(dict(text))
    df = docs
    for k, ((_, stage), want) in enumerate(zip(P.STAGES, wants, strict=False)):
        stage(spark, df, DIR).write.parquet(str(tmp_path / str(k)))
        df = spark.read.parquet(str(tmp_path / str(k)))
        assert {f.name: f.dataType for f in df.schema} == {f.name: f.dataType for f in docs.schema}
        assert {r.doc_id: r.text for r in df.collect()} == want
    got = P.STAGES[-1][1](spark, df, DIR).collect()
    assert {r.doc_id: r["size"] for r in got} == {i: len(t.split()) for i, t in text.items()}
    assert sorted(map(tuple, P.run(spark, DIR).collect())) == sorted(map(tuple, got))


def test_run_writes_each_stage(spark, monkeypatch):
    files = []

    def stage(spark, docs, sf_dir):
        files.append(docs.inputFiles())
        return docs.where("doc_id % 7 > 0")

    monkeypatch.setattr(P, "STAGES", [(str(k), stage) for k in range(3)])
    got = P.run(spark, DIR)
    files.append(got.inputFiles())
    assert DIR in files[0][0] and all(f and not any(DIR in x for x in f) for f in files[1:])
    assert set(files[1]).isdisjoint(files[2]) and files[2] == files[3]
    assert sorted(got.collect()) == sorted(spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id % 7 > 0").collect())
