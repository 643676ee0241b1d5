import hashlib
import random
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard
from spotweave.llm import suffix_dedup as S
from spotweave.llm.common import use_shared_checkpoints

DOCS = "doc_id long, text string"


def brute(rows, w=50):
    first = {}
    big = S.NO_ID
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - w + 1):
            first[b[k : k + w]] = min(first.get(b[k : k + w], big), big if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - w + 1):
            if first[b[k : k + w]] < (big if i is None else i):
                gone[k : k + w] = b"\1" * w
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def sample(seed, n=60):
    r = random.Random(seed)
    syll = ["the", "on", "er", "é", "an ", " ", "re", "of ", "\n", "日本"]
    passages = ["".join(r.choice(syll) for _ in range(r.randint(10, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        t = "".join("".join(r.choice(syll) for _ in range(r.randint(0, 40))) + r.choice(passages + [""]) for _ in range(r.randint(0, 6)))
        rows.append((i * 3 % n, t))
    rows += [(None, rows[3][1]), (7, None), (5, rows[4][1]), (5, rows[4][1]), (n + 5, "a" * 400), (n + 6, "a" * 300), (n + 7, "")]
    near = list(passages[0] * 5)
    for i in range(40):
        x = list(near)
        for _ in range(4):
            x[r.randrange(len(x))] = r.choice("xyz")
        rows.append((n + 10 + i, "".join(x)))
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 32), (2, 2), (3, 1)])
def test_equals_brute_force(spark, seed, hot):
    rows = sample(seed)
    got = S.covered(spark.createDataFrame(rows, DOCS), hot_blocks=hot).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_hot_windows_in_many_blocks(spark):
    """More blocks than an anchor may be in before its windows are dealt out singly, and met by groups of blocks first."""
    r = random.Random(9)
    common = "".join(r.choice("abcdef ") for _ in range(200))
    rows = [(i if i % 9 else None, "".join(r.choice("ghij ") for _ in range(r.randint(0, 90))) + common[r.randint(0, 60) : r.randint(100, 200)] * r.choice([1, 1, 2])) for i in range(150)] + [(4, common), (4, common), (4, "x" + common)]
    df = spark.createDataFrame(rows, DOCS)
    total = sum(len(t) for _, t in rows)
    got = S.covered(df, block_bytes=total // 70, hot_blocks=5).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("seed,hot_runs", [(1, 0), (5, 3)])
def test_many_blocks_leave_nothing_but_exchanges(spark, seed, hot_runs):
    """Beyond hot_blocks blocks the rows are as ever, and no step writes its rows beside its exchange, or makes them twice."""
    rows = sample(seed) + [(1000 + i, t) for i, t in sample(seed) if i is not None] + [(None, sample(seed)[6][1])] * 2
    before = set(checkpoint_files(spark))
    got = S.covered(spark.createDataFrame(rows, DOCS), block_bytes=sum(len(t or "") for _, t in rows) // 60, hot_blocks=2, hot_runs=hot_runs)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert set(checkpoint_files(spark)) == before
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FlatMapCoGroupsInArrow") == 2 and "RDDScan" not in final.replace("Scan ExistingRDD", "")


def checkpoint_files(spark):
    """The files of checkpoints."""
    use_shared_checkpoints(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    return [p for p in folder.rglob("*") if p.is_file()]


def sent_bytes(rows, blocks=8, buckets=48, hot_blocks=2, hot_runs=1 << 14):
    """The steps up to the runs, by hand: their bytes, and the groups of those that are dealt by single windows."""
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "_block": pa.array([k % blocks for k in range(len(rows))], pa.int32())})
    docs = pa.Table.from_batches(S.deal([batch]))
    each = [docs.filter(pc.equal(docs["_block"], b)) for b in range(blocks)]
    asked = pa.concat_tables([S.send_anchors(d, buckets, 1, True, 50, 24) for d in each])
    flags = pa.concat_tables([S.flag_anchors(asked.filter(pc.equal(asked["bucket"], b)), 1, hot_blocks, hot_runs) for b in range(buckets) if b in set(asked["bucket"].to_pylist())])
    runs = pa.concat_tables([S.send_runs(d, flags.filter(pc.equal(flags["block"], b)), buckets, 1, 3, 50, 24) for b, d in enumerate(each)])
    return sum(len(zstandard.ZstdDecompressor().decompress(x)) for x in runs["packed"].to_pylist() if x), {g for g in runs["grp"].to_pylist() if g is not None}


def test_copies_of_a_text_are_not_sent():
    """Runs travel once for a text and its copies, in whatever blocks they are; before, once for each block that had one."""
    r = random.Random(3)
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(r.randint(60, 400)))) for i in range(40)]
    copied = lambda n: r.sample(some := [(i + 100 * k, t) for k in range(n) for i, t in rows], len(some))
    assert 0 < sent_bytes(copied(6), buckets=4)[0] < sent_bytes(copied(2), buckets=4)[0] * 1.5


def test_an_anchor_of_few_runs_is_not_split():
    """A passage that every block has is few distinct runs, however many blocks: it isn't sent as single windows."""
    r = random.Random(4)
    passage = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = [(i, "".join(r.choice("ijkl ") for _ in range(90)) + passage + str(i)) for i in range(8)]
    few, groups = sent_bytes(rows)
    single, split = sent_bytes(rows, hot_runs=0)
    assert not groups and split and few * 4 < single


def test_runs_of_one_hash_are_compared(monkeypatch):
    """With a hash of two values, runs are still told apart by their bytes."""
    import numpy as np

    r = np.random.default_rng(5)
    text = [r.integers(97, 99, n).astype(np.uint8).tobytes() for n in (50, 51, 50, 53)]
    runs = [text[k] for k in r.integers(0, 4, 60)]
    data = np.frombuffer(b"".join(runs) + bytes(64), np.uint8)
    length = np.array([len(x) for x in runs])
    monkeypatch.setattr(S, "run_hash", lambda data, start, count, window: (np.arange(len(start)) % 1).astype(np.uint64))
    group = S.equal_runs(data, np.cumsum(length) - length, length - 49, 50)
    assert [[group[a] == group[b] for b in range(60)] for a in range(60)] == [[x == y for y in runs] for x in runs]


def cut(rows, w=50):
    """Text of each row without covered bytes; characters that lose a part of theirs go whole."""
    first, big = {}, S.NO_ID
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - w + 1):
            first[b[k : k + w]] = min(first.get(b[k : k + w], big), big if i is None else i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - w + 1):
            if first[b[k : k + w]] < (big if i is None else i):
                gone[k : k + w] = b"\1" * w
        yield i, t and bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")


def test_rewrite_keeps_columns_and_rows(spark):
    rows = [(i, t, "x") for i, t in sample(4, 20)]
    df = spark.createDataFrame(rows, DOCS + ", n_bytes string")
    got = S.without_repeats(df)
    assert got.schema == df.schema
    got = got.collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(cut([(i, t) for i, t, _ in rows]), key=str)


def test_empty_table(spark):
    assert S.covered(spark.createDataFrame([], DOCS)).collect() == []


def test_bucket_pointers_sort_by_prefix():
    import numpy as np

    r = np.random.default_rng(1)
    data = np.concatenate([r.integers(97, 99, 3000).astype(np.uint8), np.zeros(64, np.uint8)])
    starts = np.arange(0, 2900)
    order, cut = S.bucket_pointers(data, starts, 50)
    raw = data.tobytes()
    got = [raw[s : s + 50] for s in starts[order]]
    assert got == sorted(got)
    assert len(cut) == len(set(got))
