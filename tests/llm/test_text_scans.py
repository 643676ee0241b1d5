import random
import weakref
import zlib

import pytest
import zstandard

from spotweave.llm import decontamination as D
from spotweave.llm import language_id as L
from spotweave.llm import mixing as M

DOCS = "doc_id long, text string, item_ids string"


def test_decontamination_equals_brute_force(spark):
    r = random.Random(5)
    word = lambda: r.choice(["a", "B", "c1", "é", "Z"])
    text = lambda n: "".join(word() + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(r.randint(0, 14))) for i in range(20)] + [(30, None), (None, "a b c"), (31, "one two"), (32, "one two"), (33, "!!")]
    docs = [(i, text(r.randint(0, 200)), "x") for i in range(30)] + [(40, None, "x"), (41, "", "x"), (42, "ONE, two one two", "x"), (42, "ONE, two one two", "x")]
    docs += [(50 + i, text(30) + " " + (items[i][1] or "") + " " + text(30), "x") for i in range(20)]
    b = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, DOCS)
    keep = [x for x in items if x[0] is not None and x[1] is not None]
    want = sorted((i, *D.brute(t, keep)) for i, t, _ in docs)
    for limit in (D.LIMIT, 7):
        assert sorted(map(tuple, D.digest(D.contamination(df, b, limit=limit)).collect())) == want
        clean = D.without_hits(df, b, limit=limit)
        assert clean.schema == df.schema
        assert sorted(x.doc_id for x in clean.collect()) == sorted(w[0] for w in want if not w[-1])
    got = D.contamination(df.where("doc_id = 42"), b).first()
    assert [("ONE, two one two"[s.start : s.end]) for s in got.spans] == ["ONE, two one two"]
    assert D.contamination(df.limit(0), b).collect() == []
    with pytest.raises(ValueError, match="max_windows"):
        D.contamination(df, b, max_windows=5)
    assert not D.contamination(df, b.limit(0)).where("n_hit > 0").count()


def test_one_automaton_at_a_time():
    """A benchmark of forty times the limit: all its items are found, and memory stays that of one automaton."""
    import tracemalloc

    r = random.Random(2)
    items = [(str(i), " ".join(f"w{r.randrange(10**5)}" for _ in range(60))) for i in range(800)]
    parts, made, live = [items[k : k + 20] for k in range(0, 800, 20)], [], []
    build = D.automaton

    def counted(few, window):
        made.append(len(few))
        live.append(sum(1 for x in alive if x() is not None))
        machine = Held(build(few, window))
        alive.append(weakref.ref(machine))
        return machine

    class Held:
        def __init__(self, machine):
            self.iter = machine.iter

    alive = []
    D.automaton = counted
    try:
        tracemalloc.start()
        found = D.Scanner(parts, 10)([t for _, t in items] + ["", None])
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
        D.automaton = build
    assert [f[2] for f in found] == [{i} for i, _ in items] + [set(), set()]
    assert len(made) == 40 and max(live) <= 1


def test_language_id(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = df.select("doc_id", "text", "lang").collect()
    held = {x.doc_id: x for x in rows if zlib.crc32(str(x.doc_id).encode()) % 3 == 1}
    content = L.learn(spark.createDataFrame([x for x in rows if x.doc_id not in held], df.select("doc_id", "text", "lang").schema))
    got = L.identify(df, content).collect()
    assert len(got) == len(rows)
    right = [x.lang_pred == held[x.doc_id].lang for x in got if x.doc_id in held]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= x.score <= 1 for x in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (None, "the")], "doc_id long, text string")
    assert [x.lang_pred for x in L.identify(odd, content).collect()][:3] == ["und"] * 3
    assert L.identify(odd, {}).where("lang_pred <> 'und'").count() == 0
    assert L.identified(df, content).schema == df.schema
    assert L.identified(df, content).count() > 0.98 * len(rows)
    assert L.learn(df.limit(0)) == {}


def test_language_id_equals_a_plain_loop(spark):
    """Sizes by zstandard alone, one text, language and piece after another."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    content = L.learn(df.where("doc_id % 3 = 0"))
    odd = [(10**6 + k, t, None, None, 0) for k, t in enumerate([None, "", "½ ² Ⅷ ①", "12 34", "é", "日本", "the ½", "A" * 70_000])]
    docs = df.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars int")).collect()
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), content).collect()}
    packers = {}
    for lang, raw in content.items():
        p = zstandard.ZstdCompressionParameters.from_level(L.LEVEL, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        packers[lang] = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p)
    for r in docs:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        plain = "".join(c if c.isalpha() or c.isalnum() and not c.isdecimal() else " " for c in f" {r.text.lower()} ")
        raw = L.letters(r.text)
        assert raw.decode().split() == plain.split()
        sizes = sorted((sum(len(p.compress(raw[k : k + L.PIECE])) for k in range(0, len(raw), L.PIECE)), lang) for lang, p in packers.items())
        assert got[r.doc_id].lang_pred == sizes[0][1] and abs(got[r.doc_id].score - (sizes[1][0] - sizes[0][0]) / sizes[1][0]) < 1e-12


def test_language_of_texts_of_any_length(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("doc_id", "text", "lang").collect()
    kinds = "doc_id long, text string, lang string"
    held = lambda x: zlib.crc32(str(x.doc_id).encode()) % 3 == 1
    content = L.learn(spark.createDataFrame([x for x in rows if not held(x)], kinds))
    long = []
    for k, lang in enumerate(sorted(content)):
        # words in random order: a text of many megabytes that isn't its own dictionary
        words = " ".join(x.text for x in rows if held(x) and x.lang == lang and x.text).split()
        r = random.Random(k)
        long += [(10 * k + j, " ".join(r.choices(words, k=n)), lang) for j, n in enumerate((6_000, 60_000, 700_000))]
    assert max(len(t) for _, t, _ in long) > 3_000_000
    df = spark.createDataFrame(long, kinds)
    got = {x.doc_id: x for x in L.identify(df, content).collect()}
    assert all(got[i].lang_pred == lang and not got[i].rejected for i, _, lang in long)
    for i in range(0, len(long) // 3 * 10, 10):
        assert got[i + 2].score > 0.5 * got[i].score
    assert L.identified(df, content).count() == len(long)


def fill(sizes, weights, total, most):
    """Water-filling by repeated sharing, as stated."""
    full, left = {}, dict(sizes)
    while True:
        room = total * sum(sizes.values()) - sum(full.values())
        share = {s: room * weights[s] / sum(weights[x] for x in left) for s in left}
        over = [s for s in left if share[s] > most * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = most * sizes[s]
            del left[s]


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", "b", "b", "c", "Z", None]), r.choice([None, "", "x " * r.randint(0, 50)]), 1) for i in range(400)] + [(1007, "only", "y y y", 1)] * 3 + [(1008, "none", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = M.mix_sources(df, bins=4).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, M.mix_sources(df.repartition(3), bins=64).collect()), key=str)
    assert all(0 <= x.taken <= 2 * x.size for x in got)
    names = sorted({x[1] for x in rows if x[1]}) + [None]
    sizes = {s: sum(len((t or "").split()) for _, z, t, _ in rows if z == s) for s in names}
    want = fill({s: v for s, v in sizes.items()}, dict(zip(names, [5, 2, 1] * 9)), 1.5, 2)
    of = {i: s for i, s, *_ in rows}
    for s in names:
        mine = [x for x in got if of[x.doc_id] == s]
        assert all(abs(x.target - want[s]) < 1e-5 and x.source_size == sizes[s] for x in mine)
        assert sum(x.taken for x in mine) == int(want[s] + 1e-9)
    assert M.mix_sources(df.limit(0)).collect() == []
