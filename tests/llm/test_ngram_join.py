import random

import numpy as np
import pytest
from spotweave.llm import ngram_join as J

DOCS = "doc_id long, text string"


def grams(t, n=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ")
    w = [x for x in w if x]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows):
    ids = {}
    for i, t in rows:
        if i is not None and grams(t):
            ids.setdefault(grams(t), []).append(i)
    reps = {g: min(v) for g, v in ids.items()}
    root = {r: r for r in reps.values()}
    links = dict.fromkeys(root, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    gs = list(reps)
    for a in range(len(gs)):
        for b in range(a):
            both = len(gs[a] & gs[b])
            if 10 * both >= 8 * (len(gs[a]) + len(gs[b]) - both):
                x, y = reps[gs[a]], reps[gs[b]]
                links[x] += 1
                links[y] += 1
                x, y = sorted((find(x), find(y)))
                root[y] = x
    return sorted(((i, find(reps[grams(t)]), reps[grams(t)], len(ids[grams(t)]), links[reps[grams(t)]]) if i is not None and grams(t) else (i, i, i, 1, 0) for i, t in rows), key=str)


def sample(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["é", "Ä"]
    rows = []
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(1, 120))]
        for _ in range(r.randint(1, 30)):
            x = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                x[r.randrange(len(x))] = r.choice(vocab)
            rows.append((len(rows), r.choice([" ", "\n"]).join(x)))
    return [*rows, (900, None), (901, ""), (902, " \t"), (None, rows[0][1]), (903, "One two"), (904, "one  TWO"), (904, "one two"), (905, "x" * 300 + " y")]


@pytest.mark.parametrize("seed,tile,broadcast", [(1, 2048, 2_000_000), (2, 5, 2_000_000), (3, 7, 0)])
def test_equals_brute_force(spark, seed, tile, broadcast):
    rows = sample(seed)
    got = J.similar(spark.createDataFrame(rows, DOCS), tile_rows=tile, broadcast_rows=broadcast).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_one_of_each(spark):
    rows = [(i, t, "x") for i, t in sample(3)]
    got = J.one_of_each(spark.createDataFrame(rows, DOCS + ", root string")).collect()
    want = {i for i, c, *_ in brute([r[:2] for r in rows]) if i == c}
    assert {r.doc_id for r in got} == want


@pytest.mark.parametrize("tile", [2048, 2])
def test_rows_of_one_id_with_different_texts(spark, tile):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, None), (1, ""), (1, b), (1, b), (1, b + " "), (2, a + " x"), (3, b + " y"), (4, b + " z"), (5, "c")]
    got = {(r.doc_id, r.class_id, r.n_links) for r in J.similar(spark.createDataFrame(rows, DOCS), tile_rows=tile).collect()}
    assert got == {(1, 1, 3), (1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 2), (5, 5, 0)}


@pytest.mark.parametrize("tiles", [2, 3, 20])
def test_links_inside_a_tile_count_once_beside_empty_tiles(spark, tiles):
    text = " ".join(f"w{i}" for i in range(400))
    # of 2 tiles, ids 1 and 6 are in the same one, and the other is empty
    rows = [(1, text), (6, text + " x")]
    size = sum(len(t) for _, t in rows)
    got = J.similar(spark.createDataFrame(rows, DOCS), group_bytes=-(-size // tiles)).collect()
    assert sorted(map(tuple, got)) == brute(rows) == [(1, 1, 1, 1, 1), (6, 1, 6, 1, 1)]


def test_pages_of_one_template_are_not_chained(spark):
    """Texts that share a third of their n-grams meet by chance at most, and none is linked."""
    r = random.Random(8)
    shared = [f"menu{k}" for k in range(60)]
    rows = [(i, " ".join([*shared, *(f"w{r.randrange(10**6)}" for _ in range(120))])) for i in range(400)]
    got = J.similar(spark.createDataFrame(rows, DOCS)).collect()
    assert all((x.class_id, x.n_links) == (x.doc_id, 0) for x in got)
    bands, k = J.bands_for(J.THRESHOLD, J.RECALL, J.MAX_HASHES)
    alike = len(grams(rows[0][1]) & grams(rows[1][1])) / len(grams(rows[0][1]) | grams(rows[1][1]))
    assert 400 * 399 / 2 * (1 - (1 - alike**k) ** bands) < 400 * 399 / 2 * 0.02  # what chance makes of it


def test_pairs_are_compared_in_the_first_bucket_that_they_share():
    import pyarrow as pa

    text = [" ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(61)), " ".join(f"w{k}" for k in range(62))]
    sets, at = J.ngram_sets([t.encode() for t in text], 5)
    tag = [int(np.add.reduce(J.mix(sets[at[k] : at[k + 1]] ^ np.uint64(1))).view(np.int64)) for k in range(3)]
    kept = [[7, 0, 9], [7, 8, 9], [0, 8, 9]]  # 7: 0 and 1; 8: 1 and 2; 9: all three, of which 0 and 2 are new
    rows = [(k, tag[k], k, text[k], b, p, kept[k], 0, False) for k in range(3) for p, b in enumerate(kept[k]) if b]
    names = ("copy_id", "digest_a", "same", "text", "band", "at", "kept", "side", "apart")
    got = J._verify(pa.table({c: [r[i] for r in rows] for i, c in enumerate(names)}), 5, 0.8).to_pylist()
    total = {}
    for r in got:
        total[r["copy_id"]] = total.get(r["copy_id"], 0) + r["links"]
    assert total == {0: 2, 1: 2, 2: 2}


def test_recall_on_the_tables(spark):
    """Every pair of different sets with a Jaccard similarity of 0.8 or more, by brute force, over the smallest tables."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, J.similar(docs).collect()), key=str) == brute([tuple(r) for r in docs.collect()])


def test_empty(spark):
    assert J.similar(spark.createDataFrame([], DOCS)).collect() == []


def test_bands_reach_recall():
    b, r = J.bands_for(0.8, 0.9995, 128)
    assert b * r <= 128 and 1 - (1 - 0.8**r) ** b >= 0.9995
