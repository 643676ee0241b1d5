import math
import random
import re
import unicodedata
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F
from spotweave.llm import quality_rules as Q

DOCS = "doc_id long, text string, lang string, m string"


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    cover = {j for i, g in enumerate(tri) if c[g] > 1 for j in (i, i + 1, i + 2)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", "".join(w))), len(lines) - len(set(lines)), len(cover), n < 50 or 100 * len(cover) > 50 * n


def test_counts_equal_brute_force(spark):
    r = random.Random(2)
    piece = lambda: r.choice(["a", "b", "é#", "A|", "\n", "\t", "\x0b", " x", "  "])
    rows = [(i, "".join(piece() + r.choice([" ", ""]) for _ in range(r.randint(0, 150))), r.choice(["x", None]), "") for i in range(60)]
    rows += [(100, None, "x", ""), (101, "", None, ""), (102, "a b c " * 5000, "x", ""), (102, "a b c " * 5000, "x", "")]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.judge(spark.createDataFrame(rows, DOCS), labels).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((x.doc_id, *(x[c] for c in cols), x.kept) for x in got) == sorted((i, *(b := brute(t)), not b[-1]) for i, t, *_ in rows)
    assert Q.judge(spark.createDataFrame([], DOCS), labels).collect() == []


def test_binomial(spark):
    cases = [(0, 10, 0.01), (3, 500, 0.01), (2, 1000, 0.05), (40, 1000, 0.05), (0, 0, 0.1), (9, 20, 0.3)]
    for k, n, a in cases:
        want = sum(math.comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1)) if k <= n * a else 1
        got = spark.range(1).select(Q.binomial_at_most(F.lit(k).cast("long"), F.lit(n).cast("long"), a)).first()[0]
        assert abs(got - want) < 1e-9


def test_rules_catch_bad_and_spare_good(spark):
    r = random.Random(3)
    words = [f"word{i}" for i in range(500)]
    text = lambda junk: " ".join(r.choice(words) + ("$$$" if junk else "") for _ in range(80))
    rows = [(i, text(i % 4 == 0), "aa" if i % 10 else None, "") for i in range(4000)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 3000)] + [(1, None), (99999, 0)], "doc_id long, quality int")
    got = {x.doc_id: x for x in Q.judge(df, labels).collect()}
    assert all(got[i].kept == (i % 4 > 0) and got[i].certified for i, *_ in rows)
    few = Q.judge(df, labels.where("doc_id < 60")).collect()  # too few for any cutoff
    assert all(x.kept and not x.certified for x in few)


def plain_kept(rows, labels, alpha=Q.ALPHA, delta=Q.DELTA):
    """Kept and certified of rows (doc_id, text, lang): depths, exact binomial tails and the choice of steps in plain Python."""
    depth, failed = {}, {}
    for i, t, _ in rows:
        t = t or ""
        n, chars, symbols, dup, repeat, failed[i] = brute(t)
        solid = "".join(re.findall(r"[^\x20\x09-\x0D]+", t))
        lines = len([x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        capitals, marks = sum(unicodedata.category(c) == "Lu" for c in solid), sum(c in "!?.,;:" for c in solid)
        m = [symbols / max(chars, 1), dup / max(lines, 1), repeat / max(n, 1), capitals / max(chars, 1), marks / max(n, 1)]
        depth[i] = min(next((s for s, c in enumerate(cuts, 1) if v > c), len(cuts) + 1) for v, cuts in zip(m, Q.STEPS.values(), strict=True))
    lang = {i: x for i, _, x in rows}
    held = {}
    for i, q in labels:
        if q is not None and i in lang:
            held[i] = max(q, held.get(i, 0))
    chosen = {}
    for stratum in {lang[i] for i in held}:
        mine = [(depth[i], q) for i, q in held.items() if lang[i] == stratum]
        n, options = sum(q for _, q in mine), []
        for s in range(1, 13):
            k, bad = sum(q and d <= s for d, q in mine), sum(not q and d <= s for d, q in mine)
            tail = sum(Fraction(math.comb(n, j)) * Fraction(alpha) ** j * (1 - Fraction(alpha)) ** (n - j) for j in range(k + 1)) if k <= n * alpha else 1
            if tail <= delta / len({lang[i] for i in held}):
                options.append((-bad, s))
        if options:
            bad, s = min(options)
            chosen[stratum] = s if bad else 0
    return {i: (not failed[i] and not depth[i] <= chosen.get(lang[i], 0), lang[i] in chosen) for i in lang}


def test_kept_equals_plain_python(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    want = plain_kept([tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    got = {r.doc_id: (r.kept, r.certified) for r in Q.judge(docs, labels).collect()}
    assert got == want
    assert {x for _, x in want.values()} == {True, False}
