"""Personal data, conversation repair and token alignment against plain Python."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from spotweave.llm import conversation_repair as C
from spotweave.llm import personal_data as P
from spotweave.llm import queries as Q
from spotweave.llm import token_alignment as T

DIR = "/root/testdata/sf0.001"
FORMS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def seeds(text):
    out = []
    for k, form in enumerate(FORMS):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(x - 9 if (x := int(c) * (1 + i % 2)) > 9 else x for i, c in enumerate(reversed(digits)))
            bad = k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and (not 12 <= len(digits) <= 19 or total % 10) or k == 3 and not 9 <= len(digits) <= 15
            if not bad:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_seeds_equal_the_plain_forms():
    r = random.Random(1)
    for _ in range(8000):
        of = r.choice(["0123 .-+()@a_b%", "a@._-b0", "01.2", "0 -+().9", "4532015112830366 -"])
        text = "".join(r.choice(of) for _ in range(r.randint(0, 60)))
        assert P.base(text) == seeds(text)
    for text in ("x" * 500_000, "1" * 500_000, "a@" * 200_000, "+1 (" + "(" * 300_000, "1." * 200_000, " at " * 100_000):
        P.candidates(text, P.base(text))  # linear, or this takes hours


def test_query_finds_the_seeds_of_whole_texts(spark):
    kinds = P.KINDS
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d in docs:
        s = seeds(d.text or "")
        said = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in s)
        want[d.doc_id] = (*(sum(x[1] == k for x in s) for k in range(4)), hashlib.sha256(said.encode()).hexdigest())
    got = Q.op11_personal_data(spark, DIR).collect()
    assert len(got) == len(docs) and {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got} == want
    assert all((r.spans == "") == (sum((r.n_email, r.n_ip, r.n_card, r.n_phone)) + r.n_added == 0) for r in got)


def scored(rows, rounds=P.ROUNDS):
    """Patterns by plain loops."""
    edges = {}
    for text in rows:
        found = P.base(text)
        for s, e, seed, may, value in P.candidates(text, found):
            for c in P.contexts(text, s, e):
                old = edges.get((c, value), (-1, frozenset()))
                edges[c, value] = max(old[0], seed), old[1] | set(may)
    scores = {(v, k): 1.0 for (_, v), (k, _) in edges.items() if k >= 0}
    own = dict(scores)
    for n in range(rounds):
        sums, of = Counter(), Counter(c for c, _ in edges)
        for c, v in edges:
            for k in range(4):
                sums[c, k] += scores.get((v, k), 0)
        found = {ck: s / (of[ck[0]] + 1) for ck, s in sums.items() if s >= P.SUPPORT and s / (of[ck[0]] + 1) >= P.CONFIDENCE}
        if n + 1 < rounds:
            miss = {}
            for (c, v), (seed, may) in edges.items():
                for k in may if seed < 0 else ():
                    if (c, k) in found:
                        miss[v, k] = miss.get((v, k), 1.0) * max(1 - found[c, k], 1e-9)
            scores = {vk: 1 - m for vk, m in miss.items()} | own
    return found


PEOPLE = [f"please call me on +49 (30) 555-{1000 + i} today. mail to user{i}@mail.org thanks, host 10.0.{i}.7 down" for i in range(60)]
UNSEEN = {"please call me on 030 555 7777 today": "phone:18:30", "mail to bob at example dot com thanks": "email:8:30", "the host 10[.]0[.]3[.]9 down": "ip:9:23", "host 11-0-3-9 down": "ip:5:13"}
CLEAN = ["we paid 030 555 7777 for it", "in 2024 we met 12 345 678 people", "bob at example dot com", "", None, "mail to the user at once", "call me on time"]


def test_patterns_discover_unseen_identifiers(spark):
    texts = [*PEOPLE, *UNSEEN, *CLEAN]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {texts[r.doc_id]: r for r in P.digest(P.find(df)).collect()}
    assert all(got[t].spans == s and got[t].n_added == 1 for t, s in UNSEEN.items())
    assert all(got[t].n_added == 0 for t in (*PEOPLE, *CLEAN))
    each = P.scan(df).select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    found = {(r.context, r.kind): round(r.confidence, 9) for r in P.patterns(each).collect()}
    assert found == {k: round(v, 9) for k, v in scored([t or "" for t in texts]).items()} and len(found) > 4
    thousand = df.unionAll(spark.createDataFrame([(1000 + i, CLEAN[0]) for i in range(1000)], df.schema))  # copies say nothing more
    assert {r.doc_id: r.spans for r in P.digest(P.find(thousand)).collect() if r.doc_id < 1000} == {r.doc_id: r.spans for r in got.values()}


NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ROLE = {"u": "user", "a": "assistant"}


def damaged(rows):
    said = lambda v: " " if v is None else str(v)
    for c, t, r, x in rows:
        k, r, x = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20, said(r), said(x)
        if k:
            one = (c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)
            yield from [one] * (1 + (k == 3))


def repaired(rows):
    """By Dijkstra over (row, state), the least cost and then the least audit first."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, r, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]", x)
        faults.append(1 if not w else 2 if (r, x) in seen else 3 if w[-1] not in ".!?" else 0)
        seen.add((r, x))
    turns = [r[1] for r in rows if r[1] is not None]
    first = [r[2][:1] for r in rows]
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, s, text = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(rows) and s in (0, 3):
            break
        for c, to in NEXT[s].items():
            if c in ROLE:
                heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*text, f"{ROLE[c]}:")))
        if i < len(rows):
            _, _, r, x = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, s, text))
            more = 3 * (faults[i] == 3)
            if faults[i] not in (1, 2):
                if r[:1] in NEXT[s]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[s][r[:1]], (*text, f"{r}:{x}")))
                for c, to in NEXT[s].items():
                    if c in ROLE:
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, to, (*text, f"{ROLE[c]}:{x}")))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(k) for k in (1, 2, 3)), sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()


def all_repaired(rows):
    by = {r[0]: [] for r in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    return sorted(((k, *(repaired(v) if v else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))) for k, v in by.items()), key=str)


def test_repair_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in Q.op12_conversation_repair(spark, DIR).collect()), key=str) == all_repaired(rows)


@pytest.mark.parametrize("chunk,fan", [(4, 2), (512, 256)])
def test_chunks_meet(spark, chunk, fan):
    """One conversation of many chunks among short ones; nulls everywhere; passes are needed where chunks are short."""
    r = random.Random(7)
    roles, texts = ["user", "assistant", "system", "tool", None, "user", "assistant", ""], ["Hi.", "ok", "", "x!", None, " \n", "a. "]
    rows = [(c, r.choice([None, t, t, t, t + r.randint(0, 3)]), r.choice(roles), r.choice([*texts, f"Well, {r.randint(0, 30)}?", f"b {t}"])) for c in (None, 1, 2, 4) for t in range(300 if c == 4 else 25)]
    rows += [(9, 0, "user", "q" * 200_000), (9, 1, "assistant", "A."), (10, 3, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert sorted((tuple(x) for x in C.repair(C.damage(df), df, chunk, fan).collect()), key=str) == all_repaired(rows)
    _, passes = C.solved(C.chunks(C.placed(C.damage(df)), chunk))
    assert (passes > 0) == (chunk == 4)


def test_repair_sql(spark):
    r = random.Random(9)
    rows = [(c, r.choice([None, t, t + r.randint(0, 3)]), r.choice(["user", "assistant", "system", "tool", None, ""]), r.choice(["Hi.", "", None, " \n", "a. ", f"b {t}", f"Well, {t}?"])) for c in (None, *range(12)) for t in range(14)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").toArrow()
    assert sorted(duckdb.connect().register("conversations", conversations).sql(C.oracle()).fetchall(), key=str) == all_repaired(rows)


def aligned(rows):
    """Whole texts encoded at once, links by two pointers."""
    al = T.Aligner(f"{T.FOLDER}/{T.A_FILE}", f"{T.FOLDER}/{T.B_FILE}")
    held, counts = [], Counter()
    for doc, text in rows:
        raw = f" {text}".encode()
        ids = (al.a.encode(f" {text}", add_special_tokens=False).ids, al.b.encode(text)) if text else ((), ())
        sides = []
        for own, table in zip(ids, (al.a_bytes, al.b_bytes), strict=True):
            at, spans = 0, []
            for i in own:
                spans.append((at, at + len(table[i]), i))
                at += len(table[i])
            sides.append(spans)
        if not text or any(b"".join(t[i] for i in own) != raw for own, t in zip(ids, (al.a_bytes, al.b_bytes), strict=True)):
            held.append((doc, None))
            continue
        a, b = sides
        links, low = [], 0
        for s, e, x in a:
            while b[low][1] <= s:
                low += 1
            k = low
            while k < len(b) and b[k][0] < e:
                links.append((x, b[k][2]))
                k += 1
        groups, ends = [], sorted({x[1] for x in a} & {x[1] for x in b})
        for lo, hi in zip([0, *ends], ends):
            groups.append("|".join(",".join(str(i) for s, e, i in side if lo <= s and e <= hi) for side in sides)) if len(a) < 3000 else None
        counts.update(set(links))
        held.append((doc, (len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if len(a) < 3000 else None)))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [(d, *(zero if h is None else (h[0], h[1], h[2], len(h[3]), sum(counts[x] == most[x[0]] for x in h[3]), sum(counts[x] for x in h[3]), h[4]))) for d, h in held]


def same(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    return len(got) == len(want) and all(g[:-1] == w[:-1] and w[-1] in (None, g[-1]) for g, w in zip(got, want, strict=True))


def test_alignment_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert same([tuple(r) for r in Q.op13_token_alignment(spark, DIR).collect()], aligned(rows))


def test_alignment_of_odd_texts(spark):
    r = random.Random(3)
    letters = "ab zé \n\t  ß日本😀<|endoftext|></s>▁\x00\xa0 '’s0123.!\r\x1c\x85"
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " "), (203, "\n"), (204, "<|endoftext|> <s> <0x41>"), (None, "a word"), (205, "a word"), (205, "a word"), (206, "x" * 5000), (207, "naïve cót 日本語 text " * 300), (208, "a\n\nb\n c  d \n"), (209, " lead and trail ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = aligned(rows)
    for most in (T.MAX_PAIRS, 0):
        assert same([tuple(x) for x in T.alignment(df, max_pairs=most).collect()], want)
    few = T.Aligner(f"{T.FOLDER}/{T.A_FILE}", f"{T.FOLDER}/{T.B_FILE}", max_units=3)  # a table that begins anew at every turn
    for _, text in rows:
        if text:
            units = few.cut(text)
            few.learn([units])
            found = few.text(units)
            assert found[1] == "" or found[0] == next([*w[1:5]] for w, (_, t) in zip(want, rows, strict=True) if t == text)
