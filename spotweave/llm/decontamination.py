"""Benchmark decontamination: one Aho-Corasick automaton over the normalised texts of a benchmark.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of characters beyond ASCII. A pattern is a window of
`window` consecutive words of an item; an item of fewer words is one pattern. Each text is normalised and scanned
once, and hits are mapped back to the original text. Documents never move: the automaton goes to them.

The benchmark's size is bounded, and checked: its windows are counted (a grouped sum), and more than `max_windows` (4 million,
some 40 MB of text) are an error. Its items are collected and broadcast in lists of about `limit` windows, whose automaton
takes some 150 MB. A task makes the automaton of a single list once. Of several lists it makes and frees one after
another for each batch of rows, so it holds one automaton, however many lists there are.

Defined cases: texts of any length are scanned whole, a row at a time; null or empty texts have no words; items with a null id or no words match nothing; equal items all
count; repeated rows each get their result; extra columns are ignored by `contamination`, kept by `without_hits`;
columns named like a result column don't clash, as only the id and the text are read; an empty table gives an empty
result, an empty benchmark no hits.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
LIMIT, MAX_WINDOWS = 40_000, 4_000_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same before A-Z are lower-cased.
_WORD_AS_IS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _normal_table() -> bytes:
    """Byte to byte: A-Z to a-z, other separators to a space; bytes beyond ASCII stay."""
    return bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal_words(text: str | None, table: bytes) -> list[bytes]:
    return (text or "").encode().translate(table).split()


def automaton(items: list[tuple[object, str]], window: int):
    """The automaton over the items' windows; a pattern's value is its number of words and the places of its items."""
    table, patterns = _normal_table(), {}
    for k, (_, text) in enumerate(items):
        words = normal_words(text, table)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            patterns.setdefault(b" " + b" ".join(part) + b" ", (len(part), set()))[1].add(k)
    made = ahocorasick.Automaton()
    for p, v in patterns.items():
        made.add_word(p.decode("latin-1"), v)
    if patterns:
        made.make_automaton()
    return made if patterns else None


def scan(plain: bytes, machine) -> tuple[list[tuple[int, int]], set]:
    """Hits in a normalised text with blanks around its words: (end, words) of each, and the items that hit."""
    found, places = set(), []
    for end, (count, items) in machine.iter(plain.decode("latin-1")):
        places.append((end, count))
        found |= items
    return places, found


def hit_words(plain: bytes, places: list[tuple[int, int]]) -> np.ndarray:
    """Which words of a normalised text are in a hit."""
    spaces = np.cumsum(np.frombuffer(plain, np.uint8) == 32)
    edge = np.zeros(int(spaces[-1]), np.int32)
    end, count = np.array(places).T
    last = spaces[end] - 1
    np.add.at(edge, last - count, 1)
    np.add.at(edge, last, -1)
    return np.cumsum(edge)[:-1] > 0


def spans_of(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as (start, end) in characters of the original text."""
    out, last = [], None
    for k, m in enumerate(_WORD_AS_IS.finditer(text)):
        if hit[k]:
            if last == k - 1 and out:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
            last = k
    return out


def windows_of(text, window: int):
    """How many patterns an item has."""
    words = F.regexp_count(text, F.lit(_WORD_AS_IS.pattern))
    return F.when(words > 0, F.greatest(words - window + 1, F.lit(1))).otherwise(0)


def lists(items: DataFrame, window: int = WINDOW, limit: int = LIMIT, max_windows: int = MAX_WINDOWS) -> list[list[tuple[str, str]]]:
    """The items (id, text) in lists of about `limit` windows."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text", windows_of(F.col("text"), window).alias("n")).where("item_id is not null and n > 0")
    total = int(items.agg(F.sum("n")).first()[0] or 0)
    if total > max_windows:
        raise ValueError(f"the benchmark has {total} windows, more than max_windows ({max_windows})")
    out, room = [], 0
    for item, text, n in items.collect():  # max_windows windows at most
        if room < n or not out:
            out.append([])
            room = limit
        out[-1].append((item, text))
        room -= n
    return out


class Scanner:
    """Scans batches of texts with one automaton after another."""

    def __init__(self, items: list[list[tuple[str, str]]], window: int):
        self.items, self.window, self.table = items, window, _normal_table()
        self.only = automaton(items[0], window) if len(items) == 1 else None

    def __call__(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, set[str]]]:
        """For each text: its number of words, which of them are hit (empty if none), and the ids of the items that hit."""
        plain = []
        for t in texts:
            words = normal_words(t, self.table)
            plain.append((len(words), b" " + b" ".join(words) + b" " if words else b""))
        places, ids = [[] for _ in plain], [set() for _ in plain]
        for few in self.items:
            machine = self.only or automaton(few, self.window)
            for i, (n, p) in enumerate(plain):
                if n:
                    found, hit = scan(p, machine)
                    places[i] += found
                    ids[i].update(few[k][0] for k in hit)
            del machine
        return [(n, hit_words(p, places[i]) if places[i] else np.zeros(0, bool), ids[i]) for i, (n, p) in enumerate(plain)]


RESULT = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = LIMIT, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (sorted as strings), spans of hit words in characters."""
    shared = docs.sparkSession.sparkContext.broadcast(lists(items, window, limit, max_windows))

    def run(batches):
        scanner = Scanner(shared.value, window)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            text = batch.column("text").to_pylist()
            found = scanner(text)
            spans = [[{"start": a, "end": b} for a, b in spans_of(t, hit)] if len(hit) else [] for t, (_, hit, _) in zip(text, found, strict=True)]
            columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([int(f[1].sum()) for f in found], pa.int64()), pa.array([sorted(f[2]) for f in found], pa.list_(pa.string())), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "n_words", "n_hit", "item_ids", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def without_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = LIMIT, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(lists(items, window, limit, max_windows))

    def run(batches):
        scanner = Scanner(shared.value, window)
        for batch in batches:
            yield batch.filter(pa.array([not len(f[1]) for f in scanner(batch.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def oracle(window: int = WINDOW) -> str:
    """The digest in DuckDB: windows of each length by `lead`, joined with the items' windows."""
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    joined = lambda n: " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER o" for k in range(1, n))])
    lengths = "\n  UNION ALL ".join(f"SELECT {{0}}, k, {n} AS n, s{n} AS s FROM {{1}}" for n in range(1, window + 1))
    every = ", ".join(f"{joined(n)} AS s{n}" for n in range(1, window + 1))
    return f"""
WITH d AS (SELECT doc_id, unnest({words("text")}) AS word, generate_subscripts({words("text")}, 1) AS k FROM documents),
dw AS (SELECT doc_id, k, {every} FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
i AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS k, least(len(w), {window}) AS n FROM (SELECT item_id, {words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL)),
iw AS (SELECT item_id, k, n AS own, {every} FROM i WINDOW o AS (PARTITION BY item_id ORDER BY k)),
ip AS (SELECT DISTINCT item_id::VARCHAR AS item, n, s FROM (SELECT x.*, iw.own FROM ({lengths.format("item_id", "iw")}) x JOIN iw USING (item_id, k)) WHERE n = own AND s IS NOT NULL),
hits AS (SELECT doc_id, k, n, item FROM ({lengths.format("doc_id", "dw")}) JOIN ip USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM hits, range({window}) t(j) WHERE j < n GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len({words("text")}) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


def brute(text: str | None, items: list[tuple[object, str]], window: int = WINDOW) -> tuple[int, int, int, str, bool]:
    """The digest by direct comparison of word lists, for tests."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = _WORD.findall(low(text))
    hit, ids = set(), set()
    for i, t in items:
        w = _WORD.findall(low(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            part = w[k : k + window]
            for at in range(len(words) - len(part) + 1):
                if words[at : at + len(part)] == part:
                    hit.update(range(at, at + len(part)))
                    ids.add(str(i))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)
