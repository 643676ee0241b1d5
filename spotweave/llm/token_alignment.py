"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of which token of one meets which of the other.

Each text is encoded, after one space, by a byte-level BPE (A) and a piece BPE with byte fallback (B). Byte offsets at which tokens of
both end cut them into groups; an A and a B token are linked where their bytes overlap. A table made beforehand has, for each A id, the
B id of the same bytes. Links of such a pair, which is what a group of one and one is, are counted in a vector as
long as A's vocabulary, so they never are rows of a shuffle; only the other pairs are, after sums within each task.

Texts are cut into units where neither tokenizer joins what stands on both sides: before a single space or line feed between two
characters that aren't white space. (A's words begin there; no piece of B has a space after another sign or a line feed, which
is tested when the vocabulary is read; if one had, texts would be encoded whole.) A task encodes each distinct unit once, in a
table that begins anew at `MAX_UNITS`, and a text's numbers are sums over its units, so memory holds a text, a batch and the table. A text that has no
such place is one unit; its encoding takes some hundred bytes of memory for each of its tokens.

First pass: a row for each document with its counts and its distinct pairs, written as a table (the texts aren't read again). Second:
documents of each pair, from that table. Third: the counts go to all tasks where they are `max_pairs` at most, checked;
beyond that documents' pairs are joined with them. Both ways give the same rows.

Defined cases: null and empty texts, and those whose joined tokens of A or B aren't the space and the text, have no tokens (zeros, and
an empty string for the hash); special tokens' strings are plain text; repeated rows each count as a document and get their result; a null
doc_id stays; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranges, shared_checkpoints, spread

#: Where the vocabularies lie, unless the session's spotweave.tokenizers names another folder.
FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
MAX_UNITS, MAX_PAIRS = 400_000, 8_000_000
#: Units that are encoded by A at once.
TOGETHER = 500
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def byte_level() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _room(v: np.ndarray, size: int) -> np.ndarray:
    """The array, or a copy at least twice as long, where it is shorter than size."""
    return v if len(v) >= size else np.concatenate([v, np.zeros((max(len(v), size), *v.shape[1:]), v.dtype)])


class Aligner:
    """Units by number, with what each adds to a text."""

    def __init__(self, a_file: str, b_file: str, max_units: int = MAX_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a.encode_special_tokens = True
        letters = byte_level()
        added = self.a.get_added_tokens_decoder()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            self.a_bytes[i] = piece.encode() if i in added else bytes(letters[c] for c in piece)
        b = self.b
        pieces = [b.id_to_piece(i) for i in range(b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.separable = not any("\n" in p or re.search("[^▁]▁", p) for p in pieces)
        self.a_len, self.b_len = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        plain = {v: i for i, v in reversed([*enumerate(self.b_bytes)]) if not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i))}
        single = {v: i for i, v in enumerate(self.b_bytes) if b.is_byte(i)}
        self.same = np.array([plain.get(x, single.get(x, -1)) if x else -1 for x in self.a_bytes], np.int64)
        self.a_text, self.b_text = ([str(i) for i in range(len(v))] for v in (self.a_bytes, self.b_bytes))
        self.max_units = max_units
        self._clear()

    def _clear(self) -> None:
        self.units: dict[str, int] = {}
        self.numbers = np.zeros((1024, 5), np.int64)  # n_a, n_b, n_groups, n_links, whether the tokens' bytes are the unit's
        self.groups: list[str] = []
        # pairs of unit u: rows bounds[u] to bounds[u + 1] of keys (a << 32 | b) and times
        self.bounds, self.keys, self.times = np.zeros(1025, np.int64), np.zeros(4096, np.int64), np.zeros(4096, np.int32)

    def cut(self, text: str) -> list[str]:
        return _CUT.split(f" {text}") if self.separable else [f" {text}"]

    def learn(self, texts: list[list[str]]) -> None:
        """Adds the units of some texts that aren't there; where the table is full, it begins anew with these."""
        if len(self.units) > self.max_units:
            self._clear()
        new = list(set().union(*texts).difference(self.units))
        for lo in range(0, len(new), 20_000):
            self._add(new[lo : lo + 20_000])

    def _a_ids(self, units: list[str], joint: int, size: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Tokens of all units, and how many each has. The first `joint` units end in no white space: they are encoded joined, and tokens are dealt out by bytes."""
        flat: list[int] = []
        counts = []
        parts = [(lo, min(lo + TOGETHER, joint)) for lo in range(0, joint, TOGETHER)]
        for (lo, hi), e in zip(parts, self.a.encode_batch_fast(["".join(units[lo:hi]) for lo, hi in parts], add_special_tokens=False), strict=True):
            ids = e.ids
            ends, want = np.cumsum(self.a_len[ids]), np.cumsum(size[lo:hi])
            at = np.searchsorted(ends, want)
            if at[-1] >= len(ends) or (ends[at] != want).any():
                each = [x.ids for x in self.a.encode_batch_fast(units[lo:hi], add_special_tokens=False)]
                ids, at = [k for x in each for k in x], np.cumsum([len(x) for x in each]) - 1
            flat += ids
            counts.append(np.diff(at, prepend=-1))
        each = [self.a.encode_batch_fast([u], add_special_tokens=False)[0].ids for u in units[joint:]]
        counts.append(np.array([len(x) for x in each], np.int64))
        return flat + [k for x in each for k in x], np.concatenate(counts)

    def _b_ids(self, units: list[str]) -> tuple[list[int], np.ndarray]:
        """B adds a space: it is the unit's own, or a token by itself before a line feed."""
        found = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for i, u in enumerate(units):
            if u[0] != " " and found[i] and self.b_bytes[found[i][0]] == b" ":
                found[i] = found[i][1:]
        return list(chain.from_iterable(found)), np.fromiter(map(len, found), np.int64, len(found))

    def _add(self, units: list[str]) -> None:
        together = (lambda u: not (u[-1].isspace() or u[1].isspace()) and len(u) < 1000) if self.separable else (lambda u: False)
        first = [u for u in units if together(u)]
        units = first + [u for u in units if not together(u)] if len(first) < len(units) else first
        raw = [u.encode() for u in units]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ok = np.ones(len(units), bool)
        sides = []
        for (flat, n), table, lengths in ((self._a_ids(units, len(first), size), self.a_bytes, self.a_len), (self._b_ids(units), self.b_bytes, self.b_len)):
            ids = np.array(flat, np.int64)
            stop = np.cumsum(n)
            ends = np.r_[0, np.cumsum(lengths[ids])][stop]
            if (ends != np.cumsum(size)).any() or b"".join([table[k] for k in flat]) != b"".join(raw):
                ok &= np.array([b"".join([table[k] for k in flat[z - m : z]]) == r for z, m, r in zip(stop.tolist(), n.tolist(), raw, strict=True)])
            sides.append((ids, n))
        good = np.flatnonzero(ok)
        (a_id, n_a), (b_id, n_b) = ((ids[np.repeat(ok, n)], n[ok]) for ids, n in sides)
        a_end, b_end = np.cumsum(self.a_len[a_id]), np.cumsum(self.b_len[b_id])
        a_start, b_start = a_end - self.a_len[a_id], b_end - self.b_len[b_id]
        # groups end where tokens of both do
        stop = np.intersect1d(a_end, b_end)
        a_last, b_last = np.searchsorted(a_end, stop, "right"), np.searchsorted(b_end, stop, "right")
        unit_end = np.cumsum(size[ok])
        upto = np.searchsorted(stop, unit_end, "right")
        n_groups = np.diff(upto, prepend=0)
        # links: B tokens whose bytes overlap an A token's
        first, after = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
        many = np.maximum(after - first, 0)
        unit_of_a = np.repeat(np.arange(len(good)), n_a)
        n_links = np.bincount(unit_of_a, many, len(good)).astype(np.int64)
        key = np.repeat(a_id, many) << 32 | b_id[ranges(first, many)]
        unit = np.repeat(unit_of_a, many)
        order = np.lexsort((key, unit))
        key, unit = key[order], unit[order]
        begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])]) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.r_[begin, len(key)])
        key, unit = key[begin], unit[begin]
        # what the groups are written as
        at, bt = [self.a_text[i] for i in a_id.tolist()], [self.b_text[i] for i in b_id.tolist()]
        alo = blo = glo = 0
        strings, ends = [], list(zip(a_last.tolist(), b_last.tolist(), strict=True))
        for ghi in upto.tolist():
            parts = []
            for ahi, bhi in ends[glo:ghi]:
                parts.append(f"{at[alo]}|{bt[blo]}" if ahi - alo == 1 == bhi - blo else f"{','.join(at[alo:ahi])}|{','.join(bt[blo:bhi])}")
                alo, blo = ahi, bhi
            strings.append(";".join(parts))
            glo = ghi
        base = len(self.groups)
        self.numbers = _room(self.numbers, base + len(units))
        self.numbers[base : base + len(units)] = 0
        self.numbers[base + good] = np.stack([n_a, n_b, n_groups, n_links, np.ones(len(good), np.int64)], 1)
        written = [""] * len(units)
        for i, x in zip(good.tolist(), strings, strict=True):
            written[i] = x
        self.groups += written
        self.units.update(zip(units, range(base, base + len(units)), strict=True))
        lo = self.bounds[base]
        self.keys, self.times, self.bounds = _room(self.keys, lo + len(key)), _room(self.times, lo + len(key)), _room(self.bounds, base + len(units) + 1)
        self.keys[lo : lo + len(key)], self.times[lo : lo + len(key)] = key, times
        each = np.zeros(len(units), np.int64)
        each[good] = np.bincount(unit, minlength=len(good))
        self.bounds[base + 1 : base + len(units) + 1] = lo + np.cumsum(each)

    def text(self, units: list[str]) -> tuple[list[int], str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups and n_links, the groups' hash, and the distinct pairs (a << 32 | b) with their links."""
        ids = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))
        sums = self.numbers[ids].sum(0)
        if sums[4] != len(ids):
            return [0, 0, 0, 0], "", *[np.zeros(0, np.int64)] * 2
        written = hashlib.sha256()
        few = ids.tolist()
        for lo in range(0, len(few), 100_000):
            written.update(((";" if lo else "") + ";".join([self.groups[i] for i in few[lo : lo + 100_000]])).encode())
        own, times = np.unique(ids, return_counts=True)
        many = self.bounds[own + 1] - self.bounds[own]
        at = ranges(self.bounds[own], many)
        keys, n = self.keys[at], self.times[at] * np.repeat(times, many)
        keys, which = np.unique(keys, return_inverse=True)
        return sums[:4].tolist(), written.hexdigest(), keys, np.bincount(which, n, len(keys)).astype(np.int64)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def folder(spark: SparkSession) -> str:
    return spark.conf.get("spotweave.tokenizers", FOLDER)


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id") -> DataFrame:
    """Per row: the id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked pairs: a, b, n (links), in order."""

    def run(batches):
        aligner = Aligner(a_file, b_file)
        for batch in batches:
            lo = 0
            texts = batch.column("text")
            size = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], np.int64)
            while lo < batch.num_rows:  # some MB of texts at a time, a long one by itself
                hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), 2 << 20, "right")))
                cut = [aligner.cut(t) if t else [] for t in (x.as_py() for x in texts.slice(lo, hi - lo))]
                aligner.learn(cut)
                rows = [aligner.text(u) if u else ([0, 0, 0, 0], "", np.zeros(0, np.int64), np.zeros(0, np.int64)) for u in cut]
                at = pa.array(np.cumsum([0, *(len(r[2]) for r in rows)]), pa.int32())
                key, n = (np.concatenate([r[k] for r in rows]) for k in (2, 3))
                lists = [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for v in (key >> 32, key & 0xFFFFFFFF, n)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), *[pa.array([r[0][k] for r in rows], pa.int64()) for k in range(4)], pa.array([r[1] for r in rows], pa.string()), *lists], [id_col, *NUMBERS, "groups_sha256", "a", "b", "n"])
                lo = hi

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in NUMBERS)}, groups_sha256 string, a array<int>, b array<int>, n array<int>"
    return docs.select(F.col(id_col).alias("id"), "text").mapInArrow(run, shape)


def _lists(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of the rows' lists, and their values one after another."""
    columns = [batch.column(c) for c in names]
    return np.diff(columns[0].offsets.to_numpy()), [c.flatten().to_numpy() for c in columns]


def pair_counts(aligned: DataFrame, same: np.ndarray, flush: int = 2_000_000) -> DataFrame:
    """(a, b, documents): in how many rows each pair is linked. same: for each A id the B id of its bytes, or -1."""
    shared = aligned.sparkSession.sparkContext.broadcast(same)  # as long as A's vocabulary

    def run(batches):
        same = shared.value
        vector = np.zeros(len(same), np.int64)
        held, size = [], 0

        def some(key, n):
            return pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["a", "b", "documents"])

        def merged(held):
            key, which = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return key, np.bincount(which, np.concatenate([h[1] for h in held]), len(key)).astype(np.int64)

        for batch in batches:
            _, (a, b) = _lists(batch, "a", "b")
            exact = same[a] == b
            vector += np.bincount(a[exact], minlength=len(same))
            other = a[~exact].astype(np.int64) << 32 | b[~exact]
            held.append((other, np.ones(len(other), np.int64)))
            size += len(other)
            if size > flush:
                held = [merged(held)]
                size = len(held[0][0])
                if size > flush // 2:
                    yield some(*held[0])
                    held, size = [], 0
        i = np.flatnonzero(vector)
        if len(i):
            yield some(i << 32 | same[i], vector[i])
        if held:
            yield some(*merged(held))

    return aligned.select("a", "b").mapInArrow(run, "a int, b int, documents long").groupBy("a", "b").agg(F.sum("documents").alias("documents"))


def best_links(aligned: DataFrame, counts: DataFrame, id_col: str = "doc_id", max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Adds n_best (links of a pair whose count is its A id's highest) and count_sum (the sum of the links' counts), and drops the pairs."""
    top = counts.groupBy("a").agg(F.max("documents").alias("most"))  # a row for each A id at most
    rated = counts.join(F.broadcast(top), "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))
    if rated.limit(max_pairs + 1).count() > max_pairs:
        numbered = aligned.withColumn("_row", F.monotonically_increasing_id())
        each = numbered.select("_row", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("_row", "p.a", "p.b", "p.n")
        sums = each.join(rated, ["a", "b"]).groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("documents")).alias("count_sum"))
        found = numbered.drop("a", "b", "n").join(sums, "_row", "left").drop("_row")
        return found.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_best", "count_sum")})
    got = rated.toArrow()
    key = got["a"].to_numpy().astype(np.int64) << 32 | got["b"].to_numpy()
    order = np.argsort(key)
    shared = aligned.sparkSession.sparkContext.broadcast((key[order], got["documents"].to_numpy()[order], got["best"].to_numpy()[order]))
    keep = [id_col, *NUMBERS, "groups_sha256"]

    def run(batches):
        key, documents, best = shared.value
        for batch in batches:
            size, (a, b, n) = _lists(batch, "a", "b", "n")
            at = np.searchsorted(key, a.astype(np.int64) << 32 | b)
            row, n = np.repeat(np.arange(batch.num_rows), size), n.astype(np.int64)
            sums = []
            for v in (n * best[at], n * documents[at]) if len(at) else (n, n):
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, row, v)
                sums.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *sums], [*keep, "n_best", "count_sum"])

    kind = aligned.schema[id_col].dataType.simpleString()
    shape = f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in NUMBERS)}, groups_sha256 string, n_best long, count_sum long"
    return aligned.mapInArrow(run, shape)


def alignment(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, id_col: str = "doc_id", max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Per row: the id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    a_file, b_file = a_file or f"{folder(spark)}/{A_FILE}", b_file or f"{folder(spark)}/{B_FILE}"
    at = f"{shared_checkpoints(spark)}/{uuid.uuid4().hex}"
    aligned = align(spread(docs.select(id_col, "text")), a_file, b_file, id_col)
    aligned.write.option("compression", "zstd").parquet(at)
    aligned = spark.read.schema(aligned.schema).parquet(at)
    counts = pair_counts(aligned, Aligner(a_file, b_file).same).checkpoint()
    found = best_links(aligned, counts, id_col, max_pairs)
    return found.select(id_col, *NUMBERS, "n_best", "count_sum", "groups_sha256")
