"""Suffix-array deduplication: bytes covered by strings of `window` bytes that also start in an earlier document.

The suffixes of the whole corpus are never sorted in one place. Every window of `window` bytes is keyed by the
least-hash gram of `gram` bytes inside it (its anchor), which depends on the window's bytes alone, so equal
windows meet under one anchor. Four grouped steps over documents that are hash-dealt into blocks once (the
exchange is reused):

1. each block sends the hashes of its anchors, each once, as differences in order (about three bytes apiece), some buckets
   together, and the SHA-256 of its texts, each once; a bucket answers with the anchors that other blocks have too, and the texts that a
   smaller document has whole: such a copy is gone, and takes no further part, as what it holds the smaller document holds;
2. each block sends the runs of windows under such anchors (once for each distinct run of bytes). Runs of anchors
   that more than `hot_blocks` blocks have, with more than `hot_runs` distinct runs in all, are split into single windows (some ten times as
   many bytes: only what would be too much for one bucket is worth it), dealt out by the window's own hash, and met first
   by groups of about the square root of all blocks, of which only the least document's copies go on: so a window that
   every block has costs one task no more than that many rows;
3. each bucket sorts the suffixes that start in its windows, by bucket-pointer refinement: buckets by the first
   eight bytes, then refined by sorting on the bucket pointers of later offsets, each pass reusing the last one's
   pointers (8, 16, 32, then `window` bytes); windows that end in one bucket are equal;
4. each block marks its covered bytes.

Rows travel to their block packed and compressed, some from each task together.

Hashes only say where bytes meet: runs are taken for equal when all their bytes are; whole texts are when their SHA-256 is.
No step is computed twice or written beside its exchange, so disk holds each exchange once, however many blocks there are.

Only anchors met twice travel with their bytes, and nothing is gathered beyond a block or a bucket; both counts
follow the corpus size.

Defined cases: null text counts as empty; an empty or short text loses nothing, a text of any length is read whole (its block grows with it); rows with the same doc_id never
remove bytes of each other, nor do rows without one; a null doc_id counts as greater than every id; extra columns are ignored by
`covered`, kept by `without_repeats`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, ranges

WINDOW = 50
GRAM = 24
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 24 << 20
MIN_BLOCKS = 48
#: An anchor in more blocks than this, with more distinct runs (counted in each block), is dealt out by single windows. So many runs are about a megabyte.
HOT_BLOCKS, HOT_RUNS = 256, 1 << 14
#: Buckets whose anchors travel together, at most.
TOGETHER = 16
#: Parts of a bucket that are sorted one after another.
PARTS = 16
_SLICE = 1 << 20
_LOW32 = np.uint64((1 << 32) - 1)
_U = np.uint64
NO_ID = np.iinfo(np.int64).max


def _u64(data: np.ndarray, at: int, n: int) -> np.ndarray:
    """The n unaligned 8-byte words that start at at, at+1, ..."""
    return np.ndarray((n,), "<u8", data.data, at, (1,))


def _gather64(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ndarray((len(data) - 7,), "<u8", data.data, 0, (1,))[at]


def window_hash(data: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """64-bit hashes of the windows that start at the given places."""
    h = np.full(len(at), window, np.uint64)
    for k in [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]:
        h = mix(h ^ _gather64(data, at + k))
    return h


def deal(batches):
    """Rows packed by block, so that they travel compressed: (_block, rows as an Arrow stream)."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        to = rows["_block"].to_numpy()
        rows = rows.drop_columns(["_block"])
        order = np.argsort(to, kind="stable")
        rows, to = rows.take(order).combine_chunks(), to[order]
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
        packed = []
        for i, j in zip(cut, np.append(cut[1:], len(to)), strict=False):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_table(rows.slice(i, j - i))
            packed.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(to[cut], pa.int32()), pa.array(packed, pa.binary())], ["_block", "rows"])


def undeal(dealt: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for c in dealt["rows"].chunks for x in c])


class Block:
    """The documents of a block in order of (doc_id, text), as one byte array with 64 spare bytes at its end."""

    def __init__(self, dealt: pa.Table):
        docs = undeal(dealt).combine_chunks()
        order = pc.sort_indices(docs.select(["doc_id", "text"]), [("doc_id", "ascending"), ("text", "ascending")])
        self.rows = docs.take(order)
        ids, text = self.rows["doc_id"], pc.fill_null(self.rows["text"], "").combine_chunks()
        text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
        self.ids = pc.fill_null(ids, NO_ID).to_numpy().astype(np.int64)
        wide = text.cast(pa.large_binary())
        self.offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1].copy() if len(wide) else np.zeros(1, np.int64)
        raw = wide.buffers()[2]
        lo, hi = int(self.offsets[0]), int(self.offsets[-1])
        self.data = np.zeros(hi - lo + 64, np.uint8)
        if hi > lo:
            self.data[: hi - lo] = np.frombuffer(raw, np.uint8)[lo:hi]
        self.offsets -= lo
        self.n = hi - lo

    def texts(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct texts that hold a window: SHA-256 as four words, least document; and each document's text (-1: it holds none)."""
        found: dict[bytes, int] = {}
        text, least = np.full(len(self.ids), -1), []
        for i in np.flatnonzero(np.diff(self.offsets) >= window).tolist():
            text[i] = found.setdefault(hashlib.sha256(self.data[self.offsets[i] : self.offsets[i + 1]]).digest(), len(found))
            if text[i] == len(least):
                least.append(self.ids[i])  # documents are in order
        return np.frombuffer(b"".join(found), "<u8").reshape(-1, 4), np.array(least, np.int64), text

    def runs(self, window: int, gram: int) -> tuple[np.ndarray, ...]:
        """Maximal runs of windows under one anchor: start, number of windows, document's place, anchor's hash."""
        found = []
        begins, ends = self.offsets[:-1], self.offsets[1:]
        grams = window - gram + 1
        for lo in range(0, self.n, _SLICE):
            hi = min(lo + _SLICE, self.n)
            n = hi - lo + grams
            if hi - lo + grams + gram > len(self.data) - lo:
                n = len(self.data) - lo - gram
            h = mix(_u64(self.data, lo, n) ^ _U(gram))
            for k in [*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
                h = mix(h ^ _u64(self.data, lo + k, n))
            least = (h & ~_U(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)
            width = 1
            while width * 2 <= grams:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < grams:
                least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
            first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(begins, hi, "left")
            b, e = np.maximum(begins[first:last], lo), np.minimum(ends[first:last] - window + 1, hi)
            starts = ranges(b, np.maximum(e - b, 0)) - lo
            if not len(starts):
                continue
            at = least[starts] & _U(0xFFFFFFFF)
            cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            found.append((starts[cut] + lo, np.diff(np.append(cut, len(at))), h[at[cut].astype(np.int64)]))
        if not found:
            z = np.zeros(0, np.int64)
            return z, z, z, z.astype(np.uint64)
        start, count, key = (np.concatenate(x) for x in zip(*found, strict=True))
        return start, count, np.searchsorted(self.offsets, start, "right") - 1, key


def anchors(key: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct coarse keys (bucket above 32 bits of hash), each run's place among them, and which have two documents."""
    coarse = ((key >> _U(40)) % _U(buckets)) << _U(32) | (key & _LOW32)
    distinct, place = np.unique(coarse, return_inverse=True)
    low, high = np.full(len(distinct), NO_ID), np.full(len(distinct), -NO_ID)
    np.minimum.at(low, place, ids)
    np.maximum.at(high, place, ids)
    return distinct, place, low != high


def _spans(group: np.ndarray) -> list[tuple[int, int, int]]:
    """(group, from, to) of sorted numbers of groups."""
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    return list(zip(group[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(group)], strict=True)) if len(group) else []


ANCHORS = "block int, bucket int, keys binary, texts binary"
FLAGS = "block int, bucket int, flags binary, texts binary"
RUNS = "bucket int, block int, grp int, packed binary, done binary"
MARKS = "block int, marks binary"


class Sent:
    """What a block asks: its anchors and its texts, in groups of buckets. Later copies of a text within the block take no part."""

    def __init__(self, docs: pa.Table, buckets: int, together: int, window: int, gram: int):
        self.block = Block(docs)
        self.digest, self.least, self.text = self.block.texts(window)
        self.copied = (self.text >= 0) & (self.block.ids > self.least[self.text]) if len(self.least) else np.zeros(len(self.text), bool)
        start, count, doc, key = self.block.runs(window, gram)
        few = ~self.copied[doc]
        self.start, self.count, self.doc, key = start[few], count[few], doc[few], key[few]
        self.distinct, self.place, self.twice = anchors(key, self.block.ids[self.doc], buckets)
        of_text = (self.digest[:, 0] % _U(buckets)).astype(np.int64) // together
        self.order = np.argsort(of_text, kind="stable")
        self.anchor_spans = _spans((self.distinct >> _U(32)).astype(np.int64) // together)
        self.text_spans = _spans(of_text[self.order])


def pack_keys(keys: np.ndarray, runs: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(keys)], "<i8").tobytes() + _planes(keys) + _planes(runs))


def unpack_keys(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    return _whole(raw, n, 8), _whole(raw, n, 8 + 8 * n).astype(np.uint32)


def send_anchors(docs: pa.Table, buckets: int, together: int, counted: bool, window: int, gram: int) -> pa.Table:
    """counted: with how many distinct runs each anchor has."""
    sent = Sent(docs, buckets, together, window, gram)
    runs = np.zeros(len(sent.distinct), np.int64)
    if counted:
        h = mix(window_hash(sent.block.data, sent.start, window) ^ sent.count.astype(np.uint64)) ^ mix(sent.place.astype(np.uint64))
        runs = np.bincount(sent.place[np.unique(h, return_index=True)[1]], minlength=len(runs))
    rows: dict[int, list[bytes]] = {}
    for b, i, j in sent.anchor_spans:
        rows.setdefault(b, [b"", b""])[0] = pack_keys((sent.distinct[i:j] - _U(b * together << 32)).astype(np.int64), runs[i:j])
    for b, i, j in sent.text_spans:
        few = sent.order[i:j]
        rows.setdefault(b, [b"", b""])[1] = np.column_stack([sent.digest[few], sent.least[few].view(np.uint64)]).astype("<u8").tobytes()
    keys, texts = zip(*rows.values(), strict=True) if rows else ((), ())
    return pa.table({"block": pa.array([docs["_block"][0].as_py()] * len(rows), pa.int32()), "bucket": pa.array(list(rows), pa.int32()), "keys": pa.array(keys, pa.binary()), "texts": pa.array(texts, pa.binary())})


def flag_anchors(sent: pa.Table, together: int, hot_blocks: int, hot_runs: int) -> pa.Table:
    """For each block, a byte for each of its keys: 0 no other block has it, 1 some have, 2 more than `hot_blocks` have, with more than `hot_runs` runs;
    and a byte for each of its texts: 1 a smaller document of another block has it."""
    found = [unpack_keys(k) if k else (np.zeros(0, np.int64), np.zeros(0, np.uint32)) for k in sent["keys"].to_pylist()]
    flags = [np.zeros(len(keys), np.uint8) for keys, _ in found]
    at = [np.searchsorted(keys, np.arange(together + 1) << 32) for keys, _ in found]
    for k in range(together):  # a bucket at a time
        own = [(i, a[k], a[k + 1]) for i, a in enumerate(at) if a[k] < a[k + 1]]
        if not own:
            continue
        values = np.concatenate([found[i][0][a:b] for i, a, b in own])
        order = np.argsort(values)
        v = values[order]
        cut = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        met = np.diff(np.append(cut, len(v)))
        runs = np.add.reduceat(np.concatenate([found[i][1][a:b] for i, a, b in own])[order].astype(np.int64), cut)
        said = np.empty(len(v), np.uint8)
        said[order] = np.repeat((met > 1).astype(np.uint8) + ((met > 1) & (met > hot_blocks) & (runs > hot_runs)), met)
        ends = np.cumsum([b - a for _, a, b in own])
        for (i, a, b), e in zip(own, ends, strict=True):
            flags[i][a:b] = said[e - (b - a) : e]
    blobs = sent["texts"].to_pylist()
    texts = np.frombuffer(b"".join(blobs), "<u8").reshape(-1, 5)
    ids = texts[:, 4].view(np.int64)
    order = np.lexsort((ids, *texts[:, :4].T))
    head = np.concatenate([[True], (texts[order[1:], :4] != texts[order[:-1], :4]).any(1)]) if len(order) else np.zeros(0, bool)
    copied = np.empty(len(order), np.uint8)
    copied[order] = ids[order] > ids[order[head]][np.cumsum(head) - 1]
    ends = np.cumsum([len(b) // 40 for b in blobs])
    told = [copied[e - len(b) // 40 : e].tobytes() for b, e in zip(blobs, ends, strict=True)]
    return pa.table({"block": sent["block"], "bucket": sent["bucket"], "flags": pa.array([zlib.compress(f.tobytes(), 1) for f in flags], pa.binary()), "texts": pa.array(told, pa.binary())})


def _packed(start: np.ndarray, count: np.ndarray) -> bytes:
    return zlib.compress(np.concatenate([start, count]).astype("<u4").tobytes(), 1)


def _done(start: np.ndarray, count: np.ndarray) -> bytes:
    """Removed windows as sorted runs (start, length), packed."""
    w = np.unique(ranges(start, count))
    cut = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1] + 1])) if len(w) else np.zeros(0, np.int64)
    return _packed(w[cut], np.diff(np.append(cut, len(w))))


def run_hash(data: np.ndarray, start: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Hash of a run's bytes: its first and last window cover them all."""
    return mix(window_hash(data, start, window) * _U(3) + mix(window_hash(data, start + count - 1, window) ^ count.astype(np.uint64)))


def equal_runs(data: np.ndarray, start: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """A number for each run, the same for runs of the same bytes alone: those of one hash are compared byte by byte."""
    h = run_hash(data, start, count, window)
    length = count + window - 1
    while True:
        order = np.argsort(h, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(h) else np.zeros(0, np.int64)
        group = np.empty(len(h), np.int64)
        group[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h))))
        first = order[head][group] if len(h) else group
        other = np.flatnonzero(first != np.arange(len(h)))
        differ = count[other] != count[first[other]]
        same = other[~differ]
        bad = [other[differ]]
        ends = np.cumsum(length[same])
        lo = 0
        while lo < len(same):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4 * _SLICE, "right")))
            few = same[lo:hi]
            equal = data[ranges(start[few], length[few])] == data[ranges(start[first[few]], length[few])]
            bad.append(few[~np.logical_and.reduceat(equal, np.cumsum(length[few]) - length[few])])
            lo = hi
        bad = np.concatenate(bad)
        if not len(bad):
            return group
        h[bad] = mix(h[bad] + _U(1))  # hashes that met by chance part


def _pack(name: int, bucket: np.ndarray, part: np.ndarray, grp: int | None, ids: np.ndarray, start: np.ndarray, count: np.ndarray, text: np.ndarray, window: int, rows: dict) -> None:
    """Adds a row of packed runs for each bucket. text: the bytes of all runs, one after another."""
    length = count + window - 1
    at = np.cumsum(length) - length
    order = np.lexsort((start, part, bucket))
    cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(order) else order
    squeeze = zstandard.ZstdCompressor(level=3)
    for a, b in zip(cut, np.append(cut[1:], len(order)), strict=False):
        few = order[a:b]
        rows["bucket"].append(int(bucket[few[0]]))
        rows["block"].append(name)
        rows["grp"].append(grp)
        rows["packed"].append(squeeze.compress(pack_runs(part[few], ids[few], start[few], count[few], text[ranges(at[few], length[few])])))
        rows["done"].append(None)


def _rows(rows: dict) -> pa.Table:
    return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "block": pa.array(rows["block"], pa.int32()), "grp": pa.array(rows["grp"], pa.int32()), "packed": pa.array(rows["packed"], pa.binary()), "done": pa.array(rows["done"], pa.binary())})


def _first_of_each(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id in each run's group."""
    least = np.full(int(group.max(initial=-1)) + 1, NO_ID)
    np.minimum.at(least, group, ids)
    return least[group]


def send_runs(docs: pa.Table, flags: pa.Table, buckets: int, together: int, groups: int, window: int, gram: int) -> pa.Table:
    rows: dict = {"bucket": [], "block": [], "grp": [], "packed": [], "done": []}
    if not docs.num_rows:
        return _rows(rows)
    sent, name = Sent(docs, buckets, together, window, gram), docs["_block"][0].as_py()
    block, place = sent.block, sent.place
    said = {b: (f, t) for b, f, t in zip(*(flags[c].to_pylist() for c in ("bucket", "flags", "texts")), strict=True)}
    told = np.zeros(len(sent.least), bool)
    told[sent.order] = np.frombuffer(b"".join(said[b][1] for b, _, _ in sent.text_spans), bool)
    copied = sent.copied.copy()
    copied[sent.text >= 0] |= told[sent.text[sent.text >= 0]]
    gone = np.flatnonzero(copied)
    if len(gone):
        for k, v in zip(rows, (name % buckets, name, None, None, _packed(block.offsets[gone], block.offsets[gone + 1] - block.offsets[gone] - window + 1)), strict=True):
            rows[k].append(v)
    flag = np.frombuffer(b"".join(zlib.decompress(said[b][0]) for b, _, _ in sent.anchor_spans), np.uint8)
    flag = np.maximum(flag, sent.twice.astype(np.uint8))[place] if len(place) else flag
    keep = np.flatnonzero((flag > 0) & ~copied[sent.doc])
    start, count, ids, hot, to = sent.start[keep], sent.count[keep], block.ids[sent.doc[keep]], flag[keep] == 2, (sent.distinct[place[keep]] >> _U(32)).astype(np.int64)
    part = (sent.distinct[place[keep]] >> _U(28)).astype(np.int64) % PARTS
    if hot.any():
        single = ranges(start[hot], count[hot])
        w = window_hash(block.data, single, window)
        ids = np.concatenate([ids[~hot], np.repeat(ids[hot], count[hot])])
        to = np.concatenate([to[~hot], (w % _U(buckets)).astype(np.int64)])
        part = np.concatenate([part[~hot], (w >> _U(60)).astype(np.int64) % PARTS])
        start, count = np.concatenate([start[~hot], single]), np.concatenate([count[~hot], np.ones(len(single), np.int64)])
        hot = np.concatenate([np.zeros(int((~hot).sum()), bool), np.ones(len(single), bool)])
    least = _first_of_each(equal_runs(block.data, start, count, window), ids)
    later = ids > least
    if later.any():
        for k, v in zip(rows, (name % buckets, name, None, None, _done(start[later], count[later])), strict=True):
            rows[k].append(v)
    for chosen, grp in ((~hot & ~later, None), (hot & ~later, name % groups)):
        few = np.flatnonzero(chosen)
        if len(few):
            _pack(name, to[few], part[few], grp, ids[few], start[few], count[few], block.data[ranges(start[few], count[few] + window - 1)], window, rows)
    return _rows(rows)


def combine(sent: pa.Table, window: int) -> pa.Table:
    """Of hot windows of a group of blocks, those of the least document go on; the others are done. Of rows that aren't hot, nothing."""
    rows: dict = {"bucket": [], "block": [], "grp": [], "packed": [], "done": []}
    if sent["grp"][0].as_py() is None:
        return _rows(rows)
    found = [(block, *unpack_runs(zstandard.ZstdDecompressor().decompress(packed))) for block, packed in zip(sent["block"].to_pylist(), sent["packed"].to_pylist(), strict=True)]
    bucket = sent["bucket"][0].as_py()
    part = np.concatenate([np.repeat(np.arange(PARTS), f[1]) for f in found])
    block = np.concatenate([np.full(len(f[2]), f[0]) for f in found])
    ids, start, count = (np.concatenate([f[k] for f in found]) for k in (2, 3, 4))
    data = np.concatenate([*(f[5] for f in found), np.zeros(64, np.uint8)])
    at = np.cumsum(count + window - 1) - (count + window - 1)
    later = ids > _first_of_each(equal_runs(data, at, count, window), ids)
    for name in np.unique(block).tolist():
        gone, few = np.flatnonzero((block == name) & later), np.flatnonzero((block == name) & ~later)
        if len(gone):
            for k, v in zip(rows, (bucket, name, None, None, _done(start[gone], count[gone])), strict=True):
                rows[k].append(v)
        if len(few):
            _pack(name, np.full(len(few), bucket), part[few], None, ids[few], start[few], count[few], data[ranges(at[few], count[few] + window - 1)], window, rows)
    return _rows(rows)


def _planes(values: np.ndarray) -> bytes:
    """Differences of integers, all their lowest bytes first, and so on: they compress well."""
    return np.ascontiguousarray(np.diff(values, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _whole(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").ravel())


def pack_runs(part: np.ndarray, ids: np.ndarray, start: np.ndarray, count: np.ndarray, text: np.ndarray) -> bytes:
    head = np.array([len(ids), *np.bincount(part, minlength=PARTS)], "<i8").tobytes()
    return head + _planes(ids) + _planes(start) + count.astype("u1").tobytes() + text.tobytes()


def unpack_runs(raw: bytes) -> tuple[np.ndarray, ...]:
    """Runs per part, document, start, windows, bytes."""
    n, at = int(np.frombuffer(raw, "<i8", 1)[0]), 8 + 8 * PARTS
    return np.frombuffer(raw, "<i8", PARTS, 8), _whole(raw, n, at), _whole(raw, n, at + 8 * n), np.frombuffer(raw, "u1", n, at + 16 * n).astype(np.int64), np.frombuffer(raw, np.uint8, -1, at + 17 * n)


def bucket_pointers(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at `starts` in order of their first `depth` bytes (8 at least), and where in it each bucket of equal ones begins.

    data has 64 spare bytes at its end, and every suffix has `depth` bytes before them.
    """
    n = len(data) - 64
    value = _u64(data, 0, n).byteswap()
    suffix = np.argsort(value)
    value = value[suffix]
    head = np.concatenate([[True], value[1:] != value[:-1]])
    del value
    slots = np.arange(n, dtype=np.int64)
    first = np.maximum.accumulate(np.where(head, slots, 0))
    pointer = np.empty(n + 64, np.int64)
    pointer[n:] = n
    pointer[suffix] = first
    done = 8
    while done * 2 <= depth:
        head = np.concatenate([head, [True]])
        open_ = np.flatnonzero(~(head[:-1] & head[1:]))  # slots of buckets of two and more
        at = suffix[open_]
        by = pointer[at] << 32 | pointer[at + done]
        order = np.argsort(by)
        by, at = by[order], at[order]
        head = head[:-1]
        suffix[open_] = at
        new = np.concatenate([[True], by[1:] != by[:-1]]) if len(by) else np.zeros(0, bool)
        head[open_] = new
        pointer[at] = open_[np.flatnonzero(new)][np.cumsum(new) - 1] if len(by) else pointer[at]
        done *= 2
    by = pointer[starts] << 32 | pointer[starts + depth - done]
    order = np.argsort(by, kind="stable")
    by = by[order]
    return order, np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.zeros(0, np.int64)


def decide(sent: pa.Table, window: int) -> pa.Table:
    """Which windows of the runs that met in a bucket also start in a document of a smaller id."""
    sent = sent.combine_chunks()
    out: list[tuple[int, bytes]] = []
    runs = []
    for block, packed, done in zip(sent["block"].to_pylist(), sent["packed"].to_pylist(), sent["done"].to_pylist(), strict=True):
        if done is not None:
            out.append((block, done))
        else:
            runs.append((block, *unpack_runs(zstandard.ZstdDecompressor().decompress(packed))))
    for part in range(PARTS):
        found = []
        for block, sizes, ids, start, count, text in runs:
            a, b = int(sizes[:part].sum()), int(sizes[: part + 1].sum())
            if a < b:
                lengths = count + window - 1
                i = int(lengths[:a].sum())
                found.append((np.full(b - a, block), ids[a:b], start[a:b], count[a:b], text[i : i + int(lengths[a:b].sum())]))
        if found:
            out += _decide(found, window)
    return pa.table({"block": pa.array([b for b, _ in out], pa.int32()), "marks": pa.array([m for _, m in out], pa.binary())})


def _decide(found: list[tuple[np.ndarray, ...]], window: int) -> list[tuple[int, bytes]]:
    block, ids, start, count = (np.concatenate([f[k] for f in found]) for k in range(4))
    data = np.concatenate([*(f[4] for f in found), np.zeros(64, np.uint8)])
    at = np.cumsum(count + window - 1) - (count + window - 1)
    group = equal_runs(data, at, count, window)
    order = np.lexsort((ids, group))
    head = np.concatenate([[True], np.diff(group[order]) != 0])
    kept = order[head]  # of each distinct run the one in the least document
    length = count[kept] + window - 1
    data = np.concatenate([data[ranges(at[kept], length)], np.zeros(64, np.uint8)])
    windows = ranges(np.cumsum(length) - length, count[kept])
    owner = np.repeat(np.arange(len(kept)), count[kept])
    sorted_, cut = bucket_pointers(data, windows, window)
    who = ids[kept][owner]
    least = np.minimum.reduceat(who[sorted_], cut)
    first = np.empty(len(who), np.int64)
    first[sorted_] = np.repeat(least, np.diff(np.append(cut, len(who))))
    gone = who > first
    # a later copy of a run loses all its windows; the first copy, and others in its document, what was found for it
    begin = np.cumsum(count[kept]) - count[kept]
    removed = gone[ranges(begin[group], count)] | np.repeat(ids > ids[kept][group], count)
    every, b = ranges(start, count)[removed], np.repeat(block, count)[removed]
    o = np.argsort(b, kind="stable")
    b, every = b[o], every[o]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    return [(int(b[i]), _done(every[i:j], np.ones(j - i, np.int64))) for i, j in zip(cut, np.append(cut[1:], len(b)), strict=False)]


def removed_bytes(block: Block, marks: list[bytes], window: int) -> np.ndarray:
    edge = np.zeros(block.n + window + 1, np.int32)
    for m in marks:
        start, count = np.frombuffer(zlib.decompress(m), "<u4").astype(np.int64).reshape(2, -1)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + count + window - 1, -1)
    return np.cumsum(edge)[: block.n] > 0


def digest(docs: pa.Table, marks: pa.Table, window: int) -> pa.Table:
    block = Block(docs)
    gone = removed_bytes(block, marks["marks"].to_pylist(), window)
    o = block.offsets
    sums = np.concatenate([[0], np.cumsum(gone)])
    begins = np.concatenate([gone[:1], gone[1:] & ~gone[:-1]]) if len(gone) else gone
    starts = o[:-1][o[:-1] < block.n]
    begins[starts] = gone[starts]  # runs don't cross documents
    spans = np.concatenate([[0], np.cumsum(begins)])
    kept = [block.data[a:b] if sums[a] == sums[b] else block.data[a:b][~gone[a:b]] for a, b in zip(o[:-1], o[1:], strict=True)]
    return pa.table({"doc_id": block.rows["doc_id"], "n_bytes": np.diff(o), "n_removed": sums[o[1:]] - sums[o[:-1]], "n_spans": spans[o[1:]] - spans[o[:-1]], "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]})


def rewrite(docs: pa.Table, marks: pa.Table, window: int, names: list[str]) -> pa.Table:
    """The documents without their removed bytes; a character that loses a part of its bytes goes whole."""
    block = Block(docs)
    gone = removed_bytes(block, marks["marks"].to_pylist(), window)
    old, o = block.rows["text"].to_pylist(), block.offsets
    text = [t if t is None or not gone[a:b].any() else block.data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for t, a, b in zip(old, o[:-1], o[1:], strict=True)]
    rows = block.rows.set_column(block.rows.schema.get_field_index("text"), "text", pa.array(text, pa.string()))
    return rows.select(names)


def _marked(docs: DataFrame, window: int, gram: int, block_bytes: int, bucket_bytes: int, hot_blocks: int, hot_runs: int) -> tuple[DataFrame, DataFrame]:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(MIN_BLOCKS, math.ceil(total / block_bytes)), max(MIN_BLOCKS, math.ceil(total / bucket_bytes))
    together, groups = min(TOGETHER, max(1, buckets // MIN_BLOCKS)), math.isqrt(blocks) + 1
    # by id and text, so that rows without an id, or of one id, are dealt out too
    dealt = docs.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).mapInArrow(deal, "_block int, rows binary")
    hot = blocks > hot_blocks  # else no anchor can be in so many
    sent = dealt.groupBy("_block").applyInArrow(lambda t: send_anchors(t, buckets, together, hot, window, gram), ANCHORS)
    flags = sent.groupBy("bucket").applyInArrow(lambda t: flag_anchors(t, together, hot_blocks, hot_runs), FLAGS)
    runs = dealt.groupBy("_block").cogroup(flags.groupBy("block")).applyInArrow(lambda d, f: send_runs(d, f, buckets, together, groups, window, gram), RUNS)
    if not hot:
        return dealt, runs.groupBy("bucket").applyInArrow(lambda t: decide(t, window), MARKS)
    # one exchange, read twice: a filter before it would make the runs, and the exchange, once for each side
    met = runs.groupBy("bucket", "grp")
    cold = met.applyInArrow(lambda t: decide(t if t["grp"][0].as_py() is None else t.slice(0, 0), window), MARKS)
    few = met.applyInArrow(lambda t: combine(t, window), RUNS)
    return dealt, cold.union(few.groupBy("bucket").applyInArrow(lambda t: decide(t, window), MARKS))


def covered(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_blocks: int = HOT_BLOCKS, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (see the module's text).

    window: bytes of a repeated string, 32 to 255. gram: bytes of an anchor, 8 to window - 1.
    """
    dealt, marks = _marked(docs.select("doc_id", "text"), window, gram, block_bytes, bucket_bytes, hot_blocks, hot_runs)
    return dealt.groupBy("_block").cogroup(marks.groupBy("block")).applyInArrow(lambda d, m: digest(d, m, window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_blocks: int = HOT_BLOCKS, hot_runs: int = HOT_RUNS) -> DataFrame:
    """The documents, with the repeated bytes cut from their text; all columns and rows stay."""
    dealt, marks = _marked(docs, window, gram, block_bytes, bucket_bytes, hot_blocks, hot_runs)
    names = docs.columns
    return dealt.groupBy("_block").cogroup(marks.groupBy("block")).applyInArrow(lambda d, m: rewrite(d, m, window, names), docs.schema)
