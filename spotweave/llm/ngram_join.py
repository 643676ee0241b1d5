"""N-gram Jaccard join: all links between documents whose sets of word n-grams have a Jaccard similarity of
`threshold` or more, found by MinHash banding and verified on the full sets.

Words are runs of anything but ASCII white space, A-Z lower-cased; an n-gram is `n` words in a row, and a text of
fewer words (but not none) has one, of all its words. Steps:

1. one scan gives each document the size and a 128-bit digest of its n-gram set and one hash for each band;
   rows per band = the most, and bands = the fewest, that reach `recall` at the threshold within `max_hashes`;
2. documents of equal sets are one class (grouped by digest, partial minima before the shuffle), so copies are
   never compared;
3. classes are dealt by band hash into buckets; of buckets with the same members one stays, buckets of one go;
4. only texts of classes in a bucket of two and more are sent, once to each of their buckets, and pairs are verified
   there, on full sets, by blocked matrix products. A pair that shares several buckets is compared in the first of them alone.
   A bucket too large for one task is split by hash into tiles, and each pair of tiles is a group of its own, so no
   group grows with a hot bucket. A group returns a count of links per class and star edges, never pairs;
5. connected components of these verified edges (by star contraction, in the shared checkpoint folder) are the classes.

So the work is bounded by the pairs that share a bucket: texts that are only a little alike meet by rare chance, in twos,
and don't chain. Within a large group of near copies all pairs are compared, as all links are counted.

Defined cases: texts of any length are compared by all their n-grams; texts without words, and null texts, are classes of their own without links; rows with one doc_id and
different texts are one document with several sets, whose links are all counted, but for those among themselves; a row with a null doc_id comes back with nulls and no links;
ties go to the least doc_id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix, use_shared_checkpoints

N, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.9995, 128
GROUP_BYTES = 4 << 20
#: Up to so many candidates (16 bytes each), their ids are broadcast to the texts; beyond, both are shuffled.
BROADCAST_ROWS = 2_000_000
TILE_ROWS = 2048
_SLICE = 1 << 20
_U = np.uint64


def bands_for(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows whose needed bands, log(1-recall)/log(1-threshold^rows), fit max_hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    if not best:
        raise ValueError("max_hashes is too low for this recall")
    return best


def _seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(salt)) | _U(1)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return lower, _seeds(64 * 256, 7).reshape(64, 256)


def ngram_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, all in one array, and where each text's begin (one more at the end)."""
    lower, tab = _tables()
    hashes, counts = [], []
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < _SLICE):
            size += len(texts[hi]) + 1
            hi += 1
        h, c = _slice_sets(texts[lo:hi], n, lower, tab)
        hashes.append(h)
        counts.append(c)
        lo = hi
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def _slice_sets(texts: list[bytes], n: int, lower: np.ndarray, tab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = lower[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.arange(len(data)) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(data)]])))
    value = tab[at & 63, data]
    value[space] = 0
    if int(at.max()) >= 64:
        value = np.where(at < 64, value, value * (at.astype(np.uint64) | _U(1)))  # later bytes of very long words
    word = mix(np.add.reduceat(value, first))
    del at, value
    doc = np.searchsorted(ends, first, "right")
    words = np.bincount(doc, minlength=len(texts))
    grams = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    # n-grams: sums of words times the multiplier of their place; short texts end early
    begin = np.cumsum(words) - words
    g_doc = np.repeat(np.arange(len(texts)), grams)
    g_at = np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams) + begin[g_doc]
    left = np.minimum(words[g_doc], n)
    mult = _seeds(n, 3)
    h = left.astype(np.uint64)
    for k in range(n):
        inside = k < left
        h = np.where(inside, mix(h ^ (word[np.minimum(g_at + k, len(word) - 1)] * mult[k])), h)
    order = np.lexsort((h, g_doc))
    h, g_doc = h[order], g_doc[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (g_doc[1:] != g_doc[:-1])])
    return h[keep], np.bincount(g_doc[keep], minlength=len(texts))


SIGNED = "doc_id long, bytes int, size int, digest_a long, digest_b long, bands array<long>"


def _sign(batches, n: int, bands: int, rows: int):
    a, x = _seeds(bands * rows, 11), _seeds(bands * rows, 13)
    for batch in batches:
        text = batch.column("text")
        wide = pc.fill_null(text, "").cast(pa.large_binary())
        ids = batch.column("doc_id")
        lo = 0
        while lo < len(ids):
            hi, size = lo, 0
            while hi < len(ids) and size < 4 * _SLICE:
                size += len(wide[hi].as_buffer())
                hi += 1
            sets, at = ngram_sets(wide[lo:hi].to_pylist(), n)
            count = np.diff(at)
            some = np.flatnonzero(count)
            out = np.zeros((hi - lo, bands), np.uint64)
            first, second = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
            if len(some):
                starts = at[:-1][some]
                first[some] = np.add.reduceat(mix(sets ^ _U(1)), starts)
                second[some] = np.add.reduceat(mix(sets ^ _U(2)), starts)
                for b in range(bands):
                    h = np.full(len(some), b + 1, np.uint64)
                    for k in range(b * rows, b * rows + rows):
                        v = (sets ^ x[k]) * a[k]
                        v ^= v >> _U(32)
                        h = mix(h ^ np.minimum.reduceat(v, starts))
                    out[some, b] = np.maximum(h, _U(1))  # 0 stands for no bucket
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * bands, bands), pa.int32()), pa.array(out.ravel().view(np.int64)))
            length = pc.binary_length(wide[lo:hi]).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([ids[lo:hi], length, pa.array(count.astype(np.int32)), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), lists], ["doc_id", "bytes", "size", "digest_a", "digest_b", "bands"])
            lo = hi


VERIFIED = "copy_id long, links long, root long"


def _links(sets: list[np.ndarray], open_: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the sets are similar, of the pairs that are open (a symmetric matrix)."""
    busy = np.flatnonzero(open_.any(1))
    close = np.zeros_like(open_)
    if not len(busy):
        return close
    parts = [sets[k] for k in busy]
    size = np.array([len(p) for p in parts])
    owner = np.repeat(np.arange(len(busy)), size)
    values, place, met = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(met > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    place = column[place]
    owner, place = owner[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((len(busy), len(busy)), np.float64)
    for lo in range(0, len(shared), 4096):
        i, j = np.searchsorted(place, [lo, lo + 4096])
        m = np.zeros((len(busy), min(4096, len(shared) - lo)), np.float32)
        m[owner[i:j], place[i:j] - lo] = 1
        both += m @ m.T
    close[np.ix_(busy, busy)] = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    return close & open_


def _verify(group: pa.Table, n: int, threshold: float) -> pa.Table:
    """Links and star edges of the buckets of a group: rows (copy_id, digest_a, same, text, band, at, side, apart, kept)."""
    group = group.combine_chunks()
    ids, same, digest, band, at, side, apart = (group[c].to_numpy() for c in ("copy_id", "same", "digest_a", "band", "at", "side", "apart"))
    kept = group["kept"].chunk(0).flatten().to_numpy().reshape(len(ids), -1)
    # each text's set once, however many buckets it is in
    _, first, text_of = np.unique(np.stack([ids, same]), axis=1, return_index=True, return_inverse=True)
    sets, begin = ngram_sets(group["text"].chunk(0).take(pa.array(first)).cast(pa.large_binary()).to_pylist(), n)
    tag = np.zeros(len(first), np.uint64)
    some = np.flatnonzero(np.diff(begin))
    if len(some):
        tag[some] = np.add.reduceat(mix(sets ^ _U(1)), begin[:-1][some])
    mine = np.flatnonzero(tag.view(np.int64)[text_of] == digest)  # of a document with several sets, the text of this one
    order = mine[np.lexsort((digest[mine], ids[mine], band[mine]))]
    again = (band[order][1:] == band[order][:-1]) & (ids[order][1:] == ids[order][:-1]) & (digest[order][1:] == digest[order][:-1])
    order = order[np.concatenate([[True], ~again])] if len(order) else order
    cut = np.flatnonzero(np.concatenate([[True], np.diff(band[order]) != 0])) if len(order) else order
    out_id, out_n, out_root = [], [], []
    for i, j in zip(cut, np.append(cut[1:], len(order)), strict=False):
        members = order[i:j]
        if len(members) < 2:
            continue
        open_ = ids[members][:, None] != ids[members][None, :]
        if apart[members[0]]:  # a group of two tiles: pairs inside one are compared in that tile's own group
            open_ &= side[members][:, None] != side[members][None, :]
        for k in range(at[members[0]]):  # pairs that have met in an earlier bucket
            b = kept[members, k]
            open_ &= (b[:, None] != b[None, :]) | (b == 0)[:, None]
        close = _links([sets[begin[t] : begin[t + 1]] for t in text_of[members]], open_, threshold)
        links = close.sum(1)
        linked = np.flatnonzero(links)
        if not len(linked):
            continue
        root = np.arange(len(members))  # members are in order of id: least index, least id
        while True:
            new = np.minimum(root, np.where(close, root[None, :], len(root)).min(1))
            new = new[new]
            if (new == root).all():
                break
            root = new
        out_id.append(ids[members][linked])
        out_n.append(links[linked])
        out_root.append(ids[members][root[linked]])
    if not out_id:
        return pa.table({"copy_id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    return pa.table({"copy_id": np.concatenate(out_id), "links": np.concatenate(out_n).astype(np.int64), "root": np.concatenate(out_root)})


def similar(
    docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES, group_bytes: int = GROUP_BYTES, tile_rows: int = TILE_ROWS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, copy_id, n_copies, n_links.

    copy_id: least doc_id with the same set of n-grams, n_copies: how many rows have it; n_links: other sets with
    at least one row that reach the threshold; class_id: least doc_id of all that such links and equal sets connect.
    """
    spark = docs.sparkSession
    use_shared_checkpoints(spark)
    bands, rows = bands_for(threshold, recall, max_hashes)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = docs.mapInArrow(lambda it: _sign(it, n, bands, rows), SIGNED).checkpoint()
    some = signed.where("size > 0 and doc_id is not null")
    same = ["size", "digest_a", "digest_b"]
    classes = some.groupBy(*same).agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n_copies"), F.max("bytes").alias("bytes"), F.first("bands").alias("bands"))
    dealt = classes.select("copy_id", "digest_a", "bytes", F.posexplode("bands").alias("at", "band"))
    member = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "copy_id", "digest_a"))
    buckets = dealt.groupBy("band").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), member(1).alias("x"), member(2).alias("y")).where("n > 1")
    tiles = F.greatest(F.ceil(F.col("n") / tile_rows), F.ceil(F.col("b") / group_bytes)).cast("int")
    buckets = buckets.groupBy("n", "b", "x", "y").agg(F.min("band").alias("band")).select("band", tiles.alias("tiles"))
    # the buckets of each candidate, as many as there are bands at most
    found = F.map_from_entries(F.collect_list(F.struct("at", "band")))
    candidates = dealt.join(buckets, "band").groupBy("copy_id", "digest_a", "bytes").agg(found.alias("m"), F.collect_list(F.struct("at", "band", "tiles")).alias("in"))
    kept = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("long")))
    candidates = candidates.select("copy_id", "digest_a", "bytes", kept.alias("kept"), "in").checkpoint()
    count, total = candidates.agg(F.count("*"), F.sum(F.col("bytes") * F.aggregate("in", F.lit(0), lambda a, x: a + x["tiles"]))).first()
    groups = max(spark.sparkContext.defaultParallelism * 4, math.ceil((total or 0) / group_bytes))

    of = candidates.select(F.col("copy_id").alias("doc_id")).distinct()
    texts = docs.where("text is not null").join(F.broadcast(of) if count <= broadcast_rows else of, "doc_id", "left_semi").withColumn("same", F.xxhash64("text")).dropDuplicates(["doc_id", "same"])
    sent = texts.withColumnRenamed("doc_id", "copy_id").join(candidates.drop("bytes"), "copy_id").select("copy_id", "digest_a", "same", "text", "kept", F.explode("in").alias("i")).select("*", "i.*").drop("in", "i")
    sent = sent.withColumn("tile", F.pmod(F.xxhash64("copy_id", "digest_a"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    g = F.when(F.col("tiles") > 1, F.concat_ws("/", "band", F.least("tile", "other"), F.greatest("tile", "other"))).otherwise(F.pmod(F.xxhash64("band"), F.lit(groups)).cast("string"))
    sent = sent.select("copy_id", "digest_a", "same", "text", "band", "at", "kept", F.expr("cast(tile > other as int)").alias("side"), F.expr("tile <> other").alias("apart"), g.alias("g"))
    found = sent.groupBy("g").applyInArrow(lambda t: _verify(t, n, threshold), VERIFIED).groupBy("copy_id", "root").agg(F.sum("links").alias("links")).checkpoint()
    roots = components(found.select(F.col("copy_id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "copy_id")
    links = found.groupBy("copy_id").agg(F.sum("links").alias("n_links"))
    known = classes.select(*same, "copy_id", "n_copies").join(links, "copy_id", "left").join(roots, "copy_id", "left")
    known = known.select(*same, "copy_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "copy_id").alias("class_id"))
    alone = signed.where("size = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return some.select("doc_id", *same).join(known, same).select("doc_id", "class_id", "copy_id", "n_copies", "n_links").union(alone)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without those of which a similar one with a smaller doc_id, directly or through others, is there."""
    found = similar(docs, **options).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
