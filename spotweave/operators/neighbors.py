"""Exact nearest neighbours by an adaptive quadtree, and radius joins by tiled cells: equi-joins, never all pairs.

Points at one place are one entry with its least indices (`places`), so a crowd at a place costs one point. Places are numbered in Morton order
within their sample's square, and pieces of that order give each query its level (`levelled`): the deepest one at which it surely shares a cell, of
side s, with as many points as it needs, so that its k-th neighbour is no farther than s * sqrt(2). Dense parts get small cells and sparse ones large
cells without a cell being split or counted. Then the queries of a level meet, by blocks of `SIDE` x `SIDE` cells, the places of the block
and of two cells around it (`met`): that is exact, and no round follows. As a cell one level deeper surely holds fewer than k
others, few queries look at any place. Blocks of more than `TILE` places are tiled, and what tiles find is merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import meet, numbered

#: Bits of each axis in the Morton order, cells of a block's side, places of a piece of the order, and of a tile.
BITS, SIDE, PIECE, TILE = 26, 8, 4096, 4096


def places(points: DataFrame, k: int) -> DataFrame:
    """(sample_id, x, y, ids): the k least spot_idx of each place; rows without coordinates are left out. Points are numbered by range, so a crowded place is many tasks."""
    there = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select("sample_id", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"), "spot_idx")
    few = numbered(there, ["sample_id", "x", "y"], ["spot_idx"], "_k").where(F.col("_k") < k)
    return few.groupBy("sample_id", "x", "y").agg(F.array_sort(F.collect_list("spot_idx")).alias("ids"))  # k at most


def _spread(c: Column) -> Column:
    """Each bit of a whole number of BITS bits at twice its place."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def located(entries: DataFrame) -> DataFrame:
    """Adds cx, cy, the cell of the deepest level in the square around a sample, and the Morton code of both."""
    span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    frame = entries.groupBy("sample_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), span.alias("span"))
    cell = lambda c, low: F.least(F.floor((F.col(c) - F.col(low)) / F.when(F.col("span") > 0, F.col("span")).otherwise(1.0) * 2.0**BITS), F.lit(2**BITS - 1)).cast("long")
    at = meet(entries, frame, ["sample_id"]).withColumns({"cx": cell("x", "x0"), "cy": cell("y", "y0")}).drop("x0", "y0", "span")
    return at.withColumn("code", F.shiftleft(_spread(F.col("cx")), 1).bitwiseOR(_spread(F.col("cy"))))


def levelled(entries: DataFrame, need: int) -> DataFrame:
    """Adds each entry's level: the deepest at which a cell holds it and `need` points (entries with ids), told by runs of the Morton order in a piece
    of it; 0, the whole square, where the piece has too few."""
    ranked = numbered(located(entries), ["sample_id"], ["code", "x", "y"], "_r", total="_n")
    piece = F.least(F.expr(f"_r div {PIECE}"), F.greatest(F.expr(f"_n div {PIECE} - 1"), F.lit(0)))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("_r", "_n").schema.fields) + ", level int"

    def run(group: pa.Table) -> pa.Table:
        group = group.drop_columns(["_piece"]).sort_by("code")
        code = group["code"].to_numpy()
        points = code[group["ids"].is_valid().to_numpy()]
        level, at = np.zeros(len(code), np.int32), np.searchsorted(points, code)
        for back in range(need + 1) if len(points) >= need else ():
            first, last = at - back, at - back + need - 1
            ok = (first >= 0) & (last < len(points))
            low, high = np.minimum(points[np.where(ok, first, 0)], code), np.maximum(points[np.where(ok, last, 0)], code)
            same = BITS - (np.frexp((low ^ high).astype(np.float64))[1] + 1) // 2  # codes are below 2^52: exact
            level = np.maximum(level, np.where(ok, same, 0)).astype(np.int32)
        ids = group.schema.get_field_index("ids")
        return group.set_column(ids, "ids", group["ids"].cast(pa.list_(pa.int64()))).append_column("level", pa.array(level))

    return ranked.withColumn("_piece", piece).drop("_r", "_n").groupBy("sample_id", "_piece").applyInArrow(run, shape)


BLOCK = ["sample_id", "level", "bx", "by"]


def _around_block(c: str) -> Column:
    """The blocks of a level that a cell lies in, or within two cells of."""
    at = F.expr(f"shiftright({c}, {BITS} - level)")
    return F.array_distinct(F.array(F.floor((at - 2) / SIDE), F.floor((at + 2) / SIDE)))


def met(entries: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    """(sample_id, x, y, found): for each query place the k nearest points' (d2, dst) in order. entries: sample_id, x, y, ids, query, cx, cy, level."""
    own = lambda c: F.expr(f"shiftright({c}, {BITS} - level) div {SIDE}")
    asked = entries.where("query").select("sample_id", "level", own("cx").alias("bx"), own("cy").alias("by"), "x", "y")
    used = asked.groupBy("sample_id").agg(F.collect_set("level").alias("used"))  # a sample has BITS + 1 levels at most
    sent = meet(entries.where("ids is not null").drop("level"), used, ["sample_id"]).withColumn("level", F.explode("used"))
    sent = sent.withColumn("bx", F.explode(_around_block("cx"))).withColumn("by", F.explode(_around_block("cy"))).select(*BLOCK, "x", "y", "ids")
    sizes = meet(sent.groupBy(*BLOCK).agg(F.count("*").alias("n")), asked.select(*BLOCK).distinct(), BLOCK, "left_semi").select(*BLOCK, F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    of = F.pmod(F.xxhash64("x", "y"), F.col("tiles")).cast("int")
    points = meet(sent, sizes, BLOCK).withColumn("tile", of)
    queries = meet(asked.withColumn("ids", F.lit(None).cast(entries.schema["ids"].dataType)), sizes, BLOCK).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    both = points.unionByName(queries).repartition(*BLOCK, "tile")
    kind = entries.schema["sample_id"].dataType.simpleString()
    shape = f"sample_id {kind}, x double, y double, tiles int, found array<struct<d2:double,dst:bigint>>"

    def run(group: pa.Table) -> pa.Table:
        is_point = group["ids"].is_valid()
        p, q = group.filter(is_point).combine_chunks(), group.filter(pc.invert(is_point)).combine_chunks()
        px, py, qx, qy = (t[c].to_numpy() for t in (p, q) for c in "xy")
        ids = p["ids"].combine_chunks()
        at, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        first, many = flat[at[:-1]], np.diff(at)
        rows, counts = [], []
        for lo in range(0, len(qx) if len(px) else 0, 256):
            d2 = (qx[lo : lo + 256, None] - px) ** 2 + (qy[lo : lo + 256, None] - py) ** 2
            if len(px) > k:
                far = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
                i, j = np.nonzero(d2 <= far)
            else:
                i, j = (x.ravel() for x in np.indices(d2.shape))
            d = d2[i, j]
            order = np.lexsort((first[j], d, i))
            i, j, d = i[order], j[order], d[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k  # k places with their least indices hold the k points
            i, j, d = i[keep], j[keep], d[keep]
            entry = np.repeat(at[:-1][j], many[j]) + np.arange(many[j].sum()) - np.repeat(np.cumsum(many[j]) - many[j], many[j])
            i, d, dst = np.repeat(i, many[j]), np.repeat(d, many[j]), flat[entry]
            order = np.lexsort((dst, d, i))
            i, d, dst = i[order], d[order], dst[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            counts.append(np.bincount(i[keep], minlength=len(d2)))
            rows.append((d[keep], dst[keep]))
        n = np.concatenate(counts) if counts else np.zeros(len(qx), np.int64)
        d, dst = (np.concatenate([r[c] for r in rows]) if rows else np.zeros(0, t) for c, t in ((0, np.float64), (1, np.int64)))
        found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(dst, pa.int64())], ["d2", "dst"]))
        return pa.table({c: q[c] for c in ("sample_id", "x", "y", "tiles")} | {"found": found})

    each = both.groupBy(*BLOCK, "tile").applyInArrow(run, shape)
    whole = each.where("tiles = 1").select("sample_id", "x", "y", "found")
    parts = each.where("tiles > 1").groupBy("sample_id", "x", "y").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))  # k of each tile
    return whole.union(parts)


def nearest(queries: DataFrame, points: DataFrame, k: int = 1, other: bool = False, tile: int = TILE) -> DataFrame:
    """(sample_id, src, dst, d2, rank): the k points nearest to each query of the same sample, ties to the least index. Rows without
    coordinates are neither. Both have sample_id, spot_idx, x, y. other: queries and points are the same spots, and none is its own neighbour."""
    more = k + 1 if other else k
    at = places(points, more)
    asked = queries.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select("sample_id", F.col("spot_idx").alias("src"), (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))
    entries = at.withColumn("query", F.lit(other))
    if not other:
        entries = entries.unionByName(asked.select("sample_id", "x", "y").distinct().select("*", F.lit(None).cast(at.schema["ids"].dataType).alias("ids"), F.lit(True).alias("query")))
    found = met(levelled(entries, more).checkpoint(), more, tile)
    own = F.filter("found", lambda f: f["dst"] != F.col("src")) if other else F.col("found")
    each = meet(asked, found, ["sample_id", "x", "y"]).select("sample_id", "src", F.posexplode(F.slice(own, 1, k)).alias("rank", "f"))
    return each.select("sample_id", "src", "f.dst", "f.d2", (F.col("rank") + 1).alias("rank"))


def knn_spatial(spots: DataFrame, k: int = 6) -> DataFrame:
    return nearest(spots, spots, k, other=True)


def nearest_neighbor_distance(spots: DataFrame) -> DataFrame:
    return nearest(spots, spots, 1, other=True).select("sample_id", F.col("src").alias("spot_idx"), F.sqrt("d2").alias("distance"))


def median_pitch(spots: DataFrame) -> DataFrame:
    return nearest_neighbor_distance(spots).groupBy("sample_id").agg(F.percentile("distance", 0.5).alias("pitch"))


def symmetrize_edges(edges: DataFrame) -> DataFrame:
    """(sample_id, src, dst) and its reverse; a mutual pair is there twice."""
    return edges.select("sample_id", "src", "dst").unionAll(edges.select("sample_id", F.col("dst").alias("src"), F.col("src").alias("dst")))


def knn_graph_symmetric(spots: DataFrame, k: int = 6, pitch: float = 1.0) -> DataFrame:
    """Edges both ways with the offset of dst from src in pitches."""
    at = lambda n: spots.select("sample_id", F.col("spot_idx").alias(n), F.col("x").alias(f"{n}_x"), F.col("y").alias(f"{n}_y"))
    e = symmetrize_edges(knn_spatial(spots, k)).join(at("src"), ["sample_id", "src"]).join(at("dst"), ["sample_id", "dst"])
    return e.select("sample_id", "src", "dst", ((F.col("dst_x") - F.col("src_x")) / pitch).alias("rel_x"), ((F.col("dst_y") - F.col("src_y")) / pitch).alias("rel_y"))


def radius_join(centers: DataFrame, points: DataFrame, radius: float, tile: int = TILE) -> DataFrame:
    """(pair_id, c_idx, dst, d2) of a pair's points within the radius, the rim included. centers: pair_id, c_idx, x, y; points: pair_id, spot_idx, x, y.

    Points lie in cells as wide as the radius; a center looks at the 3 x 3 cells around it. Cells with more than `tile` points, or looked at by
    more centers than that, are cut into tiles of both, and each pair of tiles is a key of its own, so a crowded cell is many tasks.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    key = ["pair_id", "cx", "cy"]
    c = centers.select("pair_id", "c_idx", "x", "y", F.explode(near).alias("s")).select("pair_id", "c_idx", "x", "y", "s.cx", "s.cy")
    p = points.select("pair_id", F.col("spot_idx").alias("dst"), F.col("x").alias("px"), F.col("y").alias("py"), cell("x").alias("cx"), cell("y").alias("cy"))
    crowded = lambda df, n: df.groupBy(*key).agg(F.ceil(F.count("*") / tile).cast("int").alias(n)).where(F.col(n) > 1)
    hot = crowded(p, "np").join(crowded(c, "nc"), key, "full").select(*key, F.coalesce("np", F.lit(1)).alias("np"), F.coalesce("nc", F.lit(1)).alias("nc")).checkpoint()  # few cells

    def dealt(df: DataFrame, idx: str, own: str, other: str) -> DataFrame:
        n = lambda of: F.coalesce(of, F.lit(1))
        placed = df.join(hot, key, "left").withColumn(f"t_{own}", F.pmod(F.xxhash64(idx), n(f"n{own}")).cast("int"))
        return placed.withColumn(f"t_{other}", F.explode(F.sequence(F.lit(0), n(f"n{other}") - 1))).drop("np", "nc")

    found = dealt(c, "c_idx", "c", "p").join(dealt(p, "dst", "p", "c"), [*key, "t_c", "t_p"]).withColumn("d2", (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
    return found.where(F.col("d2") <= radius * radius).select("pair_id", "c_idx", "dst", "d2")


def snap_to_nearest(predictions: DataFrame, spots_a: DataFrame) -> DataFrame:
    """Each prediction (pair_id, b_idx, x, y) moved to the nearest A spot of its pair."""
    q = predictions.select(F.col("pair_id").alias("sample_id"), F.col("b_idx").alias("spot_idx"), "x", "y")
    p = spots_a.select(F.col("pair_id").alias("sample_id"), "spot_idx", "x", "y")
    found = nearest(q, p, 1).join(p.select("sample_id", F.col("spot_idx").alias("dst"), "x", "y"), ["sample_id", "dst"])
    return found.select(F.col("sample_id").alias("pair_id"), F.col("src").alias("b_idx"), F.col("dst").alias("a_idx"), "x", "y", F.sqrt("d2").alias("moved"))


def soft_target(partner: DataFrame, spots_a: DataFrame, pitch: float, sigma_pitch: float) -> DataFrame:
    """(pair_id, b_idx, a_idx, w): Gaussian weights of A spots within 4 sigma of the partner, one in sum for each B."""
    sigma = sigma_pitch * pitch
    at = partner.where("a_idx >= 0").join(spots_a.select("pair_id", F.col("spot_idx").alias("a_idx"), "x", "y"), ["pair_id", "a_idx"])
    near = radius_join(at.select("pair_id", F.col("b_idx").alias("c_idx"), "x", "y"), spots_a, 4.0 * sigma).withColumn("g", F.exp(-F.col("d2") / (2.0 * sigma * sigma)))
    return near.select("pair_id", F.col("c_idx").alias("b_idx"), F.col("dst").alias("a_idx"), weight_normalize("g", "pair_id", "c_idx").alias("w"))


def weight_normalize(col: str, *by: str):
    return F.col(col) / F.sum(col).over(Window.partitionBy(*by))


def message_hop(edges: DataFrame, features: DataFrame, width: int | None = None) -> DataFrame:
    """Per node: its features plus the mean of neighbours' features over its incoming edges (dst is the node), and the
    mean offset; nodes without edges keep their features and zero offset. features: sample_id, spot_idx, z.

    A vector travels once for each edge; its sums, partial before the shuffle, are columns of one aggregate, and are exploded
    at the end. width: of the vectors (measured if it isn't given).
    """
    if width is None:
        width = features.agg(F.max(F.size("z"))).first()[0] or 0
    values = edges.join(features.select("sample_id", F.col("spot_idx").alias("src"), "z"), ["sample_id", "src"], "left")
    mean = [F.avg(F.get("z", F.lit(k))).alias(f"m{k}") for k in range(width)]
    sums = values.groupBy("sample_id", "dst").agg(F.avg("rel_x").alias("off_x"), F.avg("rel_y").alias("off_y"), *mean).withColumnRenamed("dst", "spot_idx")
    sums = sums.select("sample_id", "spot_idx", "off_x", "off_y", F.array(*[F.col(f"m{k}") for k in range(width)]).cast("array<double>").alias("m"))
    zero = F.lit(0.0)
    out = features.join(sums, ["sample_id", "spot_idx"], "left").select("sample_id", "spot_idx", F.posexplode("z").alias("dim", "own"), "m", F.coalesce("off_x", zero).alias("off_x"), F.coalesce("off_y", zero).alias("off_y"))
    return out.select("sample_id", "spot_idx", "dim", (F.col("own") + F.coalesce(F.get("m", F.col("dim")), zero)).alias("z"), "off_x", "off_y")
