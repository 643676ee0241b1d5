"""Expression features and soft matching. expr: sample_id, spot_idx, gene_idx, count (absent rows are zero)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vectors import dot, finite

SPOT = ["sample_id", "spot_idx"]


def library_size(expr: DataFrame, spots: DataFrame | None = None) -> DataFrame:
    """Total count of each spot, 1 where it is 0. spots: those without any row get 1 too."""
    s = expr.groupBy(*SPOT).agg(F.sum("count").alias("size"))
    if spots is not None:
        s = spots.select(*SPOT).join(s, SPOT, "left")
    return s.select(*SPOT, F.when(F.coalesce("size", F.lit(0.0)) == 0, 1.0).otherwise(F.col("size")).alias("size"))


def lognorm(expr: DataFrame, scale: float = 1e4) -> DataFrame:
    """log(1 + count * scale / library size); zeros stay absent."""
    w = F.sum("count").over(Window.partitionBy(*SPOT))
    return expr.where("count <> 0").select(*SPOT, "gene_idx", F.log1p(F.col("count") * scale / F.when(w == 0, 1.0).otherwise(w)).alias("v"))


def pack(values: DataFrame) -> DataFrame:
    """A row for each spot: genes and v, two arrays of one length, made once for all that multiplies them (at most an entry for each gene)."""
    entries = F.collect_list(F.struct("gene_idx", "v"))
    return values.where("gene_idx is not null and v is not null").groupBy(*SPOT).agg(entries.alias("e")).select(*SPOT, F.col("e.gene_idx").alias("genes"), F.col("e.v").alias("v"))


#: Numbers of a block of the basis that is sent to all tasks at once; a larger basis goes in several, some dimensions each.
BLOCK_NUMBERS = 32_000_000


def _runs(column: pa.ListArray, most: int, rows: int | None = None):
    """Ranges of rows with about `most` entries each (and of `rows` rows at most), and their entries' bounds."""
    at = column.offsets.to_numpy().astype(np.int64)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, min(int(np.searchsorted(at, at[lo] + most, "right")) - 1, lo + (rows or len(column))))
        yield lo, hi, at[lo : hi + 1]
        lo = hi


def _products(place: np.ndarray, v: np.ndarray, bounds: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense block: entries (place in the block or -1, value), rows by bounds."""
    out = np.zeros((len(bounds) - 1, block.shape[1]))
    ok = place >= 0
    row = np.repeat(np.arange(len(out)), np.diff(bounds))[ok]
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first]] = np.add.reduceat(v[ok, None] * block[place[ok]], first)
    return out


def project_packed(rows: DataFrame, basis: DataFrame, numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """(sample_id, spot_idx, dim, z) = sum over genes of v * basis, from packed rows. basis: gene_idx, dim, w.

    Rows stay where they are: the basis, a block of its genes and dimensions, is sent to the tasks, and a task multiplies some rows at a time. Its size is
    checked; a basis of more than `numbers` goes in several blocks of dimensions, each a pass over the rows. A spot gets a dimension if any
    of its genes has a weight there.
    """
    spark = rows.sparkSession
    basis = basis.where("gene_idx is not null and dim is not null and w is not null").groupBy("gene_idx", "dim").agg(F.sum("w").alias("w"))
    n_genes, dims = basis.agg(F.countDistinct("gene_idx"), F.array_sort(F.collect_set("dim"))).first()
    at_once = max(1, numbers // max(n_genes, 1))
    names = [f.name for f in rows.schema.fields if f.name in SPOT]
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    parts = []
    for lo in range(0, max(len(dims), 1), at_once):
        some = dims[lo : lo + at_once]
        found = basis.where(F.col("dim").isin(some)).toArrow() if some else basis.limit(0).toArrow()  # at most `numbers` numbers
        gene, dim, w = (found[c].to_numpy() for c in ("gene_idx", "dim", "w"))
        genes, places = np.unique(gene, return_inverse=True)
        block = np.zeros((len(genes), len(some)))
        block[places, np.searchsorted(some, dim)] = w
        full = len(w) == block.size
        weighed = np.zeros(block.shape if not full else (0, 0))
        if not full:
            weighed[places, np.searchsorted(some, dim)] = 1.0
        shared = spark.sparkContext.broadcast((genes, block, weighed, np.array(some, np.int32)))

        def run(batches, shared=shared):
            genes, block, weighed, some = shared.value
            for batch in batches:
                column = batch.column("genes")
                flat, v = column.values.to_numpy(), batch.column("v").values.to_numpy()
                for lo, hi, at in _runs(column, 200_000):
                    g = flat[at[0] : at[-1]]
                    place = np.minimum(np.searchsorted(genes, g), max(len(genes) - 1, 0))
                    place = np.where(genes[place] == g, place, -1) if len(genes) else np.full(len(g), -1)
                    z = _products(place, v[at[0] : at[-1]], at - at[0], block)
                    there = _products(place, np.ones(len(place)), at - at[0], weighed) > 0 if weighed.size else np.repeat((np.add.reduceat(place >= 0, at[:-1] - at[0]) > 0)[:, None], z.shape[1], 1) if len(g) else np.zeros(z.shape, bool)
                    i, k = np.nonzero(there)
                    keys = [batch.column(n).take(pa.array(lo + i)) for n in names]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(some[k]), pa.array(z[i, k])], [*names, "dim", "z"])

        parts.append(rows.mapInArrow(run, f"{kinds}, dim int, z double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select(*SPOT, "dim", "z")


def project_basis(values: DataFrame, basis: DataFrame, numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """project_packed of (sample_id, spot_idx, gene_idx, v): one exchange, by spot, which those of `lognorm` already lie by."""
    return project_packed(pack(values), basis, numbers)


def standardize_global(z: DataFrame, training: DataFrame | None = None) -> DataFrame:
    stats = (z if training is None else training).groupBy("dim").agg(F.avg("z").alias("mu"), F.stddev_pop("z").alias("sd"))
    return z.join(stats, "dim").select(*SPOT, "dim", ((F.col("z") - F.col("mu")) / (F.col("sd") + 1e-6)).alias("z"))


def standardize_per_slice(z: DataFrame) -> DataFrame:
    w = Window.partitionBy("sample_id", "dim")
    return z.select(*SPOT, "dim", ((F.col("z") - F.avg("z").over(w)) / (F.stddev_pop("z").over(w) + 1e-6)).alias("z"))


#: Genes of one block of the products, and partial blocks that one task adds up. Numbers of the dense piece of the matrix that a task multiplies at once.
GENE_BLOCK, FAN, PIECE = 1024, 32, 1 << 22


def _gram_blocks(rows: DataFrame, tasks: int, shared, fan: int = FAN, gene_block: int = GENE_BLOCK, piece: int = PIECE) -> DataFrame:
    """(block, p, q, r) of the matrix product rows' * (rows * Q): a row for each block of genes, with the block (p) and its own QR factors, as bytes of doubles.

    A task multiplies some spots at a time, as a dense piece of these spots and the genes that they have, and adds up the products in blocks of genes; `fan` of the `tasks` tasks' blocks
    meet in one group, their sums in the next, and so on (a tree), and the last group of a block also takes its QR: the local part of a tall-skinny one.
    """

    def multiply(batches):
        q = shared.value
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column("genes")
            gene, v = column.values.to_numpy(), batch.column("v").values.to_numpy()
            for lo, hi, at in _runs(column, 200_000, max(1, piece // len(q))):
                g, w, row = gene[at[0] : at[-1]], v[at[0] : at[-1]], np.repeat(np.arange(hi - lo), np.diff(at))
                ok = (g >= 0) & (g < len(q))
                if not ok.all():
                    g, w, row = g[ok], w[ok], row[ok]
                there = np.zeros(len(q), bool)
                there[g] = True
                here = np.flatnonzero(there)
                place = row * len(here) + (np.cumsum(there) - 1)[g]
                dense = np.bincount(place, w, (hi - lo) * len(here)).reshape(hi - lo, len(here))  # entries of one place are added up
                sums = dense.T @ (dense @ q[here])
                for b in np.unique(here // gene_block):
                    mine = here // gene_block == b
                    block = total.setdefault(int(b), np.zeros((min(gene_block, len(q) - b * gene_block), q.shape[1])))
                    block[here[mine] - b * gene_block] += sums[mine]
        part = TaskContext.get().partitionId()
        for b, block in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["block", "part", "p"])

    def added(group: pa.Table) -> np.ndarray:
        out = np.zeros(len(group["p"][0].as_py()) // 8)
        for x in group["p"]:
            out += np.frombuffer(x.as_buffer())
        return out

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"block": group["block"].slice(0, 1), "part": pa.array([group["part"][0].as_py() // fan], pa.int32()), "p": pa.array([added(group).tobytes()], pa.binary())})

    def last(group: pa.Table) -> pa.Table:
        p = added(group)
        q, r = np.linalg.qr(p.reshape(-1, shared.value.shape[1]))
        return pa.table({"block": group["block"].slice(0, 1)} | {n: pa.array([x.tobytes()], pa.binary()) for n, x in (("p", p), ("q", q), ("r", r))})

    sums = rows.mapInArrow(multiply, "block int, part int, p binary")
    while tasks > fan:
        sums = sums.groupBy("block", F.expr(f"part div {fan}")).applyInArrow(add, "block int, part int, p binary")
        tasks = math.ceil(tasks / fan)
    return sums.groupBy("block").applyInArrow(last, "block int, p binary, q binary, r binary")


def svd_basis_packed(rows: DataFrame, k: int, n_genes: int, extra: int = 10, rounds: int = 4, seed: int = 0, gene_block: int = GENE_BLOCK, fan: int = FAN, piece: int = PIECE) -> DataFrame:
    """(gene_idx, dim, w): the top k right singular vectors of the stacked spots x genes matrix, not centred, from packed rows, which should be persisted: each round reads them.

    Randomised subspace iteration, one job each round: see _gram_blocks. The driver gets a row of bytes for each block of genes (a few, as genes
    are a panel of fixed size), takes the QR of the blocks' small R factors, and sends the blocks' Q factors on.
    Signs are such that the largest weight of a dimension is positive. Genes beyond n_genes count as absent.
    """
    spark, width = rows.sparkSession, min(k + extra, n_genes)
    rows = rows.select("genes", "v")
    tasks = rows.rdd.getNumPartitions()
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_genes, width)))[0]

    def times(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The product with the Gram matrix, and its orthonormal columns."""
        shared = spark.sparkContext.broadcast(q)
        found = _gram_blocks(rows, tasks, shared, fan, gene_block, piece).toArrow().sort_by("block").to_pylist()
        shared.unpersist()
        p, small = np.zeros((n_genes, width)), [np.frombuffer(x["r"]).reshape(-1, width) for x in found]
        turn = np.linalg.qr(np.concatenate(small))[0] if small else np.zeros((0, width))
        out, at = np.zeros((n_genes, turn.shape[1])), 0
        for x, r in zip(found, small, strict=True):
            here = slice(x["block"] * gene_block, min((x["block"] + 1) * gene_block, n_genes))
            p[here] = np.frombuffer(x["p"]).reshape(-1, width)
            out[here] = np.frombuffer(x["q"]).reshape(-1, len(r)) @ turn[at : at + len(r)]
            at += len(r)
        return p, out

    for _ in range(rounds):
        q = times(q)[1]
        width = q.shape[1]
    gram = q.T @ times(q)[0]
    _, turn = np.linalg.eigh((gram + gram.T) / 2)
    v = (q @ turn[:, ::-1])[:, :k]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0) if v.size else v
    gene, dim = np.nonzero(v)
    table = pa.table({"gene_idx": pa.array(gene, pa.int32()), "dim": pa.array(dim, pa.int32()), "w": pa.array(v[gene, dim], pa.float64())})
    return spark.createDataFrame(table)


def shared_svd_basis(values: DataFrame, k: int, n_genes: int, **how) -> DataFrame:
    """svd_basis_packed of (sample_id, spot_idx, gene_idx, v), packed and kept while it runs."""
    rows = pack(values.where(F.col("gene_idx").between(0, n_genes - 1))).select("genes", "v").persist()
    try:
        return svd_basis_packed(rows, k, n_genes, **how)
    finally:
        rows.unpersist()


def packed_image(rows: DataFrame, z: DataFrame, dims: int) -> DataFrame:
    """(gene_idx, dim, g) = sum over spots of v * z, for dimensions 0 to dims - 1: packed rows, transposed, times z (sample_id, spot_idx, dim, z).

    z goes beside its spot's packed row, a column a dimension, so a row leaves the join for each spot, and one entry for each gene of it meets all dimensions at once.
    """
    at = [f"_z{k}" for k in range(dims)]
    wide = z.groupBy(*SPOT).agg(*[F.sum(F.when(F.col("dim") == k, F.col("z"))).alias(n) for k, n in enumerate(at)])
    entries = rows.join(wide, SPOT).select(F.explode(F.arrays_zip("genes", "v")).alias("e"), *at)
    sums = entries.groupBy(F.col("e.genes").alias("gene_idx")).agg(*[F.sum(F.col("e.v") * F.col(n)).alias(n) for n in at])
    return sums.select("gene_idx", F.posexplode(F.array(*at)).alias("dim", "g")).where("g is not null")


#: All-pairs work is dealt into blocks. A side of more than SMALL spots goes in several, up to SPLIT, so that there is work for many tasks; past that its blocks grow up to BLOCK spots,
#: so a row is sent SPLIT times at most until a side has SPLIT * BLOCK spots. A task holds the two blocks, and STRIP scores at a time.
SMALL, SPLIT, BLOCK, STRIP = 2048, 4, 32_768, 1 << 21


def with_vectors(qk: DataFrame) -> DataFrame:
    """Rows whose vector has finite numbers alone: one NaN makes every comparison of its block false."""
    return qk.where(F.col("v").isNotNull() & F.forall("v", lambda x: finite(x)))


def _narrowed(v) -> list:
    """A vector in two columns: as floats where these are all its numbers, as most tables have them, else as it is. Half the bytes of each copy that is sent."""
    exact = F.coalesce(F.forall(v, lambda x: x.cast("float").cast("double") == x), F.lit(False))
    return [F.when(exact, v.cast("array<float>")).alias("_v4"), F.when(~exact, v).alias("_v8")]


def _widened(t: pa.Table) -> pa.Table:
    """The rows with their vectors as they were, in the place of the two columns."""
    v = t["_v4"].cast(pa.list_(pa.float64()))
    if t["_v8"].null_count < len(v):
        v = pc.coalesce(t["_v8"].cast(v.type), v)
    return t.drop_columns(["_v4", "_v8"]).append_column("v", v)


def _by_block(qk: DataFrame, score, schema: str, block: int = BLOCK, whole: bool = False, few: bool = True) -> DataFrame:
    """All A spots against all B spots of each pair of slices: the work is the sum of n_a * n_b by definition.

    Both sides of a pair are dealt by hash into blocks of at most about `block` spots, and each (B block, A block) is a group
    of its own, so a pair that holds a third of all rows is many tasks. Rows without a vector, or with one that isn't of finite numbers, are left out (unless whole).
    Each row is sent once per two blocks of the other side, by groups and not by its pair, which would leave a pair to one task. `score(pair_id, b, a)` takes the two tables of a group, of B some
    rows at a time: STRIP scores, and what it returns leaves the task at once. few: the pairs' sizes (a row for each) are sent to all tasks, so rows aren't exchanged to meet them.
    """
    qk = qk if whole else with_vectors(qk)
    n = lambda s: F.count_if(F.col("side") == s)
    blocks = lambda s: F.greatest(F.ceil(n(s) / block), F.least(F.ceil(n(s) / min(block, SMALL)), F.lit(SPLIT)), F.lit(1)).cast("int")
    sizes = qk.groupBy("pair_id").agg(*[blocks(s).alias(f"n_{s}") for s in "AB"])
    is_b = F.col("side") == "B"
    dealt = qk.where("side in ('A', 'B')").join(F.broadcast(sizes) if few else sizes, "pair_id").withColumn("own", F.pmod(F.xxhash64("spot_idx"), F.when(is_b, F.col("n_B")).otherwise(F.col("n_A"))).cast("int"))
    # two blocks of each side share a partition, so a row is sent once for two of its groups. Their number is set: by bytes, which are few here, Spark would put many groups' work into one task
    dealt = dealt.withColumn("_of", F.when(is_b, F.col("n_A")).otherwise(F.col("n_B"))).drop("n_A", "n_B")
    sent = dealt.withColumn("_half", F.explode(F.expr("sequence(0, (_of - 1) div 2)"))).withColumn("_own", F.expr("own div 2"))
    if "v" in sent.columns:
        sent = sent.select(*[c for c in sent.columns if c != "v"], *_narrowed(F.col("v")))
    either = lambda b, a: F.when(is_b, F.col(b)).otherwise(F.col(a)).cast("int")
    sent = sent.withColumn("b_half", either("_own", "_half")).withColumn("a_half", either("_half", "_own")).drop("_own", "_half")
    sent = sent.repartition(int(qk.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair_id", "b_half", "a_half")
    other = F.expr("explode(sequence(2 * if(side = 'B', a_half, b_half), least(2 * if(side = 'B', a_half, b_half) + 1, _of - 1)))")
    sent = sent.select("*", other.alias("other")).withColumn("b_block", either("own", "other")).withColumn("a_block", either("other", "own")).drop("own", "other", "_of")
    out = pa.schema(list(zip(_fields(schema), _arrow(schema), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _widened(pa.Table.from_batches(list(batches)))
        side = group["side"].combine_chunks()
        b, a = (group.filter(pc.equal(side, s)).combine_chunks() for s in "BA")
        if not b.num_rows or not a.num_rows:
            return
        pair, rows = group["pair_id"][0].as_py(), max(1, STRIP // a.num_rows)
        for lo in range(0, b.num_rows, rows):
            found = score(pair, b.slice(lo, rows).combine_chunks(), a)
            yield from pa.table(dict(zip(out.names, found, strict=True))).cast(out).to_batches(max_chunksize=1 << 17)

    return sent.groupBy("pair_id", "b_half", "a_half", "b_block", "a_block").applyInArrow(run, schema)


def _fields(schema: str) -> list:
    return StructType.fromDDL(schema).names


def _arrow(schema: str) -> list:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return [kinds[f.dataType.simpleString()] for f in StructType.fromDDL(schema).fields]


def _matrix(t: pa.Table, of: str = "v") -> np.ndarray:
    v = t[of].chunk(0) if t[of].num_chunks else t[of].combine_chunks()
    if not len(v.values):
        return np.zeros((t.num_rows, 0))
    return v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _ids(t: pa.Table) -> np.ndarray:
    return t["spot_idx"].to_numpy()


def _every(pair, b: pa.Table, a: pa.Table, scores: np.ndarray) -> tuple:
    """A row for each score of a block, by A spot and then the strip's few B spots: columns of runs and of short periods, which files keep in some bits a row. By B spot, a period is a block of A."""
    return pa.repeat(pair, scores.size), np.tile(_ids(b), a.num_rows), np.repeat(_ids(a), b.num_rows), scores.T.ravel()


def _nearest(k: int):
    """The k nearest A spots of each B spot of a block, by (distance, index). A matrix product with a margin for its
    rounding finds who can be among them; their distances are then summed in one order, so ties are exact."""

    def score(pair, b: pa.Table, a: pa.Table) -> tuple:
        bv, av, b_id, a_id = _matrix(b), _matrix(a), _ids(b), _ids(a)
        b2, a2 = (bv * bv).sum(1), (av * av).sum(1)
        out = []
        for lo in range(0, len(bv), 64):
            part = slice(lo, lo + 64)
            near = b2[part, None] + a2[None, :] - 2 * (bv[part] @ av.T)
            kth = np.partition(near, min(k, len(av)) - 1, axis=1)[:, min(k, len(av)) - 1]
            i, j = np.nonzero(near <= (kth + 1e-9 * (b2[part] + a2.max()))[:, None])
            exact = np.zeros(len(i))
            for c in range(bv.shape[1]):
                exact += (bv[lo + i, c] - av[j, c]) ** 2
            exact = np.sqrt(exact)
            order = np.lexsort((a_id[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            out.append((b_id[lo + i[rank < k]], a_id[j[rank < k]], exact[rank < k]))
        b_idx, a_idx, distance = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.repeat(pair, len(b_idx)), b_idx, a_idx, distance

    return score


PAIR = "pair_id string, b_idx long, a_idx long"


def topk_neighbors(qk: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The k nearest A spots in feature space of each B spot, ties to the least index; k rows of a block leave its task."""
    d = _by_block(qk.select("pair_id", "side", "spot_idx", "v"), _nearest(k), f"{PAIR}, distance double", block)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("pair_id", "b_idx").orderBy("distance", "a_idx"))).where(F.col("rank") <= k)


def feature_nn(qk: DataFrame, spots_a: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per B spot the A spot nearest in feature space (ties: least index) and its coordinates."""
    best = topk_neighbors(qk, 1, block).drop("rank")
    return best.join(spots_a.select("pair_id", F.col("spot_idx").alias("a_idx"), "x", "y"), ["pair_id", "a_idx"]).select("pair_id", "b_idx", "a_idx", "distance", "x", "y")


def feature_knn_weighted(qk: DataFrame, spots_a: DataFrame, k: int = 10) -> DataFrame:
    """Mean coordinates of the k nearest A spots, weighted by 1 / (distance + 1e-6)."""
    near = topk_neighbors(qk, k).withColumn("w", 1.0 / (F.col("distance") + 1e-6)).join(spots_a.select("pair_id", F.col("spot_idx").alias("a_idx"), "x", "y"), ["pair_id", "a_idx"])
    return near.groupBy("pair_id", "b_idx").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"))


#: The index: tables of projections, spots of A that a bucket should hold, bits that a query turns over besides its own bucket, and vectors of a pair that the cuts are fitted on.
TABLES, BUCKET, FLIPS, FITTED = 2, 32, 3, 4096


def index_projections(qk: DataFrame, tables: int = TABLES, bucket: int = BUCKET, seed: int = 0) -> DataFrame:
    """(pair_id, bits, width, cuts): the fitted index of each pair. A table has `bits` random directions, as many as make buckets of about `bucket` A spots, each cut at
    the median of a sample of A (the FITTED spots of least hash), so buckets are balanced along each direction. Directions follow from the seed and the width."""
    a = with_vectors(qk).where("side = 'A'")
    n = a.groupBy("pair_id").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * FITTED) / F.col("n"))
    # a hash bound first, so that a window sees some thousand rows of a pair
    few = a.join(n, "pair_id").where(F.pmod(F.xxhash64("spot_idx"), F.lit(1 << 20)) <= share * (1 << 20))
    few = few.withColumn("_k", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.xxhash64("spot_idx"), "spot_idx"))).where(F.col("_k") <= FITTED)

    def fit(group: pa.Table) -> pa.Table:
        v, n = _matrix(group), group["n"][0].as_py()
        bits = int(np.clip(round(math.log2(max(n / bucket, 1))), 1, 20))
        cuts = np.median(v @ _directions(v.shape[1], tables * bits, seed), axis=0)
        return pa.table({"pair_id": group["pair_id"].slice(0, 1), "bits": pa.array([bits], pa.int32()), "width": pa.array([v.shape[1]], pa.int32()), "cuts": pa.array([cuts.tolist()], pa.list_(pa.float64()))})

    return few.select("pair_id", "n", "v").groupBy("pair_id").applyInArrow(fit, "pair_id string, bits int, width int, cuts array<double>")


def _directions(width: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).normal(size=(n, width)).T


def index_buckets(qk: DataFrame, index: DataFrame, tables: int = TABLES, flips: int = FLIPS, seed: int = 0) -> DataFrame:
    """qk's rows (pair_id, side, spot_idx, v) with (table, bucket): an A spot once for each table, a B spot also with each of its `flips` least certain bits turned over, and with
    the two least certain ones together."""
    rows = with_vectors(qk).select("pair_id", "side", "spot_idx", "v").join(index, "pair_id")

    def deal(batches):
        for batch in batches:
            sides, bits, width = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("side", "bits", "width"))
            out = {"i": [], "table": [], "bucket": []}
            for b, w in sorted(set(zip(bits.tolist(), width.tolist(), strict=True))):
                mine = np.flatnonzero((bits == b) & (width == w))
                part = pa.table({c: batch.column(c).take(pa.array(mine)) for c in ("v", "cuts")}).combine_chunks()
                v, cuts = _matrix(part), _matrix(part, "cuts")
                off = (v @ _directions(w, tables * b, seed) - cuts).reshape(len(mine), tables, b)
                own = ((off > 0) << np.arange(b)).sum(2)
                least = np.argsort(np.abs(off), axis=2)[:, :, : min(flips, b)]
                probes = [own] + [own ^ (1 << least[:, :, f]) for f in range(least.shape[2])] + ([own ^ (1 << least[:, :, 0]) ^ (1 << least[:, :, 1])] if least.shape[2] > 1 else [])
                asks = sides[mine] == "B"
                for k, probe in enumerate(probes):
                    to = np.flatnonzero(asks) if k else np.arange(len(mine))
                    out["i"].append(np.repeat(mine[to], tables))
                    out["table"].append(np.tile(np.arange(tables), len(to)))
                    out["bucket"].append(probe[to].ravel())
            if out["i"]:
                i, table, at = (np.concatenate(x) for x in out.values())
                keep = [batch.column(c).take(pa.array(i)) for c in ("pair_id", "side", "spot_idx", "v")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(table.astype(np.int32)), pa.array(at.astype(np.int32))], ["pair_id", "side", "spot_idx", "v", "table", "bucket"])

    return rows.mapInArrow(deal, "pair_id string, side string, spot_idx long, v array<double>, table int, bucket int")


def index_neighbors(qk: DataFrame, k: int, tables: int = TABLES, bucket: int = BUCKET, flips: int = FLIPS, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """topk_neighbors by the index: the k nearest among the A spots that share one of a B spot's buckets, exactly ranked. It finds most, not all: near vectors may lie apart in every
    table; `index_work` counts the distances that it takes. Its worth is for vectors of low intrinsic dimension, such as expression features; among random directions of
    many dimensions no bucket helps. Every A spot is in the index."""
    dealt = index_buckets(qk, index_projections(qk, tables, bucket, seed), tables, flips, seed)
    own = F.concat_ws("/", F.col("pair_id"), F.col("table").cast("string"), F.col("bucket").cast("string"))
    near = _by_block(dealt.select(own.alias("pair_id"), "side", "spot_idx", "v"), _nearest(k), f"{PAIR}, distance double", block, few=False)
    pair = F.expr("substring(pair_id, 1, char_length(pair_id) - char_length(substring_index(pair_id, '/', -2)) - 1)")
    each = near.select(pair.alias("pair_id"), "b_idx", "a_idx", "distance").groupBy("pair_id", "b_idx", "a_idx").agg(F.min("distance").alias("distance"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("pair_id", "b_idx").orderBy("distance", "a_idx"))).where(F.col("rank") <= k)


def index_work(qk: DataFrame, tables: int = TABLES, bucket: int = BUCKET, flips: int = FLIPS, seed: int = 0) -> DataFrame:
    """(pair_id, distances, all_pairs): how many distances `index_neighbors` takes, repeats counted, and how many there are."""
    dealt = index_buckets(qk, index_projections(qk, tables, bucket, seed), tables, flips, seed)
    count = lambda s: F.count_if(F.col("side") == s)
    taken = dealt.groupBy("pair_id", "table", "bucket").agg((count("A") * count("B")).alias("d")).groupBy("pair_id").agg(F.sum("d").alias("distances"))
    return taken.join(with_vectors(qk).groupBy("pair_id").agg((count("A") * count("B")).alias("all_pairs")), "pair_id")


def _scaled(b: pa.Table, a: pa.Table) -> np.ndarray:
    bv, av = _matrix(b), _matrix(a)
    return bv @ av.T / np.sqrt(av.shape[1])


def attention_logits(qk: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pair_id, b_idx, a_idx, logit): dot product over the root of the width."""
    return _by_block(qk.select("pair_id", "side", "spot_idx", "v"), lambda pair, b, a: _every(pair, b, a, _scaled(b, a)), f"{PAIR}, logit double", block)


def _rounded(scores: np.ndarray, digits: int | None) -> np.ndarray:
    """To so many digits, halves away from zero; where scores are made this takes a hundredth of what a column's round does."""
    if digits is None:
        return scores
    scale = 10.0**digits
    return np.copysign(np.floor(np.abs(scores) * scale + 0.5) / scale, scores) + 0.0  # no negative zero


def cosine_match(qk: DataFrame, temperature: float = 0.1, block: int = BLOCK, digits: int | None = None) -> DataFrame:
    """(pair_id, b_idx, a_idx, logit): cosine over the temperature; norms below 1e-12 count as that. digits: logits are rounded to so many."""

    def score(pair, b: pa.Table, a: pa.Table) -> tuple:
        bv, av = (m / np.maximum(np.sqrt((m * m).sum(1)), 1e-12)[:, None] for m in (_matrix(b), _matrix(a)))
        return _every(pair, b, a, _rounded(bv @ av.T / temperature, digits))

    return _by_block(qk.select("pair_id", "side", "spot_idx", "v"), score, f"{PAIR}, logit double", block)


def softmax_over_row(logits: DataFrame) -> DataFrame:
    """(pair_id, b_idx, a_idx, p) from logits of any origin: by a window of each B spot's row."""
    w = Window.partitionBy("pair_id", "b_idx")
    e = logits.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w)))
    return e.select("pair_id", "b_idx", "a_idx", (F.col("e") / F.sum("e").over(w)).alias("p"))


def attention_weights(qk: DataFrame, block: int = BLOCK, digits: int | None = None) -> DataFrame:
    """(pair_id, b_idx, a_idx, p): the softmax of all scaled products of each B spot. Scores never meet: a first pass gives each B spot its greatest score and the sum
    of exponentials, and these go along with its vector into a second one, whose blocks are the result. digits: weights are rounded to so many."""
    q = with_vectors(qk.select("pair_id", "side", "spot_idx", "v"))
    sums = _exponentials(q, block).select("pair_id", F.lit("B").alias("side"), F.col("b_idx").alias("spot_idx"), "top", "e")
    q = q.select("pair_id", "side", "spot_idx", *_narrowed(F.col("v")))
    both = q.join(sums, ["pair_id", "side", "spot_idx"], "left").select(*q.columns, F.coalesce("top", F.lit(0.0)).alias("top"), F.coalesce("e", F.lit(1.0)).alias("e"))

    def score(pair, b: pa.Table, a: pa.Table) -> tuple:
        top, e = (b[c].to_numpy()[:, None] for c in ("top", "e"))
        return _every(pair, b, a, _rounded(np.exp(_scaled(b, a) - top) / e, digits))

    return _by_block(both, score, f"{PAIR}, p double", block, whole=True)  # improper vectors are out already


def attention_match(qk: DataFrame, spots_a: DataFrame, block: int = BLOCK, features: DataFrame | None = None) -> DataFrame:
    """Soft coordinates of each B spot, and with features (pair_id, spot_idx, z, of A) its soft feature z. A block gives one row per B spot,
    (max, sum of exp, sums of exp * coordinate and of exp * feature); these are merged by the row's overall maximum, so scores never leave a task.
    An A spot without coordinates, or without a feature where they are asked for, is left out."""
    q = qk.select("pair_id", "side", "spot_idx", "v")
    at = spots_a.select("pair_id", "spot_idx", "x", "y")
    if features is not None:
        at = at.join(features.where("z is not null").select("pair_id", "spot_idx", "z"), ["pair_id", "spot_idx"])
    else:
        at = at.withColumn("z", F.array().cast("array<double>"))
    placed = q.where("side = 'A'").join(at, ["pair_id", "spot_idx"]).select(*q.columns, "x", "y", "z").union(q.where("side = 'B'").select("*", F.lit(0.0), F.lit(0.0), F.array().cast("array<double>")))

    def score(pair, b: pa.Table, a: pa.Table) -> tuple:
        logit = _scaled(b, a)
        top = logit.max(1)
        e = np.exp(logit - top[:, None])
        soft = e @ _matrix(a, "z")
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(soft) + 1) * soft.shape[1], pa.int32()), pa.array(soft.ravel()))
        return pa.repeat(pair, b.num_rows), _ids(b), top, e.sum(1), e @ a["x"].to_numpy(), e @ a["y"].to_numpy(), lists

    parts = _by_block(placed, score, "pair_id string, b_idx long, top double, e double, ex double, ey double, ez array<double>", block)
    own = ["pair_id", "b_idx"]
    scale = F.exp(F.col("top") - F.max("top").over(Window.partitionBy(*own)))
    parts = parts.withColumn("s", scale)
    merged = parts.groupBy(*own).agg(*[F.sum(F.col("s") * F.col(c)).alias(c) for c in ("e", "ex", "ey")], F.collect_list(F.transform("ez", lambda z: F.col("s") * z)).alias("ez"))  # a list for each block of A
    out = merged.select(*own, (F.col("ex") / F.col("e")).alias("x"), (F.col("ey") / F.col("e")).alias("y"), "ez", "e")
    if features is None:
        return out.drop("ez", "e")
    zero = F.transform(F.get("ez", F.lit(0)), lambda z: F.lit(0.0))
    sums = F.aggregate("ez", zero, lambda s, z: F.zip_with(s, z, lambda a, b: a + b))
    return out.select(*own, "x", "y", F.transform(sums, lambda z: z / F.col("e")).alias("z"))


def match_top1(qk: DataFrame, partner: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per pair the share of bridged B spots whose heaviest A (ties: least index) is the partner. partner: pair_id, b_idx, a_idx.
    A block gives the best of each B spot."""

    def score(pair, b: pa.Table, a: pa.Table) -> tuple:
        bv, av, a_id = _matrix(b), _matrix(a), _ids(a)
        logit = bv @ av.T
        margin = 1e-9 * np.sqrt((bv * bv).sum(1) * (av * av).sum(1).max())
        # a product's rounding depends on the place in the block: what may be the heaviest is summed again in one order, so that equal vectors tie
        i, j = np.nonzero(logit >= (logit.max(1) - margin)[:, None])
        exact = np.zeros(len(i))
        for c in range(bv.shape[1]):
            exact += bv[i, c] * av[j, c]
        order = np.lexsort((a_id[j], -exact, i))
        first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        return pa.repeat(pair, b.num_rows), _ids(b), a_id[j[first]], exact[first] / np.sqrt(av.shape[1])

    parts = _by_block(qk.select("pair_id", "side", "spot_idx", "v"), score, f"{PAIR}, logit double", block)
    best = parts.groupBy("pair_id", "b_idx").agg(F.max(F.struct("logit", (-F.col("a_idx")).alias("i"))).alias("m")).select("pair_id", "b_idx", (-F.col("m.i")).alias("best"))
    return best.join(partner.where("a_idx >= 0"), ["pair_id", "b_idx"]).groupBy("pair_id").agg(F.avg((F.col("best") == F.col("a_idx")).cast("int")).alias("top1"), F.count("*").alias("n"))


def _exponentials(qk: DataFrame, block: int) -> DataFrame:
    """(pair_id, b_idx, top, e, e2): the greatest logit of each B spot, and the sums of exp(logit - top) and of their squares; a block gives its own."""

    def score(pair, b: pa.Table, a: pa.Table) -> tuple:
        logit = _scaled(b, a)
        top = logit.max(1)
        e = np.exp(logit - top[:, None])
        return pa.repeat(pair, b.num_rows), _ids(b), top, e.sum(1), (e * e).sum(1)

    parts = _by_block(qk.select("pair_id", "side", "spot_idx", "v"), score, "pair_id string, b_idx long, top double, e double, e2 double", block)
    parts = parts.withColumn("most", F.max("top").over(Window.partitionBy("pair_id", "b_idx"))).withColumn("s", F.exp(F.col("top") - F.col("most")))
    return parts.groupBy("pair_id", "b_idx").agg(F.max("most").alias("top"), F.sum(F.col("s") * F.col("e")).alias("e"), F.sum(F.col("s") * F.col("s") * F.col("e2")).alias("e2"))


def soft_cross_entropy(qk: DataFrame, target: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per pair the mean over bridged B spots of logsumexp(logits) less the target-weighted logits. target: pair_id, b_idx, a_idx, w.
    Blocks give sums; the few logits with a target are made by an equi-join with it."""
    qk = with_vectors(qk)
    of = lambda side, idx, v: qk.where(F.col("side") == side).select("pair_id", F.col("spot_idx").alias(idx), F.col("v").alias(v))
    few = target.join(of("B", "b_idx", "bv"), ["pair_id", "b_idx"]).join(of("A", "a_idx", "av"), ["pair_id", "a_idx"])
    got = few.groupBy("pair_id", "b_idx").agg(F.sum(F.col("w") * dot(F.col("bv"), F.col("av")) / F.sqrt(F.size("av"))).alias("g"))
    both = _exponentials(qk, block).join(got, ["pair_id", "b_idx"])
    return both.groupBy("pair_id").agg(F.avg(F.col("top") + F.log("e") - F.col("g")).alias("loss"), F.count("*").alias("n"))


def soft_cross_entropy_near(qk: DataFrame, partner: DataFrame, spots_a: DataFrame, pitch: float, sigma_pitch: float, block: int = BLOCK) -> DataFrame:
    """soft_cross_entropy against the soft target of these partners (see neighbors.soft_target), which is never made: a block weighs its A spots by their distance from a B spot's partner where it has
    the logits, and gives sums. A target has a row for each A spot within four sigma, which in slices of one extent grows with the square of the spots."""
    sigma = sigma_pitch * pitch
    at = spots_a.select("pair_id", F.col("spot_idx").alias("a_idx"), "x", "y")
    aims = partner.where("a_idx >= 0").join(at, ["pair_id", "a_idx"]).select("pair_id", F.col("b_idx").alias("spot_idx"), "x", "y")
    of = lambda s: qk.where(F.col("side") == s).select("pair_id", "spot_idx", "v")
    b = with_vectors(of("B")).join(aims, ["pair_id", "spot_idx"])
    # A spots without a proper vector have a share of the weight, those without a place have logits
    a = of("A").join(spots_a.select("pair_id", "spot_idx", "x", "y"), ["pair_id", "spot_idx"], "full")
    proper = F.col("v").isNotNull() & F.forall("v", lambda x: finite(x))
    nowhere = lambda c: F.coalesce(c, F.lit(float("nan"))).alias(c)
    both = b.withColumn("side", F.lit("B")).unionByName(a.withColumn("side", F.lit("A"))).select("pair_id", "side", "spot_idx", "v", nowhere("x"), nowhere("y"), F.coalesce(proper, F.lit(False)).alias("ok"))

    def score(pair, b: pa.Table, a: pa.Table) -> tuple:
        ok = a["ok"].to_numpy()
        px, py, ax, ay = (t[c].to_numpy() for t in (b, a) for c in ("x", "y"))
        logit = np.full((b.num_rows, len(ok)), -np.inf)
        if ok.any():
            logit[:, ok] = _scaled(b, a.filter(a["ok"]).combine_chunks())
        d2 = (ax[None, :] - px[:, None]) ** 2
        d2 += (ay[None, :] - py[:, None]) ** 2
        i, j = np.nonzero(d2 <= (4.0 * sigma) ** 2)
        g, has, of_row = np.exp(-d2[i, j] / (2.0 * sigma * sigma)), ok[j], lambda i, w: np.bincount(i, w, b.num_rows)
        aimed, near = of_row(i[has], g[has] * logit[i[has], j[has]]), np.bincount(i[has], minlength=b.num_rows)
        top = logit.max(1)
        e = np.exp(logit - top[:, None]).sum(1) if ok.any() else np.zeros(b.num_rows)
        return pa.repeat(pair, b.num_rows), _ids(b), top, e, of_row(i, g), aimed, near

    parts = _by_block(both, score, "pair_id string, b_idx long, top double, e double, g double, aimed double, near long", block, whole=True)
    parts = parts.withColumn("most", F.max("top").over(Window.partitionBy("pair_id", "b_idx")))
    each = parts.groupBy("pair_id", "b_idx").agg(F.max("most").alias("top"), F.sum(F.exp(F.col("top") - F.col("most")) * F.col("e")).alias("e"), F.sum("g").alias("g"), F.sum("aimed").alias("aimed"), F.sum("near").alias("near"))
    loss = F.col("top") + F.log("e") - F.col("aimed") / F.col("g")
    return each.where("near > 0").groupBy("pair_id").agg(F.avg(loss).alias("loss"), F.count("*").alias("n"))


def effective_support(qk: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per pair the median over B spots of 1 / sum(p^2), p the softmax of a row: how many A spots a soft match really uses."""
    each = _exponentials(qk, block).select("pair_id", (F.col("e") * F.col("e") / F.col("e2")).alias("support"))
    return each.groupBy("pair_id").agg(F.percentile("support", 0.5).alias("support"))


def make_unique_names(genes: DataFrame) -> DataFrame:
    """Repeated names get -1, -2, ... in order of gene_idx."""
    k = F.row_number().over(Window.partitionBy("gene_name").orderBy("gene_idx")) - 1
    return genes.select("gene_idx", F.when(k == 0, F.col("gene_name")).otherwise(F.concat_ws("-", "gene_name", k)).alias("gene_name"))


def common_genes(expr: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of both slices whose genes are in both."""
    of = lambda s: expr.where(F.col("sample_id") == s).select("gene_idx")
    return expr.where(F.col("sample_id").isin(a, b)).join(of(a).intersect(of(b)), "gene_idx", "left_semi")


def intersect_genes(expr: DataFrame, a: str, b: str) -> DataFrame:
    of = lambda s: expr.where(F.col("sample_id") == s).select("gene_idx")
    return of(a).intersect(of(b))


def gene_difference(expr: DataFrame, a: str, b: str) -> DataFrame:
    """Genes that only one of the slices has, and which lacks it."""
    of = lambda s: expr.where(F.col("sample_id") == s).select("gene_idx").distinct()
    return of(a).exceptAll(of(b)).withColumn("missing_in", F.lit(b)).union(of(b).exceptAll(of(a)).withColumn("missing_in", F.lit(a)))


def assert_same_genes(genes: DataFrame, reference: str) -> DataFrame:
    """(sample_id, gene_idx) where a slice's genes differ from the reference's; no rows: all agree. genes: sample_id, gene_idx, gene_name.

    Slices are compared by their number of genes and a hash that knows no order; only those that differ are looked at gene by gene.
    """
    genes = genes.select("sample_id", "gene_idx", "gene_name").distinct()
    prints = [F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(k), "gene_idx", "gene_name")).alias(f"h{k}") for k in (1, 2)]]
    want = genes.where(F.col("sample_id") == reference)
    each = genes.groupBy("sample_id").agg(*prints)
    same = each.join(each.where(F.col("sample_id") == reference).drop("sample_id"), ["n", "h1", "h2"], "left_semi").select("sample_id")
    other = genes.join(same, "sample_id", "left_anti")
    odd = other.join(want.select("gene_idx", "gene_name"), ["gene_idx", "gene_name"], "left_anti").select("sample_id", "gene_idx")
    # what a slice lacks: the reference's genes, once for each slice that differs
    names = other.agg(F.collect_set("sample_id").alias("names"))  # a name for each slice that differs
    lacking = want.join(names).select(F.explode("names").alias("sample_id"), "gene_idx", "gene_name").join(other, ["sample_id", "gene_idx", "gene_name"], "left_anti").select("sample_id", "gene_idx")
    return odd.union(lacking).distinct()


def stack_slices(*slices: DataFrame) -> DataFrame:
    out = slices[0]
    for s in slices[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
