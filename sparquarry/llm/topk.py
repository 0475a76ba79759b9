"""Exact top-k inner products through a pivot-distance index.

Vectors are turned into integers and keyed by their nearest pivot and distance to
it.  Rows sorted by (pivot, distance) are cut into annuli of bounded size: a hot
cell is simply many annuli, in many tasks.  The index is a table with one packed
row per annulus and its bounds.  A query first meets the annulus it lies in, which
gives a threshold.  Queries of neighbouring cells make a block.  Blocks first meet
the bounds of annuli alone, without their vectors; only the annuli that some query
of the block can still gain from are sent to it, and are gone through by falling
bound until no query can gain.  The bounds come from the triangle inequality: |q-x| >= |d(q,p) - d(x,p)|, so q.x is at most
(|q|^2 + |x|^2 - gap^2) / 2, and from q.x <= q.p + |q| d(x,p).

Only the pivots (PIVOTS vectors at most, a documented bound) come from a sample;
every vector is indexed and results are exact.

Defined results: vectors that are null, empty, or hold a null or non-finite
component take no part; vectors meet only vectors of their own length; ids may
repeat (each row is a candidate of its own; a query skips all rows of its own
id); ties go to the smaller id; null ids take no part; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

#: Pivots; vectors in an annulus; queries in a block; bytes of vectors in a shard; annuli whose bounds meet a block of queries at once.
PIVOTS, ANNULUS, QUERIES, SHARD_BYTES, BOUNDS = 64, 256, 1024, 8 << 20, 4096
#: Up to here sums of products are exact in doubles.
EXACT = 2.0**53

KEYED = "dim int, cell int, dist double, vec_id long, vec binary"
BLOCK = "annulus long, dim int, cell int, near double, far double, norm double, n int, ids binary, vecs binary"
QUERY = "qblock long, dim int, n int, ids binary, vecs binary, least binary"


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows: by doubles where that is exact, else in integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def integers(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, v array<long>: floor(scale * x), without the vectors that take no part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(False)))
    return good.select("vec_id", F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def _key(pivots: dict[int, np.ndarray]):
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = batch.column(1), batch.column(0).to_numpy()
            ends = column.offsets.to_numpy()
            flat, sizes = column.values.to_numpy(), np.diff(ends)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = flat[ends[rows][:, None] + np.arange(dim)]
                p = pivots[int(dim)].astype(np.float64)
                y = x.astype(np.float64)
                d2 = (y**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * (y @ p.T)
                cell = d2.argmin(1)
                dist = np.sqrt(((y - p[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(dist), pa.array(ids[rows]), pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())], names=["dim", "cell", "dist", "vec_id", "vec"])

    return key


def _pack(most: int):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        annulus = TaskContext.get().partitionId() << 40
        for frame in frames:
            new = np.flatnonzero(np.r_[True, (frame[["dim", "cell"]].to_numpy()[1:] != frame[["dim", "cell"]].to_numpy()[:-1]).any(1)]) if len(frame) else []
            rows = []
            for start, end in zip(new, [*new[1:], len(frame)]):
                for at in range(start, end, most):
                    part = frame.iloc[at : min(end, at + most)]
                    vecs = np.frombuffer(b"".join(part["vec"]), "<i8").reshape(len(part), -1)
                    norm = float(np.sqrt((vecs.astype(np.float64) ** 2).sum(1)).max())
                    rows.append((annulus, int(part["dim"].iloc[0]), int(part["cell"].iloc[0]), float(part["dist"].iloc[0]), float(part["dist"].iloc[-1]), norm, len(part), part["vec_id"].to_numpy("<i8").tobytes(), vecs.tobytes()))
                    annulus += 1
            yield pd.DataFrame(rows, columns=["annulus", "dim", "cell", "near", "far", "norm", "n", "ids", "vecs"])

    return pack


class Index:
    """blocks: the table of annuli; pivots: for each length of vectors, the pivots."""

    def __init__(self, blocks: DataFrame, pivots: dict[int, np.ndarray]):
        self.blocks, self.pivots = blocks, pivots


def build_index(vectors: DataFrame, scale: float = 256, pivots: int = PIVOTS, annulus: int = ANNULUS) -> Index:
    ints = materialise(integers(vectors, scale), "ints")
    parts = shuffle_partitions(vectors.sparkSession)
    # pivots: a bounded number of vectors of each length (tables have one or a few lengths), by hash
    dims = [r[0] for r in ints.select(F.size("v")).distinct().collect()]
    chosen = {}
    for dim in dims:
        rows = ints.where(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
        chosen[dim] = np.unique(np.array([r.v for r in rows], np.int64), axis=0)
    keyed = ints.mapInArrow(_key(chosen), KEYED)
    ordered = keyed.repartitionByRange(parts, "dim", "cell", "dist", "vec_id").sortWithinPartitions("dim", "cell", "dist", "vec_id")
    return Index(materialise(ordered.mapInPandas(_pack(annulus), BLOCK), "annuli"), chosen)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of one query: highest score, then smallest id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


LOWEST = np.iinfo(np.int64).min


def _queries(every: int, k: int):
    """The queries of each annulus with the least score that its own annulus proves reachable."""

    def queries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for dim, cell, ids, vecs in zip(frame["dim"], frame["cell"], frame["ids"], frame["vecs"]):
                ids, vecs = np.frombuffer(ids, "<i8"), np.frombuffer(vecs, "<i8").reshape(-1, dim)
                for at in np.flatnonzero(ids % every == 0):
                    other = ids != ids[at]
                    scores = dot(vecs[at : at + 1], vecs[other])[0] if other.any() else np.zeros(0, np.int64)
                    least = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else LOWEST
                    rows.append((dim, cell, int(ids[at]), vecs[at].tobytes(), least))
            yield pd.DataFrame(rows, columns=["dim", "cell", "vec_id", "vec", "least"])

    return queries


def _deal(sizes: dict[tuple[int, int], int], pivots: dict[int, np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(dim, cell, first block, number of blocks): each cell after its nearest one not yet dealt, small ones together."""
    out, block = [], 0
    for dim in sorted({d for d, _ in sizes}):
        left, p, held = sorted(c for d, c in sizes if d == dim), pivots[dim].astype(np.float64), 0
        at = left[0]
        while left:
            left.remove(at)
            n = sizes[dim, at]
            if held and held + n > QUERIES:
                block, held = block + 1, 0
            blocks = -(-n // QUERIES)
            out.append((dim, at, block, blocks))
            if blocks > 1:
                block, held = block + blocks, 0
            else:
                held += n
            at = min(left, key=lambda c: (((p[c] - p[at]) ** 2).sum(), c), default=at)
        block += held > 0
    return out


def _block_queries(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id")
    return pd.DataFrame({"qblock": [int(pdf["qblock"].iloc[0])], "dim": [int(pdf["dim"].iloc[0])], "n": [len(pdf)], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "vecs": [b"".join(pdf["vec"])], "least": [pdf["least"].to_numpy("<i8").tobytes()]})


def bounds(q: np.ndarray, norms: np.ndarray, pivots: np.ndarray, near: float, far: float, norm: float, cell: int) -> np.ndarray:
    """For each query the most that its inner product with a vector of the annulus can be."""
    p = pivots[cell].astype(np.float64)
    d = np.sqrt(((q - p) ** 2).sum(1))
    gap = np.maximum(0.0, np.maximum(near - d, d - far))
    by_triangle = (norms**2 + norm**2 - gap**2) / 2
    by_pivot = q @ p + norms * far
    return np.minimum(np.minimum(by_triangle, by_pivot), norms * norm) * (1 + 1e-9) + 1e-3


def _near(pivots: dict[int, np.ndarray]):
    """The annuli that a query of the block can gain from, by their bounds."""

    def near(queries: pd.DataFrame, annuli: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"annulus": np.zeros(0, np.int64), "qblock": np.zeros(0, np.int64)})]
        for _, block in queries.iterrows():
            dim = int(block["dim"])
            q, least = np.frombuffer(block["vecs"], "<i8").reshape(-1, dim).astype(np.float64), np.frombuffer(block["least"], "<i8")
            norms = np.sqrt((q**2).sum(1))
            some = annuli[annuli["dim"] == dim]
            hit = [bool((bounds(q, norms, pivots[dim], a.near, a.far, a.norm, a.cell) >= least).any()) for a in some.itertuples()]
            found = some["annulus"].to_numpy(np.int64)[np.array(hit, bool)]
            out.append(pd.DataFrame({"annulus": found, "qblock": np.full(len(found), int(block["qblock"]))}))
        return pd.concat(out, ignore_index=True)

    return near


def _search(pivots: dict[int, np.ndarray], k: int):
    def search(queries: pd.DataFrame, annuli: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, block in queries.iterrows():
            dim = int(block["dim"])
            ids, q = np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["vecs"], "<i8").reshape(-1, dim)
            least = np.frombuffer(block["least"], "<i8").copy()
            qf = q.astype(np.float64)
            norms = np.sqrt((qf**2).sum(1))
            some = annuli[annuli["dim"] == dim]
            most = [bounds(qf, norms, pivots[dim], a.near, a.far, a.norm, a.cell) for a in some.itertuples()]
            order = sorted(range(len(most)), key=lambda i: -most[i].max())
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
            for i in order:
                open_ = np.flatnonzero(most[i] >= least)
                if not len(open_):
                    continue
                a = some.iloc[i]
                cand, vecs = np.frombuffer(a["ids"], "<i8"), np.frombuffer(a["vecs"], "<i8").reshape(-1, dim)
                scores = dot(q[open_], vecs)
                for j, row in zip(open_, scores):
                    take = np.flatnonzero((row >= least[j]) & (cand != ids[j]))
                    if len(take):
                        c, s = np.r_[best[j][0], cand[take]], np.r_[best[j][1], row[take]]
                        top = _best(c, s, k)
                        best[j] = (c[top], s[top])
                        if len(top) == k:
                            least[j] = max(least[j], best[j][1][-1])
            for query, (c, s) in zip(ids, best):
                out += [(int(query), int(x), int(y)) for x, y in zip(c, s)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return search


def search(index: Index, every: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row whose id is divisible by every, against all other rows."""
    blocks, spark = index.blocks, index.blocks.sparkSession
    queries = materialise(blocks.select("dim", "cell", "ids", "vecs").mapInPandas(_queries(every, k), "dim int, cell int, vec_id long, vec binary, least long"), "queries")
    # one row for each pivot that has queries: PIVOTS for each length of vectors at most
    sizes = {(r["dim"], r["cell"]): r["count"] for r in queries.groupBy("dim", "cell").count().collect()}
    dealt = spark.createDataFrame(_deal(sizes, index.pivots), "dim int, cell int, first long, blocks long")
    dealt = queries.join(F.broadcast(dealt), ["dim", "cell"]).withColumn("qblock", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    packed = materialise(dealt.select("qblock", "dim", "vec_id", "vec", "least").groupBy("qblock", "dim").applyInPandas(_block_queries, QUERY), "qblocks")
    n_blocks = packed.agg(F.coalesce(F.max("qblock"), F.lit(0))).first()[0] + 1
    n_annuli, size = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("vecs")), F.lit(0))).first()
    found = survivors(index, packed, n_blocks, n_annuli)
    shards = int(max(2 * shuffle_partitions(spark), -(-size // SHARD_BYTES)))
    left = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = blocks.join(found, "annulus").withColumn("shard", F.pmod(F.xxhash64("annulus"), F.lit(shards)).cast("int"))
    found = left.groupBy("qblock", "shard").cogroup(right.groupBy("qblock", "shard")).applyInPandas(_search(index.pivots, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def survivors(index: Index, packed: DataFrame, n_blocks: int, n_annuli: int) -> DataFrame:
    """annulus, qblock: the pairs that bounds do not exclude.  Some 50 bytes of an annulus are sent for each block of queries."""
    parts = max(1, -(-n_annuli // BOUNDS))
    left = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = index.blocks.select("annulus", "dim", "cell", "near", "far", "norm").withColumn("part", F.pmod(F.xxhash64("annulus"), F.lit(parts)).cast("int"))
    right = right.withColumn("qblock", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    return left.groupBy("qblock", "part").cogroup(right.groupBy("qblock", "part")).applyInPandas(_near(index.pivots), "annulus long, qblock long")
