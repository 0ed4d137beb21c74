"""k-means on vectors with starts that a hash decides, and nearest centers among any number of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from furrow.session import materialize

# Rounds of seeding, and candidates that a round is expected to add for each center.
SEED_ROUNDS, OVERSAMPLING = 3, 2
# Centers that a block holds about, and points that meet a block of centers in one task.
CENTER_BLOCK, POINT_BLOCK = 2048, 8192
# Pivots travel to every task; with more centers than these times CENTER_BLOCK, blocks grow.
MAX_PIVOTS = 4096


def nearest_of(points: DataFrame, known: np.ndarray, column: str = "desc") -> DataFrame:
    """Adds ``cluster`` and ``dist``: the closest of a short list of centers, the first one on ties.

    The centers travel with the function and are compared in Arrow batches, so no row is
    multiplied and nothing shuffles.
    """

    @F.pandas_udf(StructType([StructField("cluster", IntegerType()), StructField("dist", DoubleType())]))
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        best, cluster = np.full(len(x), np.inf), np.zeros(len(x), np.int32)
        for k, center in enumerate(known):  # one center at a time keeps memory at the batch size
            squares = ((x - center) ** 2).sum(axis=1)
            closer = squares < best
            best[closer], cluster[closer] = squares[closer], k
        return pd.DataFrame({"cluster": cluster, "dist": np.sqrt(best)})

    return points.withColumn("_near", nearest(column)).select(
        *points.columns, F.col("_near.cluster").alias("cluster"), F.col("_near.dist").alias("dist")
    )


# ---- seeding and steps ----------------------------------------------------------------


def draw(key: Column, number: int) -> Column:
    """A number from 0 to 1 for each key, from the first 32 bits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{number}:"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def seeds(points: DataFrame, k: int, key: str = "kp", column: str = "desc", rounds: int = SEED_ROUNDS) -> np.ndarray:
    """Up to ``k`` starts by oversampling: k-means|| with a hash in place of chance.

    The first candidate is the row with the least hash. In each round a row becomes one with a probability in proportion to
    its squared distance to the candidates so far, about ``OVERSAMPLING * k`` rows a round whatever the table holds.
    Each candidate then weighs as many rows as are nearest to it; the heaviest one is the first start, and next comes in
    turn the one with the greatest weight times squared distance to the starts so far. Ties go to the smaller key.
    """
    rows = points.select(F.col(key).alias("_key"), F.col(column).cast("array<double>").alias("_vector"))
    found = rows.orderBy(F.sha2(F.concat(F.lit("0:"), F.col("_key").cast("string")), 256), "_key").limit(1).collect()
    if not found:
        return np.zeros((0, 0))
    for number in range(1, rounds + 1):
        measured = nearest_of(rows, np.array([r["_vector"] for r in found]), "_vector").withColumn("_d", F.col("dist") * F.col("dist"))
        cost = measured.agg(F.sum("_d")).first()[0]
        chosen = measured.where(draw(F.col("_key"), number) * cost < OVERSAMPLING * k * F.col("_d"))
        found += chosen.select("_key", "_vector").collect()
    found.sort(key=lambda r: r["_key"])
    candidates = np.array([r["_vector"] for r in found])
    counts = nearest_of(rows, candidates, "_vector").groupBy("cluster").agg(F.count("*").alias("n")).collect()
    weight = np.zeros(len(candidates))
    for r in counts:
        weight[r["cluster"]] = r["n"]
    starts, reach = [int(weight.argmax())], np.full(len(candidates), np.inf)
    while len(starts) < min(k, len(candidates)):
        reach = np.minimum(reach, ((candidates - candidates[starts[-1]]) ** 2).sum(axis=1))
        if not (weight * reach).any():
            break  # what is left are copies of the starts
        starts.append(int((weight * reach).argmax()))
    return candidates[starts]


def moved(points: DataFrame, centers: np.ndarray, column: str = "desc") -> np.ndarray:
    """Each center at the mean of the points nearest to it; one without points stays. A batch brings one sum for each
    center and position, and so do all."""

    def sums(batches):
        for pdf in batches:
            x = np.stack(pdf["_vector"].to_numpy()).astype(np.float64)
            own = pdf["cluster"].to_numpy()
            used = np.unique(own)
            yield pd.DataFrame({
                "cluster": used, "n": [int((own == c).sum()) for c in used], "total": [x[own == c].sum(axis=0).tolist() for c in used],
            })

    rows = points.select(F.col(column).cast("array<double>").alias("_vector"))
    partial = nearest_of(rows, centers, "_vector").select("_vector", "cluster").mapInPandas(sums, "cluster INT, n BIGINT, total ARRAY<DOUBLE>")
    totals = partial.select("cluster", "n", F.posexplode("total").alias("pos", "part")).groupBy("cluster", "pos").agg(
        F.sum("n").alias("n"), F.sum("part").alias("total")
    )
    out = centers.copy()
    for r in totals.collect():  # centers x positions
        out[r["cluster"], r["pos"]] = r["total"] / r["n"]
    return out


def fit_centers(points: DataFrame, k: int, iterations: int, key: str = "kp", column: str = "desc") -> DataFrame:
    """``cluster, center`` by k-means: hashed seeding, then Lloyd steps. The result depends on the rows alone, not on
    their order or partitions; clusters are numbered by their centers. Fewer than ``k`` distinct points give fewer
    centers. Rows without a vector take no part."""
    usable = points.where(F.col(column).isNotNull() & (F.size(column) > 0))
    centers = seeds(usable, k, key, column)
    for _ in range(iterations if len(centers) else 0):
        after = moved(usable, centers, column)
        if np.array_equal(after, centers):
            break
        centers = after
    rows = [(i, c) for i, c in enumerate(sorted(centers.tolist()))]
    return points.sparkSession.createDataFrame(rows, "cluster INT, center ARRAY<DOUBLE>")


# ---- many centers ---------------------------------------------------------------------


def _pivots(centers: DataFrame, n: int, block: int) -> np.ndarray:
    """Some of the centers, chosen by a hash: one for each block of centers, ``MAX_PIVOTS`` at most."""
    some = centers.orderBy(F.xxhash64("cluster"), "cluster").limit(min(MAX_PIVOTS, max(1, -(-n // block))))
    return np.array([r["center"] for r in some.collect()], np.float64)


def nearest_in_blocks(points: DataFrame, centers: DataFrame, column: str = "desc", block: int = CENTER_BLOCK, point_block: int = POINT_BLOCK) -> DataFrame:
    """``nearest_center`` for any number of centers, as exact.

    Centers are dealt to the nearest of some pivots, which are centers themselves, and a pivot with many is cut by
    hash; each piece is a block with a radius around its pivot. A point visits only blocks in which something can be
    as near as its nearest pivot: those whose pivot lies within that distance plus the block's radius. Point pieces and
    center blocks meet by equal numbers and are compared with a matrix product; everything within rounding error of the best
    is measured again. A point brings one candidate from each block that it visits.
    """
    from furrow.operators.vectors import _block_pair

    known = materialize(centers.select("cluster", F.col("center").cast("array<double>").alias("center")))
    n, low, high, each = known.agg(F.count("*"), F.min("cluster"), F.max("cluster"), F.count_distinct("cluster")).first()
    if not n or (low, high, each) != (0, n - 1, n):
        raise ValueError("clusters must be numbered from 0 without gaps")
    pivots = _pivots(known, n, block)
    dealt = materialize(nearest_of(known.withColumnRenamed("cluster", "_center"), pivots, "center").withColumnsRenamed({"cluster": "_pivot", "dist": "_reach"}))
    # at most as many rows as pivots
    sizes = {r["_pivot"]: r for r in dealt.groupBy("_pivot").agg(F.count("*").alias("n"), F.max("_reach").alias("radius")).collect()}
    radius = np.array([sizes[p]["radius"] if p in sizes else -np.inf for p in range(len(pivots))])
    cuts = [-(-sizes[p]["n"] // block) if p in sizes else 0 for p in range(len(pivots))]

    @F.pandas_udf("array<int>")
    def visited(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        d = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
        least = d.min(axis=1, keepdims=True)
        near = d - radius <= least + 1e-9 * (d + least)
        return pd.Series([np.flatnonzero(row).astype(np.int32).tolist() for row in near])

    # rows get their numbers once; they would change if they were given again
    rows = materialize(points.withColumn("_row", F.monotonically_increasing_id()))
    cut = F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("_pivot") + 1)
    visits = rows.select("_row", F.col(column).alias("_vector"), F.explode(visited(column)).alias("_pivot"))
    counts = visits.groupBy("_pivot").agg(F.ceil(F.count("*") / F.lit(point_block)).cast("int").alias("_parts"))
    parts = {r["_pivot"]: r["_parts"] for r in counts.collect()}  # at most as many rows as pivots
    of = F.element_at(F.array(*[F.lit(max(1, parts.get(p, 1))) for p in range(len(pivots))]), F.col("_pivot") + 1)
    left = visits.withColumns({
        "_part": F.pmod(F.xxhash64("_row"), of).cast("int"), "_cut": F.explode(F.sequence(F.lit(0), cut - 1)),
    }).select("_pivot", "_cut", "_part", F.lit("").alias("group_key"), F.lit(0).alias("band"), F.col("_row").alias("kp"), F.col("_vector").alias("desc"))
    right = dealt.withColumns({
        "_cut": F.pmod(F.xxhash64("_center"), cut).cast("int"), "_part": F.explode(F.sequence(F.lit(0), of - 1)),
    }).select("_pivot", "_cut", "_part", F.col("_center").cast("long").alias("kp"), F.col("center").alias("desc"))
    keys = ["_pivot", "_cut", "_part"]
    schema = "group_key STRING, band INT, kp BIGINT, target_kp BIGINT, dist DOUBLE"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_block_pair, schema)
    best = found.groupBy(F.col("kp").alias("_row")).agg(F.min(F.struct("dist", "target_kp")).alias("_hit"))
    return rows.join(best, "_row").select(*points.columns, F.col("_hit.target_kp").cast("int").alias("cluster"), F.col("_hit.dist").alias("dist"))
