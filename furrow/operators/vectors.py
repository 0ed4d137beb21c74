"""Descriptors, centers and matches.

Descriptor table: ``image_id, kp, desc ARRAY<FLOAT>`` (plus ``group_key, band`` for
registration). Centers: ``cluster INT, center ARRAY<DOUBLE>``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.clustering import nearest_in_blocks, nearest_of
from furrow.session import broadcast_if_small, materialize

# Clusters and iterations of the bag-of-words model, the match ratio and
# the number of mutual matches shown.
WORDS, WORD_ITERATIONS = 3, 5
MATCH_RATIO = 0.75
SHOWN_MATCHES = 10
# Centers travel to every task, so their number is checked.
MAX_CENTERS = 4096
# Rows of one block in the blocked nearest-neighbour join.
BLOCK_ROWS = 2048
# Bytes of descriptors that are dealt out at a time.
TURN_BYTES = 4 << 30
# Query rows per product and measured pairs per step inside one block pair.
BLOCK_STEP, PAIR_STEP = 512, 1 << 16


def with_features(descriptors: DataFrame, column: str = "desc") -> DataFrame:
    """Drops undecodable rows and rows without descriptors."""
    return descriptors.where(F.col(column).isNotNull() & (F.size(column) > 0))


def center_list(centers: DataFrame, limit: int = MAX_CENTERS) -> np.ndarray:
    """All centers in cluster order, on the driver; refuses more than ``limit``."""
    rows = centers.select("cluster", "center").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} centers to send to every task")
    rows.sort(key=lambda r: r["cluster"])
    if [r["cluster"] for r in rows] != list(range(len(rows))):
        raise ValueError("clusters must be numbered from 0 without gaps")
    return np.array([r["center"] for r in rows], dtype=np.float64)


def nearest_center(points: DataFrame, centers: DataFrame, column: str = "desc") -> DataFrame:
    """Adds ``cluster`` and ``dist``: the closest center, smallest cluster on ties.

    Up to ``MAX_CENTERS`` centers travel to every task, so no row is multiplied and nothing shuffles; more of them
    meet the points in blocks.
    """
    few = centers.select("cluster", "center").limit(MAX_CENTERS + 1).count() <= MAX_CENTERS
    return nearest_of(points, center_list(centers), column) if few else nearest_in_blocks(points, centers, column)


def nearest_value(values: DataFrame, centers: list[float], column: str) -> DataFrame:
    """Same on one number per row, against a short driver-side list of centers."""
    scored = F.array(*[F.struct(F.abs(F.col(column) - c).alias("d"), F.lit(i).alias("k")) for i, c in enumerate(centers)])
    return values.withColumn("cluster", F.array_min(scored)["k"])


def cluster_cost(points: DataFrame, centers: DataFrame, column: str = "desc") -> DataFrame:
    """Sum of distances (not of squares) to the own center."""
    return nearest_center(points, centers, column).agg(F.sum("dist").alias("cost"), F.count("*").alias("n"))


def bag_of_words(points: DataFrame, centers: DataFrame, pooling: str = "max", clusters: int = WORDS) -> DataFrame:
    """Group of each image: 1 + index of the smallest pooled distance, first on ties.

    A cluster without descriptors pools to 0 and therefore wins. One conditional
    aggregate per cluster keeps a partial row per image, so hot images combine map-side.
    """
    pool = {"max": F.max, "sum": F.sum}[pooling]
    near = nearest_center(points, centers)
    pooled = near.groupBy("image_id").agg(
        *[F.coalesce(pool(F.when(F.col("cluster") == k, F.col("dist"))), F.lit(0.0)).alias(f"_p{k}") for k in range(clusters)]
    )
    ranked = F.array_min(F.array(*[F.struct(F.round(f"_p{k}", 9), F.lit(k).alias("k")) for k in range(clusters)]))
    return pooled.select("image_id", (ranked["k"] + 1).alias("grp"), *[F.col(f"_p{k}").alias(f"pool_{k}") for k in range(clusters)])


def bag_of_many_words(points: DataFrame, centers: DataFrame, clusters: int, pooling: str = "max") -> DataFrame:
    """``image_id, grp`` by the same rule for any number of clusters, as rows of (image, cluster).

    Of the clusters without descriptors only the first can win, and it stands right behind the first gap in the
    cluster numbers of the image.
    """
    pool = {"max": F.max, "sum": F.sum}[pooling]
    pooled = nearest_center(points, centers).groupBy("image_id", "cluster").agg(F.round(pool("dist"), 9).alias("_pool"))
    order = Window.partitionBy("image_id").orderBy("cluster")
    # up to the first gap, cluster numbers are places; one row for each cluster of an image
    placed = pooled.withColumn("_place", F.row_number().over(order) - 1)
    least = F.min(F.struct("_pool", "cluster")).alias("_least")
    unbroken = F.count_if(F.col("_place") == F.col("cluster")).alias("_gap")
    found = placed.groupBy("image_id").agg(least, unbroken)
    gap = F.when(F.col("_gap") < clusters, F.struct(F.lit(0.0).alias("_pool"), F.col("_gap").cast("int").alias("cluster")))
    return found.select("image_id", (F.least("_least", gap)["cluster"] + 1).alias("grp"))


def fit_words(points: DataFrame, column: str = "desc", k: int = WORDS, iterations: int = WORD_ITERATIONS, seed: int = 1) -> KMeansModel:
    """k-means on vectors with random, seeded starts."""
    vectors = points.select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    return KMeans(k=k, maxIter=iterations, initMode="random", seed=seed).fit(vectors)


def model_centers(points: DataFrame, model: KMeansModel) -> DataFrame:
    """Centers of a model as a table, sorted so that numbering does not depend on the start."""
    rows = sorted([float(x) for x in center] for center in model.clusterCenters())
    return points.sparkSession.createDataFrame(
        [(i, row) for i, row in enumerate(rows)], "cluster INT, center ARRAY<DOUBLE>"
    )


def fit_line(values: DataFrame, column: str, k: int, iterations: int = 10) -> list[float]:
    """k-means on one number; the values are counted first, so a step reads one row per
    distinct value."""
    known = values.where(F.col(column).isNotNull())
    return fit_counts(materialize(known.groupBy(column).agg(F.count("*").alias("weight"))), column, k, iterations)


def fit_counts(counted: DataFrame, column: str, k: int, iterations: int = 10) -> list[float]:
    """k-means on counted values (``column, weight``): evenly spaced starts, fixed Lloyd steps,
    sorted centers. A step brings k sums back; an empty cluster keeps its center."""
    x = F.col(column).cast("double")
    low, high = counted.agg(F.min(x), F.max(x)).first()
    if low is None:
        return []
    centers = [low + (high - low) * (i + 0.5) / k for i in range(k)]
    for _ in range(iterations):
        steps = nearest_value(counted, centers, column).groupBy("cluster").agg((F.sum(x * F.col("weight")) / F.sum("weight")).alias("m"))
        means = {r["cluster"]: r["m"] for r in steps.collect()}  # at most k rows
        moved = [means.get(i, c) for i, c in enumerate(centers)]
        if moved == centers:
            break
        centers = moved
    return sorted(centers)


def _blocked(rows: DataFrame, large: DataFrame, own: str, other: str) -> DataFrame:
    """Hash each row into a block of its side and copy it to every block of the other side. Groups that are not among the
    large ones have one block on both sides."""
    n = lambda side: F.coalesce(f"_n_{side}", F.lit(1))
    sized = rows.join(large, "group_key", "left")
    return (
        sized.withColumn(f"_{own}", F.pmod(F.xxhash64("kp"), n(own)).cast("int"))
        .withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), n(other) - 1)))
        .drop("_n_q", "_n_t")
    )


def _block_pairs(descriptors: DataFrame, target_band: int, block_rows: int, compare, schema: str) -> DataFrame:
    """Calls ``compare`` with each block of a group's other bands and each block of its target descriptors. Rows are dealt
    out once: only the sizes of groups with several blocks come to them first, and a block of several bands meets the
    target descriptors once for all of them."""
    used = with_features(descriptors).where(F.col("group_key").isNotNull()).select("group_key", "band", "kp", "desc")
    of_target = F.col("band") == target_band

    def blocks(rows: Column, side: str) -> Column:
        return F.greatest(F.ceil(F.count_if(rows) / block_rows), F.lit(1)).cast("int").alias(f"_n_{side}")

    sizes = used.groupBy("group_key").agg(blocks(~of_target, "q"), blocks(of_target, "t"))
    large = broadcast_if_small(materialize(sizes.where("_n_q > 1 or _n_t > 1")))
    left = _blocked(used.where(~of_target), large, "q", "t")
    right = _blocked(used.where(of_target).drop("band"), large, "t", "q")
    right = right.toDF(*right.columns)  # fresh columns: both sides come from one table
    keys = ["group_key", "_q", "_t"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema)


NEAR = "group_key STRING, band INT, kp BIGINT, target_kp BIGINT, dist DOUBLE"


def nearest_two(descriptors: DataFrame, target_band: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The two nearest target descriptors of every descriptor of the other bands, exact.

    Both sides of a group are cut into blocks of about ``block_rows`` rows; one
    task compares one block pair with a matrix product and returns two candidates per
    query, and the block results are merged by a small aggregation. A hot group is only
    more block pairs, and no pair of rows is ever written.
    """
    partial = _block_pairs(descriptors, target_band, block_rows, _block_pair, NEAR)
    best = F.array_sort(F.collect_list(F.struct("dist", "target_kp")))
    # two entries per target block: the list is as long as the block count, not the group
    return (
        partial.groupBy("group_key", "band", "kp")
        .agg(F.slice(best, 1, 2).alias("near"))
        .select("group_key", "band", "kp", F.posexplode("near").alias("pos", "hit"))
        .select("group_key", "band", "kp", (F.col("pos") + 1).alias("rank"), "hit.target_kp", "hit.dist")
    )


def mutual_pairs(descriptors: DataFrame, target_band: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``group_key, band, kp, target_kp, dist``: the pairs of a descriptor of any other band and a target descriptor of
    its group that are each other's nearest; ties go to the smaller keypoint on both sides.

    One pass over the block pairs gives the candidates of both directions.
    """

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        there = _block_pair(left, right).assign(back=False)
        back = [_block_pair(right.assign(band=band), own).assign(back=True) for band, own in left.groupby("band")]
        return pd.concat([there, *back])

    partial = _block_pairs(descriptors, target_band, block_rows, both, NEAR + ", back BOOLEAN")
    best = partial.groupBy("group_key", "band", "back", "kp").agg(F.min(F.struct("dist", "target_kp")).alias("hit"))
    there = best.where("not back").select("group_key", "band", "kp", "hit.target_kp", "hit.dist")
    back = best.where("back").select("group_key", "band", F.col("kp").alias("target_kp"), F.col("hit.target_kp").alias("kp"))
    return there.join(back, ["group_key", "band", "kp", "target_kp"])


def _block_pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    columns = ["group_key", "band", "kp", "target_kp", "dist"]
    if left.empty or right.empty:
        return pd.DataFrame(columns=columns)
    q = np.stack(left["desc"].to_numpy()).astype(np.float64)
    t = np.stack(right["desc"].to_numpy()).astype(np.float64)
    kps = right["kp"].to_numpy()
    t_norm = (t * t).sum(1)
    parts = []
    for start in range(0, len(q), BLOCK_STEP):
        part = q[start : start + BLOCK_STEP]
        norms = (part * part).sum(1)[:, None] + t_norm[None, :]
        rough = norms - 2.0 * part @ t.T
        # the product form loses digits: every target within its error of the second
        # smallest value is measured again, so ties and duplicates stay exact
        second = np.partition(rough, min(1, len(t) - 1), axis=1)[:, min(1, len(t) - 1)]
        row, col = np.nonzero(rough <= second[:, None] + 1e-9 * (norms.max() + 1.0))
        dist = np.concatenate(
            [
                np.sqrt(((part[row[i : i + PAIR_STEP]] - t[col[i : i + PAIR_STEP]]) ** 2).sum(1))
                for i in range(0, len(row), PAIR_STEP)
            ]
        )
        order = np.lexsort((kps[col], dist, row))
        row, col, dist = row[order], col[order], dist[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        top = place < 2
        own = start + row[top]
        parts.append((left["band"].to_numpy()[own], left["kp"].to_numpy()[own], kps[col[top]], dist[top]))
    found = [np.concatenate(p) for p in zip(*parts, strict=True)]
    out = pd.DataFrame(dict(zip(columns[1:], found, strict=True)))
    out.insert(0, "group_key", left["group_key"].iloc[0])
    return out


def ratio_matches(near: DataFrame, ratio: float = MATCH_RATIO) -> DataFrame:
    """Keeps a nearest neighbour clearly closer than the second one."""
    d1 = F.max(F.when(F.col("rank") == 1, F.col("dist")))
    d2 = F.max(F.when(F.col("rank") == 2, F.col("dist")))
    hit = F.max(F.when(F.col("rank") == 1, F.col("target_kp")))
    wide = near.groupBy("group_key", "band", "kp").agg(hit.alias("target_kp"), d1.alias("dist"), d2.alias("dist_2"))
    return wide.where(F.col("dist_2").isNotNull() & (F.col("dist") < F.col("dist_2") * ratio))


def matches_in_turns(keypoints: DataFrame, target_band: int, ratio: float = MATCH_RATIO, turn_bytes: int | None = None) -> DataFrame:
    """``ratio_matches`` of the two nearest, written out. All groups are matched, in as many turns as keep what is dealt out
    in one turn at about ``turn_bytes`` of descriptors (a group is in one turn): the shuffle files of a turn go when its
    matches are written."""
    width = 8 if "double" in dict(keypoints.dtypes)["desc"] else 4
    numbers = with_features(keypoints).agg(F.sum(F.size("desc").cast("long"))).first()[0] or 0
    turns = max(1, -(-numbers * width // (turn_bytes or TURN_BYTES)))
    turn = F.pmod(F.xxhash64("group_key"), F.lit(turns))
    return reduce(DataFrame.unionAll, [materialize(ratio_matches(nearest_two(keypoints.where(turn == k), target_band), ratio)) for k in range(turns)])


def shown_matches(matches: DataFrame, shown: int = SHOWN_MATCHES) -> DataFrame:
    """The closest pairs, as a plot shows them."""
    return matches.orderBy("dist", "kp").limit(shown)


def match_points(matches: DataFrame, keypoints: DataFrame, target_band: int) -> DataFrame:
    """Coordinates of both ends of each match; keypoint numbers count per band."""
    source = keypoints.select("group_key", "band", "kp", F.col("x").alias("xs"), F.col("y").alias("ys"))
    target = keypoints.where(F.col("band") == target_band).select(
        "group_key", F.col("kp").alias("target_kp"), F.col("x").alias("xd"), F.col("y").alias("yd")
    )
    return matches.join(source, ["group_key", "band", "kp"]).join(target, ["group_key", "target_kp"])
