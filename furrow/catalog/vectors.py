"""Descriptors, centers, neighbours and matches on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.catalog.registry import centers, descriptors, keyed_descriptors, query, sql, table
from furrow.operators import vectors as V
from furrow.operators.clustering import OVERSAMPLING, SEED_ROUNDS, fit_centers
from furrow.plans import jobs
from furrow.session import new_folder
from furrow.sources import sinks as K

# No pair of the stand-in passes the default ratio, so its queries use a wider one.
RATIO = 0.95


@query("f02_with_features", """select vec_id as kp, len(embedding)::INT as dims from embeddings where vec_id % 10 <> 0""")
def _(spark, sf):
    # every tenth row loses its descriptors: one half is NULL, the other half empty
    kp = F.col("kp")
    gone = F.when(kp % 20 == 0, F.array().cast("array<float>"))
    rows = descriptors(spark, sf).withColumn("desc", F.when(kp % 10 == 0, gone).otherwise(F.col("desc")))
    return V.with_features(rows).select("kp", F.size("desc").alias("dims"))


@query("j03_nearest_center", sql("select kp, cluster, round(dist, 6) as dist from near1", "near1"))
def _(spark, sf):
    near = V.nearest_center(descriptors(spark, sf), centers(spark, sf))
    return near.select("kp", "cluster", F.round("dist", 6).alias("dist"))


@query("g14_predicted_cluster", sql("select cluster, count(*) as n from near1 group by 1", "near1"))
def _(spark, sf):
    return V.nearest_center(descriptors(spark, sf), centers(spark, sf)).groupBy("cluster").agg(F.count("*").alias("n"))


@query("a09_cluster_cost", sql("select round(sum(dist), 6) as cost, count(*) as n from near1", "near1"))
def _(spark, sf):
    return V.cluster_cost(descriptors(spark, sf), centers(spark, sf)).withColumn("cost", F.round("cost", 6))


def _pooled(fn: str) -> str:
    pools = ", ".join(f"coalesce({fn}(dist) filter (where cluster = {k}), 0) as p{k}" for k in range(3))
    return sql(
        "select image_id, (case when round(p0, 9) <= round(p1, 9) and round(p0, 9) <= round(p2, 9) then 1 "
        "when round(p1, 9) <= round(p2, 9) then 2 else 3 end)::INT as grp, "
        "round(p0, 6) as pool_0, round(p1, 6) as pool_1, round(p2, 6) as pool_2 "
        f"from (select label::BIGINT as image_id, {pools} from near1 group by 1)", "near1")


def _rounded(pooled):
    return pooled.withColumns({f"pool_{k}": F.round(f"pool_{k}", 6) for k in range(3)})


@query("a10_max_pooled_group", _pooled("max"))
def _(spark, sf):
    return _rounded(V.bag_of_words(descriptors(spark, sf), centers(spark, sf), "max"))


@query("a11_sum_pooled_group", _pooled("sum"))
def _(spark, sf):
    return _rounded(V.bag_of_words(descriptors(spark, sf), centers(spark, sf), "sum"))


@query("g15_word_groups", f"select image_id, grp from ({_pooled('max')})")
def _(spark, sf):
    return jobs.word_groups(descriptors(spark, sf), centers(spark, sf))


def _fitted(final: str, dims: int = 64) -> str:
    """Seeding, reduction to three starts and five steps, unrolled."""
    k, per_round, steps = V.WORDS, OVERSAMPLING * V.WORDS, V.WORD_ITERATIONS

    def d(a: str, b: str) -> str:
        return "(" + " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(1, dims + 1)) + ")"

    ctes = [
        "pts as materialized (select vec_id as kp, embedding::DOUBLE[] as v from embeddings)",
        "c0 as materialized (select kp, v as c from pts order by sha256('0:' || kp), kp limit 1)",
    ]
    for r in range(1, SEED_ROUNDS + 1):
        ctes += [
            f"d{r} as materialized (select p.kp, any_value(p.v) as v, min({d('p.v', 'c.c')}) as d from pts p, c{r - 1} c group by p.kp)",
            f"""c{r} as materialized (select kp, c from c{r - 1} union all select kp, v from d{r}
                where ('0x' || substr(sha256('{r}:' || kp), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (select sum(d) from d{r}) < {per_round} * d)""",
        ]
    ctes.append(f"""w as materialized (select kp, any_value(c) as c, count(*) as weight from (select c.kp, c.c,
        row_number() over (partition by p.kp order by {d('p.v', 'c.c')}, c.kp) as i from pts p, c{SEED_ROUNDS} c) where i = 1 group by kp)""")
    ctes.append("s1 as materialized (select kp, c from w order by weight desc, kp limit 1)")
    for j in range(2, k + 1):
        ctes.append(f"""s{j} as materialized (select kp, c from s{j - 1} union all (select w.kp, any_value(w.c) from w, s{j - 1} s
            group by w.kp order by any_value(weight) * min({d('w.c', 's.c')}) desc, w.kp limit 1))""")
    ctes.append(f"m0 as materialized (select row_number() over (order by kp) as k, c from s{k})")
    means = ", ".join(f"avg(v[{i}])" for i in range(1, dims + 1))
    for r in range(steps):
        ctes.append(f"""m{r + 1} as materialized (with own as (select p.kp, p.v, m.k, row_number() over (partition by p.kp order by {d('p.v', 'm.c')}, m.k) as i
            from pts p, m{r} m), t as (select k, [{means}] as c from own where i = 1 group by k)
            select m{r}.k, coalesce(t.c, m{r}.c) as c from m{r} left join t using (k))""")
    ctes.append(f"fitted as materialized (select (row_number() over (order by c) - 1)::INT as cluster, c from m{steps})")
    ctes.append(f"""own as (select kp, cluster from (select p.kp, m.cluster, row_number() over (partition by p.kp order by {d('p.v', 'm.c')}, m.cluster) as i
        from pts p, fitted m) where i = 1)""")
    return f"with {', '.join(ctes)} {final}"


def _fit(spark, sf):
    return fit_centers(descriptors(spark, sf), V.WORDS, V.WORD_ITERATIONS)


@query("g12_fitted_centers", _fitted("""select f.cluster, unnest(range(len(c)))::INT as pos, round(unnest(c), 6) as value, n from fitted f
    join (select cluster, count(*) as n from own group by 1) using (cluster)"""))
def _(spark, sf):
    """Centers fitted from hashed starts, and how many vectors are nearest to each."""
    points, fitted = descriptors(spark, sf), _fit(spark, sf)
    sizes = V.nearest_center(points, fitted).groupBy("cluster").agg(F.count("*").alias("n"))
    values = fitted.select("cluster", F.posexplode("center").alias("pos", "value"))
    return values.join(sizes, "cluster").select("cluster", "pos", F.round("value", 6).alias("value"), "n")


@query("k07_saved_model", _fitted("select kp, cluster as fitted, cluster as loaded from own"))
def _(spark, sf):
    """Every vector's cluster by the fitted model, and by the same model saved and loaded."""
    points, fitted, folder = descriptors(spark, sf), _fit(spark, sf), new_folder(spark)
    K.save_centers(fitted, folder)
    near = V.nearest_center(points, fitted).select("kp", "desc", F.col("cluster").alias("fitted"))
    return V.nearest_center(near, K.load_centers(spark, folder)).select("kp", "fitted", F.col("cluster").alias("loaded"))


@query("j04_two_nearest", sql("select kp, band, rank::INT as rank, target_kp, round(dist, 6) as dist from near2", "near2"))
def _(spark, sf):
    near = V.nearest_two(keyed_descriptors(spark, sf), 0)
    return near.select("kp", "band", "rank", "target_kp", F.round("dist", 6).alias("dist"))


@query("j05_ratio_test", sql("select kp, band, target_kp, round(dist, 6) as dist, round(dist_2, 6) as dist_2 from ratio", "ratio"))
def _(spark, sf):
    good = V.ratio_matches(V.nearest_two(keyed_descriptors(spark, sf), 0), RATIO)
    return good.select("kp", "band", "target_kp", F.round("dist", 6).alias("dist"), F.round("dist_2", 6).alias("dist_2"))


MUTUAL = """select band, kp, target_kp, round(dist, 6) as dist from
    (select *, row_number() over (partition by kp order by dist, target_kp) as i,
       row_number() over (partition by band, target_kp order by dist, kp) as j from pair)
    where i = 1 and j = 1"""


@query("j06_mutual_nearest", sql(MUTUAL, "pair"))
def _(spark, sf):
    """Mutual neighbours of every band and band 0, in each group."""
    return V.mutual_pairs(keyed_descriptors(spark, sf), 0).select("band", "kp", "target_kp", F.round("dist", 6).alias("dist"))


@query("j06_shown_matches", sql(MUTUAL + " order by dist, kp limit 10", "pair"))
def _(spark, sf):
    return V.shown_matches(V.mutual_pairs(keyed_descriptors(spark, sf), 0)).select("band", "kp", "target_kp", F.round("dist", 6).alias("dist"))


@query("j07_match_points", sql("""select kp, target_kp, band, (kp % 8)::DOUBLE as xs, floor(kp / 8.0)::DOUBLE as ys,
    (target_kp % 8)::DOUBLE as xd, floor(target_kp / 8.0)::DOUBLE as yd from ratio""", "ratio"))
def _(spark, sf):
    keyed = keyed_descriptors(spark, sf)
    points = V.match_points(V.ratio_matches(V.nearest_two(keyed, 0), RATIO), keyed, 0)
    return points.select("kp", "target_kp", "band", "xs", "ys", "xd", "yd")


@query("s08_float_lines", """select vec_id, len(embedding)::INT as dims, embedding[1]::DOUBLE as first,
    round(list_sum(embedding::DOUBLE[]), 6) as total from embeddings""")
def _(spark, sf):
    from furrow.sources.logs import float_lines

    numbers = F.transform("embedding", lambda x: x.cast("double").cast("string"))
    lines = table(spark, sf, "embeddings").select("vec_id", F.array_join(numbers, " ").alias("value"))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    return float_lines(lines).select("vec_id", F.size("p").alias("dims"), F.col("p")[0].alias("first"), F.round(total, 6).alias("total"))
