"""Queries for vectors, drift and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions.vector import cosine, euclidean, running_mean, silhouette_band
from newsloom.operators import vectors as vec
from newsloom.operators.bounds import broadcast_if_small
from newsloom.plans.catalog import query
from newsloom.plans.tables import VECTORS, STAMP, rounded, stamp
from newsloom.session import materialize

COSINE = "list_cosine_similarity({}, {})"

MEANS = """parts AS (SELECT label, i, avg(vector[i]) AS x FROM vectors, generate_series(1, 64) g(i)
    GROUP BY 1, 2),
  means AS (SELECT label, list(x ORDER BY i) AS c FROM parts GROUP BY 1)"""


def means(t):
    return vec.centroids(t("embeddings").select("label", F.col("embedding").alias("vector")),
                         "vector", ["label"])


@query("e1_cosine", """WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a,
    b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
  SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS similarity FROM p""")
def _(t):
    a = t("embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", rounded(cosine(F.col("a"), F.col("b")))
                                      .alias("similarity"))


@query("e2_nearest_centroid", f"""WITH {VECTORS}, {MEANS}, s AS (SELECT id, m.label,
    list_cosine_similarity(vector, c) AS sim FROM vectors, means m),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, label) AS k FROM s)
  SELECT id, label AS centroid_id, round(sim, 6) AS similarity FROM r WHERE k = 1""")
def _(t):
    cents = means(t).select(F.col("label").alias("id"), "centroid")
    out = vec.nearest_centroid(t("embeddings"), "vec_id", "embedding", cents)
    return out.select(F.col("vec_id").alias("id"), "centroid_id",
                      rounded(F.col("similarity")).alias("similarity"))


@query("e3_running_mean", f"""WITH {VECTORS}, {MEANS}, n AS (SELECT label, count(*) AS n FROM vectors
    GROUP BY 1) SELECT id, round((c[1] * n + vector[1]) / (n + 1), 6) AS x1,
    round((c[64] * n + vector[64]) / (n + 1), 6) AS x64
  FROM vectors JOIN means USING (label) JOIN n USING (label)""")
def _(t):
    rows = t("embeddings").join(broadcast_if_small(means(t)), "label")
    mean = running_mean(F.col("centroid"), F.col("n"), F.col("embedding"))
    return rows.select(F.col("vec_id").alias("id"), mean.alias("m")).select(
        "id", rounded(F.get("m", F.lit(0))).alias("x1"), rounded(F.get("m", F.lit(63))).alias("x64"))


@query("e4_group_centroids", f"""WITH {VECTORS}, {MEANS} SELECT label, i::INT AS position,
  round(x, 6) AS value FROM parts""")
def _(t):
    return means(t).select("label", F.posexplode("centroid").alias("p", "x")).select(
        "label", (F.col("p") + 1).alias("position"), rounded(F.col("x")).alias("value"))


@query("e5_set_drift", f"""WITH {VECTORS}, h AS (SELECT label < 5 AS old, i, avg(vector[i]) AS x
    FROM vectors, generate_series(1, 64) g(i) GROUP BY 1, 2),
  c AS (SELECT old, list(x ORDER BY i) AS c FROM h GROUP BY 1),
  d AS (SELECT 1 - list_cosine_similarity(a.c, b.c) AS drift FROM c a, c b
    WHERE a.old AND NOT b.old)
  SELECT round(drift, 6) AS drift, CASE WHEN drift > 0.3 THEN 'high' WHEN drift > 0.15
    THEN 'moderate' ELSE 'stable' END AS band FROM d""")
def _(t):
    rows = t("embeddings")
    out = vec.set_drift(rows.filter("label < 5"), rows.filter("label >= 5"), "embedding")
    return out.withColumn("drift", rounded(F.col("drift")))


SERIES = f"""{VECTORS}, b AS (SELECT *, time_bucket(INTERVAL 4 HOUR, ts) AS bucket FROM vectors),
  n AS (SELECT bucket, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= 2),
  x AS (SELECT bucket, i, avg(vector[i]) AS x FROM b, generate_series(1, 64) g(i) GROUP BY 1, 2),
  c AS (SELECT bucket, n, list(x ORDER BY i) AS c FROM x JOIN n USING (bucket) GROUP BY 1, 2),
  l AS (SELECT *, lag(c) OVER (ORDER BY bucket) AS p FROM c),
  series AS (SELECT bucket, n, 1 - list_cosine_similarity(p, c) AS drift FROM l
    WHERE p IS NOT NULL)"""


@query("e6_drift_series", f"""WITH {SERIES} SELECT {STAMP.format('bucket')} AS bucket, n,
  round(drift, 6) AS drift FROM series""")
def _(t):
    out = vec.drift_series(t.vectors, "ts", "vector")
    return out.withColumns({"bucket": stamp("bucket"), "drift": rounded(F.col("drift"))})


@query("e7_drift_spikes", f"""WITH {SERIES} SELECT {STAMP.format('bucket')} AS bucket,
  drift > (SELECT avg(drift) + 1.5 * stddev_pop(drift) FROM series) AS is_spike FROM series""")
def _(t):
    out = vec.flag_spikes(vec.drift_series(t.vectors, "ts", "vector"))
    return out.select(stamp("bucket").alias("bucket"), "is_spike")


@query("e8_kmeans")
def _(t):
    rows = t("embeddings").select("vec_id", "embedding")
    model = vec.fit_kmeans(rows, "embedding", k=8, n_init=20, max_iter=500)
    return vec.assign_clusters(rows, model, "embedding").select("vec_id", "cluster", "distance")


# Within and between clusters, squared distances add up to those from the mean of all, if the
# centres are the means of their members; no row has a nearer centre than its own.
@query("e8_kmeans_invariants", """WITH x AS (SELECT i, embedding[i]::DOUBLE AS x
    FROM embeddings, generate_series(1, 64) g(i)),
  m AS (SELECT i, avg(x) AS m FROM x GROUP BY i)
  SELECT count(*) // 64 AS rows, 8 AS clusters, 0 AS misplaced, round(sum((x - m) ** 2), 3) AS total
  FROM x JOIN m USING (i)""")
def _(t):
    rows = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    model = vec.fit_kmeans(rows, "v", k=8, n_init=20, max_iter=500, tol=1e-12)
    placed = materialize(vec.assign_clusters(rows, model, "v"), "placed")
    means = vec.centroids(placed, "v", ["cluster"]).withColumnRenamed("centroid", "mean")
    middle = vec.centroids(placed, "v").select("centroid").scalar()
    own = vec.cluster_distances(placed.drop("distance"), "cluster", "v",
                                means.select("cluster", F.col("mean").alias("centroid")))
    found = own.join(placed.select("vec_id", F.col("distance").alias("to_centre")), "vec_id").agg(
        F.count("*").alias("rows"), F.countDistinct("cluster").cast("int").alias("clusters"),
        F.count_if(F.abs(F.col("distance") - F.col("to_centre")) > 1e-6).cast("int").alias("misplaced"),
        F.sum(F.col("distance") ** 2).alias("within"))
    between = means.withColumn("middle", middle).agg(
        F.sum(F.col("n") * euclidean(F.col("mean"), F.col("middle")) ** 2)).scalar()
    return found.withColumn("between", between).select("rows", "clusters", "misplaced", F.round(
        F.col("within") + F.col("between"), 3).alias("total"))


@query("e9_confidence", f"""WITH {VECTORS}, {MEANS}, d AS (SELECT id, list_distance(vector, c) AS d
    FROM vectors JOIN means USING (label))
  SELECT id, round(1 - d / (SELECT max(d) FROM d), 6) AS confidence FROM d""")
def _(t):
    rows = t("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"),
                                  "embedding")
    cents = means(t).select(F.col("label").alias("cluster"), "centroid")
    out = vec.with_confidence(vec.cluster_distances(rows, "cluster", "embedding", cents))
    return out.select("id", rounded(F.col("confidence")).alias("confidence"))


@query("e10_tfidf")
def _(t):
    from pyspark.ml.functions import vector_to_array

    out = vec.tfidf(t("documents").select("doc_id", "text"), "text", 1000)
    weights = vector_to_array("features")
    return out.select("doc_id", F.size(F.filter(weights, lambda x: x > 0)).alias("terms"),
                      F.round(F.sqrt(F.aggregate(weights, F.lit(0.0), lambda a, x: a + x * x)), 6)
                      .alias("length"))


@query("e11_clustering_benchmark")
def _(t):
    from pyspark.ml.functions import array_to_vector

    texts = t("documents").select(F.coalesce("text", F.lit("")).alias("text"))
    meaning = vec.embed(F.col("text"), vec.hash_embedder(32)).cast("array<double>")
    sets = {"lexical": vec.tfidf(texts, "text", 1000),
            "semantic": texts.select(array_to_vector(meaning).alias("features"))}
    out = vec.clustering_benchmark(sets, (5, 10, 15))
    return out.withColumn("band", silhouette_band(F.col("silhouette")))


@query("e12_silhouette_band", """SELECT l_tax * 10 AS score, CASE WHEN l_tax * 10 >= 0.7 THEN 'strong'
  WHEN l_tax * 10 >= 0.5 THEN 'reasonable' WHEN l_tax * 10 >= 0.25 THEN 'weak' ELSE 'none' END
  AS band, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(t):
    score = F.col("l_tax") * 10
    return t("lineitem").groupBy(score.alias("score"), silhouette_band(score).alias("band")).agg(
        F.count("*").alias("n"))


@query("e13_projection")
def _(t):
    out = vec.project_2d(t("embeddings").select("vec_id", "label", "embedding"), "embedding")
    return out.select("vec_id", "label", "x", "y")


# Principal components: the axes' values are not correlated, the first varies more, and the sum of
# squares along them is the largest there is, found here by powers of the covariance matrix.
@query("e13_projection_invariants", """WITH RECURSIVE x AS MATERIALIZED (SELECT vec_id, i, embedding[i]::DOUBLE AS x
    FROM embeddings, generate_series(1, 64) g(i)),
  m AS (SELECT i, avg(x) AS m FROM x GROUP BY i),
  c AS MATERIALIZED (SELECT vec_id, i, x - m AS x FROM x JOIN m USING (i)),
  s AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) / (count(*) - 1) AS s
    FROM c a JOIN c b USING (vec_id) GROUP BY ALL),
  power AS (SELECT 0 AS step, i, j, s AS p FROM s
    UNION ALL (SELECT step + 1, i, j, p / max(abs(p)) OVER () FROM (
      SELECT a.step, a.i, b.j, sum(a.p * b.p) AS p FROM power a JOIN power b ON a.j = b.i
      WHERE a.step < 16 GROUP BY a.step, a.i, b.j))),
  axis AS (SELECT i, p FROM power WHERE step = 16 AND j = (SELECT j FROM power
    WHERE step = 16 AND i = j ORDER BY p DESC, j LIMIT 1)),
  first AS (SELECT sum(a.p * s.s * b.p) / any_value((SELECT sum(p * p) FROM axis)) AS variance
    FROM axis a JOIN s ON s.i = a.i JOIN axis b ON b.i = s.j)
  SELECT (SELECT count(*) FROM embeddings) AS rows, round(variance, 5) AS first, true AS ordered,
    true AS apart FROM first""")
def _(t):
    out = vec.project_2d(t("embeddings").select("vec_id", "embedding"), "embedding")
    found = out.agg(F.count("*").alias("rows"), F.var_samp("x").alias("first"),
                    F.var_samp("y").alias("second"), F.corr("x", "y").alias("corr"))
    return found.select("rows", F.round("first", 5).alias("first"),
                        (F.col("first") >= F.col("second")).alias("ordered"),
                        (F.abs("corr") < 1e-6).alias("apart"))


@query("e13_centers_2d")
def _(t):
    out = vec.project_2d(t("embeddings").select("vec_id", "label", "embedding"), "embedding")
    return vec.cluster_centers_2d(out, "label")


NOISE = "CASE WHEN label >= 8 THEN -1 ELSE label END"


@query("e14_cluster_sizes", f"""SELECT {NOISE} AS cluster, count(*) AS size FROM embeddings
  WHERE label < 8 GROUP BY 1 ORDER BY size DESC, cluster LIMIT 15""")
def _(t):
    return vec.cluster_sizes(t("embeddings").select(F.expr(NOISE).alias("cluster")))


@query("e14_cluster_totals", f"""SELECT count(DISTINCT c) FILTER (c <> -1) AS clusters,
  count(*) FILTER (c <> -1) AS clustered, count(*) FILTER (c = -1) AS noise
  FROM (SELECT {NOISE} AS c FROM embeddings)""")
def _(t):
    return vec.cluster_totals(t("embeddings").select(F.expr(NOISE).alias("cluster")))


@query("d26_embed", "SELECT doc_id, 32 AS dims FROM documents")
def _(t):
    return t("documents").select("doc_id", vec.embed(F.col("text"), vec.hash_embedder(32))
                                 .alias("v")).select("doc_id", F.size("v").alias("dims"))
