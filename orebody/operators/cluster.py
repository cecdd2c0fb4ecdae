"""Clustering of points (id, features): moments, nearest centroids, and BFR with its three sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.functions.scalars import distance, draw
from orebody.plans.durable import durable

#: Clusters that one row may hold, which every task gets; the close ones among so many are sought pair by pair.
CENTERS = 10_000
#: Fixed value: centroids nearer than this merge.
CLOSE = 3.0


def chunk_split(points: DataFrame, chunks: int = 5, seed: int = 11) -> DataFrame:
    """points with chunk: a repeatable deal by id."""
    return points.withColumn("chunk", draw(F.col("id"), seed) % chunks)


def kmeans(points: DataFrame, k: int, seed: int = 1, rounds: int = 20) -> DataFrame:
    """id, features and cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.withColumn("__v", array_to_vector("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="__v", predictionCol="cluster").fit(rows)
    return model.transform(rows).select("id", "features", F.col("cluster").cast("bigint").alias("cluster"))


def moments(rows: DataFrame) -> DataFrame:
    """cluster, dim, n, sum and sumsq of the members' features."""
    each = rows.select("cluster", F.posexplode("features").alias("dim", "x"))
    return each.groupBy("cluster", "dim").agg(F.count("*").alias("n"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sumsq"))


def merged_moments(parts: DataFrame) -> DataFrame:
    """Moments add up."""
    return parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("sumsq").alias("sumsq"))


def centroids(stats: DataFrame) -> DataFrame:
    """cluster, n, centroid and std (arrays by dimension) from moments."""
    mean = F.col("sum") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("sumsq") / F.col("n") - mean * mean, F.lit(0.0)))
    rows = stats.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", mean.alias("m"), spread.alias("s")))).alias("d"))
    return rows.select("cluster", "n", F.transform("d", lambda x: x["m"]).alias("centroid"), F.transform("d", lambda x: x["s"]).alias("std"))


def _few(centers: DataFrame) -> DataFrame:
    n = centers.count()
    if n > CENTERS:
        raise ValueError(f"{n} clusters: {CENTERS} at most may be sent to every task")
    return centers


def nearest(points: DataFrame, centers: DataFrame, scaled: bool = True) -> DataFrame:
    """id, cluster and distance of each point's nearest center; equal distances: the least cluster.

    The centers (k of them, the caller's parameter) are one row, of which each point takes the least: nothing is
    shuffled and points with one id stay apart. Without centers there are no rows. scaled: differences in
    standard deviations.
    """
    c = F.col
    every = _few(centers).agg(F.collect_list(F.struct("cluster", "centroid", "std")).alias("centers"))
    both = points.select("id", "features").crossJoin(F.broadcast(every))  # one row
    d = lambda x: distance(c("features"), x["centroid"], x["std"] if scaled else None)
    best = F.array_min(F.transform("centers", lambda x: F.struct(F.round(d(x), 9).alias("d"), x["cluster"].alias("c"))))
    return both.select("id", best.alias("best")).where("best IS NOT NULL").select("id", c("best.c").alias("cluster"), F.round("best.d", 6).alias("distance"))


def assign(points: DataFrame, centers: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Points nearer than the threshold (id, features, cluster), and the others (id, features)."""
    near = nearest(points.select(F.struct("id", "features").alias("id"), "features"), centers)
    rows = near.select("id.id", "id.features", "cluster", (F.col("distance") < threshold).alias("near"))
    return rows.where("near").select("id", "features", "cluster"), rows.where("NOT near").select("id", "features")


def singletons(rows: DataFrame) -> DataFrame:
    """Clusters of one member."""
    return rows.groupBy("cluster").agg(F.count("*").alias("n")).where("n = 1").select("cluster")


def split_singletons(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The points (id, features, cluster) outside groups of one, and those alone in theirs."""
    alone = singletons(found)
    return found.join(alone, "cluster", "left_anti"), found.join(alone, "cluster", "left_semi")


def initial_outliers(points: DataFrame, k: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Cluster into 5k groups: points outside groups of one, and those alone in theirs."""
    several, alone = split_singletons(durable(kmeans(points, 5 * k, seed), "groups"))
    return several.select("id", "features"), alone.select("id", "features")


def close_centers(centers: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of centers nearer than the threshold; centers: as many as clusters."""
    a = _few(centers).select(F.col("cluster").alias("a"), F.col("centroid").alias("x"))
    every = F.broadcast(centers.agg(F.collect_list(F.struct(F.col("cluster").alias("b"), F.col("centroid").alias("y"))).alias("all")))  # one row
    later = F.transform(F.filter("all", lambda o: o["b"] > F.col("a")), lambda o: F.struct(o["b"].alias("b"), F.round(distance(F.col("x"), o["y"]), 6).alias("distance")))
    return a.crossJoin(every).select("a", F.inline(F.filter(later, lambda o: o["distance"] < threshold)))


def chains(stats: DataFrame, threshold: float) -> DataFrame:
    """cluster and into: the least cluster of the chain of near centers that it belongs to, for clusters in chains."""
    from orebody.operators.graph import connected_components

    pairs = close_centers(centroids(stats), threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return connected_components(durable(pairs, "pairs")).select(F.col("id").alias("cluster"), F.col("component").alias("into"))


def renamed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with their cluster replaced as names (cluster, into) says; names: CENTERS rows at most."""
    return rows.join(F.broadcast(names), "cluster", "left").withColumn("cluster", F.coalesce("into", "cluster")).select(*rows.columns)


def merge_close(stats: DataFrame, threshold: float = CLOSE) -> DataFrame:
    """Moments of clusters whose centers lie nearer than the threshold, merged under the least cluster of their chain."""
    return merged_moments(renamed(stats, chains(stats, threshold)))


def bfr(points: DataFrame, k: int, chunks: int = 5, threshold: float | None = None, seed: int = 1, close: float = CLOSE) -> tuple[DataFrame, DataFrame]:
    """BFR: rounds (round, n_discard, n_compressed_clusters, n_compressed, n_retained) and assignments (id, cluster).

    Of the discard and the compressed set only moments are kept, of the retained set the points. The first chunk's
    outliers are retained, the rest gives k clusters (the discard set). Each chunk's points join their nearest discard
    cluster, or else compressed cluster, if it is nearer than the threshold (by default twice the root of the
    dimensions, in standard deviations); the others are retained. Retained points are grouped into 5k: groups of several
    are compressed, single points stay. Compressed clusters with centers nearer than `close` merge; after the last chunk
    those join the nearest discard cluster whose center is nearer than `close`. -1 marks what stays outside.
    Assignments are written chunk by chunk and renamed as clusters merge.
    """
    spark, c = points.sparkSession, F.col
    rows = durable(chunk_split(points, chunks, seed), "points")
    first = rows.where("chunk = 0").select("id", "features")
    one = first.select(F.size("features").alias("d")).first()
    limit = threshold if threshold is not None else 2 * (one["d"] if one else 1) ** 0.5
    none = spark.createDataFrame([], "cluster bigint, dim int, n bigint, sum double, sumsq double")
    rest, retained = initial_outliers(first, k, seed)
    found = durable(kmeans(rest, k, seed), "groups") if not rest.isEmpty() else rest.withColumn("cluster", F.lit(0).cast("bigint"))
    discard, compressed = durable(moments(found), "discard"), none
    inside, outside = [found.select("id", "cluster")], []  # assignments to discard and to compressed clusters
    retained, tag, rounds = durable(retained, "retained"), 0, []
    for chunk in range(chunks):
        if chunk:
            new = rows.where(c("chunk") == chunk).select("id", "features")
            joined, others = (durable(x, "assigned") for x in assign(new, durable(centroids(discard), "centers"), limit))
            discard = durable(merged_moments(discard.unionByName(moments(joined))), "discard")
            inside.append(joined.select("id", "cluster"))
            if not compressed.isEmpty():
                joined, others = (durable(x, "assigned") for x in assign(others, durable(centroids(compressed), "centers"), limit))
                compressed = durable(merged_moments(compressed.unionByName(moments(joined))), "compressed")
                outside.append(joined.select("id", "cluster"))
            retained = durable(retained.unionByName(others), "retained")
        if retained.count() > 5 * k:
            several, alone = split_singletons(durable(kmeans(retained, 5 * k, seed), "groups"))
            tag += 5 * k  # the new groups' numbers are their own
            several = durable(several.withColumn("cluster", c("cluster") + tag), "compressed")
            compressed = durable(compressed.unionByName(moments(several)), "compressed")
            outside.append(several.select("id", "cluster"))
            retained = durable(alone.select("id", "features"), "retained")
        if not compressed.isEmpty():
            names = durable(chains(compressed, close), "names")
            compressed = durable(merged_moments(renamed(compressed, names)), "compressed")
            outside = [durable(renamed(x, names), "outside") for x in outside]
        held = compressed.where("dim = 0").agg(F.count("*").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        members = discard.where("dim = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        rounds.append((chunk + 1, members, held["c"], held["n"], retained.count()))
    out = retained.select("id", F.lit(-1).cast("bigint").alias("cluster"))
    for x in inside:
        out = out.unionByName(x)
    if outside:
        centers = centroids(compressed).select(c("cluster").alias("id"), c("centroid").alias("features"))
        near = nearest(centers, durable(centroids(discard), "centers"), scaled=False).where(c("distance") < close)
        to = durable(near.select(c("id").alias("own"), c("cluster").alias("into")), "names")
        for x in outside:
            out = out.unionByName(x.join(F.broadcast(to), c("cluster") == c("own"), "left").select("id", F.coalesce("into", F.lit(-1)).cast("bigint").alias("cluster")))
    return spark.createDataFrame(rounds, "round int, n_discard bigint, n_compressed_clusters bigint, n_compressed bigint, n_retained bigint"), out
