"""Clustering of search results on (total links, rank): Spark ML k-means, or rounds
of k-means from given centres, whose result is the same wherever it runs."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.constants import KMEANS_K, KMEANS_MAX_ITER, SCATTER_MAX, SCATTER_MIN
from webloom.operators.paging import listing_page, write_listing
from webloom.session import ensure_checkpoint_dir

FEATURES = ("total_links", "rank")


def complete(rows: DataFrame) -> Column:
    """Whether a row has both features (neither NULL nor NaN)."""
    return reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in FEATURES])


def features(rows: DataFrame) -> DataFrame:
    """Complete rows plus a ``features`` vector ``[total_links, rank]``."""
    cast = rows.filter(complete(rows)).withColumn("total_links", F.col("total_links").cast("double"))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(cast)


def fit(rows: DataFrame, k: int = KMEANS_K, max_iter: int = KMEANS_MAX_ITER,
        seed: int = 7) -> KMeansModel:
    """k-means (k-means|| initialisation, fixed seed) on the feature vectors."""
    return KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="features",
                  predictionCol="label").fit(features(rows))


def lloyd(rows: DataFrame, centres: list[tuple[float, float]], rounds: int = KMEANS_MAX_ITER) -> list[tuple[float, float]]:
    """Centres after at most ``rounds`` rounds of k-means from the given ones, fewer
    once none moves. A centre that loses all its rows stays where it is. A round
    is one scan and a partial aggregate; only its k sums come to the driver."""
    centres = [tuple(map(float, c)) for c in centres]
    for _ in range(rounds):
        found = {r["label"]: (r["total_links"], r["rank"]) for r in centroids(nearest(rows, centres)).collect()}
        moved = [found.get(i, c) for i, c in enumerate(centres)]
        if moved == centres:
            break
        centres = moved
    return centres


def spread_centres(rows: DataFrame, k: int = KMEANS_K) -> list[tuple[float, float]]:
    """k distinct starting centres that depend on the rows alone: those at equal steps
    through the distinct complete rows by (total_links, rank)."""
    links, rank = F.col("total_links").cast("double"), F.col("rank").cast("double")
    points = rows.filter(complete(rows)).select(links.alias("total_links"), rank.alias("rank")).distinct()
    n = points.count()
    path = f"{ensure_checkpoint_dir(rows.sparkSession)}/listing-{uuid.uuid4().hex}"
    write_listing(points, path, "total_links", "rank")
    picks = [listing_page(rows.sparkSession, path, i * n // min(k, n), 1) for i in range(min(k, n))]
    return [(r["total_links"], r["rank"]) for p in picks for r in p.collect()]


def assign(rows: DataFrame, model: KMeansModel) -> DataFrame:
    """Nearest-centroid label for every row: ``(url, total_links, rank, label)``;
    a row that lacks a feature keeps its place with a NULL label.

    The model's k centres travel with the task closure; rows are never shuffled.
    """
    return nearest(rows, model_centroids(model))


def nearest(rows: DataFrame, centres: list[tuple[float, float]]) -> DataFrame:
    """Label of the nearest centre (the first of equally near ones) for every row."""
    links, rank = F.col("total_links").cast("double"), F.col("rank").cast("double")
    far = [F.pow(links - F.lit(x), 2) + F.pow(rank - F.lit(y), 2) for x, y in centres]
    least = F.array_min(F.array(*far))
    label = F.when(complete(rows), F.array_position(F.array(*far), least) - 1).cast("int")
    return rows.select("url", links.alias("total_links"), "rank", label.alias("label"))


def centroids(labelled: DataFrame) -> DataFrame:
    """Centroid table ``(label, n, total_links, rank)`` from labelled rows; rows
    without a label belong to none."""
    return labelled.filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                         F.avg("total_links").alias("total_links"),
                                         F.avg("rank").alias("rank"))


def model_centroids(model: KMeansModel) -> list[tuple[float, float]]:
    return [tuple(float(v) for v in c) for c in model.clusterCenters()]


def scatter_points(rows: DataFrame, lo: float = SCATTER_MIN, hi: float = SCATTER_MAX) -> DataFrame:
    """Points behind the links-vs-rank chart inside its axis range, with log10 rank."""
    inside = (F.col("total_links").between(lo, hi) & F.col("rank").between(lo, hi))
    return rows.filter(inside).select("url", "total_links", "rank",
                                      F.log10("rank").alias("log_rank"))
