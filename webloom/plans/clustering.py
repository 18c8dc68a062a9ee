"""Result clustering job: saved analysis rows -> k-means -> labelled rows,
centroids and the scatter table behind the links-vs-rank chart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from webloom.constants import ANALYSIS_TAG, KMEANS_K, KMEANS_MAX_ITER
from webloom.operators import cluster as CL
from webloom.sources import readers


@dataclass
class Clusters:
    labelled: DataFrame   # (url, total_links, rank, label)
    centroids: DataFrame  # (label, n, total_links, rank)
    scatter: DataFrame    # (url, total_links, rank, log_rank) inside the chart range


def cluster_results(rows: DataFrame, k: int = KMEANS_K, max_iter: int = KMEANS_MAX_ITER,
                    seed: int = 7) -> Clusters:
    labelled = CL.assign(rows, CL.fit(rows, k, max_iter, seed))
    return Clusters(labelled=labelled, centroids=CL.centroids(labelled),
                    scatter=CL.scatter_points(rows))


def run(spark: SparkSession, analysis_dir: str, out_dir: str, tag: str = ANALYSIS_TAG,
        k: int = KMEANS_K, seed: int = 7) -> Clusters:
    """Read every saved analysis file with ``tag`` in its name, cluster, write."""
    c = cluster_results(readers.read_analysis(spark, analysis_dir, tag), k, seed=seed)
    c.labelled.write.mode("overwrite").parquet(f"{out_dir}/labelled")
    c.centroids.write.mode("overwrite").parquet(f"{out_dir}/centroids")
    c.scatter.write.mode("overwrite").parquet(f"{out_dir}/scatter")
    return c
