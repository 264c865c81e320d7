"""Statistical models on feature tables: clipping, PCA, clusters, pairwise preferences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.session import materialize


def clip_standardise(df: DataFrame, columns: list[str], upper: float = 0.99) -> DataFrame:
    """Each column cut at its upper percentile, then mean 0 and population deviation 1 (a constant column becomes 0)."""
    caps = df.agg(*[F.percentile_approx(c, upper, 10_000).alias(c) for c in columns]).first()
    cut = df.withColumns({c: F.least(F.col(c), F.lit(caps[c])) for c in columns})
    m = cut.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return cut.withColumns({c: F.lit(0.0) if not m[f"s_{c}"] else (F.col(c) - F.lit(m[f"m_{c}"])) / F.lit(m[f"s_{c}"]) for c in columns})


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df)


def principal_components(df: DataFrame, key: str, columns: list[str], k: int = 3) -> tuple[DataFrame, DataFrame]:
    """(key, pc array) and the loadings (feature, component, loading)."""
    v = _vectors(df, columns)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(v)
    rows = [(c, j + 1, float(model.pc[i, j])) for i, c in enumerate(columns) for j in range(k)]
    return model.transform(v).select(key, vector_to_array("pc").alias("pc")), df.sparkSession.createDataFrame(rows, "feature string, component int, loading double")


def cluster_trials(df: DataFrame, columns: list[str], ks: range = range(2, 6), seed: int = 7) -> DataFrame:
    """(k, silhouette, cost) of k-means for each k; the silhouette uses squared Euclidean distance."""
    v = _vectors(df, columns).cache()
    rows = []
    for k in ks:
        m = KMeans(k=k, seed=seed, maxIter=20).fit(v)
        rows.append((k, float(ClusteringEvaluator().evaluate(m.transform(v))), float(m.summary.trainingCost)))
    v.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, cost double")


def truncated_svd(weights: DataFrame, key: str, term: str, weight: str, k: int, buckets: int = 1 << 8) -> DataFrame:
    """(key, vector array<double>): each row's sparse vector (key, term, weight) on its k leading singular directions, of length 1. Terms
    share ``buckets`` by hash, which bounds the matrix that reaches the driver to buckets squared.
    """
    b = weights.groupBy(key, F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int").alias("i")).agg(F.sum(weight).alias("w"))
    rows = materialize(b.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("z")), "rows")

    def products(batches):
        """Each task's sum of the products of its rows with themselves."""
        total = np.zeros((buckets, buckets))
        for p in batches:
            for z in p["z"]:
                i, w = np.array([x["i"] for x in z]), np.array([x["w"] for x in z])
                total[np.ix_(i, i)] += np.outer(w, w)
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})

    cells = rows.mapInPandas(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    gram = np.zeros((buckets, buckets))
    gram[cells["i"], cells["j"]] = cells["v"]
    basis = weights.sparkSession.sparkContext.broadcast(np.linalg.eigh(gram)[1][:, ::-1][:, :k])  # its eigenvectors, largest first

    def project(batches):
        for p in batches:
            out = []
            for z in p["z"]:
                y = sum((basis.value[x["i"]] * x["w"] for x in z), np.zeros(basis.value.shape[1]))
                out.append(y / (np.linalg.norm(y) or 1.0))
            yield pd.DataFrame({key: p[key], "vector": out})

    return rows.mapInPandas(project, f"{key} {dict(weights.dtypes)[key]}, vector array<double>")


def clusters(df: DataFrame, key: str, columns: list[str], k: int, seed: int = 7) -> DataFrame:
    """(key, cluster)."""
    v = _vectors(df, columns)
    return KMeans(k=k, seed=seed, maxIter=20).fit(v).transform(v).select(key, F.col("prediction").alias("cluster"))


def preference_model(pairs: DataFrame, names: list[str], least: int = 20) -> DataFrame:
    """(name, weight) of a logistic model of choices on feature differences, symmetric and without intercept.

    pairs: (left map<string,double>, right map<string,double>, choice, split); trains on split 'train' and choices left or
    right. Fewer than ``least`` directional labels give an empty table.
    """
    p = pairs.filter(F.col("choice").isin("left", "right"))
    d = [(F.coalesce(F.col("left")[n], F.lit(0.0)) - F.coalesce(F.col("right")[n], F.lit(0.0))).alias(n) for n in names]
    x = p.filter("split = 'train'").select(*d, (F.col("choice") == "left").cast("double").alias("label"))
    if p.limit(least).count() < least or x.select("label").distinct().count() < 2:
        return pairs.sparkSession.createDataFrame([], "name string, weight double")
    both = x.unionByName(x.select(*[(-F.col(n)).alias(n) for n in names], (1 - F.col("label")).alias("label")))
    m = LogisticRegression(fitIntercept=False, regParam=0.01, maxIter=50).fit(_vectors(both, names))
    return pairs.sparkSession.createDataFrame([(n, float(w)) for n, w in zip(names, m.coefficients)], "name string, weight double")
