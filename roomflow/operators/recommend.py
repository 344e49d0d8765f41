"""Model-based recommendations: low-use room clusters and upsell rules.

Room clusters: one-dimensional values are cut where the within-cluster squared
error (the k-means objective) is least, exactly (``operators.cuts``). Lloyd
iterations (Spark ML KMeans, on request) depend on a random start and can stop in a
worse local optimum. Upsell rules mine frequent product sets depth first
(``operators.itemsets``); Spark ML's FPGrowth is the alternative. Training inputs
are small derived tables (one row per room, one basket per tenant), checkpointed to
the reliable checkpoint folder so a lost executor does not replay the scan of the
raw table. Only a handful of scalars (totals, pivots, cuts, k cluster means, the
names of frequent products) ever reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    StringType,
    StructField,
    StructType,
)

from ..functions import columns as C
from ..functions.totals import mean
from ..session import reliable
from .cuts import k_means_cuts
from .itemsets import frequent_itemsets_diffsets


def room_average_utilization(util_df: DataFrame) -> DataFrame:
    """Mean utilization % per room over its months (room_id, avg_utilization)."""
    rooms = C.drop_null_keys(util_df.select("room_id", "utilization_pct"), ["room_id"])
    return rooms.groupBy("room_id").agg(mean(F.col("utilization_pct")).alias("avg_utilization"))


def two_means_cut(values: DataFrame, x: str = "_x") -> float | None:
    """Largest value of the lower cluster in the optimal two-means split of
    column ``x`` (exact; ties stay together), None with fewer than two values."""
    cuts = k_means_cuts(values, 2, x)
    return cuts[0] if cuts else None


def ml_underutilized_rooms(util_df: DataFrame, n_clusters: int = 2, seed: int = 42,
                           max_iter: int = 20, method: str = "auto") -> DataFrame:
    """Rooms in the cluster with the lowest mean utilization.

    Clusters are fitted on the per-room average (NULL as 0 for fitting only);
    ``method='auto'`` takes the optimal cuts (:func:`k_means_cuts`; 'exact' is its
    older name for two clusters), 'kmeans' is Spark ML's (``seed``, ``max_iter``).
    Labels are
    0..k-1 by ascending value, so they do not depend on a random start. Fewer
    distinct averages than clusters give as many clusters as there are values.
    Columns: room_id, avg_utilization, cluster, ml_underutilized. Without
    room_id or utilization_pct the input comes back unchanged.
    """
    if "room_id" not in util_df.columns or "utilization_pct" not in util_df.columns:
        return util_df
    if n_clusters < 1:
        raise ValueError("n_clusters must be >= 1")
    if method not in ("auto", "exact", "kmeans"):
        raise ValueError("method must be 'auto', 'exact' or 'kmeans'")
    rooms = reliable(room_average_utilization(util_df)
                      .withColumn("_x", F.coalesce(F.col("avg_utilization"), F.lit(0.0))))
    if method == "exact" and n_clusters != 2:
        raise ValueError("the exact method is for two clusters")
    if method != "kmeans":
        above = [F.when(F.col("_x") > F.lit(c), 1).otherwise(0)
                 for c in k_means_cuts(rooms, n_clusters)]
        return _lowest_cluster(rooms.select(
            "room_id", "avg_utilization", reduce(lambda p, q: p + q, above, F.lit(0)).alias("cluster")))
    features = VectorAssembler(inputCols=["_x"], outputCol="_features").transform(rooms)
    model = KMeans(k=n_clusters, seed=seed, maxIter=max_iter, featuresCol="_features",
                   predictionCol="_raw").fit(features)
    centres = [float(c[0]) for c in model.clusterCenters()]
    order = sorted(range(len(centres)), key=lambda i: (centres[i], i))
    relabel = F.create_map(*[x for new, old in enumerate(order) for x in (F.lit(old), F.lit(new))])
    labelled = (model.transform(features)
                .withColumn("cluster", F.element_at(relabel, F.col("_raw")).cast("int"))
                .select("room_id", "avg_utilization", "cluster"))
    return _lowest_cluster(labelled)


def _lowest_cluster(labelled: DataFrame) -> DataFrame:
    # k rows: the mean of each cluster (NULL averages skipped), lowest first
    means = (labelled.groupBy("cluster").agg(F.avg("avg_utilization").alias("m"))
             .orderBy(F.asc_nulls_last("m"), "cluster").limit(1).collect())
    lowest = means[0]["cluster"] if means else 0
    flagged = labelled.withColumn("ml_underutilized", F.col("cluster") == F.lit(lowest))
    return flagged.where(F.col("ml_underutilized"))


RULE_SCHEMA = StructType([
    StructField("antecedent", StringType()),
    StructField("consequent", StringType()),
    StructField("consequents", ArrayType(StringType())),
    StructField("support", DoubleType()),
    StructField("confidence", DoubleType()),
    StructField("lift", DoubleType()),
])


def tenant_baskets(bookings: DataFrame) -> DataFrame:
    """One basket (distinct products) per tenant; tenants without any product
    keep an empty basket so they still count as transactions."""
    rows = bookings.select(C.col(C.TENANT).alias("tenant"), C.col("product_name").alias("item"))
    rows = rows.where(F.col("tenant").isNotNull())
    return (rows.groupBy("tenant")
            .agg(F.array_sort(F.collect_set("item")).alias("items")))


def _support_ok(n: int, min_support: float):
    return F.col("freq").cast("double") / F.lit(float(n)) >= F.lit(float(min_support))


def frequent_itemsets(baskets: DataFrame, min_support: float) -> tuple[DataFrame, int]:
    """FPGrowth itemsets (items sorted, freq) and the number of baskets."""
    n = baskets.count()
    if n == 0:
        return baskets.sparkSession.createDataFrame([], "items array<string>, freq bigint"), 0
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(baskets)
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").cast("bigint"))
    # exact support test (the trainer rounds min count up from a double product)
    return sets.where(_support_ok(n, min_support)), n


def ml_product_upsell(bookings: DataFrame, min_support: float = 0.05,
                      min_confidence: float = 0.3, max_consequents: int | None = None,
                      method: str = "diffsets") -> DataFrame:
    """Association rules with one antecedent product, strongest first.

    Baskets are the products of each tenant. For every frequent itemset I of
    size >= 2 and each item a in I the rule {a} -> I minus a has
    support = freq(I)/N, confidence = freq(I)/freq(a) and
    lift = confidence / support(I minus a); both sides are frequent itemsets
    themselves (downward closure), so two equi-joins on the itemset table give
    every number. Columns: antecedent, consequent (first of the sorted
    consequent set), consequents, support, confidence, lift.
    ``max_consequents`` keeps only consequent sets up to that size (and stops
    mining at itemsets one larger). ``method``: 'diffsets' (default, see
    ``operators.itemsets``) or 'fpgrowth' (Spark ML FPGrowth, whose work grows
    with its partition count on dense baskets).
    """
    spark = bookings.sparkSession
    if C.TENANT not in bookings.columns or "product_name" not in bookings.columns:
        return spark.createDataFrame([], RULE_SCHEMA)
    if method == "diffsets":
        max_size = None if max_consequents is None else max_consequents + 1
        sets, n = frequent_itemsets_diffsets(bookings, min_support, max_size)
        sets = reliable(sets) if n else sets
    elif method == "fpgrowth":
        sets, n = frequent_itemsets(reliable(tenant_baskets(bookings)), min_support)
        sets = reliable(sets) if n else sets
    else:
        raise ValueError("method must be 'diffsets' or 'fpgrowth'")
    if n == 0:
        return spark.createDataFrame([], RULE_SCHEMA)
    singles = sets.where(F.size("items") == 1).select(
        F.col("items")[0].alias("antecedent"), F.col("freq").alias("freq_a"))
    rest_sets = sets.select(F.col("items").alias("consequents"), F.col("freq").alias("freq_c"))
    cands = (sets.where(F.size("items") >= 2)
             .select(F.col("freq").alias("freq_ac"), F.col("items"),
                     F.explode("items").alias("antecedent"))
             .withColumn("consequents", F.array_remove("items", F.col("antecedent"))))
    if max_consequents is not None:
        cands = cands.where(F.size("consequents") <= max_consequents)
    nn = float(n)
    # confidence needs the antecedent only: most sets go before they meet their other half
    strong = (cands.join(singles, "antecedent")
              .withColumn("confidence", F.col("freq_ac").cast("double") / F.col("freq_a").cast("double"))
              .where(F.col("confidence") >= F.lit(float(min_confidence))))
    rules = (strong.join(rest_sets, "consequents")
             .withColumn("support", F.col("freq_ac").cast("double") / F.lit(nn))
             .withColumn("lift", F.col("confidence") / (F.col("freq_c").cast("double") / F.lit(nn))))
    return (rules.select("antecedent", F.col("consequents")[0].alias("consequent"), "consequents",
                         "support", "confidence", "lift")
            .orderBy(F.desc("confidence"), F.desc("support"), "antecedent", "consequents"))
