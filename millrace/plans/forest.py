"""Queries about the forest whose answers SQL can state: which rows have predictions, and bounds on how wrong they are."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace import sources
from millrace.operators import model, stats
from millrace.plans import catalog
from millrace.plans.catalog import query
from millrace.sources import inferred

_TOTALS = "WITH v AS (SELECT p_partkey, p_name, p_brand, sum(l_extendedprice) AS total, substr(md5(CAST(p_partkey AS VARCHAR)), 1, 2) < 'cd' AS train FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL) "


@query(_TOTALS + "SELECT count(*) FILTER (total <> 0) AS n_used, count(*) FILTER (total = 0) AS n_zero, TRUE AS better_than_mean, TRUE AS near FROM v WHERE NOT train")
def ml_rf_bound(t):
    """Predictions for rows that weren't fitted are less wrong than the mean of those that were, and by under a tenth on the whole."""
    parts, names, forest = catalog._fitted(t)
    mean = parts.filter(model.in_training("p_partkey")).agg(F.avg(catalog._TARGET).alias("mean"))
    rows = model.predict(parts.filter(~model.in_training("p_partkey")), forest, names).join(F.broadcast(mean))
    own = stats.mape(rows, catalog._TARGET, "prediction")
    other = stats.mape(rows, catalog._TARGET, "mean").select(F.col("mape").alias("of_mean"))
    whole = rows.agg((F.abs(F.sum("prediction") - F.sum(catalog._TARGET)) < 0.1 * F.sum(catalog._TARGET)).alias("near"))
    return own.join(F.broadcast(other)).join(F.broadcast(whole)).select("n_used", "n_zero", (F.col("mape") < F.col("of_mean")).alias("better_than_mean"), "near")


@query(_TOTALS + "SELECT p_partkey, p_name, TRUE AS inside FROM v")
def ml_predictions_file(t):
    """The predictions joined to their parts by key, written as CSV and read back: each within what the forest has seen."""
    parts, names, forest = catalog._fitted(t)
    predicted = model.predict(parts, forest, names).select("p_partkey", "prediction")
    folder = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/predictions-{uuid.uuid4().hex}"
    sources.write_csv(t.part.select("p_partkey", "p_name").join(predicted, "p_partkey"), path)
    ends = parts.filter(model.in_training("p_partkey")).agg(F.min(catalog._TARGET).alias("least"), F.max(catalog._TARGET).alias("most"))
    back = inferred.read_csv(t.spark, path).rows.join(F.broadcast(ends))
    return back.select("p_partkey", "p_name", F.col("prediction").between(F.col("least") * 0.999999, F.col("most") * 1.000001).alias("inside"))


@query("SELECT CAST(1 AS DOUBLE) AS total, TRUE AS all_used")
def ml_importance_sum(t):
    parts, names, forest = catalog._fitted(t)
    shares = model.importances(parts, forest, names, n=len(names))
    return shares.agg(F.round(F.sum("importance"), 6).alias("total"), (F.count_if(F.col("importance") > 0) == len(names)).alias("all_used"))


@query(_TOTALS + "SELECT p_brand, count(*) AS n, TRUE AS bounded FROM v GROUP BY p_brand")
def ml_residual_by_brand(t):
    """How far predictions are from the actual values, by brand: less than these are from each other."""
    parts, names, forest = catalog._fitted(t)
    rows = model.predict(parts, forest, names)
    gaps = rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("prediction") - F.col(catalog._TARGET))).alias("gap"), F.stddev_pop(catalog._TARGET).alias("spread"))
    return gaps.select("p_brand", "n", (F.col("gap") < F.col("spread")).alias("bounded"))
