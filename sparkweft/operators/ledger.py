"""Cost ledger: prices as of a day, call costs and usage reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATES = "effective_from date, model string, input_per_1m double, output_per_1m double, per_image double, per_call double, free boolean"


def price_table(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Rates by version (effective_from) and model; ``*`` stands for all other models."""
    rates = spark.createDataFrame(list(rows), RATES)
    bad = rates.where("least(input_per_1m, output_per_1m, per_image, per_call) < 0 or effective_from is null")
    if not bad.isEmpty():
        raise ValueError("a price is negative or has no date")
    if not rates.groupBy("effective_from", "model").count().where("count > 1").isEmpty():
        raise ValueError("a model has two prices from one day")
    return rates


def priced(calls: DataFrame, rates: DataFrame, time: str = "created_at") -> DataFrame:
    """Adds the rate in force: of the newest version by the call's day, the model's own, else ``*``.

    Versions are few and joined by day, not by call: distinct days meet the version list once.
    A version that lacks the model leaves the call unpriced; older ones aren't asked.
    """
    versions = rates.select("effective_from").distinct()
    days = calls.select(F.to_date(time).alias("_day")).distinct()
    in_force = days.join(versions, F.col("effective_from") <= F.col("_day")).groupBy("_day").agg(F.max("effective_from").alias("effective_from"))
    fields = ["input_per_1m", "output_per_1m", "per_image", "per_call", "free"]
    own = rates.where("model != '*'").select("effective_from", "model", F.struct(*fields).alias("_own"))
    any_model = rates.where("model = '*'").select("effective_from", F.struct(*fields).alias("_any"))
    out = calls.withColumn("_day", F.to_date(time)).join(in_force, "_day", "left").join(own, ["effective_from", "model"], "left").join(any_model, "effective_from", "left")
    return out.withColumn("rate", F.coalesce("_own", "_any")).drop("_day", "_own", "_any")


def call_cost(rate: str = "rate", role: str = "role") -> Column:
    """Dollars of a call, 6 places; one image for layout and vision calls; null without a rate."""
    r = F.col(rate)
    image = F.when(F.col(role).isin("layout", "vision"), 1).otherwise(0)
    cost = (F.col("prompt_tokens") * r["input_per_1m"] + F.col("completion_tokens") * r["output_per_1m"]) / 1e6 + image * r["per_image"] + r["per_call"]
    return F.when(r["free"], 0.0).otherwise(F.round(cost, 6))


def usage_report(ledger: DataFrame, *by: str) -> DataFrame:
    """Runs, calls, tokens and cost, in all or by columns."""
    measures = [
        F.countDistinct("extraction_id").alias("runs"), F.count("*").alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), F.coalesce(F.round(F.sum("cost_usd"), 4), F.lit(0.0)).alias("cost_usd")]
    return ledger.groupBy(*by).agg(*measures) if by else ledger.agg(*measures)


def trigger_key(kind: str, user: str, credential: str) -> Column:
    """``kind:id`` of whoever started a run."""
    return F.concat_ws(":", F.col(kind), F.coalesce(F.col(user).cast("string"), F.col(credential).cast("string")))
