"""Views of the driver's tables in the engine's data model; each is a plain projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Bound:
    """The engine's tables over a folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def tenants(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))

    @property
    def applications(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("tenant_id"), F.col("n_name").alias("name"))

    @property
    def actors(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("application_id"), F.col("s_name").alias("name"))

    @property
    def subjects(self) -> DataFrame:
        """Customers as a four-way tree of folders inside each application; actor_id by key."""
        order = W.partitionBy("c_nationkey").orderBy("c_custkey")
        rows = self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("application_id"), F.col("c_name").alias("name"), (F.row_number().over(order) - 1).alias("n"))
        up = rows.select(F.col("id").alias("parent_subject_id"), F.col("application_id"), F.col("n").alias("up"))
        child = rows.withColumn("up", F.when(F.col("n") > 0, F.floor((F.col("n") - 1) / 4).cast("int")))
        # a merge join: files of customers may be far smaller than their rows in the driver's memory
        return child.join(up.hint("merge"), ["application_id", "up"], "left").select("id", "application_id", "name", "parent_subject_id")

    @property
    def sources(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject_id"), status.alias("status"), F.col("o_orderpriority").alias("type"),
            F.round(F.col("o_totalprice") * 100).cast("bigint").alias("size_bytes"), F.col("o_orderdate").alias("created_at"))

    @property
    def owned_sources(self) -> DataFrame:
        """Sources with their application and tenant."""
        subjects = self.raw("customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_nationkey").alias("application_id"))
        apps = self.applications.select(F.col("id").alias("application_id"), "tenant_id")
        return self.sources.join(subjects, "subject_id").join(apps, "application_id")

    @property
    def usage(self) -> DataFrame:
        """Ledger calls: extraction, model, role, tokens, day."""
        role = F.element_at(F.array(*[F.lit(x) for x in ("layout", "vision", "extract", "graph")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("extraction_id"), F.concat("l_returnflag", "l_linestatus").alias("model"), role.alias("role"),
            F.col("l_quantity").cast("bigint").alias("prompt_tokens"), (F.col("l_quantity") * 3).cast("bigint").alias("completion_tokens"), F.col("l_shipdate").alias("created_at"))

    @property
    def chunks(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("subject_id"), F.col("embedding"))

    @property
    def facts(self) -> DataFrame:
        """Edges customer/supplier LOCATED_IN nation, nation PART_OF region, customer PURCHASED part."""
        located = [self.raw(t).select(F.concat(F.lit(f"{t}:"), F.col(f"{p}key")).alias("a"), F.lit("LOCATED_IN").alias("relation"), F.concat(F.lit("nation:"), F.col(n)).alias("b"), F.lit(0).cast("bigint").alias("source_id"), F.lit(0.9).alias("confidence"))
                   for t, p, n in (("customer", "c_cust", "c_nationkey"), ("supplier", "s_supp", "s_nationkey"))]
        part_of = self.raw("nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey")).alias("a"), F.lit("PART_OF").alias("relation"), F.concat(F.lit("region:"), F.col("n_regionkey")).alias("b"), F.lit(0).cast("bigint").alias("source_id"), F.lit(1.0).alias("confidence"))
        bought = self.raw("lineitem").join(self.raw("orders").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.concat(F.lit("customer:"), F.col("o_custkey")).alias("a"), F.lit("PURCHASED").alias("relation"), F.concat(F.lit("part:"), F.col("l_partkey")).alias("b"),
            F.col("o_orderkey").alias("source_id"), F.round(1 - F.col("l_discount"), 2).alias("confidence"))
        out = part_of
        for edges in (*located, bought):
            out = out.unionByName(edges)
        return out
