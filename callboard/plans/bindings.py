"""The domain's tables as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Funding kinds of order priorities.
KINDS = {"1-URGENT": "exact", "2-HIGH": "minimum", "3-MEDIUM": "maximum", "4-NOT SPECIFIED": "not_stated", "5-LOW": "unknown"}


class Tables:
    """Lazy frames over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sources(self) -> DataFrame:
        return self.nation.select(F.col("n_name").alias("source_key"))

    def programs(self) -> DataFrame:
        """Orders as programs, customers' nations as their sources."""
        kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.col("o_orderpriority")]
        money = F.col("o_totalprice").cast("decimal(14,2)")
        numeric = F.col("value_kind").isin("exact", "minimum", "maximum")
        rows = self.orders.withColumn("value_kind", kind).join(self.customer, F.col("o_custkey") == F.col("c_custkey")).join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.select(
            F.col("o_orderkey").alias("program_id"), F.col("n_name").alias("source_key"), F.when(F.col("o_orderstatus") == "P", "hidden").otherwise("published").alias("publication_status"),
            F.col("o_orderstatus").alias("source_status"), F.col("o_orderdate").alias("published_at"), F.col("o_orderdate").cast("date").alias("deadline_on"), "value_kind",
            F.when(numeric, "USD").alias("currency_code"), *(F.when(F.col("value_kind") == k, money).alias(f"{n}_amount") for k, n in (("exact", "exact"), ("minimum", "min"), ("maximum", "max"))),
            F.when(numeric, money).alias("funding"), F.concat(F.lit("Call "), F.col("o_orderkey")).alias("title"), F.col("c_mktsegment").alias("support_type"), F.year("o_orderdate").alias("launch_year"),
        )

    def themes(self) -> DataFrame:
        rows = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        return rows.select(F.col("l_orderkey").alias("program_id"), F.col("p_type").alias("slug")).distinct()

    def geographies(self) -> DataFrame:
        rows = self.lineitem.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(self.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return rows.select(F.col("l_orderkey").alias("program_id"), F.col("r_name").alias("slug")).distinct()

    def bi_programs(self) -> DataFrame:
        """Programs with their topics and regions as arrays."""
        topics = self.themes().groupBy("program_id").agg(F.sort_array(F.collect_set("slug")).alias("topics"))
        regions = self.geographies().groupBy("program_id").agg(F.sort_array(F.collect_set("slug")).alias("regions"))
        rows = self.programs().join(topics, "program_id", "left").join(regions, "program_id", "left")
        none = F.array().cast("array<string>")
        return rows.withColumn("topics", F.coalesce("topics", none)).withColumn("regions", F.coalesce("regions", none)).withColumn("is_active", F.col("source_status") == "O").withColumn("deadline", F.col("deadline_on")).withColumn("source_id", F.col("source_key"))

    def brand_links(self) -> DataFrame:
        """Suppliers and the brands of their line items."""
        rows = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        return rows.select(F.col("l_suppkey").alias("src"), F.col("p_brand").alias("dst"), F.col("l_orderkey").alias("program_id"))

    def members(self) -> DataFrame:
        """Users with events in each week, with a level, a count and the kinds of their events."""
        from callboard.operators.temporal import week_start

        rows = self.events.select(week_start(F.col("ts")).alias("week_start"), F.col("user_id").alias("entity"), "value", "event_type")
        return rows.groupBy("week_start", "entity").agg(F.floor(F.max("value") / 50).cast("int").alias("level"), F.count(F.lit(1)).cast("int").alias("entries"), F.array_sort(F.collect_set("event_type")).alias("kinds"))
