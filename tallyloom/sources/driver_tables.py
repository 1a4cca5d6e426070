"""The canonical tables, from the star schema: order = basket, part = item, nation of the customer = leader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Item type that stands for basic lands: everyone has them, so they are left out of statistics.
BASIC = "ECONOMY"


class Tables:
    """Lazy canonical tables of a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def baskets(self) -> DataFrame:
        """(basket_id, leader, owner): all baskets, empty ones too."""
        c = self.read("customer").select(F.col("c_custkey").alias("owner"), F.col("c_nationkey").alias("leader"))
        return self.read("orders").select(F.col("o_orderkey").alias("basket_id"), F.col("o_custkey").alias("owner")).join(c, "owner").select("basket_id", "leader", "owner")

    def items(self) -> DataFrame:
        """(item, name, kind, cost, brand, price)."""
        return self.read("part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("cost"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))

    def lines(self) -> DataFrame:
        """(basket_id, leader, owner, item, qty): a row for each line."""
        lines = self.read("lineitem").select(F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("item"), F.col("l_quantity").cast("long").alias("qty"))
        return lines.join(self.baskets(), "basket_id")

    def basket_items(self) -> DataFrame:
        """(basket_id, leader, item): each item of a basket once, basics left out."""
        kept = self.items().where(F.col("kind") != BASIC).select("item")
        lines = self.read("lineitem").select(F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("item")).join(kept, "item")
        # baskets are dealt once, into tasks of about a million lines, and what is alike meets there
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.read("lineitem").count() >> 20)
        return lines.repartition(n, "basket_id").join(self.baskets().repartition(n, "basket_id"), "basket_id").select("basket_id", "leader", "item").distinct()

    def decks(self) -> DataFrame:
        """(leader, item, qty): for each leader the items of the owner with most baskets."""
        rank = F.row_number().over(W.partitionBy("leader").orderBy(F.desc("n"), "owner"))
        best = self.baskets().groupBy("leader", "owner").agg(F.count("*").alias("n")).withColumn("r", rank).where("r = 1").select("leader", "owner")
        return self.lines().join(best, ["leader", "owner"]).groupBy("leader", "item").agg(F.sum("qty").alias("qty"))

    def collection(self) -> DataFrame:
        """(item, qty): returned lines are what is at hand."""
        return self.read("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").alias("qty"))

    def opened(self) -> DataFrame:
        """(item): items of the first opened sets, suppliers with a balance over 9000."""
        s = self.read("supplier").where("s_acctbal > 9000").select(F.col("s_suppkey").alias("l_suppkey"))
        return self.read("lineitem").join(s, "l_suppkey", "left_semi").select(F.col("l_partkey").alias("item")).distinct()

    def printings(self) -> DataFrame:
        """(item, printing, price, day, currency): a row for each line."""
        return self.read("lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("printing"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 8).alias("price"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.col("l_returnflag").alias("currency"))

    def tags(self) -> DataFrame:
        """(item, tag): the words of the name."""
        return self.items().select("item", F.explode(F.split("name", " ")).alias("tag"))

    def vectors(self) -> DataFrame:
        """(item, vec array<double>, cluster)."""
        return self.read("embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("cluster"))

    def nations(self) -> DataFrame:
        """(leader, name, region)."""
        return self.read("nation").select(F.col("n_nationkey").alias("leader"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))

    def item_colours(self) -> DataFrame:
        """(item, colours): the bits of the cost, of five."""
        return self.items().select("item", F.expr("filter(sequence(0, 4), b -> shiftright(cost, b) % 2 = 1)").alias("colours"))

    def leader_colours(self) -> DataFrame:
        return self.nations().select("leader", F.expr("filter(sequence(0, 4), b -> shiftright((leader * 7 + 3) % 32, b) % 2 = 1)").alias("colours"))
