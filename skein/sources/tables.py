"""Graphs derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.model import Graph


def pair_weight(a: str = "src", b: str = "dst") -> Column:
    """A symmetric whole-number weight."""
    return (1 + (F.least(a, b) * 31 + F.greatest(a, b) * 17) % 97).cast("double")


def with_coordinates(vertices: DataFrame) -> DataFrame:
    lon = F.radians((F.col("id") * 7919 % 360000) / 1000.0 - 180)
    lat = F.radians((F.col("id") * 104729 % 180000) / 1000.0 - 90)
    return vertices.select("id", lon.alias("lon"), lat.alias("lat"))


def part_chain(spark: SparkSession, sf_dir: str, by: str = "order") -> Graph:
    """Parts that follow each other in an order (returned lines) or at a supplier (large quantities)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key, keep = ("l_orderkey", "l_returnflag = 'R'") if by == "order" else ("l_suppkey", "l_quantity >= 48")
    w = Window.partitionBy(key).orderBy("l_orderkey", "l_linenumber", "l_partkey")
    chain = lines.where(keep).select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    edges = chain.where("dst is not null and src <> dst").distinct().withColumn("weight", pair_weight())
    return Graph(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id")), edges)
