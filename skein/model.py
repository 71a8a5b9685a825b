"""The graph: two tables, and the views that kernels read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """``vertices(id, ...)`` with ids 0..n-1 and ``edges(src, dst[, weight])``: directed, distinct, without self loops."""

    vertices: DataFrame
    edges: DataFrame

    @property
    def weighted(self) -> bool:
        return "weight" in self.edges.columns

    def out(self) -> DataFrame:
        """``(src, dst, weight)``; the weight is 1 where edges have none."""
        weight = F.col("weight").cast("double") if self.weighted else F.lit(1.0)
        return self.edges.select("src", "dst", weight.alias("weight"))

    def reversed(self) -> Graph:
        swap = [F.col("dst").alias("src"), F.col("src").alias("dst")]
        return Graph(self.vertices, self.edges.select(*swap, *[c for c in self.edges.columns if c not in ("src", "dst")]))

    def as_undirected(self) -> Graph:
        """Every edge in both directions, once; the smaller weight where two meet."""
        both = self.edges.unionByName(self.reversed().edges)
        if self.weighted:
            return Graph(self.vertices, both.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
        return Graph(self.vertices, both.distinct())

    def pairs(self) -> DataFrame:
        """Unordered pairs ``(a, b)`` with a < b, once each."""
        return self.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    def adjacency(self) -> DataFrame:
        """``(id, nbr, incoming)``: each pair at both its ends; an entry is outgoing if any edge leaves there or the pair is mutual."""
        ends = self.edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr"), F.lit(1).alias("o"))
        other = self.edges.select(F.col("dst").alias("id"), F.col("src").alias("nbr"), F.lit(0).alias("o"))
        return ends.unionByName(other).groupBy("id", "nbr").agg((F.max("o") == 0).alias("incoming"))

    def degrees(self) -> DataFrame:
        """``(id, out_degree, degree)``; ``degree`` counts distinct neighbours."""
        out = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
        total = self.adjacency().groupBy("id").agg(F.count("*").alias("degree"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return self.vertices.select("id").join(out, "id", "left").join(total, "id", "left").select("id", zero("out_degree"), zero("degree"))

    def summary(self) -> DataFrame:
        """One row: ``vertices, alist_entries, bits_per_edge, alist_bytes`` of the packed adjacency."""
        v = self.vertices.agg(F.count("*").alias("vertices"))
        e = self.pairs().agg((2 * F.count("*")).alias("alist_entries"))
        both = v.join(e, F.lit(True)).withColumn("bits_per_edge", bits_per_edge(F.col("vertices")))
        return both.withColumn("alist_bytes", F.expr("(alist_entries * bits_per_edge + 7) div 8"))


def bits_per_edge(n):
    """Bits of the largest id and of the direction flag."""
    return (F.length(F.bin(F.greatest(n - 1, F.lit(1)))) + 1).cast("long")
