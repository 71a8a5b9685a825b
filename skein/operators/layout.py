"""Relabelling, packed sizes, text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.scalar import bit_length
from skein.model import Graph
from skein.operators import kernels
from skein.operators.traverse import bfs_forest
from skein.plans.ranking import global_row_number


def order_of(g: Graph, order: str = "identity", seed: int = 1, start: int = 0) -> DataFrame:
    """``(id, new_id)``, a permutation of the ids.

    ``identity``, ``hash`` (by a multiplicative hash), ``random`` (by a seeded
    hash), ``half`` (the lower half stays, the upper is dealt by the multiplicative hash), ``bfs`` (root,
    level, id), ``subtree`` and ``subtree_light`` (see ``kernels.subtree_order``).
    """
    ids = g.vertices.select("id")
    if order == "identity":
        return ids.select("id", F.col("id").alias("new_id"))
    if order.startswith("subtree"):
        return kernels.subtree_order(g, order == "subtree").select("id", "new_id")
    if order == "hash":
        keyed = ids.withColumn("k", F.col("id") * 2654435761 % 4294967296)
    elif order == "random":
        keyed = ids.withColumn("k", F.xxhash64("id", F.lit(seed)))
    elif order == "half":
        n = g.vertices.count()
        keyed = ids.withColumn("k", F.when(F.col("id") < n // 2, F.struct(F.lit(0).alias("u"), F.col("id").alias("v"))).otherwise(F.struct(F.lit(1).alias("u"), (F.col("id") * 2654435761 % 4294967296).alias("v"))))
    elif order == "bfs":
        n = g.vertices.count()
        keyed = bfs_forest(g, start).select("id", F.struct(F.pmod(F.col("root") - start, F.lit(n)), F.col("level")).alias("k"))
    else:
        raise ValueError(order)
    return global_row_number(keyed, ["k", "id"], "new_id").select("id", "new_id")


def apply_mapping(g: Graph, mapping: DataFrame) -> Graph:
    """The graph under ``(id, new_id)``."""
    a, b = mapping.select(F.col("id").alias("src"), F.col("new_id").alias("ns")), mapping.select(F.col("id").alias("dst"), F.col("new_id").alias("nd"))
    rest = [c for c in g.edges.columns if c not in ("src", "dst")]
    edges = g.edges.join(a, "src").join(b, "dst").select(F.col("ns").alias("src"), F.col("nd").alias("dst"), *rest)
    other = [c for c in g.vertices.columns if c != "id"]
    return Graph(g.vertices.join(mapping, "id").select(F.col("new_id").alias("id"), *other), edges)


def relabel(g: Graph, order: str = "random", **how) -> Graph:
    return apply_mapping(g, order_of(g, order, **how))


def cal_bits(g: Graph) -> DataFrame:
    """``(id, bits)`` of the delta-coded adjacency: the deltas' bits, one step per level, two flags per entry."""
    delta = bit_length(F.abs(F.col("id") - F.col("nbr")))
    return g.adjacency().groupBy("id").agg((F.sum(delta) + F.max(delta) - 1 + 2 * F.count("*")).alias("bits"))


def cal_size(g: Graph) -> DataFrame:
    return cal_bits(g).agg(F.expr("(coalesce(sum(bits), 0) + 7) div 8").alias("alist_bytes"))


def dot_lines(g: Graph) -> DataFrame:
    """``(line)``: one Graphviz edge per out-edge."""
    return g.edges.select(F.format_string("\t%d -> %d;", "src", "dst").alias("line"))


def write_dot(g: Graph, path: str) -> None:
    """A folder of part files; head and tail are written with the first and last range of sources."""
    body = dot_lines(g).withColumn("k", F.lit(1)).unionByName(g.vertices.sparkSession.createDataFrame([("digraph {", 0), ("}", 2)], "line string, k int"))
    body.orderBy("k", "line").select("line").write.text(path)


def tsv_lines(g: Graph, counted: bool = True) -> DataFrame:
    """``(k, line)``: the header (k = 0) with the numbers of vertices and edges, and one line for each edge."""
    edges = g.edges.select(F.lit(1).alias("k"), F.format_string("%d \t%d", "src", "dst").alias("line"))
    sizes = g.vertices.agg(F.count("*").alias("n")).join(g.edges.agg(F.count("*").alias("m")), F.lit(True))  # one row
    head = sizes.select(F.lit(0).alias("k"), F.explode(F.array(F.format_string("# Nodes: %d Edges: %d", "n", "m"), F.lit("# NodeId \tNodeId"))).alias("line"))
    return head.unionByName(edges)


def write_tsv(g: Graph, path: str) -> None:
    """A folder of part files in order: the header stands at the head of the first, edges by source and target."""
    tsv_lines(g).orderBy("k", F.split("line", " \t")[0].try_cast("long"), "line").select("line").write.text(path)


def sorted_entries(g: Graph) -> DataFrame:
    """``(pos, id, nbr, incoming)``: all entries with their place in the order by vertex and neighbour; sorted by ranges, so no task holds more than its own."""
    return global_row_number(g.adjacency(), ["id", "nbr"], "pos").select("pos", "id", "nbr", "incoming")


def write_sorted(g: Graph, path: str) -> None:
    """A folder of part files with ``from to F|R`` lines of all entries, in order over the parts."""
    line = F.format_string("%d %d %s", F.col("id"), F.col("nbr"), F.when(F.col("incoming"), "R").otherwise("F"))
    g.adjacency().orderBy("id", "nbr").select(line).write.text(path)


def write_jdbc(g: Graph, url: str, table: str, **options: str) -> None:
    """Edges to a database table, in parallel connections; needs the database's driver on the class path."""
    g.edges.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def edge_ordinal(g: Graph) -> DataFrame:
    """``(src, dst, pos)``: the place of each edge among its source's, by target."""
    from pyspark.sql import Window

    return g.edges.select("src", "dst", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).cast("long").alias("pos"))
