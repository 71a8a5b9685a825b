"""Edge lists, road networks and headers in text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.model import Graph


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.startswith(F.trim("value"), F.lit("#")) & (F.trim("value") != ""))
    return lines.select(F.split(F.trim("value"), "[ \t]+").alias("f"))


def merge(rows: DataFrame) -> DataFrame:
    """One entry per (a, b) from ``(a, b, out[, weight, at])``: outgoing wins, and so does the last outgoing weight."""
    aggs = [F.max(F.col("out").cast("int")).alias("o")]
    if "weight" in rows.columns:
        aggs.append(F.max_by("weight", F.struct(F.col("out"), F.col("at"))).alias("weight"))
    return rows.where("a <> b").groupBy("a", "b").agg(*aggs).withColumn("out", F.col("o") == 1).drop("o")


def read_edge_text(spark: SparkSession, *paths: str) -> Graph:
    """``from to F|R`` lines of forward and reverse files; self loops go, repeats merge with outgoing winning."""
    rows = None
    for p in paths:
        one = _fields(spark, p).select(F.get("f", F.lit(0)).cast("long").alias("a"), F.get("f", F.lit(1)).cast("long").alias("b"), (F.get("f", F.lit(2)) == "F").alias("out"))
        rows = one if rows is None else rows.unionByName(one)
    edges = merge(rows).where("out").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return Graph(vertices_of(spark, edges, header_count(spark, paths[0])), edges)


def header_count(spark: SparkSession, path: str) -> int | None:
    """n of a ``# Nodes: n`` header."""
    hit = spark.read.text(path).select(F.regexp_extract("value", r"^#\s*Nodes:\s*([0-9]+)", 1).alias("n")).where("n <> ''").first()
    return int(hit[0]) if hit else None


def vertices_of(spark: SparkSession, edges: DataFrame, n: int | None = None) -> DataFrame:
    if n is None:
        n = (edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or -1) + 1
    return spark.range(n)


def read_dimacs(spark: SparkSession, edges_path: str, coords_path: str | None = None, reverse_path: str | None = None) -> Graph:
    """1-based ``from to F|R metres`` lines, of a forward and a reverse file, and ``v id x y`` coordinates in millionths of a degree; weights in km, angles in radians."""
    f = _fields(spark, edges_path)
    if reverse_path is not None:
        f = f.unionByName(_fields(spark, reverse_path))
    f = f.withColumn("at", F.monotonically_increasing_id())
    at = lambda i, kind="long": F.get("f", F.lit(i)).cast(kind)
    rows = f.select((at(0) - 1).alias("a"), (at(1) - 1).alias("b"), (at(2, "string") == "F").alias("out"), (at(3) / 1000.0).alias("weight"), "at")
    edges = merge(rows).where("out").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    if coords_path is None:
        return Graph(vertices_of(spark, edges, header_count(spark, edges_path)), edges)
    v = spark.read.text(coords_path).where(F.startswith("value", F.lit("v "))).select(F.split("value", "[ \t]+").alias("f"))
    angle = lambda i: at(i) / 1e6 * math.pi / 180
    return Graph(v.select((at(1) - 1).alias("id"), angle(2).alias("lon"), angle(3).alias("lat")), edges)


def read_pairs(spark: SparkSession, path: str, directed: bool = True, keep_multiple: bool = False) -> Graph:
    """``from to`` lines of a generator; repeats are merged unless ``keep_multiple``."""
    rows = _fields(spark, path).select(F.get("f", F.lit(0)).cast("long").alias("src"), F.get("f", F.lit(1)).cast("long").alias("dst")).where("src <> dst")
    edges = rows if keep_multiple else rows.distinct()
    g = Graph(vertices_of(spark, edges, header_count(spark, path)), edges)
    return g if directed else g.as_undirected()


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """``key=value`` lines of a header as one row of longs."""
    kv = spark.read.text(path).select(F.split("value", "=").alias("f"))
    pick = lambda k: F.max(F.when(F.get("f", F.lit(0)) == k, F.get("f", F.lit(1)).cast("long"))).alias(k)
    return kv.agg(pick("vertices"), pick("alist_entries"), pick("alist_bytes"))


def page_checksum(spark: SparkSession, path: str, page: int = 4096) -> DataFrame:
    """``(pages, bits, zero_pages)`` of binary files: the OR over all bytes, and pages without a bit."""

    # an expression would copy the whole content, or count from its start, for every page
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, out = memoryview(content.as_buffer()), []
                for at in range(0, len(data), page):
                    p = data[at : at + page]
                    whole = len(p) // 8 * 8
                    out.append(int(np.bitwise_or.reduce(np.frombuffer(p[:whole], ">u8"), initial=0)) | int.from_bytes(p[whole:], "big"))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(out, np.uint64).view(np.int64))], names=["b"])

    bits = spark.read.format("binaryFile").load(path).select("content").mapInArrow(fold, "b long")
    return bits.agg(F.count("*").alias("pages"), F.bit_or("b").alias("bits"), F.count_if(F.col("b") == 0).alias("zero_pages"))
