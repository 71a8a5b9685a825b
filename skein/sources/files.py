"""Graph files: bit-packed adjacency of fixed width (CSR) or by deltas (CAL), with index, weights, coordinates and header."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.scalar import bit_length
from skein.model import Graph
from skein.plans.ranking import running_sum
from skein.plans.storage import drop, save
from skein.sources.text import read_info

#: Words of 64 bits in one block that a task packs and the writer appends.
BLOCK = 1 << 14


def id_bits(n: int) -> int:
    """Bits of an entry: the largest id's and the direction's."""
    return max(1, (n - 1).bit_length()) + 1


def _entries(g: Graph) -> DataFrame:
    """``(id, nbr, incoming, weight)``: the adjacency, with the least weight of the pair's edges."""
    adj = g.adjacency()
    if not g.weighted:
        return adj.withColumn("weight", F.lit(1.0))
    out = g.out()
    both = out.select(F.col("src").alias("id"), F.col("dst").alias("nbr"), "weight").unionByName(out.select(F.col("dst").alias("id"), F.col("src").alias("nbr"), "weight"))
    return adj.join(both.groupBy("id", "nbr").agg(F.min("weight").alias("weight")), ["id", "nbr"])


def placed_entries(g: Graph, form: str) -> tuple[DataFrame, DataFrame]:
    """(entries, vertices) of the packed form.

    Entries: ``(id, nbr, incoming, weight, rank, at, width, value, flag_at)``:
    each vertex's entries in file order and the bits that they take.  Vertices:
    ``(id, degree, offset, flags, bits)``, in bits from the file's start.  CAL
    lists stand in order of their deltas' bit lengths; a delta loses its top bit
    and starts with a one, a zero raises the length, and two flags for each
    entry (sign, direction) follow the list.
    """
    n = g.vertices.count()
    e = _entries(g)
    if form == "csr":
        width = id_bits(n)
        w = Window.partitionBy("id").orderBy("nbr")
        e = e.withColumns({"rank": F.row_number().over(w).cast("long") - 1, "width": F.lit(width).cast("long"), "value": F.col("nbr") * 2 + F.col("incoming").cast("long")})
        e = e.withColumns({"inside": F.col("rank") * width, "flags": F.lit(None).cast("long")})
        sizes = e.groupBy("id").agg(F.count("*").alias("degree"), F.sum("width").alias("bits"), F.sum("width").alias("list"))
    else:
        delta = F.abs(F.col("id") - F.col("nbr"))
        e = e.withColumn("width", bit_length(delta))
        w = Window.partitionBy("id").orderBy("width", "nbr")
        before = F.coalesce(F.sum("width").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        low = delta.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("width") - 1).cast("int")) - 1)
        e = e.withColumns({"rank": F.row_number().over(w).cast("long") - 1, "inside": before + F.col("width") - 1, "value": low * 2 + 1, "flags": (F.col("nbr") > F.col("id")).cast("long") + 2 * F.col("incoming").cast("long")})
        sizes = e.groupBy("id").agg(F.count("*").alias("degree"), (F.sum("width") + F.max("width") - 1).alias("list"))
        sizes = sizes.withColumn("bits", F.col("list") + 2 * F.col("degree"))
    v = g.vertices.select("id").join(sizes, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("degree", "bits", "list")])
    v = save(running_sum(v, [], ["id"], "bits", "offset"), "offsets")
    e = e.join(v.select("id", "offset", "list"), "id")
    e = e.withColumns({"at": F.col("offset") + F.col("inside"), "flag_at": F.col("offset") + F.col("list") + 2 * F.col("rank")})
    return e, v.select("id", "degree", "offset", (F.col("offset") + F.col("list")).alias("flags"), "bits")


def _words(pieces: DataFrame, total_bits: int) -> DataFrame:
    """``(word, value)`` for every 64-bit word, from pieces ``(at, width, value)`` that do not overlap."""
    shift, word = (F.col("at") % 64).cast("int"), F.floor(F.col("at") / 64).cast("long")
    low = F.call_function("shiftleft", F.col("value"), shift)
    high = F.when(shift + F.col("width") > 64, F.call_function("shiftrightunsigned", F.col("value"), 64 - shift))
    parts = pieces.select(F.explode(F.array(F.struct(word.alias("word"), low.alias("value")), F.struct((word + 1).alias("word"), high.alias("value")))).alias("p")).select("p.*")
    sums = parts.where("value is not null").groupBy("word").agg(F.bit_or("value").alias("value"))
    every = pieces.sparkSession.range((total_bits + 63) // 64).withColumnRenamed("id", "word")
    return every.join(sums, "word", "left").select("word", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def write_longs(rows: DataFrame, path: str, size: int | None = None) -> None:
    """``(word, value)`` with words from 0 up as one file of little-endian values, cut to ``size`` bytes.

    Tasks pack blocks of words; the format is a single file, so the driver
    appends the blocks in order, holding one at a time.
    """
    spark = rows.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch.column(1).flatten(), np.cumsum(pc.list_value_length(batch.column(1)).to_numpy())
            words, values = (flat.field(k).to_numpy().astype("<i8") for k in (0, 1))
            data = [values[a:b][np.argsort(words[a:b])].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["block", "data"])

    blocks = rows.groupBy(F.floor(F.col("word") / BLOCK).alias("block")).agg(F.collect_list(F.struct("word", "value")).alias("x")).mapInArrow(pack, "block long, data binary")
    blocks = save(blocks, "blocks")
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place, True)
    left = size
    for row in blocks.orderBy("block").toLocalIterator():
        data = bytes(row["data"]) if left is None else bytes(row["data"])[:left]
        out.write(data)
        left = None if left is None else left - len(data)
    out.close()
    drop(blocks)


def write_doubles(rows: DataFrame, path: str) -> None:
    """``(word, value)`` with double values, as :func:`write_longs`."""

    def bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"word": f["word"], "value": f["value"].to_numpy("<f8").view("<i8")})

    write_longs(rows.select("word", F.col("value").cast("double").alias("value")).mapInPandas(bits, "word long, value long"), path)


def write_graph(g: Graph, name: str, form: str = "csr") -> None:
    """The graph as ``name.vertices``, ``name.calist`` and ``name.info``; with weights also ``name.rew_index`` and ``name.rew``, with coordinates ``name.co``.

    ``.vertices`` holds a bit offset for each vertex (CSR) or two, of its list
    and its flags (CAL); ``.rew_index`` byte offsets into ``.rew``, the weights
    in the entries' order; ``.co`` longitude and latitude in radians.
    """
    spark = g.vertices.sparkSession
    entries, v = placed_entries(g, form)
    entries = save(entries, "entries")
    row = v.agg(F.count("*").alias("n"), F.coalesce(F.sum("degree"), F.lit(0)).alias("m"), F.coalesce(F.sum("bits"), F.lit(0)).alias("bits")).first()
    pieces = entries.select("at", "width", "value")
    if form == "cal":
        pieces = pieces.unionByName(entries.select(F.col("flag_at").alias("at"), F.lit(2).cast("long").alias("width"), F.col("flags").alias("value")))
    size = (row["bits"] + 7) // 8
    write_longs(_words(pieces, row["bits"]), f"{name}.calist", size)
    if form == "csr":
        write_longs(v.select(F.col("id").alias("word"), F.col("offset").alias("value")), f"{name}.vertices")
    else:
        two = F.explode(F.array(F.struct((F.col("id") * 2).alias("word"), F.col("offset").alias("value")), F.struct((F.col("id") * 2 + 1).alias("word"), F.col("flags").alias("value"))))
        write_longs(v.select(two.alias("p")).select("p.*"), f"{name}.vertices")
    if g.weighted:
        first = save(running_sum(v.select("id", "degree"), [], ["id"], "degree", "first"), "first")
        write_longs(first.select(F.col("id").alias("word"), (F.col("first") * 8).alias("value")), f"{name}.rew_index")
        write_doubles(entries.join(first.select("id", "first"), "id").select((F.col("first") + F.col("rank")).alias("word"), F.col("weight").alias("value")), f"{name}.rew")
    if "lon" in g.vertices.columns:
        two = F.explode(F.array(F.struct((F.col("id") * 2).alias("word"), F.col("lon").alias("value")), F.struct((F.col("id") * 2 + 1).alias("word"), F.col("lat").alias("value"))))
        write_doubles(g.vertices.select(two.alias("p")).select("p.*"), f"{name}.co")
    drop(entries)
    head = f"vertices={row['n']}\nalist_entries={row['m']}\nalist_bytes={size}\n"
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(f"{name}.info")
    out = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place, True)
    out.write(head.encode())
    out.close()


def read_longs(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """``(word, value)`` of a file of little-endian 64-bit values, in tasks by file range; a last part of fewer bytes is filled with zeros."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(place).getLen()
    form = "<f8" if kind == "double" else "<i8"
    value = lambda data: np.frombuffer(data.ljust(8, b"\0"), form)[0].item()
    if size % 8:  # fixed-length records need whole ones, so such a file (below 2 GB) is one row
        whole = spark.read.format("binaryFile").load(path).select("content")

        def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for content in f["content"]:
                    values = np.frombuffer(content + b"\0" * (-len(content) % 8), form)
                    yield pd.DataFrame({"word": np.arange(len(values)), "value": values})

        return whole.mapInPandas(cut, f"word long, value {kind}")
    rows = context.binaryRecords(path, 8).zipWithIndex().map(lambda x: (x[1], value(x[0])))
    return spark.createDataFrame(rows, f"word long, value {kind}")


def _bits_at(rows: DataFrame, words: DataFrame, at: str, width: int, out: str) -> DataFrame:
    """``rows`` with the ``width`` bits of the file at bit ``at``."""
    keyed = rows.withColumns({"_w": F.floor(F.col(at) / 64).cast("long"), "_s": (F.col(at) % 64).cast("int")})
    one = words.select(F.col("word").alias("_w"), F.col("value").alias("_a"))
    two = words.select((F.col("word") - 1).alias("_w"), F.col("value").alias("_b"))
    both = keyed.join(one, "_w").join(two, "_w", "left")
    low = F.call_function("shiftrightunsigned", F.col("_a"), F.col("_s"))
    high = F.when(F.col("_s") > 0, F.call_function("shiftleft", F.coalesce("_b", F.lit(0).cast("long")), 64 - F.col("_s"))).otherwise(0)
    return both.withColumn(out, low.bitwiseOR(high).bitwiseAND(F.lit((1 << width) - 1))).drop("_w", "_s", "_a", "_b")


def read_adjacency(spark: SparkSession, name: str, form: str = "csr") -> DataFrame:
    """``(id, pos, nbr, incoming)`` of a graph's files; ``pos`` is an entry's place in its vertex's list."""
    info = read_info(spark, f"{name}.info").first()
    n, m = info["vertices"], info["alist_entries"]
    index, words = read_longs(spark, f"{name}.vertices"), save(read_longs(spark, f"{name}.calist"), "words")
    if form == "csr":
        width = id_bits(n)
        last = spark.range(1).select(F.lit(n).cast("long").alias("word"), F.lit(m * width).cast("long").alias("value"))
        ends = index.unionByName(last).select((F.col("word") - 1).alias("word"), F.col("value").alias("end"))
        lists = index.join(ends, "word").where("end > value").withColumn("pos", F.explode(F.expr(f"sequence(0L, (end - value) div {width} - 1)")))
        got = _bits_at(lists.select(F.col("word").alias("id"), "pos", (F.col("value") + F.col("pos") * width).alias("at")), words, "at", width, "x")
        return got.select("id", "pos", F.shiftright("x", 1).alias("nbr"), (F.col("x") % 2 == 1).alias("incoming"))
    half = lambda k, c: index.where(F.col("word") % 2 == k).select(F.floor(F.col("word") / 2).alias("id"), F.col("value").alias(c))
    starts = half(0, "start")
    total = spark.range(1).select(F.lit(n).cast("long").alias("id"), F.lit(8 * info["alist_bytes"]).cast("long").alias("start"))
    ends = starts.unionByName(total).select((F.col("id") - 1).alias("id"), F.col("start").alias("end"))
    lists = starts.join(half(1, "flags"), "id").join(ends, "id").where("flags > start")
    need = lists.withColumn("word", F.explode(F.expr("sequence(start div 64, (end - 1) div 64)"))).join(words, "word")
    gathered = need.groupBy("id", "start", "flags").agg(F.sort_array(F.collect_list(F.struct("word", "value"))).alias("x"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for me, start, flags, x in zip(f["id"], f["start"], f["flags"], f["x"], strict=True):
                bits = np.unpackbits(np.array([w["value"] for w in x], "<i8").view(np.uint8), bitorder="little")[start % 64 :]
                yield pd.DataFrame(unpack_list(me, bits, flags - start), columns=["id", "pos", "nbr", "incoming"])

    return gathered.mapInPandas(run, "id long, pos long, nbr long, incoming boolean")


def unpack_list(me: int, bits: np.ndarray, flags: int) -> list[tuple[int, int, int, bool]]:
    """The entries of one delta list; ``flags``: bits of the list itself."""
    out, at, length = [], 0, 1
    while at < flags:
        if not bits[at]:
            at, length = at + 1, length + 1
            continue
        delta = 1 << (length - 1) | sum(int(b) << k for k, b in enumerate(bits[at + 1 : at + length]))
        up, incoming = bits[flags + 2 * len(out)], bits[flags + 2 * len(out) + 1]
        out.append((me, len(out), me + delta if up else me - delta, bool(incoming)))
        at += length
    return out


def read_weights(spark: SparkSession, name: str) -> DataFrame:
    """``(id, pos, weight)`` of ``name.rew_index`` and ``name.rew``."""
    index, values = read_longs(spark, f"{name}.rew_index"), read_longs(spark, f"{name}.rew", "double")
    starts = index.select(F.col("word").alias("id"), F.floor(F.col("value") / 8).alias("first"))
    m = spark.range(1).select(F.lit(starts.count()).cast("long").alias("id"), F.lit(values.count()).cast("long").alias("first"))
    ends = starts.unionByName(m).select((F.col("id") - 1).alias("id"), F.col("first").alias("end"))
    each = starts.join(ends, "id").where("end > first").withColumn("pos", F.explode(F.expr("sequence(0L, end - first - 1)")))
    return each.withColumn("word", F.col("first") + F.col("pos")).join(values, "word").select("id", "pos", F.col("value").alias("weight"))


def read_coordinates(spark: SparkSession, name: str) -> DataFrame:
    """``(id, lon, lat)`` of ``name.co``."""
    values = read_longs(spark, f"{name}.co", "double")
    pick = lambda k, c: values.where(F.col("word") % 2 == k).select(F.floor(F.col("word") / 2).alias("id"), F.col("value").alias(c))
    return pick(0, "lon").join(pick(1, "lat"), "id")


def read_graph(spark: SparkSession, name: str, form: str = "csr", weighted: bool = False) -> Graph:
    """The graph of its files; entries that are not incoming are edges."""
    adj = read_adjacency(spark, name, form)
    n = read_info(spark, f"{name}.info").first()["vertices"]
    out = adj.where("not incoming")
    if weighted:
        edges = out.join(read_weights(spark, name), ["id", "pos"]).select(F.col("id").alias("src"), F.col("nbr").alias("dst"), "weight")
    else:
        edges = out.select(F.col("id").alias("src"), F.col("nbr").alias("dst"))
    return Graph(spark.range(n), edges)
