"""Sharding by histogram sort: splitters from exact byte counts below probes, then one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import table
from skein.plans.storage import drop, save

SHARDS = 16
#: Bits of a key digit (so 2**DIGIT probes for each open splitter and round), digits of the text's and of the row's part.
DIGIT, TEXT_DIGITS, ROW_DIGITS = 9, 4, 3
#: Bytes from the wanted boundary, as a share of a shard, at which a splitter is settled, and up to which it moves to the edge of a group of equal texts.
TOLERANCE, GROUP_SHIFT = 0.0005, 0.02
#: Bytes of one part of the final order.
PART_BYTES = 128 << 20
_KEY = "_skein_key"


def keyed(id_col: str, text_col: str) -> Column:
    """63 bits: a hash of the text, so that equal texts stand together, then one of the id, so that a large group of them can be cut."""
    take = lambda h, bits: F.shiftrightunsigned(h, 64 - bits)
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return F.shiftleft(take(text, DIGIT * TEXT_DIGITS), DIGIT * ROW_DIGITS).bitwiseOR(take(F.xxhash64(F.col(id_col)), DIGIT * ROW_DIGITS))


def splitters(rows: DataFrame, parts: int, size_col: str, tolerance: float = TOLERANCE, group_shift: float = GROUP_SHIFT, key_col: str = _KEY) -> list[int]:
    """``parts - 1`` keys; part j gets the keys from splitter j-1 up to, but without, splitter j.

    Round by round, the bytes below 2**DIGIT evenly spaced probes inside each
    open interval are counted exactly (one aggregate over the rows that lie in
    such an interval).  The probe nearest to the wanted number of bytes is
    taken if it is within the tolerance, else the interval around the wanted
    boundary is probed in turn.  Where the probes come down to single texts, an
    edge of the group of equal texts is taken if it is within ``group_shift``
    of a part; a larger group is cut between its rows.  At most ``parts *
    2**DIGIT`` sums reach the driver in a round.
    """
    spark, digits = rows.sparkSession, TEXT_DIGITS + ROW_DIGITS
    first = rows.agg(F.sum(size_col)).first()[0] or 0
    wanted = [first * j / parts for j in range(1, parts)]
    found: dict[int, int] = {}
    open_ = {0: (0, list(range(len(wanted))))}  # prefix: bytes below it, splitters inside it
    for d in range(digits):
        shift = DIGIT * (digits - d - 1)
        near = first / parts * (max(tolerance, group_shift) if d == TEXT_DIGITS - 1 else tolerance)
        prefix = F.shiftrightunsigned(key_col, shift + DIGIT).alias("prefix")
        inside = rows.select(prefix, F.shiftrightunsigned(key_col, shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int").alias("digit"), F.col(size_col).alias("size"))
        if d:
            these = spark.createDataFrame([(p,) for p in open_], "prefix long")
            inside = inside.join(F.broadcast(these), "prefix")  # one row for each open splitter at most
        sums: dict[int, list[tuple[int, int]]] = {}
        for r in inside.groupBy("prefix", "digit").agg(F.sum("size").alias("n")).collect():
            sums.setdefault(r["prefix"], []).append((r["digit"], r["n"]))
        nxt: dict[int, tuple[int, list[int]]] = {}
        for p, (below, mine) in open_.items():
            cells, k = sorted(sums.get(p, [])), 0
            for j in mine:
                while k < len(cells) - 1 and below + cells[k][1] < wanted[j]:
                    below, k = below + cells[k][1], k + 1
                if not cells:
                    found[j] = p << (shift + DIGIT)
                    continue
                digit, n = cells[k]
                low = (p << DIGIT | digit) << shift
                if min(wanted[j] - below, below + n - wanted[j]) <= near or d == digits - 1:
                    found[j] = low if wanted[j] - below <= below + n - wanted[j] else low + (1 << shift)
                else:
                    nxt.setdefault(p << DIGIT | digit, (below, []))[1].append(j)
        open_ = nxt
        if not open_:
            break
    return [found[j] for j in range(len(wanted))]


def sharded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, shards: int = SHARDS, tolerance: float = TOLERANCE, group_shift: float = GROUP_SHIFT, part_bytes: int = PART_BYTES) -> DataFrame:
    """``df`` with ``shard`` (0 to shards-1, near equal bytes) and ``slot`` (gapless from 0 in each shard); columns of these names are replaced.

    Rows are in order of a hash of their text, then of their id, so equal texts
    stand together.  A boundary between shards that falls into a group of equal
    texts moves to the group's nearer edge if that is at most ``group_shift`` of
    a shard away, so shards are equal to twice that share and groups of up to
    that size are never cut; a larger group is cut between ids.  Rows equal in
    id and text stay together and may swap slots.  A null text is empty, null
    ids are equal.  Bytes are ``size_col`` or the text's UTF-8 bytes plus one.
    An empty table gives an empty one.

    The splitters are found on narrow rows of key and size.  Then one exchange
    deals the rows to ranges of keys, where they are sorted; rows are numbered
    inside each range, and the ranges' counts per shard make the slots.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    spark = df.sparkSession
    size = F.col(size_col) if size_col else (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long")
    narrow = save(df.select(keyed(id_col, text_col).alias(_KEY), size.alias("_skein_size")), "keys")
    cuts = splitters(narrow, shards, "_skein_size", tolerance, group_shift)
    total = narrow.agg(F.sum("_skein_size")).first()[0] or 0
    drop(narrow)
    rows = df.select(*[F.col(f"`{c}`") for c in names], keyed(id_col, text_col).alias(_KEY))
    shard = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(_KEY)))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    ranged = rows.repartitionByRange(n, _KEY, id_col).sortWithinPartitions(_KEY, id_col)
    # the number's lower 33 bits count the rows of a task in their sorted order
    numbered = ranged.withColumns({"_skein_shard": shard, "_skein_part": F.spark_partition_id(), "_skein_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    numbered = save(numbered.drop(_KEY), "ranged")
    counts = numbered.groupBy("_skein_part", "_skein_shard").agg(F.count("*").alias("n"), F.min("_skein_at").alias("_skein_low"))
    w = Window.partitionBy("_skein_shard").orderBy("_skein_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = save(counts.withColumn("_skein_start", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n"), "starts")  # one row for each part, and one more for each shard
    out = numbered.join(F.broadcast(starts), ["_skein_part", "_skein_shard"])
    slot = (F.col("_skein_start") + F.col("_skein_at") - F.col("_skein_low")).cast("long")
    return out.select(*[F.col(f"`{c}`") for c in names], F.col("_skein_shard").alias("shard"), slot.alias("slot"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by bytes."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).cast("string").alias("digest"))
    out = sharded(narrow, "doc_id", "digest", "size")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

