"""Label-correcting fixpoints: states that only ever fall, pushed along edges by the vertices that changed."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.storage import drop, in_session, save, save_counting

#: Out-edges of one source that a task takes; a source with more is dealt to several.
HUB = 100_000


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def steady(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` without adaptive execution, for loops of small, alike rounds: partitionings are kept, and the caller's settings stay as they are."""
    side = spark.newSession()
    side.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    side.conf.set("spark.sql.adaptive.enabled", "false")
    return side


class Laid:
    """Edges ``(src, dst, ...)`` laid out by source once; the edges of a source with more than ``hub`` are dealt by target as well."""

    def __init__(self, edges: DataFrame, k: int, hub: int = HUB):
        level = StorageLevel.MEMORY_AND_DISK
        counts = edges.groupBy(F.col("src").alias("hub")).agg(F.count("*").alias("n")).where(F.col("n") > hub)
        self.hubs = counts.select("hub", F.ceil(F.col("n") / hub).cast("int").alias("pieces")).persist(level)
        self.any = not self.hubs.isEmpty()
        plain = edges.join(self.hubs, edges["src"] == self.hubs["hub"], "left_anti") if self.any else edges
        self.plain = plain.repartition(k, "src").persist(level)
        if self.any:
            cut = edges.join(self.hubs, edges["src"] == self.hubs["hub"]).withColumn("piece", F.pmod(F.xxhash64("dst"), F.col("pieces")).cast("int"))
            self.cut = cut.drop("hub", "pieces").repartition(k, "src", "piece").persist(level)

    def meet(self, front: DataFrame) -> DataFrame:
        """Every edge with its source's row of ``front(id, ...)``; a hub's row goes to all its pieces."""
        out = front.join(self.plain, front["id"] == self.plain["src"])
        if not self.any:
            return out
        rows = front.join(self.hubs, front["id"] == self.hubs["hub"]).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        more = rows.join(self.cut, (rows["id"] == self.cut["src"]) & (rows["at"] == self.cut["piece"]))
        return out.unionByName(more.select(*out.columns))

    def free(self) -> None:
        for table in (self.plain, self.hubs, *([self.cut] if self.any else [])):
            table.unpersist()


def propagate(start: DataFrame, edges: DataFrame, message: Callable[[Column, Column], Column], max_rounds: int = 1_000_000, hub: int = HUB, each: Callable[[int, int, float], None] | None = None) -> DataFrame:
    """``(id, state)`` where no edge lowers a state any more.

    ``start(id, state)``: one row per vertex, null for a vertex not reached
    yet.  A changed vertex sends ``message(state, weight)`` along its out-edges
    ``(src, dst, weight)``; a vertex takes the least of its own state and what
    it gets.  Edges are laid out by source once and stay so; each round
    shuffles only messages, already reduced to one per target and task.  Raises
    if ``max_rounds`` are not enough.  ``each`` is told every round's number (from
    1), the states that it changed, and its seconds.
    """
    spark = start.sparkSession
    side = steady(spark)
    kept = save(edges.select("src", "dst", "weight"), "edges")
    laid = Laid(in_session(side, kept), parts(spark), hub)
    state = in_session(side, save(start.select("id", "state", F.col("state").isNotNull().alias("changed")), "state"))
    for n in range(1, max_rounds + 1):
        began = time.perf_counter()
        sent = laid.meet(state.where("changed").select("id", "state")).select("dst", message(F.col("state"), F.col("weight")).alias("m"))
        best = sent.groupBy("dst").agg(F.min("m").alias("m"))
        joined = state.join(best, state["id"] == best["dst"], "left")
        better = F.col("m").isNotNull() & (F.col("state").isNull() | (F.col("m") < F.col("state")))
        nxt, changes = save_counting(joined.select("id", F.when(better, F.col("m")).otherwise(F.col("state")).alias("state"), better.alias("changed")), "state", F.col("changed"))
        drop(state)
        state = nxt
        if each:
            each(n, changes, time.perf_counter() - began)
        if not changes:
            break
    else:
        raise RuntimeError(f"states still fell after {max_rounds} rounds")
    laid.free()
    drop(kept)
    found = in_session(spark, state)
    out = found.select("id", "state")
    out._skein_path = found._skein_path
    return out
