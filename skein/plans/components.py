"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.storage import drop, save


def _to_roots(parent: DataFrame) -> DataFrame:
    """Pointers ``(id, to)`` with ``to <= id``, doubled until every one ends at a root."""
    while True:
        p, q = parent.alias("p"), parent.where("to <> id").alias("q")
        step = p.join(q, F.col("p.to") == F.col("q.id"), "left")
        nxt = save(step.select(F.col("p.id"), F.coalesce("q.to", "p.to").alias("to"), F.col("q.to").isNotNull().alias("moved")), "jump")
        drop(parent)
        out = nxt.select("id", "to")
        out._skein_path = nxt._skein_path
        if nxt.where("moved").isEmpty():
            return out
        parent = out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """``(id, component)`` for every vertex with an edge; ``component`` is the smallest id reachable.

    Each round points every vertex to the smaller of itself and its smallest
    neighbour, follows the pointers to their roots by doubling, and rewrites
    the edges between roots.  Vertices left with an edge at least halve, so the
    number of rounds is logarithmic and the tables shrink geometrically.  The minimum is
    pre-aggregated before its shuffle, and every join reads tables without a
    claimed partitioning, so adaptive execution may split a hub's rows.
    Self loops give a component of one vertex; nulls are ignored.
    """
    e = save(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct(),
        "edges",
    )
    steps: list[DataFrame] = []
    for _ in range(max_rounds):
        both = e.union(e.select("b", "a"))
        parent = save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to")), "parent")
        jumped = _to_roots(parent)
        steps.append(jumped)
        x, y = jumped.select(F.col("id").alias("a"), F.col("to").alias("x")), jumped.select(F.col("id").alias("b"), F.col("to").alias("y"))
        nxt = save(
            e.join(x, "a").join(y, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(),
            "edges",
        )
        drop(e)
        e = nxt
        if e.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    drop(e)
    label = steps[-1]
    for step in reversed(steps[:-1]):
        s, t = step.alias("s"), label.alias("t")
        # only images that were still alive in the next round have a further label
        merged = save(s.join(t, F.col("s.to") == F.col("t.id"), "left").select(F.col("s.id"), F.coalesce("t.to", "s.to").alias("to")), "label")
        drop(step, label)
        label = merged
    out = label.select("id", F.col("to").alias("component"))
    out._skein_path = label._skein_path
    return out
