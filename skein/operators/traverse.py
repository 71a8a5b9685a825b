"""Traversals: breadth-first and shortest-path forests, components, goal-directed search, spanning forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.scalar import haversine
from skein.model import Graph
from skein.operators import kernels
from skein.plans.components import connected_components
from skein.plans.fixpoint import propagate
from skein.plans.storage import drop, save


def _one(g: Graph) -> Graph:
    return Graph(g.vertices, g.edges.select("src", "dst", F.lit(1.0).alias("weight")))


def _forest(g: Graph, start: int, one_task: int) -> DataFrame:
    """``(id, root, cost)``: the least (rank of the root, cost) that reaches each vertex, roots ranked from ``start`` upwards, around.

    A vertex is a root if no lower-ranked vertex reaches it, so the sequential
    walk "start again at the next vertex not seen" gives the same forest.
    """
    if one_task and kernels.fits(g, one_task):
        return kernels.walk_forest(g, start)
    n = g.vertices.count()
    rank = F.pmod(F.col("id") - start, F.lit(n))
    init = g.vertices.select("id", F.struct(rank.alias("rank"), F.lit(0.0).alias("cost")).alias("state"))
    done = propagate(init, g.out(), lambda s, w: F.struct(s["rank"].alias("rank"), (s["cost"] + w).alias("cost")))
    return done.select("id", F.pmod(F.col("state.rank") + start, F.lit(n)).alias("root"), F.col("state.cost").alias("cost"))


def bfs_forest(g: Graph, start: int = 0, one_task: int = kernels.ONE_TASK) -> DataFrame:
    """``(id, root, level)`` of the breadth-first forest over out-edges."""
    return _forest(_one(g), start, one_task).select("id", "root", F.col("cost").cast("long").alias("level"))


def forest_count(forest: DataFrame) -> DataFrame:
    """One row: trees, the largest tree's root (smallest such) and its members."""
    sizes = forest.groupBy("root").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("components"), F.max_by("root", F.struct("n", -F.col("root"))).alias("giant_root"), F.max("n").alias("giant_size"))


def _from(g: Graph, source: int, edges: DataFrame) -> DataFrame:
    init = g.vertices.select("id", F.when(F.col("id") == source, 0.0).alias("state"))
    return propagate(init, edges, lambda s, w: s + w).where("state is not null")


def bfs_levels(g: Graph, source: int, undirected: bool = False) -> DataFrame:
    """``(id, level)`` of what ``source`` reaches; each round is one level."""
    g = _one(g.as_undirected() if undirected else g)
    return _from(g, source, g.out()).select("id", F.col("state").cast("long").alias("level"))


def bfs_rounds(g: Graph, source: int) -> DataFrame:
    """``(round, settled, seconds)`` of a walk by levels: what each round settles and how long it takes; the last settles nothing."""
    g, seen = _one(g), []
    init = g.vertices.select("id", F.when(F.col("id") == source, 0.0).alias("state"))
    drop(propagate(init, g.out(), lambda s, w: s + w, each=lambda *row: seen.append(row)))
    return g.vertices.sparkSession.createDataFrame(seen, "round long, settled long, seconds double")


def sssp(g: Graph, source: int) -> DataFrame:
    """``(id, cost)`` of what ``source`` reaches, for weights of at least 0."""
    return _from(g, source, g.out()).select("id", F.col("state").alias("cost"))


def sssp_forest(g: Graph, start: int = 0, limit: int | None = None, only_start: bool = False, one_task: int = kernels.ONE_TASK) -> DataFrame:
    """``(id, root, cost)`` of the shortest-path forest; ``limit``: only the first so many vertices in order of settling; ``only_start``: only the first tree."""
    out = _forest(g, start, one_task)
    if only_start:
        out = out.where(F.col("root") == start)
    if limit is not None:
        n = g.vertices.count()
        out = out.orderBy(F.pmod(F.col("root") - start, F.lit(n)), "cost", "id").limit(limit)
    return out


def _with_heuristic(g: Graph, target: int | tuple[float, float]) -> DataFrame:
    """Edges whose weight also holds the distance from their end to the target."""
    if isinstance(target, tuple):
        lon, lat = F.lit(target[0]), F.lit(target[1])
    else:
        t = g.vertices.where(F.col("id") == target).select("lon", "lat").first()
        lon, lat = F.lit(t[0]), F.lit(t[1])
    h = g.vertices.select(F.col("id").alias("dst"), haversine(F.col("lon"), F.col("lat"), lon, lat).alias("h"))
    return g.out().join(h, "dst").select("src", "dst", (F.col("weight") + F.col("h")).alias("weight"))


def astar(g: Graph, source: int, target: int | tuple[float, float], mode: str = "reference") -> DataFrame:
    """``(id, cost)`` of what ``source`` reaches.

    ``reference``: keys accumulate the heuristic of every vertex passed.
    ``shortest``: true path costs.
    """
    edges = _with_heuristic(g, target) if mode == "reference" else g.out()
    return _from(g, source, edges).select("id", F.col("state").alias("cost"))


def astar_found(g: Graph, source: int, target: int) -> DataFrame:
    return astar(g, source, target, "shortest").agg(F.coalesce(F.bool_or(F.col("id") == target), F.lit(False)).alias("found"))


def wcc(g: Graph) -> DataFrame:
    """``(id, component)``: the smallest id connected when directions are ignored."""
    comp = connected_components(g.edges, "src", "dst")
    return g.vertices.select("id").join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def scc(g: Graph, max_rounds: int = 10_000) -> DataFrame:
    """``(id, component)``: the smallest id that reaches the vertex and is reached by it.

    Vertices without a live in- or out-edge are components of their own and are
    trimmed, again and again.  Of the rest, each takes the smallest id that
    reaches it as a colour; those that reach their colour's vertex inside the
    colour form a component and leave.
    """
    done: DataFrame | None = None
    live = save(g.edges.select("src", "dst"), "live")
    ids = g.vertices.select("id")
    left = save(ids, "left")
    for _ in range(max_rounds):
        core = live.select(F.col("src").alias("id")).intersect(live.select(F.col("dst").alias("id")))
        inner = save(left.join(core, "id", "left_semi"), "inner")
        cut = left.join(inner, "id", "left_anti").select("id", F.col("id").alias("component"))
        cut = save(cut, "cut")
        done = cut if done is None else done.unionByName(cut)
        if cut.isEmpty() and not inner.isEmpty():
            one = live.select("src", "dst", F.lit(0.0).alias("weight"))
            color = propagate(inner.select("id", F.col("id").alias("state")), one, lambda s, w: s)
            c1, c2 = color.select(F.col("id").alias("src"), F.col("state").alias("cs")), color.select(F.col("id").alias("dst"), F.col("state").alias("cd"))
            same = live.join(c1, "src").join(c2, "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("weight"))
            back = propagate(color.select("id", F.when(F.col("state") == F.col("id"), F.col("id")).alias("state")), same, lambda s, w: s)
            found = save(back.where("state is not null").select("id", F.col("state").alias("component")), "found")
            done = done.unionByName(found)
            inner = save(inner.join(found, "id", "left_anti"), "inner")
            drop(color, back)
        left = inner
        a, b = left.select(F.col("id").alias("src")), left.select(F.col("id").alias("dst"))
        nxt = save(live.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst"), "live")
        drop(live)
        live = nxt
        if left.isEmpty():
            return save(done, "scc")
    raise RuntimeError("components did not settle")


def msf(g: Graph) -> DataFrame:
    """``(a, b, weight)``: a minimum spanning forest of the undirected graph, ties by (a, b).

    Each round every component takes its least outgoing edge, and components
    joined by those merge; their number at least halves.
    """
    w = F.col("weight") if g.weighted else F.lit(1.0)
    edges = g.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("weight")).groupBy("a", "b").agg(F.min("weight").alias("weight"))
    live = save(edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "weight", "a", "b"), "live")
    picked: DataFrame | None = None
    while not live.isEmpty():
        key = F.struct("weight", "a", "b", "u", "v")
        both = live.select(F.col("u").alias("c"), key.alias("k")).unionByName(live.select(F.col("v").alias("c"), key.alias("k")))
        best = save(both.groupBy("c").agg(F.min("k").alias("k")).select("k.*").distinct(), "picked")
        picked = best if picked is None else picked.unionByName(best)
        comp = connected_components(best, "u", "v")
        x, y = comp.select(F.col("id").alias("u"), F.col("component").alias("cu")), comp.select(F.col("id").alias("v"), F.col("component").alias("cv"))
        moved = live.join(x, "u", "left").join(y, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"), "weight", "a", "b").where("u <> v")
        nxt = save(moved, "live")
        drop(live, comp)
        live = nxt
    if picked is None:
        return edges.select("a", "b", "weight")
    return picked.select("a", "b", "weight").distinct()


def prim_costs(g: Graph, one_task: int = kernels.ONE_TASK) -> DataFrame:
    """One row ``(weight, trees)`` of a minimum spanning forest: by Prim's walk up to ``one_task`` vertices and edges, above by :func:`msf` and :func:`wcc`."""
    both = g.as_undirected()
    if kernels.fits(both, one_task):
        return kernels.prim_forest(both).agg(F.sum("cost").alias("weight"), F.countDistinct("root").alias("trees"))
    weight = msf(g).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))
    return weight.join(wcc(g).agg(F.countDistinct("component").alias("trees")), F.lit(True))



def frontiers(forest: DataFrame, level: str = "level", threshold: int = 1000) -> DataFrame:
    """``(level, vertices, above)``: the vertices that a walk settles in each round, and whether at least ``threshold`` of them wait together."""
    sizes = forest.groupBy(F.col(level).alias("level")).agg(F.count("*").alias("vertices"))
    return sizes.withColumn("above", F.col("vertices") >= threshold)


def threshold_share(forest: DataFrame, level: str = "level", threshold: int = 1000) -> DataFrame:
    """One row ``(f_threshold)``: the share of vertices settled in rounds of at least ``threshold``."""
    rounds = frontiers(forest, level, threshold)
    share = F.sum(F.when(F.col("above"), F.col("vertices")).otherwise(0)) / F.sum("vertices")
    return rounds.agg(F.coalesce(share, F.lit(0.0)).alias("f_threshold"))
