"""Analytics over edges: PageRank, conductance, similarity, cores, independent sets, layout measures."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalar import PAGE
from skein.model import Graph, bits_per_edge
from skein.plans.fixpoint import Laid, parts, steady
from skein.plans.ranking import running_sum
from skein.plans.storage import drop, in_session, new_path, save, save_counting


def pagerank(g: Graph, iterations: int = 5, damping: float = 0.85) -> DataFrame:
    """``(id, rank)`` after so many rounds from 1/n; what vertices without out-edges hold is lost.

    Edges are laid out by source once, a hub's in pieces; ranks come out of
    their sum by id in the same layout, so a round shuffles partial sums only.
    """
    spark = g.vertices.sparkSession
    n = g.vertices.count()
    if not n:
        return g.vertices.select("id", F.lit(0.0).alias("rank"))
    k, side = parts(spark), steady(spark)
    deg = g.edges.groupBy("src").agg(F.count("*").alias("deg"))
    kept = save(g.edges.select("src", "dst").join(deg, "src"), "edges")
    vertices = save(g.vertices.select("id"), "ids")
    laid = Laid(in_session(side, kept), k)
    ids = in_session(side, vertices).repartition(k, "id").persist(StorageLevel.MEMORY_AND_DISK)
    ranks = ids.withColumn("rank", F.lit(1.0 / n))
    for _ in range(iterations):
        sums = laid.meet(ranks).groupBy("dst").agg(F.sum(F.col("rank") * damping / F.col("deg")).alias("s"))
        ranks = ids.join(sums, ids["id"] == sums["dst"], "left").select("id", ((1 - damping) / n + F.coalesce("s", F.lit(0.0))).alias("rank"))
    out = in_session(spark, save(ranks, "ranks"))
    laid.free()
    ids.unpersist()
    drop(kept, vertices)
    return out


def conductance(g: Graph, parts_: int = 50) -> DataFrame:
    """``(part, cross, din, dout, value)`` of every ``id % parts`` class, over the adjacency at both ends.

    ``din``: entries of the part's vertices, ``dout``: of all others, ``cross``:
    entries of the part whose other end lies outside.  0 where nothing crosses
    and a side is empty, infinite where a side is empty but something crosses.
    """
    adj = g.adjacency()
    p = adj.select((F.col("id") % parts_).alias("part"), (F.col("nbr") % parts_ != F.col("id") % parts_).cast("long").alias("x"))
    own = p.groupBy("part").agg(F.sum("x").alias("cross"), F.count("*").alias("din"))
    every = g.vertices.select((F.col("id") % parts_).alias("part")).distinct()
    # one row of the total
    total = own.agg(F.coalesce(F.sum("din"), F.lit(0)).alias("all"))
    rows = every.join(own, "part", "left").join(total, F.lit(True)).select("part", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("cross", "din")], "all").withColumn("dout", F.col("all") - F.col("din")).drop("all")
    least = F.least("din", "dout")
    value = F.when(least > 0, F.col("cross") / least).when(F.col("cross") > 0, F.lit(float("inf"))).otherwise(0.0)
    return rows.withColumn("value", value)


def similarity(g: Graph, pairs: DataFrame, steps: int = 3) -> DataFrame:
    """``(x, y, lrw, srw)`` for the pairs ``(x, y)``: local and superposed random walks of ``steps`` steps on the undirected graph.

    Walks from all asked vertices move together, one sparse distribution per
    start; each step is one join and one sum.
    """
    adj = g.adjacency().select("id", "nbr")
    deg = save(adj.groupBy("id").agg(F.count("*").alias("deg")), "deg")
    entries = deg.agg(F.coalesce(F.sum("deg"), F.lit(0))).first()[0]
    moves = save(adj.join(deg, "id"), "moves")
    starts = pairs.select(F.col("x").alias("s")).union(pairs.select("y")).distinct()
    now = starts.select("s", F.col("s").alias("id"), F.lit(1.0).alias("p"))
    seen = None
    for t in range(steps):
        now = save(now.join(moves, "id").groupBy("s", F.col("nbr").alias("id")).agg(F.sum(F.col("p") / F.col("deg")).alias("p")), "walk")
        one = now.withColumn("t", F.lit(t + 1))
        seen = one if seen is None else seen.unionByName(one)
    ds = lambda c: deg.select(F.col("id").alias(c), F.col("deg").alias(f"d{c}"))
    asked = pairs.select("x", "y").distinct().join(ds("x"), "x", "left").join(ds("y"), "y", "left")
    there = asked.join(seen.select(F.col("s").alias("x"), F.col("id").alias("y"), "t", F.col("p").alias("p")), ["x", "y"]).select("x", "y", "t", (F.col("dx") * F.col("p")).alias("v"))
    back = asked.join(seen.select(F.col("s").alias("y"), F.col("id").alias("x"), "t", F.col("p").alias("p")), ["x", "y"]).select("x", "y", "t", (F.col("dy") * F.col("p")).alias("v"))
    sums = there.unionByName(back).groupBy("x", "y").agg(F.sum(F.when(F.col("t") == steps, F.col("v"))).alias("l"), F.sum("v").alias("r"))
    return asked.select("x", "y").join(sums, ["x", "y"], "left").select("x", "y", *[(F.coalesce(c, F.lit(0.0)) / max(1, entries)).alias(n) for c, n in (("l", "lrw"), ("r", "srw"))])


def edge_similarity(g: Graph) -> DataFrame:
    """``(x, y, lrw, srw)`` of :func:`similarity` in three steps, for every edge ``(x, y)``.

    Walks are reversible, so both sides of a pair are alike, and of adjacent
    vertices they are sums over triangles and cycles of four: with degrees d, a
    step counts 1, two steps 1 / d(z) for every common neighbour z, three steps
    1 / (d(u) d(w)) for every walk x-u-w-y.  Where a walk goes back these are
    sums over one vertex's neighbours; the others close a cycle.  With vertices
    ranked by (degree, id), paths a-m-c whose end a is the highest meet at
    (a, c) and see every cycle once, by its highest vertex.  So only such paths
    are shuffled, not the walks from every vertex, and hubs make few of them.
    """
    pairs = save(g.pairs(), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    deg = save(both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("deg")), "deg")
    entries = deg.agg(F.coalesce(F.sum("deg"), F.lit(0))).first()[0]
    of = lambda c: deg.select(F.col("id").alias(c), F.col("deg").alias(f"d{c}"))
    known = save(pairs.join(of("a"), "a").join(of("b"), "b"), "known")
    inv = lambda c: 1 / F.col(c).cast("double")
    # hi is the higher end of a pair
    up = F.struct("da", "a") > F.struct("db", "b")
    pick = lambda x, y, c: F.when(up, F.col(x)).otherwise(F.col(y)).alias(c)
    ranked = save(known.select(pick("a", "b", "hi"), pick("b", "a", "lo"), pick("da", "db", "dhi"), pick("db", "da", "dlo")), "ranked")
    ends = ranked.select(F.col("lo").alias("m"), F.col("dlo").alias("dm"), F.col("hi").alias("a"), F.col("dhi").alias("da"))
    # c below m, or above it and below a
    down = ranked.select(F.col("hi").alias("m"), F.col("lo").alias("c"), F.col("dlo").alias("dc"))
    paths = ends.join(down.unionByName(ranked.select(F.col("lo").alias("m"), F.col("hi").alias("c"), F.col("dhi").alias("dc"))), "m")
    paths = paths.where(F.struct("dc", "c") < F.struct("da", "a")).select("a", "c", "m", "dm")
    marks = ranked.select(F.col("hi").alias("a"), F.col("lo").alias("c"), F.lit(None).cast("long").alias("m"), F.lit(None).cast("long").alias("dm"))
    w = Window.partitionBy("a", "c")
    met = paths.unionByName(marks).select("a", "c", "m", "dm", F.count("m").over(w).alias("n"), F.count("*").over(w).alias("rows"), F.sum(inv("dm")).over(w).alias("s"))
    met = met.where("m is not null and (n > 1 or rows > n)").withColumns({"rest": F.when(F.col("n") > 1, F.col("s") - inv("dm")).otherwise(0.0), "tri": F.col("rows") > F.col("n")})
    met = save(met.join(of("a"), "a").join(of("c"), "c").select("a", "c", "m", "rest", "tri", "dm", "da", "dc"), "met")

    def gives(x: str, y: str, two, three) -> DataFrame:
        return met.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), two.alias("two"), three.alias("three"))

    zero, tri = F.lit(0.0), lambda c: F.when(F.col("tri"), inv(c)).otherwise(0.0)
    # a triangle meets twice, with m and c exchanged: each time it gives to a-m, and half to m-c
    found = gives("a", "m", tri("dc"), F.col("rest") * inv("dc")).unionByName(gives("m", "c", tri("da") / 2, F.col("rest") * inv("da")))
    sums = save(found.groupBy("a", "b").agg(F.sum("two").alias("two"), F.sum("three").alias("three")), "sums")
    ends = known.select(F.col("a").alias("id"), F.col("db").alias("d")).unionByName(known.select(F.col("b").alias("id"), F.col("da").alias("d")))
    back = save(ends.groupBy("id").agg(F.sum(inv("d")).alias("s")), "back")
    by = lambda c: back.select(F.col("id").alias(c), F.col("s").alias(f"s{c}"))
    rows = known.join(by("a"), "a").join(by("b"), "b").join(sums, ["a", "b"], "left")
    # x-y-w-y and x-u-x-y, of which x-y-x-y is both
    three = F.col("sa") * inv("da") + F.col("sb") * inv("db") - inv("da") * inv("db") + F.coalesce("three", zero)
    scale = 2.0 / max(1, entries)
    out = save(rows.select("a", "b", (three * scale).alias("lrw"), ((1.0 + F.coalesce("two", zero) + three) * scale).alias("srw")), "similar")
    drop(pairs, deg, known, ranked, met, sums, back)
    return g.edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).distinct().withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")}).join(out, ["a", "b"]).select("x", "y", "lrw", "srw")


def core_numbers(g: Graph, max_rounds: int = 100_000) -> DataFrame:
    """``(id, core)``: the largest k with a subgraph of least degree k around the vertex.

    Starting from degrees, a vertex takes the H-index of its neighbours' values
    until nothing changes; after the first round only neighbours of changed
    vertices are looked at.  A round counts values per (vertex, value) before it
    ranks them, so a hub needs as many rows as it has distinct values.  Raises
    if ``max_rounds`` are not enough.
    """
    adj = save(g.adjacency().select("id", "nbr"), "adj")
    deg = adj.groupBy("id").agg(F.count("*").alias("core"))
    state = save(g.vertices.select("id").join(deg, "id", "left").select("id", F.coalesce("core", F.lit(0)).alias("core"), F.lit(True).alias("changed")), "core")
    near = adj
    for n in range(max_rounds):
        if n:  # entries of the vertices next to a change
            moved = state.where("changed").select(F.col("id").alias("nbr"))
            near = adj.join(adj.join(moved, "nbr").select("id").distinct(), "id", "left_semi")
        values = near.join(state.select(F.col("id").alias("nbr"), "core"), "nbr").groupBy("id", "core").agg(F.count("*").alias("n"))
        at_least = F.sum("n").over(Window.partitionBy("id").orderBy(F.col("core").desc()))
        h = values.select("id", F.least("core", at_least).alias("h")).groupBy("id").agg(F.max("h").alias("h"))
        new = F.least("core", F.coalesce("h", F.col("core")))
        nxt, changes = save_counting(state.join(h, "id", "left").select("id", new.alias("core"), (new < F.col("core")).alias("changed")), "core", F.col("changed"))
        drop(state)
        state = nxt
        if not changes:
            drop(adj)
            return state.select("id", "core")
    raise RuntimeError(f"core numbers still fell after {max_rounds} rounds")


def maximal_independent_set(g: Graph, max_rounds: int = 1_000_000) -> DataFrame:
    """``(id, in_mis)`` of the greedy set by ascending id.

    A vertex joins once all its smaller neighbours are out and leaves once one
    is in, so a round decides whole fronts; the number of rounds is the longest
    chain of decisions.  A round meets the open pairs with the last round's
    decisions only, drops what they settle, and appends new decisions to a
    folder; nothing is written twice.
    """
    spark = g.vertices.sparkSession
    folder = new_path(spark, "decided")
    lower = save(g.pairs().select(F.col("b").alias("id"), F.col("a").alias("low")), "lower")
    schema = "id long, in_mis boolean"

    def decide(rows: DataFrame, n: int) -> DataFrame:
        rows.select(F.col("id").cast("long").alias("id"), "in_mis").write.parquet(f"{folder}/round={n}")
        return spark.read.schema(schema).parquet(f"{folder}/round={n}")

    last = decide(g.vertices.select("id").join(lower, "id", "left_anti").select("id", F.lit(True).alias("in_mis")), 0)
    for n in range(1, max_rounds):
        seen = lower.join(last.select(F.col("id").alias("low"), "in_mis"), "low", "left")
        state = seen.groupBy("id").agg(F.coalesce(F.bool_or("in_mis"), F.lit(False)).alias("out"), F.count_if(F.col("in_mis").isNull()).alias("open"))
        # a pair whose smaller end is out is settled, and so are all pairs of a decided vertex
        marked = save(seen.select("id", "low", F.col("in_mis").isNull().alias("waits")).join(state, "id"), "marked")
        last = decide(marked.where("out or open = 0").select("id", (~F.col("out")).alias("in_mis")).distinct(), n)
        nxt, left = save_counting(marked.where("not out and open > 0 and waits").select("id", "low"), "lower", F.lit(True))
        drop(lower, marked)
        lower = nxt
        if not left:
            return spark.read.schema(schema).parquet(folder).select("id", "in_mis")
    raise RuntimeError("the set did not settle")


def csr_offsets(g: Graph) -> DataFrame:
    """``(id, degree, bit_offset)``: where each vertex's entries begin in the packed adjacency, by running sums over id ranges."""
    deg = g.degrees().select("id", "degree")
    n = g.vertices.count()
    bits = g.vertices.sparkSession.range(1).select(bits_per_edge(F.lit(n)).alias("b")).first()[0]
    sized = deg.withColumn("bits", F.col("degree") * bits)
    return running_sum(sized, [], ["id"], "bits", "bit_offset").select("id", "degree", "bit_offset")


def entropies(g: Graph) -> DataFrame:
    """One row: entropy of the entries' targets, and of their distances plus one bit for the sign."""
    adj = g.adjacency()
    total = adj.agg(F.count("*").alias("m"))

    def entropy(key) -> DataFrame:
        counts = adj.groupBy(key.alias("k")).agg(F.count("*").alias("n")).join(total, F.lit(True))
        p = F.col("n") / F.col("m")
        return counts.agg(F.coalesce(F.sum(p * F.log2(1 / p)), F.lit(0.0)).alias("e"))

    a, b = entropy(F.col("nbr")), entropy(F.abs(F.col("nbr") - F.col("id")))
    return a.select(F.col("e").alias("entropy_direct")).join(b.select((1 + F.col("e")).alias("entropy_delta")), F.lit(True))


def deltas(g: Graph) -> DataFrame:
    """One row: mean and deviation of the entries' distances in the vertex table (16 bytes each) and in the adjacency (bytes), and the shares that cross a page."""
    offset = save(csr_offsets(g).select("id", F.floor(F.col("bit_offset") / 8).alias("byte")), "offsets")
    adj = g.adjacency()
    both = adj.join(offset, "id").join(offset.select(F.col("id").alias("nbr"), F.col("byte").alias("other")), "nbr")
    v, e = (F.abs(F.col("id") - F.col("nbr")) * 16), F.abs(F.col("byte") - F.col("other"))
    share = lambda x: F.avg((x >= PAGE).cast("double"))
    return both.agg(
        F.avg(v).alias("delta_vertices_mean"), F.stddev_pop(v).alias("delta_vertices_sd"), F.avg(e).alias("delta_edges_mean"), F.stddev_pop(e).alias("delta_edges_sd"),
        share(v).alias("prob_vertex_page_crossing"), share(e).alias("prob_calist_page_crossing"),
    )


def static_measures(g: Graph) -> DataFrame:
    """``(metric, value)`` with three decimals."""
    row = entropies(g).join(deltas(g), F.lit(True))
    return row.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c.upper()) for c in row.columns]), F.array(*[F.round(c, 3) for c in row.columns]))).alias("metric", "value"))


def degree_distribution(g: Graph) -> DataFrame:
    return g.degrees().groupBy("degree").agg(F.count("*").alias("vertices"))
