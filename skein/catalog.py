"""Queries over the graphs derived from the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.scalar import haversine
from skein.model import Graph
from skein.operators import analytics, kernels, layout, traverse
from skein.plans.storage import new_path, save
from skein.sources import codec, files, generate, text
from skein.sources.tables import part_chain, with_coordinates

Query = Callable[[SparkSession, str], DataFrame]
#: A* aims at this vertex.
TARGET = 979


def graph(spark: SparkSession, sf_dir: str, by: str = "order") -> Graph:
    g = part_chain(spark, sf_dir, by)
    return Graph(g.vertices, save(g.edges, "graph"))


def located(g: Graph) -> Graph:
    return Graph(with_coordinates(g.vertices), g.edges)


def _of(make: Callable[[Graph], DataFrame], by: str = "order") -> Query:
    return lambda spark, sf_dir: make(graph(spark, sf_dir, by))


def _scaled_ranks(g: Graph) -> DataFrame:
    n = g.vertices.count()
    return analytics.pagerank(g, 5).select("id", F.round(F.col("rank") * n, 6).alias("scaled_rank"))


def _similar(g: Graph) -> DataFrame:
    out = analytics.edge_similarity(g)
    return out.select("x", "y", F.round("lrw", 12).alias("lrw"), F.round("srw", 12).alias("srw"))


def _conductance(g: Graph) -> DataFrame:
    return analytics.conductance(g, 50).withColumn("value", F.round("value", 9))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) for c in df.columns])


def _to_target(g: Graph) -> DataFrame:
    v = with_coordinates(g.vertices)
    t = v.where(F.col("id") == 0).select(F.col("lon").alias("tlon"), F.col("lat").alias("tlat"))  # one row
    return v.join(t, F.lit(True)).select("id", F.round(haversine(F.col("lon"), F.col("lat"), F.col("tlon"), F.col("tlat")), 4).alias("km"))


def _offsets(g: Graph) -> DataFrame:
    return analytics.csr_offsets(g)


def _hash_order(g: Graph) -> DataFrame:
    return layout.order_of(g, "hash")


def _mapped(g: Graph) -> DataFrame:
    return layout.apply_mapping(g, layout.order_of(g, "hash")).edges


def _raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_returnflag") == "R").alias("out"))


def _ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.sources.text import merge

    return merge(_raw_rows(spark, sf_dir)).select("a", "b", "out")


def _astar(g: Graph) -> DataFrame:
    t = TARGET if g.vertices.count() > TARGET else 1
    return traverse.astar(located(g), 0, t).select("id", F.round("cost", 3).alias("cost"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.streaming.ingest import degree_counts

    return degree_counts(spark, sf_dir)


def _from_files(form: str) -> Callable[[Graph], DataFrame]:
    """The graph written to files and read again, with weights."""

    def run(g: Graph) -> DataFrame:
        spark, name = g.vertices.sparkSession, new_path(g.vertices.sparkSession, f"graph-{form}")
        files.write_graph(g, name, form)
        adj = files.read_adjacency(spark, name, form).join(files.read_weights(spark, name), ["id", "pos"])
        return adj.select("id", "nbr", "incoming", "weight")

    return run


def _coordinates(g: Graph) -> DataFrame:
    name = new_path(g.vertices.sparkSession, "graph-co")
    files.write_graph(located(g), name)
    return files.read_coordinates(g.vertices.sparkSession, name).select("id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


def _header(form: str) -> Callable[[Graph], DataFrame]:
    def run(g: Graph) -> DataFrame:
        name = new_path(g.vertices.sparkSession, "graph-info")
        files.write_graph(Graph(g.vertices, g.edges.select("src", "dst")), name, form)
        return text.read_info(g.vertices.sparkSession, f"{name}.info")

    return run


def _ir_text(g: Graph) -> DataFrame:
    """Forward and reverse edge lists in text, read as one graph."""
    spark, name = g.vertices.sparkSession, new_path(g.vertices.sparkSession, "ir")
    g.edges.select(F.format_string("%d %d F", "src", "dst")).write.text(f"{name}-f")
    g.edges.select(F.format_string("%d\t%d R", "dst", "src")).write.text(f"{name}-r")
    return text.read_edge_text(spark, f"{name}-f", f"{name}-r").edges


def _road_text(g: Graph) -> DataFrame:
    """Forward and reverse road files with weights in metres, 1-based."""
    spark, name = g.vertices.sparkSession, new_path(g.vertices.sparkSession, "roads")
    metres = (F.col("weight") * 1000).cast("long")
    g.edges.select(F.format_string("%d %d F %d", F.col("src") + 1, F.col("dst") + 1, metres)).write.text(f"{name}-f")
    g.edges.select(F.format_string("%d %d R %d", F.col("dst") + 1, F.col("src") + 1, metres)).write.text(f"{name}-r")
    return text.read_dimacs(spark, f"{name}-f", reverse_path=f"{name}-r").edges


def _road_places(g: Graph) -> DataFrame:
    spark, name = g.vertices.sparkSession, new_path(g.vertices.sparkSession, "places")
    micro = lambda k, m: (F.col("id") * k % m - m // 2) * 1000
    g.vertices.select(F.format_string("v %d %d %d", F.col("id") + 1, micro(7919, 360000), micro(104729, 180000))).write.text(f"{name}-co")
    g.edges.select(F.format_string("%d %d F 1", F.col("src") + 1, F.col("dst") + 1)).write.text(f"{name}-e")
    v = text.read_dimacs(spark, f"{name}-e", f"{name}-co").vertices
    return v.select("id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


def _tsv_text(g: Graph) -> DataFrame:
    """The generator's text with its header, written and read; the header's count makes the vertices."""
    name = new_path(g.vertices.sparkSession, "tsv")
    layout.write_tsv(g, name)
    back = text.read_pairs(g.vertices.sparkSession, name)
    return back.edges.join(back.vertices.agg(F.count("*").alias("vertices")), F.lit(True))


def _scan(g: Graph) -> DataFrame:
    """Checksum of the packed adjacency's pages."""
    name = new_path(g.vertices.sparkSession, "scan")
    files.write_graph(Graph(g.vertices, g.edges.select("src", "dst")), name)
    return text.page_checksum(g.vertices.sparkSession, f"{name}.calist").select("pages", "zero_pages")


def _scalars(g: Graph) -> DataFrame:
    from skein.functions import scalar as fn

    e, a, b = g.edges, F.col("src"), F.col("dst")
    return e.select("src", "dst", fn.abs_diff(a, b).alias("apart"), fn.sign_diff(a, b).alias("falls"), fn.saturating_subtract(a, b).alias("over"), fn.bytes_of_bits(a).alias("n_bytes"), fn.bit_length(a + 1).alias("n_bits"), fn.page_of_bit(a * 4096).alias("page"), fn.lcg_next(a, 0xFFFF).alias("lcg"))


def _scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in the order of a scan that jumps about."""
    from skein.functions import scalar as fn

    return spark.range(4096).select(F.col("id").alias("k"), fn.lcg_at(F.col("id"), 0xFFF).alias("block"))


QUERIES: dict[str, Query] = {
    "edges_ingest": _of(lambda g: g.edges),
    "edges_ingest_supplier": _of(lambda g: g.edges, "supplier"),
    "pairs_merge": _of(lambda g: g.pairs()),
    "adjacency": _of(lambda g: g.adjacency()),
    "flags_merge": _ingest,
    "self_loop_filter": lambda s, d: _raw_rows(s, d).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")),
    "undirected": _of(lambda g: g.as_undirected().edges),
    "graph_summary": _of(lambda g: g.summary()),
    "degree_out": _of(lambda g: g.degrees().select("id", "out_degree")),
    "degree_total": _of(lambda g: g.degrees().select("id", "degree")),
    "degree_distribution": _of(analytics.degree_distribution),
    "max_degree": _of(lambda g: g.degrees().agg(F.max("degree").alias("max_degree"))),
    "csr_offsets": _of(_offsets),
    "csr_size": _of(lambda g: g.summary().select("bits_per_edge", "alist_bytes")),
    "cal_size": _of(layout.cal_size),
    "edge_ordinal": _of(layout.edge_ordinal),
    "neighbor_higher": _of(lambda g: g.adjacency().where("nbr > id").select("id", "nbr")),
    "static_entropy": _of(lambda g: _rounded(analytics.entropies(g))),
    "static_deltas": _of(lambda g: _rounded(analytics.deltas(g).select("delta_vertices_mean", "delta_vertices_sd", "delta_edges_mean", "delta_edges_sd"), 3)),
    "page_crossing": _of(lambda g: _rounded(analytics.deltas(g).select("prob_vertex_page_crossing", "prob_calist_page_crossing"))),
    "conductance_p0": _of(lambda g: _conductance(g).where("part = 0")),
    "conductance_all": _of(_conductance),
    "haversine_to_target": _of(_to_target),
    "pagerank_5": _of(_scaled_ranks),
    "pagerank_5_supplier": _of(_scaled_ranks, "supplier"),
    "lrw_srw_3": _of(_similar),
    "bfs_levels_0": _of(lambda g: traverse.bfs_levels(g, 0)),
    "bfs_undirected_0": _of(lambda g: traverse.bfs_levels(g, 0, undirected=True)),
    "bfs_forest": _of(traverse.bfs_forest),
    "bfs_forest_fixpoint": _of(lambda g: traverse.bfs_forest(g, one_task=0)),
    "bfs_forest_supplier": _of(traverse.bfs_forest, "supplier"),
    "bfs_forest_count": _of(lambda g: traverse.forest_count(traverse.bfs_forest(g)).select("components", "giant_size")),
    "wcc_labels": _of(traverse.wcc),
    "wcc_labels_supplier": _of(traverse.wcc, "supplier"),
    "wcc_count": _of(lambda g: traverse.wcc(g).agg(F.countDistinct("component").alias("components"))),
    "scc_labels": _of(traverse.scc),
    "scc_count": _of(lambda g: traverse.scc(g).agg(F.countDistinct("component").alias("components")), "supplier"),
    "sssp_0": _of(lambda g: traverse.sssp(g, 0)),
    "sssp_forest": _of(traverse.sssp_forest),
    "sssp_forest_fixpoint": _of(lambda g: traverse.sssp_forest(g, one_task=0)),
    "sssp_limit_k": _of(lambda g: traverse.sssp_forest(g, limit=500)),
    "sssp_first_tree": _of(lambda g: traverse.sssp_forest(g, only_start=True).select("id", "cost")),
    "astar_0": _of(_astar),
    "astar_found": _of(lambda g: traverse.astar_found(located(g), 0, 1)),
    "kcore_numbers": _of(analytics.core_numbers),
    "mis_members": _of(lambda g: analytics.maximal_independent_set(g).where("in_mis").select("id")),
    "msf_edges": _of(traverse.msf),
    "msf_weight": _of(lambda g: traverse.msf(g).agg(F.sum("weight").alias("weight"), F.count("*").alias("edges"))),
    "prim_costs": _of(traverse.prim_costs),
    "relabel_identity": _of(lambda g: layout.order_of(g, "identity")),
    "relabel_hash": _of(_hash_order),
    "relabel_bfs": _of(lambda g: layout.order_of(g, "bfs")),
    "relabel_half": _of(lambda g: layout.order_of(g, "half")),
    "apply_mapping": _of(_mapped),
    "dot_lines": _of(layout.dot_lines),
    "dfs_preorder": _of(kernels.dfs_forest),
    "dfs_weight_remap": _of(kernels.subtree_order),
    "kronecker_edges": lambda s, d: generate.kronecker_edges(s),
    "random_weights": _of(lambda g: generate.with_random_weights(g).edges),
    "codec_roundtrip_csr": _of(lambda g: codec.round_trip(g, "csr")),
    "codec_roundtrip_cal": _of(lambda g: codec.round_trip(g, "cal")),
    "stream_degrees": _daily,
    "files_csr": _of(_from_files("csr")),
    "files_cal": _of(_from_files("cal")),
    "files_coordinates": _of(_coordinates),
    "files_header_csr": _of(_header("csr")),
    "files_header_cal": _of(_header("cal")),
    "files_checksum": _of(_scan),
    "text_edges": _of(_ir_text),
    "text_roads": _of(_road_text),
    "text_places": _of(_road_places),
    "text_pairs": _of(_tsv_text),
    "scalar_functions": _of(_scalars),
    "frontier_sizes": _of(lambda g: traverse.frontiers(traverse.bfs_levels(g, 0), threshold=200)),
    "frontier_share": _of(lambda g: _rounded(traverse.threshold_share(traverse.bfs_levels(g, 0), threshold=200))),
    "giant_tree": _of(lambda g: traverse.forest_count(traverse.bfs_forest(g))),
    "prim_first_tree": _of(lambda g: kernels.prim_forest(g.as_undirected(), only_start=True).agg(F.sum("cost").alias("weight"), F.count("*").alias("members"))),
    "static_measures": _of(lambda g: analytics.static_measures(g)),
    "bfs_rounds": _of(lambda g: traverse.bfs_rounds(g, 0).select("round", "settled")),
    "sorted_entries": _of(layout.sorted_entries),
    "relabel_random": _of(lambda g: layout.order_of(g, "random")),
    "dfs_tree": _of(lambda g: kernels.subtree_order(g).select("id", "parent", "weight")),
    "scan_order": _scan_order,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def _graph_sql(key: str = "l_orderkey", keep: str = "l_returnflag = 'R'") -> str:
    return f"""with recursive e as (select distinct src, dst, (1 + (least(src, dst) * 31 + greatest(src, dst) * 17) % 97)::double w from
  (select l_partkey src, lead(l_partkey) over (partition by {key} order by l_orderkey, l_linenumber, l_partkey) dst from lineitem where {keep}) where dst is not null and src <> dst),
v as (select p_partkey id from part), n as (select count(*) n from v),
s as (select src a, dst b from e union select dst, src from e),
p as (select distinct least(src, dst) a, greatest(src, dst) b, w from e),
deg as (select id, (select count(*) from s where a = id) degree, (select count(*) from e where src = id) out_degree from v),
bits as (select length(bin(greatest(n - 1, 1))) + 1 b from n)"""


_R, _Q = _graph_sql(), _graph_sql("l_suppkey", "l_quantity >= 48")
_FLAGS = "f as (select l_partkey a, l_suppkey b, l_returnflag = 'R' o from lineitem where l_partkey <> l_suppkey)"
_OFFSETS = "off as (select id, degree, coalesce(sum(degree * b) over (order by id rows between unbounded preceding and 1 preceding), 0)::bigint bit_offset from deg, bits)"
_DELTAS = _OFFSETS + """, d as (select abs(s.a - s.b) * 16 dv, abs(x.bit_offset // 8 - y.bit_offset // 8) de from s join off x on x.id = s.a join off y on y.id = s.b)"""
_COND = """c as (select a % 50 part, sum((a % 50 <> b % 50)::int) x, count(*) din from s group by 1),
k as (select q.part, coalesce(x, 0)::bigint cross_, coalesce(din, 0)::bigint din, ((select count(*) from s) - coalesce(din, 0))::bigint dout from (select distinct id % 50 part from v) q left join c using (part))"""
_COND_SELECT = "select part, cross_ as \"cross\", din, dout, round(case when least(din, dout) > 0 then cross_ / least(din, dout) when cross_ > 0 then 'inf'::double else 0 end, 9) as \"value\" from k"
_RANKS = ", ".join(
    f"r{k} as (select v.id, 0.15 / n + coalesce(s, 0) r from v cross join n left join (select dst, sum(0.85 * r / out_degree) s from e join r{k - 1} on r{k - 1}.id = src join deg on deg.id = src group by dst) t on t.dst = v.id)" for k in range(1, 6)
)
_PAGERANK = f", r0 as (select id, 1.0::double / n r from v, n), {_RANKS} select id, round(r * n, 6) scaled_rank from r5, n"
_FOREST = """f(id, k) using key (id) as (select id, id * 1048576 from v union
  select e.dst, min(f.k + 1) from f join e on f.id = e.src join recurring.f q on q.id = e.dst where f.k + 1 < q.k group by e.dst)"""
_PATHS = """f(id, r, c) using key (id) as (select id, id, 0.0::double from v union
  select dst, min(k).r, min(k).c from (select e.dst, {'r': f.r, 'c': f.c + e.w} k, q.r qr, q.c qc from f join e on f.id = e.src join recurring.f q on q.id = e.dst) where (k.r, k.c) < (qr, qc) group by dst)"""
_SSSP = """d(id, cost) using key (id) as (select 0::bigint, 0.0::double union
  select x.dst, min(d.cost + x.w) from d join {edges} x on d.id = x.src left join recurring.d r on r.id = x.dst where r.cost is null or d.cost + x.w < r.cost group by x.dst)"""
_WCC = "c(id, component) using key (id) as (select id, id from v union select s.b, min(c.component) from c join s on c.id = s.a join recurring.c q on q.id = s.b where c.component < q.component group by s.b)"
_SCC = "t(a, b) as (select id, id from v union select t.a, e.dst from t join e on t.b = e.src), scc as (select x.a id, min(x.b) component from t x join t y on x.a = y.b and x.b = y.a group by x.a)"
_CORE = """k(it, id, c) as (select 0, id, degree from deg union all select it + 1, id, least(any_value(c), coalesce(max(least(rn, nc)), 0)) from (
  select k.it, k.id, k.c, m.c nc, row_number() over (partition by k.id order by m.c desc) rn from k left join s on s.a = k.id left join k m on m.id = s.b) where it < 40 group by it, id)"""
_MIS = """m(i, sel) as (select -1::bigint, []::bigint[] union all select i + 1, case when exists (select 1 from s where a = i + 1 and list_contains(m.sel, b)) then sel else list_append(sel, i + 1) end
  from m where i + 1 < (select n from n))"""
_CO = "co as (select id, radians(((id * 7919) % 360000) / 1000.0 - 180) lon, radians(((id * 104729) % 180000) / 1000.0 - 90) lat from v)"
_HAV = "2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h))"


def _hav(a: str, b: str) -> str:
    return f"pow(sin(({b}.lat - {a}.lat) / 2), 2) + cos({a}.lat) * cos({b}.lat) * pow(sin(({b}.lon - {a}.lon) / 2), 2)"


_ASTAR = f"""{_CO}, tg as (select co.* from co, n where id = case when n > {TARGET} then {TARGET} else 1 end),
ah as (select co.id, {_hav('co', 'tg')} h from co, tg), ae as (select src, dst, w + {_HAV} w from e join ah on ah.id = dst)"""
_WALK = ", ".join(
    [f"sd as (select distinct x s from ask union select distinct y from ask), u0 as (select s, s id, 1.0::double p from sd)"]
    + [f"u{k} as (select u.s, s.b id, sum(p / degree) p from u{k - 1} u join s on s.a = u.id join deg on deg.id = u.id group by all)" for k in range(1, 4)]
)
_SIM = f""", ask as (select distinct src x, dst y from e), {_WALK},
us as (select 1 t, * from u1 union all select 2, * from u2 union all select 3, * from u3),
both_ as (select ask.x, ask.y, t, degree * p v from ask join deg on deg.id = ask.x join us on us.s = ask.x and us.id = ask.y union all select ask.x, ask.y, t, degree * p from ask join deg on deg.id = ask.y join us on us.s = ask.y and us.id = ask.x)
select ask.x, ask.y, round(coalesce(sum(v) filter (t = 3), 0) / (select count(*) from s), 12) lrw, round(coalesce(sum(v), 0) / (select count(*) from s), 12) srw from ask left join both_ using (x, y) group by ask.x, ask.y"""
#: Weight and edges of a spanning forest: with c(t) components among edges of weight t or less, the forest has c(t - 1) - c(t) edges of weight t.
_SPAN = """th as (select t from (select 0::bigint t union all select unnest(range(1, 98))::bigint)),
tc(t, id, c) using key (t, id) as (select t, id, id from th, v union
  select f.t, x.b, min(f.c) from tc f join (select a, b, w from p union all select b, a, w from p) x on x.a = f.id and x.w <= f.t join recurring.tc q on q.t = f.t and q.id = x.b where f.c < q.c group by f.t, x.b),
cc as (select t, count(distinct c) n from tc group by t),
span as (select (select n from cc where t = 97) trees, sum(case when t < 97 then n - (select n from cc where t = 97) end)::double weight, max(n) - min(n) edges from cc)"""
_TURN = "({} % 2147483648 * 2654435761 % 4294967296)"
_FIRST_TREE = """ft(id, c) using key (id) as (select 0::bigint, 0::bigint union select s.b, 0 from ft join s on s.a = ft.id left join recurring.ft q on q.id = s.b where q.id is null)"""
#: Depth-first: each step settles the top of a stack whose settled members are gone, and pushes its neighbours, the least on top.
_DFS = """nb as (select src id, list({'u': dst, 'p': src} order by dst desc) l from {edges} group by src),
w(z, stack, seen, vs, ps, rs, r) using key (z) as (
  select 0, [{'u': 0::bigint, 'p': null::bigint}], list_resize([]::boolean[], n, false), []::bigint[], []::bigint[], []::bigint[], 0::bigint from n
  union
  select 0, case when len(rest) > 0 then rest when nxt is not null then [{'u': nxt, 'p': null::bigint}] else [] end, seen2, vs2, ps2, rs2, case when len(rest) > 0 or nxt is null then r else nxt end
  from (select *, case when len(rest) = 0 then list_position(seen2, false) - 1 end nxt from (
    select r, seen2, list_append(vs, v.u) vs2, list_append(ps, v.p) ps2, list_append(rs, r) rs2, list_filter(list_concat(stack[:-2], coalesce(nb.l, [])), lambda x: not seen2[x.u + 1]) rest
    from (select *, stack[-1] v, list_concat(seen[:stack[-1].u], [true], seen[stack[-1].u + 2:]) seen2 from w where len(stack) > 0) left join nb on nb.id = v.u))),
dfs as (select unnest(vs) id, unnest(rs) root, unnest(ps) parent, unnest(range(len(vs))) preorder from w)"""
#: A subtree's members follow its vertex in preorder, up to the next vertex that is no deeper.
_DFS_DEPTH = """dd(id, d) using key (id) as (select id, 0 from dfs where parent is null union select dfs.id, dd.d + 1 from dd join dfs on dfs.parent = dd.id),
do_ as (select dfs.id, parent, preorder, d from dfs join dd using (id))"""
#: With its children in their order of visits, a vertex is numbered once half of its subtree is.
_DFS_SIZE = _DFS_DEPTH + """, ds as (select id, parent, preorder, coalesce((select min(preorder) from do_ y where y.preorder > x.preorder and y.d <= x.d), (select count(*) from do_)) - preorder size from do_ x)"""
_MIDDLE = """ko as (select *, coalesce(sum(size) over (partition by parent order by heavy desc, preorder desc rows between unbounded preceding and 1 preceding), 0)::bigint bef
  from (select *, parent is not null and row_number() over (partition by parent order by size desc, preorder desc) = 1 heavy from ds)),
own as (select h.id, coalesce(min(k.bef + k.size) filter (k.bef + k.size >= h.size // 2), 0) o from ds h left join ko k on k.parent = h.id group by h.id),
bg(id, x) as (select id, bef from ko where parent is null union all select k.id, bg.x + k.bef + (k.bef >= h.size // 2)::bigint from bg join ko k on k.parent = bg.id join ds h on h.id = bg.id)"""
#: An edge is in the forest unless lighter edges, or equal ones before it, connect its ends.
_MSF = """ce as (select p.a, p.b, w, x.c ca, y.c cb from p join tc x on x.t = w - 1 and x.id = a join tc y on y.t = w - 1 and y.id = p.b where x.c <> y.c),
rr(a, b, w, c) as (select a, b, w, ca from ce union select r.a, r.b, r.w, case when q.ca = r.c then q.cb else q.ca end from rr r join ce q on q.w = r.w and (q.a < r.a or (q.a = r.a and q.b < r.b)) and (q.ca = r.c or q.cb = r.c))"""
_HASHED = "hm as (select id, row_number() over (order by (id * 2654435761) % 4294967296, id) - 1 new_id from v)"

ORACLES: dict[str, str] = {
    "edges_ingest": f"{_R} select src, dst, w weight from e",
    "edges_ingest_supplier": f"{_Q} select src, dst, w weight from e",
    "pairs_merge": f"{_R} select a, b from p",
    "adjacency": f"{_R} select a id, b nbr, not exists (select 1 from e where src = a and dst = b) incoming from s",
    "flags_merge": f"with {_FLAGS} select a, b, bool_or(o) as \"out\" from f group by a, b",
    "self_loop_filter": f"with {_FLAGS} select a, b, count(*) n from f group by a, b",
    "undirected": f"{_R} select a src, b dst, min(w) weight from (select src a, dst b, w from e union all select dst, src, w from e) group by a, b",
    "graph_summary": f"{_R} select n vertices, (select count(*) from s) alist_entries, b bits_per_edge, ((select count(*) from s) * b + 7) // 8 alist_bytes from n, bits",
    "degree_out": f"{_R} select id, out_degree from deg",
    "degree_total": f"{_R} select id, degree from deg",
    "degree_distribution": f"{_R} select degree, count(*) vertices from deg group by degree",
    "max_degree": f"{_R} select max(degree) max_degree from deg",
    "csr_offsets": f"{_R}, {_OFFSETS} select id, degree, bit_offset from off",
    "csr_size": f"{_R} select b bits_per_edge, ((select count(*) from s) * b + 7) // 8 alist_bytes from bits",
    "cal_size": f"{_R} select (sum(x)::bigint + 7) // 8 alist_bytes from (select sum(length(bin(abs(a - b)))) + max(length(bin(abs(a - b)))) - 1 + 2 * count(*) x from s group by a)",
    "edge_ordinal": f"{_R} select src, dst, row_number() over (partition by src order by dst) - 1 pos from e",
    "neighbor_higher": f"{_R} select a id, b nbr from s where b > a",
    "static_entropy": f"{_R}, m as (select count(*)::double m from s), x as (select count(*) / (select m from m) p from s group by b), y as (select count(*) / (select m from m) p from s group by abs(a - b)) select round((select sum(p * log2(1 / p)) from x), 6) entropy_direct, round(1 + (select sum(p * log2(1 / p)) from y), 6) entropy_delta",
    "static_deltas": f"{_R}, {_DELTAS} select round(avg(dv), 3) delta_vertices_mean, round(stddev_pop(dv), 3) delta_vertices_sd, round(avg(de), 3) delta_edges_mean, round(stddev_pop(de), 3) delta_edges_sd from d",
    "page_crossing": f"{_R}, {_DELTAS} select round(avg((dv >= 4096)::int), 6) prob_vertex_page_crossing, round(avg((de >= 4096)::int), 6) prob_calist_page_crossing from d",
    "conductance_p0": f"{_R}, {_COND} {_COND_SELECT} where part = 0",
    "conductance_all": f"{_R}, {_COND} {_COND_SELECT}",
    "haversine_to_target": f"{_R}, {_CO}, z as (select * from co where id = 0), q as (select co.id, {_hav('co', 'z')} h from co, z) select id, round({_HAV}, 4) km from q",
    "pagerank_5": f"{_R}{_PAGERANK}",
    "pagerank_5_supplier": f"{_Q}{_PAGERANK}",
    "lrw_srw_3": f"{_R}{_SIM}",
    "bfs_levels_0": f"{_R}, {_SSSP.format(edges='(select src, dst, 1.0::double w from e)')} select id, cost::bigint as \"level\" from d",
    "bfs_undirected_0": f"{_R}, {_SSSP.format(edges='(select a src, b dst, 1.0::double w from s)')} select id, cost::bigint as \"level\" from d",
    "bfs_forest": f"{_R}, {_FOREST} select id, k // 1048576 root, k % 1048576 as \"level\" from f",
    "bfs_forest_fixpoint": f"{_R}, {_FOREST} select id, k // 1048576 root, k % 1048576 as \"level\" from f",
    "bfs_forest_supplier": f"{_Q}, {_FOREST} select id, k // 1048576 root, k % 1048576 as \"level\" from f",
    "bfs_forest_count": f"{_R}, {_FOREST} select count(*) components, max(c) giant_size from (select k // 1048576 root, count(*) c from f group by 1)",
    "wcc_labels": f"{_R}, {_WCC} select id, component from c",
    "wcc_labels_supplier": f"{_Q}, {_WCC} select id, component from c",
    "wcc_count": f"{_R}, {_WCC} select count(distinct component) components from c",
    "scc_labels": f"{_R}, {_SCC} select id, component from scc",
    "scc_count": f"{_Q}, {_SCC} select count(distinct component) components from scc",
    "sssp_0": f"{_R}, {_SSSP.format(edges='e')} select id, cost from d",
    "sssp_forest": f"{_R}, {_PATHS} select id, r root, c cost from f",
    "sssp_forest_fixpoint": f"{_R}, {_PATHS} select id, r root, c cost from f",
    "sssp_limit_k": f"{_R}, {_PATHS} select id, r root, c cost from f order by r, c, id limit 500",
    "sssp_first_tree": f"{_R}, {_SSSP.format(edges='e')} select id, cost from d",
    "astar_0": f"{_R}, {_ASTAR}, {_SSSP.format(edges='ae')} select id, round(cost, 3) cost from d",
    "astar_found": f"{_R}, {_SSSP.format(edges='e')} select coalesce(bool_or(id = 1), false) found from d",
    "kcore_numbers": f"{_R}, {_CORE} select id, c core from k where it = 40",
    "mis_members": f"{_R}, {_MIS} select unnest(sel) id from m where i = (select n - 1 from n)",
    "relabel_identity": f"{_R} select id, id new_id from v",
    "relabel_hash": f"{_R}, {_HASHED} select id, new_id from hm",
    "relabel_bfs": f"{_R}, {_FOREST} select id, row_number() over (order by k, id) - 1 new_id from f",
    "apply_mapping": f"{_R}, {_HASHED} select x.new_id src, y.new_id dst, w weight from e join hm x on x.id = src join hm y on y.id = dst",
    "dot_lines": f"{_R} select chr(9) || src || ' -> ' || dst || ';' line from e",
    "codec_roundtrip_csr": f"{_R} select (select count(*) from s)::bigint entries, 0::bigint lost, ((select count(*) from s) * b + 7) // 8 alist_bytes from bits",
    "codec_roundtrip_cal": f"{_R} select (select count(*) from s)::bigint entries, 0::bigint lost, (sum(x)::bigint + 7) // 8 alist_bytes from (select sum(length(bin(abs(a - b)))) + max(length(bin(abs(a - b)))) - 1 + 2 * count(*) x from s group by a)",
    "msf_weight": f"{_R}, {_SPAN} select weight, edges from span",
    "prim_costs": f"{_R}, {_SPAN} select weight, trees from span",
    "prim_first_tree": f"{_R}, {_FIRST_TREE}, {_SPAN.replace('th, v union', 'th, ft v union')} select weight, (select count(*) from ft) members from span",
    "relabel_half": f"{_R} select id, row_number() over (order by id >= n // 2, case when id < n // 2 then id else id * 2654435761 % 4294967296 end, id) - 1 new_id from v, n",
    "random_weights": f"{_R} select src, dst, {_TURN.format('(' + _TURN.format('(' + _TURN.format('3735928559') + ' + src)') + ' + dst)')} / 4294967296.0::double * n weight from e, n",
    "files_csr": f"{_R} select a id, b nbr, not exists (select 1 from e where src = a and dst = b) incoming, (1 + (least(a, b) * 31 + greatest(a, b) * 17) % 97)::double weight from s",
    "files_cal": f"{_R} select a id, b nbr, not exists (select 1 from e where src = a and dst = b) incoming, (1 + (least(a, b) * 31 + greatest(a, b) * 17) % 97)::double weight from s",
    "files_coordinates": f"{_R}, {_CO} select id, round(lon, 9) lon, round(lat, 9) lat from co",
    "files_header_csr": f"{_R} select n vertices, (select count(*) from s) alist_entries, ((select count(*) from s) * b + 7) // 8 alist_bytes from n, bits",
    "files_header_cal": f"{_R} select (select n from n) vertices, (select count(*) from s) alist_entries, (sum(x)::bigint + 7) // 8 alist_bytes from (select sum(length(bin(abs(a - b)))) + max(length(bin(abs(a - b)))) - 1 + 2 * count(*) x from s group by a)",
    "files_checksum": f"{_R} select (((select count(*) from s) * b + 7) // 8 + 4095) // 4096 pages, 0::bigint zero_pages from bits",
    "text_edges": f"{_R} select src, dst from e",
    "text_roads": f"{_R} select src, dst, w weight from e",
    "text_places": f"{_R}, {_CO} select id, round(lon, 9) lon, round(lat, 9) lat from co",
    "text_pairs": f"{_R} select src, dst, n vertices from e, n",
    "scalar_functions": f"{_R} select src, dst, abs(src - dst) apart, (src > dst)::int falls, greatest(src - dst, 0)::bigint \"over\", (src + 7) // 8 n_bytes, length(bin(src + 1)) n_bits, src * 4096 // 32768 page, (src * 1103515245 + 12345) & 65535 lcg from e",
    "frontier_sizes": f"{_R}, {_SSSP.format(edges='(select src, dst, 1.0::double w from e)')} select cost::bigint as \"level\", count(*) vertices, count(*) >= 200 above from d group by cost",
    "frontier_share": f"{_R}, {_SSSP.format(edges='(select src, dst, 1.0::double w from e)')} select round(coalesce(sum(case when c >= 200 then c else 0 end) / sum(c), 0), 6) f_threshold from (select count(*) c from d group by cost)",
    "giant_tree": f"{_R}, {_FOREST} select (select count(distinct k // 1048576) from f) components, root giant_root, c giant_size from (select k // 1048576 root, count(*) c from f group by 1) order by c desc, root limit 1",
    "dfs_preorder": f"{_R}, {_DFS.replace('{edges}', 'e')} select id, root, parent, preorder from dfs",
    "dfs_tree": f"{_R}, {_DFS.replace('{edges}', '(select a src, b dst from s)')}, {_DFS_SIZE} select id, parent, size weight from ds",
    "dfs_weight_remap": f"{_R}, {_DFS.replace('{edges}', '(select a src, b dst from s)')}, {_DFS_SIZE}, {_MIDDLE} select ds.id, x + o new_id, size weight, parent from ds join own using (id) join bg using (id)",
    "msf_edges": f"{_R}, {_SPAN}, {_MSF} select a, b, w weight from ce where not exists (select 1 from rr where rr.a = ce.a and rr.b = ce.b and rr.c = ce.cb)",
    "bfs_rounds": f"{_R}, {_SSSP.format(edges='(select src, dst, 1.0::double w from e)')} select cost::bigint as \"round\", count(*) settled from d where cost > 0 group by cost union all select max(cost)::bigint + 1, 0 from d",
    "static_measures": f"{_R}, {_DELTAS}, m as (select count(*)::double m from s), x as (select count(*) / (select m from m) p from s group by b), y as (select count(*) / (select m from m) p from s group by abs(a - b)), "
    "one as (select (select sum(p * log2(1 / p)) from x) ENTROPY_DIRECT, 1 + (select sum(p * log2(1 / p)) from y) ENTROPY_DELTA, avg(dv) DELTA_VERTICES_MEAN, stddev_pop(dv) DELTA_VERTICES_SD, avg(de) DELTA_EDGES_MEAN, stddev_pop(de) DELTA_EDGES_SD, "
    "avg((dv >= 4096)::int) PROB_VERTEX_PAGE_CROSSING, avg((de >= 4096)::int) PROB_CALIST_PAGE_CROSSING from d) select metric, round(v, 3) as \"value\" from (unpivot one on columns(*) into name metric value v)",
    "sorted_entries": f"{_R} select row_number() over (order by a, b) - 1 pos, a id, b nbr, not exists (select 1 from e where src = a and dst = b) incoming from s",
    "scan_order": "with recursive r(k, block) as (select 0::bigint, 0::bigint union all select k + 1, (block * 1103515245 + 12345) & 4095 from r where k < 4095) select k, block from r",
    "stream_degrees": "select user_id, count(*) n_events, count(distinct event_type) n_types from events group by user_id",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

