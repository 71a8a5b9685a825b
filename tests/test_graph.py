"""Kernels on the small worked graph and on seeded random graphs against sequential models."""

import heapq
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import catalog
from skein.functions import scalar
from skein.model import Graph
from skein.operators import analytics, kernels, layout, traverse
from skein.sources import codec, generate, text
from skein.sources.tables import pair_weight

EDGES = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 5), (6, 5), (7, 8)]
SF = "/root/testdata/sf0.001"


def make(spark, n, edges):
    return Graph(spark.range(n), spark.createDataFrame(edges, "src long, dst long").withColumn("weight", pair_weight()))


@pytest.fixture(scope="module")
def toy(spark):
    return make(spark, 10, EDGES)


def col(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy("id").collect()]


def test_degrees(toy):
    assert col(toy.degrees(), "out_degree") == [1, 1, 2, 1, 2, 0, 1, 1, 0, 0]
    assert col(toy.degrees(), "degree") == [2, 2, 3, 2, 2, 2, 1, 1, 1, 0]


@pytest.mark.parametrize("one_task", [0, kernels.ONE_TASK])
def test_forests(toy, one_task):
    assert col(traverse.bfs_forest(toy, 0, one_task), "root") == [0, 0, 0, 0, 0, 0, 6, 7, 7, 9]
    assert col(traverse.bfs_forest(toy, 6, one_task), "level") == [0, 1, 2, 3, 4, 1, 0, 0, 1, 0]
    assert col(traverse.sssp_forest(toy, 0, one_task=one_task), "cost") == [0, 18, 84, 101, 166, 182, 0, 0, 63, 0]


def test_levels_and_orders(toy):
    assert col(traverse.bfs_levels(toy, 0, undirected=True), "id", "level") == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)]
    assert col(kernels.dfs_forest(toy), "preorder") == list(range(10))
    assert col(kernels.dfs_forest(toy), "parent") == [None, 0, 1, 2, 3, 4, None, None, 7, None]
    assert sorted(col(layout.order_of(toy, "subtree"), "new_id")) == list(range(10))


def plain_depth_first(n, edges):
    near = {v: sorted(b for a, b in edges if a == v) for v in range(n)}
    parent, root, order = {}, {}, []

    def visit(v, r, p):
        parent[v], root[v] = p, r
        order.append(v)
        for u in near[v]:
            if u not in parent:
                visit(u, r, v)

    for v in range(n):
        if v not in parent:
            visit(v, v, None)
    return parent, root, order


def plain_subtree_order(n, edges, heavy):
    parent, _, order = plain_depth_first(n, edges | {(b, a) for a, b in edges})
    kids = {v: [u for u in order if parent[u] == v] for v in [*range(n), None]}
    size, new = {}, {}
    for v in reversed(order):
        size[v] = 1 + sum(size[u] for u in kids[v])

    def visit(v):
        todo, began = list(reversed(kids[v])), len(new)
        if heavy and todo:
            todo.insert(0, todo.pop(todo.index(max(todo, key=size.get))))
        for u in todo:
            if v not in new and len(new) - began >= size[v] // 2:
                new[v] = len(new)
            visit(u)
        if v not in new:
            new[v] = len(new)

    for r in reversed(kids[None]):
        visit(r)
    return [(v, new[v], size[v], parent[v]) for v in range(n)]


def test_depth_first_has_no_limit(spark, monkeypatch):
    monkeypatch.setattr(kernels, "ONE_TASK", 0)
    monkeypatch.setattr(kernels.one_task, "__defaults__", (0,))
    rng = random.Random(4)
    for n, m in ((1, 0), (60, 50), (60, 90), (90, 300)):
        edges = {(a, b) for _ in range(m) if (a := rng.randrange(n)) != (b := rng.randrange(n))}
        g = Graph(spark.range(n), spark.createDataFrame(sorted(edges), "src long, dst long"))
        parent, root, order = plain_depth_first(n, edges)
        got = sorted(map(tuple, kernels.dfs_forest(g).collect()), key=lambda r: r[3])
        assert got == [(v, root[v], parent[v], k) for k, v in enumerate(order)]
        for heavy in (True, False):
            assert col(kernels.subtree_order(g, heavy), "id", "new_id", "weight", "parent") == plain_subtree_order(n, edges, heavy)


def test_components(toy):
    assert col(traverse.wcc(toy), "component") == [0] * 7 + [7, 7, 9]
    assert col(traverse.scc(toy), "component") == [0, 0, 0, 3, 3, 5, 6, 7, 8, 9]


def test_prim_costs_above_one_task(toy):
    assert traverse.prim_costs(toy, 0).first() == traverse.prim_costs(toy).first()


def test_first_tree_has_no_limit(toy, monkeypatch):
    monkeypatch.setattr(kernels.one_task, "__defaults__", (0,))
    both = toy.as_undirected()
    for start, members in ((0, 7), (7, 2), (9, 1)):
        tree = kernels.prim_forest(both, start, only_start=True)
        assert tree.count() == members and {r.root for r in tree.collect()} == {start}
    assert kernels.prim_forest(both).agg(F.sum("cost")).first()[0] == 278


def test_kronecker_query_has_the_default_size(spark):
    assert catalog.queries()["kronecker_edges"](spark, SF).count() == 16 << 16


def test_analytics(toy):
    want = [0.044449844, 0.052782367, 0.06929375, 0.086949844, 0.088907367, 0.07025, 0.015, 0.015, 0.02775, 0.015]
    assert np.allclose(col(analytics.pagerank(toy, 5), "rank"), want, atol=1e-8)
    assert col(analytics.core_numbers(toy), "core") == [2, 2, 2, 1, 1, 1, 1, 1, 1, 0]
    assert [i for i, m in enumerate(col(analytics.maximal_independent_set(toy), "in_mis")) if m] == [0, 3, 5, 7, 9]
    c = analytics.conductance(toy, 50).where("part = 0").first()
    assert (c.cross, c.din, c.dout, c.value) == (2, 2, 14, 1.0)
    e = analytics.entropies(toy).first()
    assert (round(e.entropy_direct, 3), round(e.entropy_delta, 3)) == (3.078, 1.544)
    s = analytics.similarity(toy, toy.vertices.sparkSession.createDataFrame([(0, 1)], "x long, y long"), 3).first()
    assert np.allclose((s.lrw, s.srw), (0.072916667, 0.239583333))
    msf = traverse.msf(toy).agg(F.sum("weight"), F.count("*")).first()
    assert tuple(msf) == (278, 7)
    assert kernels.prim_forest(toy.as_undirected()).agg(F.sum("cost")).first()[0] == 278


def test_edge_similarity(spark, toy):
    rng = random.Random(6)
    edges = sorted({(a, b) for _ in range(160) if (a := rng.randrange(30)) != (b := rng.choice([rng.randrange(30), 0]))})
    for g in (toy, make(spark, 30, edges)):
        asked = g.edges.select(F.col("src").alias("x"), F.col("dst").alias("y"))
        want = {(r.x, r.y): (r.lrw, r.srw) for r in analytics.similarity(g, asked, 3).collect()}
        got = {(r.x, r.y): (r.lrw, r.srw) for r in analytics.edge_similarity(g).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)


def test_edge_similarity_moves_no_walks(toy, monkeypatch):
    monkeypatch.setattr(analytics, "similarity", lambda *a: pytest.fail("walks from every vertex"))
    assert catalog._similar(toy).count() == len(EDGES)


def test_sizes_and_codecs(toy):
    assert tuple(toy.summary().first()) == (10, 16, 5, 10) and layout.cal_size(toy).first()[0] == 7
    for form in ("csr", "cal"):
        assert tuple(codec.round_trip(toy, form).first()) == (16, 0, {"csr": 10, "cal": 7}[form])


def test_codec_lists():
    rng = random.Random(1)
    for _ in range(200):
        me = rng.randrange(1000)
        entries = sorted({(rng.choice([x for x in (rng.randrange(1000),) if x != me] or [me + 1]), rng.random() < 0.5) for _ in range(rng.randint(1, 20))}, key=lambda e: e[0])
        entries = list({n: (n, f) for n, f in entries}.values())
        value, bits = codec.pack_cal(me, entries)
        lengths = [abs(me - n).bit_length() for n, _ in entries]
        assert bits == sum(lengths) + max(lengths) - 1 + 2 * len(entries)
        assert sorted(codec.unpack_cal(me, value, len(entries))) == sorted(entries)


def test_random_graphs_against_models(spark):
    rng = random.Random(9)
    for n in (1, 40):
        edges = sorted({(a, b) for _ in range(2 * n) if (a := rng.randrange(n)) != (b := rng.randrange(n))})
        g = make(spark, n, edges) if edges else Graph(spark.range(n), spark.createDataFrame([], "src long, dst long, weight double"))
        near = {a: [] for a in range(n)}
        for a, b in edges:
            near[a].append((b, 1 + (min(a, b) * 31 + max(a, b) * 17) % 97))
        cost = {}
        start = n // 2
        for k in range(n):
            r = (start + k) % n
            heap = [(0, r)] if r not in cost else []
            while heap:
                c, v = heapq.heappop(heap)
                if v not in cost:
                    cost[v] = (r, c)
                    for u, w in near[v]:
                        heapq.heappush(heap, (c + w, u))
        for one in (0, kernels.ONE_TASK):
            assert col(traverse.sssp_forest(g, start, one_task=one), "root", "cost") == [cost[i] for i in range(n)]


def test_mapping_is_a_permutation(toy):
    for order in ("identity", "hash", "random", "half", "bfs", "subtree_light"):
        assert sorted(col(layout.order_of(toy, order), "new_id")) == list(range(10)), order
    assert layout.relabel(toy, "hash").edges.count() == len(EDGES)


def test_text_sources(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# Nodes: 5\n0 1 F\n1 0 R\n0\t1 R\n1 1 F\n2 3 R\n3 2 F\n")
    g = text.read_edge_text(spark, str(tmp_path / "e.txt"))
    assert g.vertices.count() == 5 and sorted(map(tuple, g.edges.collect())) == [(0, 1), (3, 2)]
    (tmp_path / "d.txt").write_text("1 2 F 1500\n1 2 F 2500\n2 1 R 900\n")
    (tmp_path / "c.txt").write_text("c x\np aux 2\nv 1 1000000 2000000\nv 2 0 0\n")
    d = text.read_dimacs(spark, str(tmp_path / "d.txt"), str(tmp_path / "c.txt"))
    assert [tuple(r) for r in d.edges.collect()] == [(0, 1, 2.5)] and d.vertices.count() == 2
    (tmp_path / "p.txt").write_text("# Nodes: 3 Edges: 3\n# NodeId \tNodeId\n0 \t1\n0 \t1\n2 \t2\n")
    assert text.read_pairs(spark, str(tmp_path / "p.txt")).edges.count() == 1
    assert text.read_pairs(spark, str(tmp_path / "p.txt"), keep_multiple=True).edges.count() == 2
    (tmp_path / "i.txt").write_text("vertices=100\nalist_entries=1790\nalist_bytes=1790\n")
    assert tuple(text.read_info(spark, str(tmp_path / "i.txt")).first()) == (100, 1790, 1790)
    (tmp_path / "b.bin").write_bytes(bytes(4096) + b"\x01\xff" + bytes(4094))
    assert text.page_checksum(spark, str(tmp_path / "b.bin")).select("pages", "zero_pages").first() == (2, 1)


def test_checksum_of_many_pages(spark, tmp_path):
    # 40 MB: cutting every page from the start of the whole took the square of its size
    data = np.random.default_rng(1).integers(0, 256, 40_000_003, dtype=np.uint8)
    data[4096 * 70 : 4096 * 72] = 0
    (tmp_path / "big.bin").write_bytes(data.tobytes())
    began = time.perf_counter()
    assert text.page_checksum(spark, str(tmp_path / "big.bin")).select("pages", "zero_pages").first() == (9766, 2)
    assert time.perf_counter() - began < 120
    (tmp_path / "none.bin").write_bytes(b"")
    assert text.page_checksum(spark, str(tmp_path / "none.bin")).select("pages", "zero_pages").first() == (0, 0)


def test_generator():
    s, d = generate.kronecker_range(8, 0, 300)
    a, b = generate.kronecker_range(8, 120, 300)
    assert (s[120:] == a).all() and (d[120:] == b).all() and s.min() >= 0 and max(s.max(), d.max()) < 256
    assert sorted(generate.scramble(np.arange(256), 8, 12345, 678)) == list(range(256))
    state = np.array(generate.seed_state(1, 2), np.uint64)[:, None]
    stepped = state.copy()
    for _ in range(37):
        generate._draw(stepped, np.array([True]))
    assert (generate._apply(generate.jump(37), state) == stepped).all()
    r = generate.random_numbers(50)
    assert ((r >= 0) & (r < 1)).all() and np.allclose(generate.random_numbers(10, position=40), r[40:])


def test_scalars(spark):
    row = spark.range(1).select(scalar.bit_reverse(F.lit(1).cast("long")), scalar.bit_length(F.lit(8)), scalar.lcg_next(F.lit(1).cast("long"), 0xFFFF), scalar.haversine(F.lit(0.0), F.lit(0.0), F.lit(np.pi), F.lit(0.0))).first()
    assert row[0] == -(2**63) and row[1] == 4 and row[2] == (1103515245 + 12345) & 0xFFFF and abs(row[3] - 6371 * np.pi) < 1e-6


FAST = ["edges_ingest", "flags_merge", "csr_offsets", "cal_size", "static_deltas", "conductance_all", "pagerank_5", "lrw_srw_3", "wcc_labels", "relabel_bfs", "apply_mapping", "stream_degrees"]


@pytest.mark.parametrize("name", FAST)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    columns = want.columns
    got = catalog.queries()[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_rounds_settle_the_levels(toy):
    got = traverse.bfs_rounds(toy, 0).collect()
    assert [(r["round"], r["settled"]) for r in got] == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 0)]
    assert all(r["seconds"] > 0 for r in got)


def test_entries_sorted_over_all_parts(toy, spark, tmp_path):
    rows = sorted(map(tuple, layout.sorted_entries(toy).collect()))
    want = sorted(tuple(r) for r in toy.adjacency().select("id", "nbr", "incoming").collect())
    assert rows == [(k, *r) for k, r in enumerate(want)]
    layout.write_sorted(toy, f"file://{tmp_path}/entries")
    parts = sorted((tmp_path / "entries").glob("part-*"))
    lines = [x for p in parts for x in p.read_text().splitlines()]
    assert lines == [f"{a} {b} {'R' if incoming else 'F'}" for a, b, incoming in want]


def test_generator_by_index(spark):
    mask = 0x3FF
    got = [r[0] for r in spark.range(mask + 1).orderBy("id").select(scalar.lcg_at(F.col("id"), mask)).collect()]
    x, want = 0, []
    for _ in range(mask + 1):
        want.append(x)
        x = (x * scalar.LCG_A + scalar.LCG_C) & mask
    assert got == want and len(set(want)) == mask + 1
