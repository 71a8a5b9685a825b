"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import table
from skein.plans.ranking import global_row_number, running_sum
from skein.plans.storage import save

#: Weights of the sources by rank, repeating; the share of all words that the mix holds; most uses of a word.
WEIGHTS, SHARE_PERCENT, MOST = (5, 2, 1), 150, 2
#: Weight schedules by rank, repeating: (time, weight) knots over training time 0..1, linear between.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def size_of(text: Column) -> Column:
    """Words of a text: 1 for each start of a run without white space (null: 0)."""
    squeezed = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    words = F.filter(F.split(squeezed, " ", -1), lambda w: w != "")
    return F.size(words).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """``(source, rank, source_size, target)`` from ``(source, source_size)``.

    Sources are ranked by code point, null last, and take ``weights`` in turn.
    All share ``percent`` of the words by weight; a target stops at ``most``
    times its source, and what it leaves is shared again by weight until no
    target is above.  Each pass is one aggregate over the sources, which stay
    in Spark.
    """
    ordered = sources.withColumn("_skein_null", F.col("source").isNull())
    ranked = global_row_number(ordered, ["_skein_null", "source"], "rank").drop("_skein_null")
    pick = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    rows = save(ranked.withColumns({"weight": pick, "most": F.col("source_size") * most}), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    full = F.lit(False)
    while True:
        free = rows.agg(F.sum(F.when(full, F.col("most")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count(F.when(full, 1))).first()
        if free[2] == before or not free[1]:
            break
        before, level = free[2], (total * percent / 100 - (free[0] or 0)) / free[1]
        full = F.col("weight") * F.lit(level) > F.col("most")
    return rows.select("source", "rank", "source_size", F.least(F.col("weight") * F.lit(level), F.col("most").cast("double")).alias("target"))


def _pieces(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """(demand before, time, weight, slope, demand) of each linear piece of a schedule, with demand 1 in all."""
    area = [(t2 - t1) * (w1 + w2) / 2 for (t1, w1), (t2, w2) in zip(knots, knots[1:], strict=False)]
    if min(w for _, w in knots) < 0 or not sum(area) > 0 or knots[0][0] != 0 or knots[-1][0] != 1:
        raise ValueError("a schedule needs weights of at least 0, not all 0, from time 0 to 1")
    out, done = [], 0.0
    for ((t1, w1), (t2, w2)), part in zip(zip(knots, knots[1:], strict=False), area, strict=True):
        if part:
            out.append((done, t1, w1 / sum(area), (w2 - w1) / (t2 - t1) / sum(area), part / sum(area)))
            done += part / sum(area)
    return out


def position(demand: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """The training time at which a source's cumulative demand (0..1) reaches ``demand``: the inverse of its integrated schedule."""
    out = F.lit(None).cast("double")
    for r, knots in enumerate(schedules):
        mine = F.lit(None).cast("double")
        for done, t, w, slope, _ in _pieces(knots):
            u = F.greatest(demand - done, F.lit(0.0))
            # w x + slope x^2 / 2 = u, by the form that stays exact for a small slope
            x = 2 * u / (F.lit(w) + F.sqrt(F.greatest(F.lit(w * w) + 2 * slope * u, F.lit(0.0))))
            here = F.when(u > 0, F.lit(t) + x).otherwise(F.lit(t))
            mine = here if done == 0 else F.when(demand >= done, here).otherwise(mine)
        out = F.when(rank % len(schedules) == r, F.least(mine, F.lit(1.0))).otherwise(out)
    return out


def _sql_position(knots: tuple[tuple[float, float], ...]) -> str:
    """:func:`position` for one schedule, of ``v``, in SQL."""
    out = ""
    for done, t, w, slope, _ in reversed(_pieces(knots)):
        u = f"greatest(v - {done!r}::double, 0.0::double)"
        here = f"case when {u} > 0 then {t!r}::double + 2 * {u} / ({w!r}::double + sqrt(greatest({w * w!r}::double + 2 * {slope!r}::double * {u}, 0.0::double))) else {t!r}::double end"
        out = here if not out else f"case when v >= {last!r}::double then {out} else {here} end"
        last = done
    return f"least({out}, 1.0::double)"


def _placed(docs: DataFrame, id_col: str, size_col: str, source_col: str, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """``(id, size, source, h, before, rank, source_size, target, words)``: each row's place in its source's stream and its source's goal."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"), F.col(source_col).alias("source"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("h"),
    )
    rows = save(rows, "sizes")
    goal = save(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, most), "targets")
    placed = running_sum(rows, ["source"], ["h", "id", "size"], "size", "before")
    p, g = placed.alias("p"), goal.alias("g")
    both = p.join(g, F.col("p.source").eqNullSafe(F.col("g.source")), "left").select("p.*", "g.rank", "g.source_size", "g.target")
    return both.withColumn("words", F.round("target").cast("long"))


def _uses(most: int, schedules=SCHEDULES) -> Column:
    """An array over the rounds of the stream: the words of the row that each round takes, and its training position (null: nothing taken)."""

    def one(k: Column) -> Column:
        before = k * F.col("source_size") + F.col("before")
        taken = F.least(F.greatest(F.col("words") - before, F.lit(0).cast("long")), F.col("size"))
        return F.struct(taken.alias("taken"), F.when(taken > 0, position(before / F.col("words"), F.col("rank"), schedules)).alias("position"))

    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")), one)


def mix(docs: DataFrame, id_col: str = "doc_id", size_col: str = "size", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST, schedules=SCHEDULES) -> DataFrame:
    """``(id, size, source, source_size, target, taken, positions)`` for every row.

    Each source's documents stand in an order given by a hash of their id; its
    stream is that order, repeated.  The mix takes the first words of the
    stream up to the rounded target, so each source meets it exactly and only
    the last document taken can be taken in part.  ``positions`` holds, for each
    round of the stream that takes words of the document, the training time (0
    to 1) at which the source's integrated weight schedule meets its cumulative
    demand there, so two copies lie a whole round apart.  A null size counts as
    0, a null source is a source, rows without an id come first; equal rows are
    interchangeable; an empty table gives an empty one.  Sums per source are
    pre-aggregated, and running sums are made over ranges of rows, so that one
    source may hold most rows.
    """
    plan = _placed(docs, id_col, size_col, source_col, weights, percent, most).withColumn("uses", _uses(most, schedules))
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda a, u: a + u["taken"])
    positions = F.transform(F.filter("uses", lambda u: u["taken"] > 0), lambda u: u["position"])
    return plan.select("id", "size", "source", "source_size", "target", taken.alias("taken"), positions.alias("positions"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target of every document's source, the words of it that the mix takes, and where; in order of the first position (not taken: last)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source").select("doc_id", "source", size_of(F.col("text")).alias("size"))
    at = lambda k: F.round(F.get("positions", F.lit(k)), 9)
    out = mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", at(0).alias("position"), at(1).alias("second_position"))
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


#: The same rows in DuckDB.
ORACLE_OP3 = rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::bigint size from documents),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source is null, encode(source)) - 1 k from d group by source),
w as (select *, case k % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end weight, 2 * source_size most, sum(source_size) over () * 1.5 total from s),
o as (select *, coalesce(sum(most) over (order by most / weight, k rows between unbounded preceding and 1 preceding), 0)::double full_,
  sum(weight) over (order by most / weight, k rows between current row and unbounded following) free from w),
l as (select coalesce(arg_min((total - full_) / free, pos) filter ((total - full_) / free * weight <= most), 0) lvl from (select *, row_number() over (order by most / weight, k) pos from o)),
t as (select source, k, source_size, least(weight * lvl, most::double) target from w, l),
r as (select d.*, t.source_size, t.target, round(t.target)::bigint words, coalesce(sum(size) over (partition by d.source order by md5(coalesce(doc_id::varchar, '')), doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint before
  from d join t on d.source is not distinct from t.source),
u as (select *, unnest([0, 1])::bigint k from r),
c as (select *, k * source_size + before b, greatest(least(words - (k * source_size + before), size), 0)::bigint part from u),
x as (select *, b / words v from c where part > 0),
y as (select doc_id, size, before, source, k, case k_rank % 3 {' '.join(f"when {i} then {_sql_position(knots)}" for i, knots in enumerate(SCHEDULES))} end position from (select x.*, t.k k_rank from x join t on x.source is not distinct from t.source)),
g as (select doc_id, size, before, source, source_size, target, sum(part)::bigint taken from c group by all)
select g.doc_id, g.size, g.source_size, g.target, g.taken, round(y0.position, 9) as "position", round(y1.position, 9) second_position from g
  left join y y0 on y0.k = 0 and y0.doc_id is not distinct from g.doc_id and y0.source is not distinct from g.source and y0.before = g.before and y0.size = g.size
  left join y y1 on y1.k = 1 and y1.doc_id is not distinct from g.doc_id and y1.source is not distinct from g.source and y1.before = g.before and y1.size = g.size
"""


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs``, with all their columns, as the mix has them: whole documents, in order of their training position.

    A document comes once for each round of its source that takes at least half
    of it, each time where the source's cumulative demand reaches it in that
    round.  Empty texts hold no words and are never taken; null ids and sources
    are values like others; rows equal in id, source and size come as often as
    the first of them, each; an empty table gives an empty one.
    """
    names = docs.columns
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("id"), size_of(F.col(text_col)).alias("size"), F.col(source_col).alias("source"))
    plan = _placed(sized.select("id", "size", "source"), "id", "size", "source", WEIGHTS, SHARE_PERCENT, MOST)
    plan = plan.groupBy("id", "source", "size").agg(F.min("before").alias("before"), *[F.first(c).alias(c) for c in ("source_size", "words", "rank")])
    times = F.transform(F.filter(_uses(MOST), lambda u: (u["taken"] > 0) & (2 * u["taken"] >= F.col("size"))), lambda u: u["position"])
    plan = save(plan.select("id", "source", "size", times.alias("times")).where(F.size("times") > 0), "plan")
    s, p = sized.alias("s"), plan.alias("p")
    on = F.col("s.id").eqNullSafe(F.col("p.id")) & F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.size") == F.col("p.size"))
    rows = s.join(p, on).select("s.row", F.posexplode("p.times").alias("_skein_k", "position"))
    ranged = rows.repartitionByRange("position", "_skein_k").sortWithinPartitions("position", "_skein_k")
    return ranged.select("row.*")
