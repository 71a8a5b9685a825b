"""Quality rules with thresholds that adapt to each language and source, from mergeable quantile sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import let, table, words_of
from skein.plans.storage import save

#: Metrics per thousand, each with the least spread that its fence allows for, and whether a lower fence holds as well.
METRICS = {"symbols_pm": (100, False), "dup_lines_pm": (100, False), "repeats_pm": (100, False), "word_chars_pm": (1000, True)}
#: Rows from which a group has thresholds of its own; smaller ones take the language's, then everyone's.
MIN_GROUP = 200
#: Fence: so many spreads (upper minus lower quartile) beyond the quartile.
SPREADS = 3
SYMBOLS = "#*$%&|<>"
#: Columns that this operator makes.
OWN_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", *METRICS, "base_failed", "kept")


def _covered(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in ``words``.

    The windows' hashes are sorted with their positions, so that equal ones are
    neighbours: n log n work for a text of any length, with no shuffle.
    """

    def count(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

        def again(s: Column) -> Column:
            same = F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(s, F.greatest(k - 1, F.lit(0)))["h"])))
            return let(F.sort_array(F.transform(same, lambda x: x["i"])), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

        return let(F.sort_array(grams), again)

    return F.when(F.size(words) >= 4, count(words)).otherwise(0)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` (long); null: an empty text.

    Columns of these names, and of those that :func:`judged` adds, are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, " \t\x0b\f\r", "") != "")
    both = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    counts = let(words_of(F.col(text_col)), lambda w: F.struct(F.size(w).alias("n"), _covered(w).alias("r")))
    out = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text_col and c not in OWN_COLUMNS],
        counts.alias("_skein_w"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        both.alias("_skein_l"),
    )
    fields = {"n_words": F.col("_skein_w.n"), "n_repeat_words": F.col("_skein_w.r"), "n_dup_lines": F.col("_skein_l.n") - F.col("_skein_l.d"), "n_lines": F.col("_skein_l.n")}
    return out.withColumns({k: v.cast("long") for k, v in fields.items()}).drop("_skein_w", "_skein_l")


def per_mille() -> dict[str, Column]:
    share = lambda a, b: F.expr(f"{a} * 1000 div greatest({b}, 1)")
    return {"symbols_pm": share("n_symbols", "n_words"), "dup_lines_pm": share("n_dup_lines", "n_lines"), "repeats_pm": share("n_repeat_words", "n_words"), "word_chars_pm": share("word_chars", "n_words")}


def bucket(v: Column) -> Column:
    """Bucket of a value of at least 0: exact below 32, then 32 buckets for each power of two (error at most 1/32).

    Counts per bucket are the sketch; sketches merge by adding counts, in any order, with the same result.
    """
    return let(F.struct(v.alias("v"), F.greatest(F.length(F.bin(v)) - 6, F.lit(0)).alias("e")), lambda s: F.when(s["v"] < 32, s["v"]).otherwise(s["e"] * 32 + F.call_function("shiftright", s["v"], s["e"])))


def bucket_floor(b: Column) -> Column:
    """Smallest value of a bucket."""
    e = F.floor(b / 32).cast("int") - 1
    return F.when(b < 32, b).otherwise(F.call_function("shiftleft", (b % 32 + 32).cast("long"), F.greatest(e, F.lit(0))))


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, metric, bucket, n)``: one quantile sketch per key and metric."""
    stacked = rows.select(*keys, F.explode(F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))])).alias("metric", "value"))
    return stacked.groupBy(*keys, "metric", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of the coarser ``keys``."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, rows, low_<metric>, high_<metric>)`` from the quartiles of each sketch."""
    by = [F.col(k).isNull() for k in keys] + [F.col(k) for k in keys]
    w = Window.partitionBy(*by, "metric").orderBy("bucket")
    total = Window.partitionBy(*by, "metric")
    run = sketch.withColumns({"upto": F.sum("n").over(w), "rows": F.sum("n").over(total)})
    q = lambda part: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * part, bucket_floor(F.col("bucket"))))
    quart = run.groupBy(*keys, "metric").agg(F.max("rows").alias("rows"), q(1).alias("q1"), q(3).alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.create_map(*[x for m, (least, _) in METRICS.items() for x in (F.lit(m), F.lit(least))])[F.col("metric")])
    fenced = quart.select(*keys, "metric", "rows", (F.col("q1") - SPREADS * spread).alias("low"), (F.col("q3") + SPREADS * spread).alias("high"))
    one = lambda m, side: F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{side}_{m}")
    return fenced.groupBy(*keys).agg(F.max("rows").alias("rows"), *[one(m, side) for m in METRICS for side in ("low", "high")])


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` without the text, with their measures, ``base_failed`` and ``kept``.

    A row is kept unless the base rule fails or a metric lies beyond the fence
    of its (language, source); a null language or source is a group like any
    other.  Groups of fewer than ``min_group`` rows are judged by their
    language's sketch, or by everyone's where that is small as well.  Repeated
    rows stay repeated and count as often; an empty table gives an empty one.
    Columns of the result's names are replaced, others kept.
    The texts are read once, into a narrow table; only counts are shuffled.
    """
    rows = save(measures(docs, text_col).withColumns(per_mille()), "measures")
    fine = save(sketches(rows, [lang_col, source_col]), "sketches")
    own, lang, all_ = fences(fine, [lang_col, source_col]), fences(merged(fine, [lang_col]), [lang_col]), fences(merged(fine, []), [])
    names = [f"{side}_{m}" for m in METRICS for side in ("low", "high")]
    o, g, a = own.alias("o"), lang.alias("g"), all_.alias("a")
    pick = lambda c: F.when(F.col("o.rows") >= min_group, F.col(f"o.{c}")).when(F.col("g.rows") >= min_group, F.col(f"g.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    # one row for everyone stands on the right of the last join
    limits = o.join(g, F.col(f"o.{lang_col}").eqNullSafe(F.col(f"g.{lang_col}"))).join(a, F.lit(True)).select(F.col(f"o.{lang_col}").alias("_skein_lang"), F.col(f"o.{source_col}").alias("_skein_source"), *[pick(c).alias(f"_skein_{c}") for c in names])
    limits = save(limits, "limits")
    out = rows.join(limits, rows[lang_col].eqNullSafe(limits["_skein_lang"]) & rows[source_col].eqNullSafe(limits["_skein_source"]), "left")
    inside = F.lit(True)
    for m, (_, two_sided) in METRICS.items():
        inside = inside & (F.col(m) <= F.col(f"_skein_high_{m}"))
        if two_sided:
            inside = inside & (F.col(m) >= F.col(f"_skein_low_{m}"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumns({"base_failed": failed, "kept": ~failed & F.coalesce(inside, F.lit(True))}).drop("_skein_lang", "_skein_source", *[f"_skein_{c}" for c in names])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    out = judged(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_FENCE = ", ".join(f"max(high) filter (metric = '{m}') high_{m}, max(low) filter (metric = '{m}') low_{m}" for m in METRICS)
_SPREAD = "case metric " + " ".join(f"when '{m}' then {least}" for m, (least, _) in METRICS.items()) + " end"


def _sql_fences(name: str, keys: str) -> str:
    k = keys + ", " if keys else ""
    return f"""
{name}_s as (select {k}metric, bucket, sum(n)::bigint n from sk group by {k}metric, bucket),
{name}_r as (select {k}metric, bucket, sum(n) over (partition by {k}metric order by bucket) upto, sum(n) over (partition by {k}metric) total from {name}_s),
{name}_q as (select {k}metric, max(total) total, min(case when upto * 4 >= total then lo end) q1, min(case when upto * 4 >= total * 3 then lo end) q3
  from (select *, case when bucket < 32 then bucket else (bucket % 32 + 32) << greatest(bucket // 32 - 1, 0) end lo from {name}_r) group by {k}metric),
{name}_f as (select {k}metric, total, q1 - {SPREADS} * greatest(q3 - q1, {_SPREAD}) low, q3 + {SPREADS} * greatest(q3 - q1, {_SPREAD}) high from {name}_q),
{name} as (select {k}max(total) total, {_FENCE} from {name}_f {'group by ' + keys if keys else ''})"""


ORACLE_OP5 = rf"""
with d as (select row_number() over () r, doc_id, lang, source, coalesce(text, '') t from documents),
w as (select r, unnest(ws) word, generate_subscripts(ws, 1) i from (select r, regexp_extract_all(t, '[^ \t\n\x0B\f\r]+') ws from d)),
tri as (select r, i, word || ' ' || lead(word) over p || ' ' || lead(word, 2) over p gram from w window p as (partition by r order by i)),
rep as (select r, i from (select r, i, count(*) over (partition by r, gram) n from tri where gram is not null) where n > 1),
cov as (select r, count(distinct j) n from (select r, unnest([i, i + 1, i + 2]) j from rep) group by r),
wc as (select r, count(*) n, sum(length(word)) chars from w group by r),
l as (select r, unnest(string_split(t, chr(10))) line from d),
lc as (select r, count(*) n, count(distinct line) u from l where regexp_matches(line, '[^ \t\n\x0B\f\r]') group by r),
m as (select d.r, doc_id, lang, source, coalesce(wc.n, 0)::bigint n_words, coalesce(wc.chars, 0)::bigint word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint n_symbols, coalesce(lc.n - lc.u, 0)::bigint n_dup_lines, coalesce(lc.n, 0)::bigint n_lines, coalesce(cov.n, 0)::bigint n_repeat_words
  from d left join wc using (r) left join lc using (r) left join cov using (r)),
p as (select *, n_symbols * 1000 // greatest(n_words, 1) symbols_pm, n_dup_lines * 1000 // greatest(n_lines, 1) dup_lines_pm,
  n_repeat_words * 1000 // greatest(n_words, 1) repeats_pm, word_chars * 1000 // greatest(n_words, 1) word_chars_pm from m),
v as (select lang, source, 'symbols_pm' metric, symbols_pm x from p union all select lang, source, 'dup_lines_pm', dup_lines_pm from p
  union all select lang, source, 'repeats_pm', repeats_pm from p union all select lang, source, 'word_chars_pm', word_chars_pm from p),
sk as (select lang, source, metric, case when x < 32 then x else greatest(length(bin(x)) - 6, 0) * 32 + (x >> greatest(length(bin(x)) - 6, 0)::bigint) end bucket, count(*) n from v group by all),
{_sql_fences('o', 'lang, source')},
{_sql_fences('g', 'lang')},
{_sql_fences('a', '')},
x as (select p.*, {', '.join(f"case when o.total >= {MIN_GROUP} then o.{s}_{m} when g.total >= {MIN_GROUP} then g.{s}_{m} else a.{s}_{m} end {s}_{m}" for m in METRICS for s in ('low', 'high'))}
  from p join o on o.lang is not distinct from p.lang and o.source is not distinct from p.source join g on g.lang is not distinct from p.lang cross join a),
y as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from x)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {' and '.join(f'{m} <= high_{m}' + (f' and {m} >= low_{m}' if two else '') for m, (_, two) in METRICS.items())} kept from y
"""
