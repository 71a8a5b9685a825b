"""URL verdicts: rules first, then a ratio of variable-order Markov models of accepted and rejected URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import table
from skein.plans.storage import save

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Longest context, and the share of a class's characters from which a context is kept: 0 keeps every one that was counted.
ORDER, SHARE = 4, 0.0
#: Symbols of a folded URL: a-z, 0, . / _ -, one for the rest, and the end mark.
ALPHABET = 33
#: Rows of the score table up to which it is sent to every task.
BROADCAST_ROWS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first ``://`` and ``/?#``, A-Z lower-cased; then up to ``?`` or ``#``.  Null or no ``://``: both empty."""
    at = F.locate("://", url)
    tail = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    tail = F.coalesce(tail, F.lit(""))
    host = F.translate(F.regexp_extract(tail, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its text and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones win
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def folded(host: Column, path: Column) -> Column:
    """Lower case, digits as 0, other symbols as ``*``, with marks at both ends."""
    text = F.translate(F.concat(host, path), _UPPER + "123456789", _LOWER + "0" * 9)
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(text, r"[^a-z0./_-]", "*"), F.lit("$"))


def grams(text: Column) -> Column:
    """Every character with the ``ORDER`` before it."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - ORDER), lambda i: F.substring(text, i, F.lit(ORDER + 1)))


def calibrates(host: Column) -> Column:
    """Whether a host's URLs set the threshold; those of the others, two thirds, train the models."""
    return F.crc32(host.cast("binary")) % 3 == 1


def _log_ratio(seen: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """``(gram, ratio)`` for each gram of ``seen``: log P(char | context) among accepted less that among rejected, in millionths.

    Witten-Bell smoothing from order 0 upwards: with n characters and t kinds
    of them after a context, P = (count + t * P_shorter) / (n + t).  A context
    that its class never had, or below the kept share, adds nothing, so each
    position uses the longest contexts that its class knows.
    """
    total = counts.agg(*[F.sum(c).alias(f"all_{c}") for c in ("allow", "block")])
    out = seen.select("gram")
    for c in ("allow", "block"):
        out = out.withColumn(f"p_{c}", F.lit(1.0 / ALPHABET))
    for k in range(ORDER + 1):
        part = counts.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("g")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        ctx = part.groupBy(F.substring("g", 1, k).alias("ctx")).agg(
            *[x for c in ("allow", "block") for x in (F.sum(c).alias(f"n_{c}"), F.count(F.when(F.col(c) > 0, 1)).alias(f"t_{c}"))]
        )
        # one row of totals
        ctx = ctx.join(total, F.lit(True)).select("ctx", *[F.when(F.col(f"n_{c}") >= F.col(f"all_{c}") * share, F.col(f"n_{c}")).alias(f"n_{c}") for c in ("allow", "block")], "t_allow", "t_block")
        out = out.withColumns({"g": F.substring("gram", ORDER + 1 - k, k + 1), "ctx": F.substring("gram", ORDER + 1 - k, k)})
        out = out.join(part, "g", "left").join(ctx, "ctx", "left")
        p = {f"p_{c}": F.when(F.col(f"n_{c}") > 0, (F.coalesce(c, F.lit(0)) + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"p_{c}")) for c in ("allow", "block")}
        out = save(out.select("gram", *[v.alias(k_) for k_, v in p.items()]), "order")
    return out.select("gram", F.round((F.log("p_allow") - F.log("p_block")) * 1_000_000).cast("long").alias("ratio"))


def verdicts(pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, share: float = SHARE) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, score`` (columns of these names are replaced).

    The models are counted over the distinct (host, path) that a rule accepts
    or rejects, of two thirds of the hosts.  ``score`` is the log-likelihood
    difference per character in millionths, null where a rule decides; the
    threshold is the one that best separates the ruled URLs of the other hosts
    (mean of both hit rates; the lowest such, halfway to the next value), or 0
    where those lack a class.  If the models have no accepted, or no rejected,
    URL, they say nothing and the rest is allowed.  Null and malformed URLs have
    empty host and path and are judged by the models.  Work is on distinct
    URLs; a URL repeated by a third of the rows is counted once.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.drop("host", "path", "rule", "verdict", "score").withColumns({"host": host, "path": path})
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    spread = 2 * pages.sparkSession.sparkContext.defaultParallelism  # a URL makes many grams, so its rows are worth dealing out
    names = save(rows.select("host", "path").distinct().withColumns({"rule": rule, "known": verdict}).repartition(spread), "urls")
    pieces = names.select("host", "path", "known", F.explode(grams(folded(F.col("host"), F.col("path")))).alias("gram"))
    counts = save(pieces.groupBy("gram").agg(*[F.count(F.when((F.col("known") == c) & ~calibrates(F.col("host")), 1)).alias(c) for c in ("allow", "block")]), "counts")
    ratio = save(_log_ratio(counts, counts.where("allow + block > 0"), share), "ratio")
    lookup = F.broadcast(ratio) if ratio.count() <= BROADCAST_ROWS else ratio
    sums = pieces.join(lookup, "gram").groupBy("host", "path", "known").agg(F.sum("ratio").alias("s"), F.count("*").alias("n"))
    scored = save(sums.select("host", "path", "known", F.expr("s div n").alias("score")), "scored")
    both = names.where(~calibrates(F.col("host"))).agg(F.countDistinct("known")).first()[0] == 2
    cut = _threshold(scored.where(F.col("known").isNotNull() & calibrates(F.col("host")))) if both else None
    last = scored.join(names.select("host", "path", "rule"), ["host", "path"]).select(
        F.col("host").alias("_skein_host"), F.col("path").alias("_skein_path"), "rule",
        F.coalesce("known", F.when(F.lit(True) if cut is None else F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"),
        F.when(F.col("known").isNull(), F.col("score")).alias("score"),
    )
    last = save(last, "verdicts")
    return rows.join(last, (rows["host"] == last["_skein_host"]) & (rows["path"] == last["_skein_path"])).drop("_skein_host", "_skein_path")


def _threshold(labelled: DataFrame, step: int = 5_000, most: int = 5_000_000) -> int:
    """From a histogram of at most ``2 * most / step + 1`` bins for each class; 0 where one has no URL."""
    bins = labelled.groupBy(F.expr(f"greatest(-{most}, least({most}, score)) div {step}").alias("bin"), "known").count().collect()
    have = {c: {r["bin"]: r["count"] for r in bins if r["known"] == c} for c in ("allow", "block")}
    total = {c: sum(h.values()) for c, h in have.items()}
    if not all(total.values()):
        return 0
    at = sorted({*have["allow"], *have["block"]})
    best, cut, below = -1.0, 0, {"allow": 0, "block": 0}
    for k, b in enumerate([*at, at[-1] + 1]):
        value = below["block"] / total["block"] + 1 - below["allow"] / total["allow"]
        if value > best + 1e-12:
            best, cut = value, (b + (at[k - 1] if k else b - 1) + 1) * step // 2
        for c in below:
            below[c] += have[c].get(b, 0)
    return cut


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    out = verdicts(table(spark, sf_dir, "pages", "page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "score")
