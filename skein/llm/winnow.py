"""Benchmark decontamination by winnowed fingerprints with a guarantee for every shared window."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import map_batches, table, text_bytes
from skein.plans.storage import drop, save

#: Words of a window that counts as shared, and of a fingerprinted k-gram.
WINDOW, GRAM = 10, 8
#: Most bits (as a power of two) of the map of benchmark fingerprints that every task gets: 8 MB.
MAP_BITS = 26
#: Bytes of benchmark contexts up to which the join sends them to every task; beyond, both sides are shuffled with so many salts.
BROADCAST_BYTES, SALTS = 16 << 20, 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A byte is part of a word unless it is one of \x00-\x2F, \x3A-\x60, \x7B-\x7F (after lower-casing).
_WORD = np.ones(256, bool)
_WORD[:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
#: Words hashed at a time.
_STEP = 1 << 17
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """The words of many texts: lower-cased bytes, where each word starts and ends, a hash of each, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def line(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(at, at + n))


def split_words(raw: np.ndarray, ends: np.ndarray) -> Words:
    """``ends``: n+1 offsets of the texts in ``raw``.  No word spans two texts."""
    data = _LOWER[raw]
    inside = _WORD[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[:1] = False
    before[ends[:-1][ends[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    cut = ends[1:] - 1
    after[cut[cut >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, ends)
    if not len(start):
        return Words(data, start, end, np.zeros(0, np.uint64), first)
    length = end - start
    powers = _powers(_P, int(length.max()))
    h = np.empty(len(start), np.uint64)
    letters = data[inside]
    upto = np.cumsum(length)
    for a in range(0, len(start), _STEP):
        b = min(len(start), a + _STEP)
        base = upto[a] - length[a]
        offset = upto[a:b] - length[a:b] - base
        piece = letters[base : upto[b - 1]]
        at = np.arange(len(piece)) - np.repeat(offset, length[a:b])
        h[a:b] = np.add.reduceat((piece.astype(np.uint64) + np.uint64(1)) * powers[at], offset)
    return Words(data, start, end, _mix(h + length.astype(np.uint64)), first)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive words, also of those across texts."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for w, p in zip(range(k), _powers(_Q, k), strict=True):
        out += h[w : w + n] * p
    return _mix(out)


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """Positions that hold the rightmost least hash of some ``span`` consecutive hashes (of all, if there are fewer)."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    span = min(span, n)
    at = np.arange(n - span + 1)
    best, low = at.copy(), grams[: n - span + 1].copy()
    for d in range(1, span):
        other = grams[d : d + n - span + 1]
        less = other <= low
        best[less], low[less] = at[less] + d, other[less]
    return np.unique(best)


def gram_of(size: int, gram: int = GRAM) -> tuple[int, int]:
    """For windows of ``size`` words: words of a k-gram, and how many consecutive k-grams a window holds."""
    k = min(gram, size)
    return k, size - k + 1


def marks(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, first word) of the winnowed k-grams for windows of ``size`` words; none spans two texts.

    Two texts that share ``size`` words select the same k-gram inside them.
    """
    k, span = gram_of(size)
    grams = gram_hashes(words.hash, k)
    at = winnow(grams, span)  # across texts too: the windows inside a text are among those winnowed
    text_of = np.searchsorted(words.first, at, "right")
    at = at[text_of == np.searchsorted(words.first, at + (k - 1), "right")]
    return _mix(grams[at] + np.uint64(size)), at


def _context(words: Words, at: int, size: int, low: int, high: int) -> tuple[str, int]:
    """The k-gram at a word with all words that a window around it may hold, between ``low`` and ``high``; and its place in there."""
    k, span = gram_of(size)
    a, b = max(low, at - span + 1), min(high, at + k + span - 1)
    return words.line(a, b - a).decode(), at - a


def contexts(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, size, key, ctx, at)``: the fingerprints of every item with the words around; an item without an id has an empty name."""

    def make(batch: pa.RecordBatch) -> dict:
        words = split_words(*text_bytes(batch.column(1)))
        counts = np.minimum(np.diff(words.first), WINDOW)
        out: dict[str, list] = {"item": [], "size": [], "key": [], "ctx": [], "at": []}
        names = batch.column(0).to_pylist()
        found = {size: marks(words, size) for size in np.unique(counts[counts > 0]).tolist()}
        for size, (keys, at) in found.items():
            text = np.searchsorted(words.first, at, "right") - 1
            for key, pos, t in zip(keys.view(np.int64).tolist(), at.tolist(), text.tolist(), strict=True):
                if counts[t] == size:
                    line, place = _context(words, pos, size, int(words.first[t]), int(words.first[t + 1]))
                    for name, value in zip(out, (names[t], size, key, line, place), strict=True):
                        out[name].append(value)
        return {c: pa.array(v, pa.string() if c in ("item", "ctx") else pa.int32() if c in ("size", "at") else pa.int64()) for c, v in out.items()}

    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), text_col)
    return map_batches(named, make, "item string, size int, key long, ctx string, at int", text_at=1)


def _bit_map(known: DataFrame) -> tuple[int, np.ndarray, list[int]]:
    """(bits, map, sizes): one bit for each benchmark fingerprint's first ``bits`` bits.

    The map's size follows the number of fingerprints up to ``MAP_BITS``; with
    more of them it lets more fingerprints through, and the join decides.
    """
    row = known.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()  # at most WINDOW sizes
    bits = min(MAP_BITS, max(16, (16 * int(row["n"])).bit_length()))
    slot = F.shiftrightunsigned("key", 64 - bits)
    cells = known.groupBy(F.shiftright(slot, 6).alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("ones")).toArrow()  # at most 2 ** (MAP_BITS - 6) rows
    out = np.zeros(1 << (bits - 6), np.int64)
    out[cells["cell"].to_numpy()] = cells["ones"].to_numpy()
    return bits, out.view(np.uint64), sorted(row["sizes"])


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def fingerprinted(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, digest, n_words, marks)`` for every row: its winnowed fingerprints that the map of ``known`` ones lets through.

    Fingerprints of a text with the same words around are one entry with all their positions.
    """
    bits, ones, sizes = _bit_map(known)
    shared = docs.sparkSession.sparkContext.broadcast(ones)
    kind = dict(docs.dtypes)[id_col]
    entry = pa.struct([("key", pa.int64()), ("size", pa.int32()), ("ctx", pa.string()), ("at", pa.int32()), ("pos", pa.list_(pa.int64()))])

    def make(batch: pa.RecordBatch) -> dict:
        words = split_words(*text_bytes(batch.column(2)))
        found: list[dict] = [{} for _ in range(batch.num_rows)]
        for size in sizes:
            keys, at = marks(words, size)
            slot = keys >> np.uint64(64 - bits)
            hit = np.flatnonzero(shared.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
            text = np.searchsorted(words.first, at[hit], "right") - 1
            for key, pos, t in zip(keys[hit].view(np.int64).tolist(), at[hit].tolist(), text.tolist(), strict=True):
                low = int(words.first[t])
                line, place = _context(words, pos, size, low, int(words.first[t + 1]))
                found[t].setdefault((key, size, line, place), []).append(pos - low)
        rows = [[(*what, places) for what, places in f.items()] for f in found]
        flat = [dict(zip(("key", "size", "ctx", "at", "pos"), x, strict=True)) for row in rows for x in row]
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        return {"id": batch.column(0), "digest": batch.column(1), "n_words": np.diff(words.first), "marks": pa.ListArray.from_arrays(ends, pa.array(flat, entry))}

    rows = docs.select(F.col(id_col).alias("_skein_id"), digest(F.col(text_col)).alias("_skein_digest"), F.col(text_col).alias("_skein_text"))
    return map_batches(rows, make, f"id {kind}, digest binary, n_words long, marks array<struct<key:bigint,size:int,ctx:string,at:int,pos:array<bigint>>>", text_at=2)


def extended(pairs: DataFrame, kind: str) -> DataFrame:
    """``(id, digest, spans, context)`` of the pairs whose k-grams grow, word by word to both sides, to a whole window; ``spans``: the shared words as flat [from, to) pairs."""

    def make(batch: pa.RecordBatch) -> dict:
        keep, spans = [], []
        names = ("size", "ctx", "at", "pos", "item_ctx", "item_at")
        for row, (size, ctx, at, pos, other, there) in enumerate(zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names], strict=True)):
            mine, its = ctx.split(" "), other.split(" ")
            k, _ = gram_of(size)
            if mine[at : at + k] != its[there : there + k]:
                continue
            left, right = 0, k
            while left < min(at, there) and mine[at - left - 1] == its[there - left - 1]:
                left += 1
            while at + right < len(mine) and there + right < len(its) and mine[at + right] == its[there + right]:
                right += 1
            if left + right >= size:
                keep.append(row)
                spans.append(merge([(p - left, p + right) for p in pos]))
        kept = batch.take(pa.array(keep, pa.int64()))
        return {"id": kept.column(0), "digest": kept.column(1), "spans": pa.array(spans, pa.list_(pa.int64())), "context": kept.column(2)}

    columns = ("id", "digest", "context", "size", "ctx", "at", "pos", "item_ctx", "item_at")
    return map_batches(pairs.select(*columns), make, f"id {kind}, digest binary, spans array<long>, context long")


def _join_known(left: DataFrame, right: DataFrame, key: str, salt: Column, small: bool) -> DataFrame:
    """An equi-join with a table of the benchmark: sent to every task if ``small``, else with salted keys, so that a key that many documents hold is no single task."""
    if small:
        return left.join(F.broadcast(right), key)
    salted = right.withColumn("_skein_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_skein_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(salted, [key, "_skein_salt"]).drop("_skein_salt")


def matched(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """(rows, shared, named, small): every document's words and marks; ``(id, digest, spans, context)`` of what it shares; ``(context, item)``; whether the latter is small.

    Fingerprints of documents and items meet in an equi-join.  The documents'
    side holds those that the benchmark's bit map lets through.
    """
    known = contexts(items, item_id, item_text).withColumn("context", F.xxhash64("key", "size", "ctx", "at"))
    known = save(known.dropDuplicates(["item", "context"]), "contexts")
    small = (known.agg(F.sum(F.octet_length("ctx") + F.octet_length("item") + 32)).first()[0] or 0) <= broadcast_bytes
    rows = save(fingerprinted(docs, known, id_col, text_col), "marks")
    theirs = known.select("key", "size", "context", F.col("ctx").alias("item_ctx"), F.col("at").alias("item_at")).dropDuplicates(["context"]).drop("size")
    mine = rows.where(F.size("marks") > 0).select("id", "digest", F.explode("marks").alias("m")).select("id", "digest", "m.*")
    pairs = _join_known(mine, theirs, "key", F.xxhash64("digest", "at"), small)
    shared = save(extended(pairs, dict(rows.dtypes)["id"]), "shared")
    return rows, shared, known.select("context", "item"), small


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(id, n_words, hits, items)`` for every row of ``docs``.

    ``hits``: the hit words as flat [from, to) pairs in order; ``items``: the
    ids of items with a window in the text, sorted as strings.  Each document
    is read once; fingerprints, never texts, are shuffled, and only those that
    the benchmark's bit map lets through.  Null or empty texts have no words and
    no hits; repeated rows stay repeated; items without words never match, and
    an empty benchmark hits nothing.
    """
    rows, shared, named, small = matched(docs, items, id_col, text_col, item_id, item_text, broadcast_bytes)
    kind = dict(rows.dtypes)["id"]
    spans = shared.groupBy("id", "digest").agg(F.flatten(F.collect_set("spans")).alias("hits"))

    def make(batch: pa.RecordBatch) -> dict:
        flat = [merge(list(zip(x[::2], x[1::2], strict=True))) for x in batch.column(2).to_pylist()]
        return {"id": batch.column(0), "digest": batch.column(1), "hits": pa.array(flat, pa.list_(pa.int64()))}

    spans = map_batches(spans, make, f"id {kind}, digest binary, hits array<long>")
    whose = _join_known(shared.select("id", "digest", "context").distinct(), named, "context", F.xxhash64("digest"), small)
    whose = whose.groupBy("id", "digest").agg(F.sort_array(F.collect_set("item")).alias("items"))
    d, s, w = rows.select("id", "digest", "n_words").alias("d"), spans.alias("s"), whose.alias("w")
    same = lambda x: F.col("d.id").eqNullSafe(F.col(f"{x}.id")) & (F.col("d.digest") == F.col(f"{x}.digest"))
    hits, names = F.coalesce("s.hits", F.array().cast("array<long>")), F.coalesce("w.items", F.array().cast("array<string>"))
    return d.join(s, same("s"), "left").join(w, same("w"), "left").select("d.id", "d.n_words", hits.alias("hits"), names.alias("items"))


def merge(spans: list[tuple[int, int]]) -> list[int]:
    """Union of [from, to) spans as flat pairs in order."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def hit_words(hits: str = "hits"):
    """Number of words in flat [from, to) pairs."""
    return F.aggregate(F.transform(hits, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    found = overlaps(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    n_hit = hit_words()
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that share no window with an item.

    Rows without an id, repeated rows and empty texts are judged by their text
    like the rest; an empty benchmark keeps all.  The rows to drop are found as
    (id, digest of the text), so only those are joined to the documents.
    """
    rows, shared, named, _ = matched(docs, items, id_col, text_col, "item_id", "text")
    bad = save(shared.select(F.col("id").alias("_skein_id"), F.col("digest").alias("_skein_digest")).distinct(), "contaminated")
    drop(rows, shared)
    on = docs[id_col].eqNullSafe(bad["_skein_id"]) & (digest(docs[text_col]) == bad["_skein_digest"])
    return docs.join(bad, on, "left_anti")


#: The same rows in DuckDB: every window of every item is looked up among all windows of its length in the documents.
ORACLE_OP7 = r"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select item_id, least(len(w), 10) n, unnest(range(1, len(w) - least(len(w), 10) + 2)) i, w from b where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') t from bw),
dw as (select r, s.n n, unnest(range(1, len(w) - s.n + 2)) i, w from d, (select distinct n from win) s where len(w) >= s.n),
hit as (select r, i, dw.n, item_id from dw join win on dw.n = win.n and array_to_string(w[i : i + dw.n - 1], ' ') = t),
words as (select r, count(distinct j) n_hit from (select r, unnest(range(i, i + n)) j from hit) group by r),
items as (select r, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) ids from (select distinct r, item_id from hit) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (r) left join items using (r)
"""
