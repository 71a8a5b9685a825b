"""SimHash near-duplicates: fingerprints linked at a small Hamming distance by pigeonring filtering."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import map_batches, table
from skein.plans.components import connected_components
from skein.plans.storage import drop, save, save_counting

#: Bits of a fingerprint, words of a shingle, seed of XXH64.
BITS, SHINGLE, SEED = 64, 3, 42
_CHUNK = 1 << 15
#: The stage that keeps one of similar documents: words of a shingle, least Jaccard similarity of two sets of shingles (numerator, denominator).
STAGE_SHINGLE, ALIKE = 5, (4, 5)
#: Bands of a MinHash signature and values in a band: sets of similarity 0.8 share no band with probability (1 - 0.8**4)**32 < 5e-8.
BANDS, ROWS = 32, 4
#: Keys of sets up to which they are sent to every task, with a hash of an id (16 bytes each).
BROADCAST_KEYS = 1_000_000
#: Types of ids, of 8 bytes at most, that may be sent to every task.
FIXED = ("tinyint", "smallint", "int", "bigint")
#: Bits of the parity map of a set, and longs that hold it.
MAP_BITS, MAP_LONGS = 2048, 32
_TURNS = np.random.default_rng(SEED).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text, A-Z lower-cased, over word shingles (repeats count; fewer words: all of them; none: 0)."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(line, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    total = n - shingle + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, total, _CHUNK):
        upto = min(total, at + _CHUNK)
        h = np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts[at:upto], ends[at + shingle - 1 : upto + shingle - 1], strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for every row, repeats included; ``fp`` is the fingerprint's 64 bits as a signed long."""

    def make(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        fps = np.fromiter((fingerprint(t) for t in texts.to_pylist()), np.uint64, len(texts))
        return {"id": batch.column(0), "fp": fps.view(np.int64)}

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(id_col, text_col), make, f"id {kind}, fp long", text_at=1)


def segments(distance: int, bits: int = BITS) -> list[tuple[int, int]]:
    """``distance + 1`` consecutive segments as (lowest bit, width)."""
    m = distance + 1
    cuts = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _keys(i: int, seg: Column, following: Column) -> Column:
    """A hash of each chain of two segments; chains that share a hash by chance fail the Hamming test."""
    return F.transform(following, lambda x: F.struct(F.lit(i).cast("byte").alias("i"), F.xxhash64(F.lit(i), seg, x).alias("key")))


def _flipped(value: Column, flips: Column) -> Column:
    return F.transform(flips, lambda x: value.bitwiseXOR(x))


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """All pairs ``(a, b)``, a > b, of the distinct fingerprints ``fp`` that differ in at most ``distance`` bits.

    Pigeonring: the ``m = distance + 1`` segments lie on a ring.  If two
    fingerprints differ in at most ``distance`` bits, some start segment has
    the property that every chain of ``l`` consecutive segments from it differs
    in at most ``floor(l * distance / m)`` bits: in none for the first segment,
    in one at most for the first two.  So candidates meet in an equi-join on
    that chain: one side comes with its own two segments, the other with its
    first segment and every second segment that is at most a bit away.  For
    distance 2 that is a key of 42 bits or more, whatever the number of
    fingerprints.  Longer chains prune inside the join, before the full
    Hamming test; where all rows hold one fingerprint there is nothing to join.
    """
    if distance < 1:
        raise ValueError("distance must be at least 1")
    segs = segments(distance)
    m = len(segs)
    value = lambda low, width: F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
    own, near = [], []
    for i, (at, after) in enumerate(zip(segs, segs[1:] + segs[:1], strict=True)):
        flips = F.array(*[F.lit(x).cast("long") for x in (0, *(1 << b for b in range(after[1])))])
        own.append(_keys(i, value(*at), F.array(value(*after))))
        near.append(_keys(i, value(*at), _flipped(value(*after), flips)))
    dealt = lambda rows: fps.select("fp", F.explode(F.concat(*rows)).alias("k")).select("fp", "k.*")
    # three small rows for each fingerprint are the built side
    x, y = dealt(own).hint("shuffle_hash").alias("x"), dealt(near).select("key", "fp").alias("y")
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    viable = F.lit(False)
    for i in range(m):
        mask, chain = 0, F.col("x.i") == i
        for length in range(1, m):
            low, width = segs[(i + length - 1) % m]
            mask |= ((1 << width) - 1) << low
            chain = chain & (F.bit_count(differ.bitwiseAND(F.lit(_signed(mask)))) <= length * distance // m)
        viable = viable | chain
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp"))
    return x.join(y, on & viable & (F.bit_count(differ) <= distance)).select(F.col("y.fp").alias("a"), F.col("x.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2) -> DataFrame:
    """``(id, fp, component)`` for every row of ``docs``.

    ``component`` is the smallest id among the rows reachable through links,
    the row itself included.  A null or empty text has fingerprint 0 and is
    linked like any other.  Rows with a null id get a component like others and
    never name one, unless no row of the component has an id (then null).
    Repeated rows stay repeated.  An empty table gives an empty result.
    """
    prints = save(fingerprints(docs, id_col, text_col), "prints")
    groups = save(prints.groupBy("fp").agg(F.min("id").alias("first")), "groups")
    comp = connected_components(links(groups.select("fp"), distance))
    known = groups.join(comp.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    known = save(known, "roots")
    least = known.groupBy("root").agg(F.min("first").alias("component"))
    names = save(known.join(least, "root").select("fp", "component"), "names")
    drop(comp, groups, known)
    return prints.join(names, "fp").select("id", "fp", "component")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def shingle_hashes(text: bytes, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """XXH64 of the word shingles of a UTF-8 text, A-Z lower-cased, repeats included (fewer words: all of them; none: empty)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[last:], strict=False)), np.uint64)


def shingle_set(text: bytes, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """The distinct ones of :func:`shingle_hashes`, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, key, n, bands, map)`` for every row.

    ``fp`` is the SimHash of the row's shingles, repeats included.  Of the row's set of shingles ``n`` is the number, ``key`` a hash, ``bands``
    a hash of each MinHash band (empty set: none), and ``map`` says for each of
    ``MAP_BITS`` values of a shingle's first bits whether an odd number of
    shingles has it.
    """

    def make(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        fps, sets = np.zeros(len(texts), np.uint64), []
        for k, t in enumerate(texts.to_pylist()):
            hashes = shingle_hashes(t)
            fps[k] = majority(hashes)
            sets.append(np.unique(hashes))
        n = np.array([len(x) for x in sets], np.int64)
        flat, full = np.concatenate(sets), n > 0
        starts = (np.cumsum(n) - n)[full]
        bands = np.zeros((len(starts), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for k, turn in enumerate(_TURNS if len(starts) else ()):
            bands[:, k // ROWS] = bands[:, k // ROWS] * _MIX + np.minimum.reduceat(flat * turn, starts)
        cell = np.repeat(np.arange(len(sets)), n) * MAP_BITS + (flat >> np.uint64(64 - MAP_BITS.bit_length() + 1)).astype(np.int64)
        odd = np.packbits((np.bincount(cell, minlength=len(sets) * MAP_BITS) & 1).astype(np.uint8)).view(np.uint64)
        keys = np.array([_set_key(x) for x in sets], np.uint64)
        return {"id": batch.column(0), "fp": fps.view(np.int64), "key": keys.view(np.int64), "n": n, "bands": _lists(full * BANDS, bands.reshape(-1)), "map": _lists(full * 0 + MAP_LONGS, odd)}

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(id_col, text_col), make, f"id {kind}, fp long, key long, n long, bands array<long>, map array<long>", text_at=1)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``(key, hashes)`` for every row of a table of one column: its set of shingles and the set's key."""

    def make(batch: pa.RecordBatch) -> dict:
        column = batch.column(0).cast(pa.large_binary()).fill_null(b"")
        sets = [shingle_set(t) for t in column.to_pylist()]
        keys = np.array([_set_key(x) for x in sets], np.uint64)
        return {"key": keys.view(np.int64), "hashes": _lists(np.array([len(x) for x in sets], np.int64), np.concatenate(sets))}

    return map_batches(texts, make, "key long, hashes array<long>", text_at=0)


def _may_be_alike(x: str, y: str) -> Column:
    """A test that no pair of similar sets fails, from ``n`` and ``map`` of both.

    Two sets of similarity s or more differ in at most (1 - s) / (1 + s) of
    their sizes' sum, and every bit in which their maps differ needs a shingle
    in which the sets do; so the maps' Hamming distance is bounded.
    """
    up, down = ALIKE
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = F.lit(0)
    for k in range(MAP_LONGS):
        differ = differ + F.bit_count(F.get(f"{x}.map", F.lit(k)).bitwiseXOR(F.get(f"{y}.map", F.lit(k))))
    return (F.least(n, m) * down >= F.greatest(n, m) * up) & (differ * (down + up) <= (n + m) * (down - up))


def _alike(pairs: DataFrame, groups: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of keys whose sets are similar enough, by their exact intersection.

    The sets are made again from the texts ``(id, text)`` of one row of each
    key, found by a hash of its id, rather than stored for all rows.  Rows
    without an id are all asked where a key has no other.
    """
    named = lambda c: F.xxhash64(F.col(c).cast("string"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(groups, "key")
    wanted, nameless = save_counting(wanted.select("key", named("first").alias("name"), F.col("first").isNull().alias("nameless")), "wanted", F.col("nameless"))
    few = wanted.count() <= BROADCAST_KEYS  # else the texts are shuffled once
    sent = F.broadcast if few else lambda df: df
    mine = docs.where(F.col("id").isNotNull()).withColumn("name", named("id"))
    texts = mine.join(sent(wanted.where("not nameless").select("name").distinct()), "name", "left_semi").select("text")
    if nameless:
        texts = texts.unionByName(docs.where(F.col("id").isNull()).select("text"))
    sets = shingle_sets(texts).join(sent(wanted.select("key")), "key", "left_semi")
    known = save(sets.groupBy("key").agg(F.first("hashes").alias("hashes")), "sets")
    x, y = known.select(F.col("key").alias("a"), F.col("hashes").alias("x")), known.select(F.col("key").alias("b"), F.col("hashes").alias("y"))
    both, either = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    # J = both / (either - both)
    out = save(pairs.join(x, "a").join(y, "b").where(both * sum(ALIKE) >= either * ALIKE[0]).select("a", "b"), "alike")
    drop(known, wanted)
    return out


def _near_prints(prints: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of keys whose rows share a fingerprint or have two that :func:`links` links.

    Of the keys with one fingerprint the least stands for the others.
    """
    held = save(prints.select("fp", "key").distinct(), "held")
    leads = save(held.groupBy("fp").agg(F.min("key").alias("lead")), "leads")
    same = held.join(leads, "fp").where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    x, y = leads.select(F.col("fp").alias("a"), F.col("lead").alias("x")), leads.select(F.col("fp").alias("b"), F.col("lead").alias("y"))
    near = links(leads.select("fp")).join(x, "a").join(y, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    out = save(same.unionByName(near), "near")
    drop(held, leads)
    return out


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, component)`` for every row of ``docs``: components of the texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    Equal sets are one vertex.  Candidates have SimHashes over these shingles
    that pigeonring links, as in :func:`near_duplicates`, or, as sets of
    similarity 0.8 lie some ten bits apart, share a MinHash band.  First, every
    member of a bucket meets the bucket's smallest and largest key; then only
    members that are still in different components meet, in buckets of more than
    three.  Pairs are pruned, inside that join, by the Hamming distance of their
    parity maps, which loses no similar pair, and what is left is compared by
    the whole sets.  So the rows that the joins make stay in proportion to the
    members, also where thousands of texts are alike.  Names and null ids are as
    in :func:`near_duplicates`.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = save(signatures(docs, "id", "text"), "signatures")
    groups = save(prints.groupBy("key").agg(F.min("id").alias("first"), *[F.first(c).alias(c) for c in ("n", "bands", "map")]), "groups")
    rows = groups.select("key", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.count("*").alias("members"), F.min("key").alias("least"), F.max("key").alias("most")).where("members > 1")
    dealt = save(rows.join(buckets, "band"), "buckets")
    what, firsts = groups.select("key", "n", "map"), groups.select("key", "first")

    stars = dealt.select(F.explode(F.array("least", "most")).alias("a"), F.col("key").alias("b")).where("a <> b")
    near = _near_prints(prints)
    stars = stars.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x, y = what.alias("x"), what.alias("y")
    stars = stars.join(x, F.col("a") == F.col("x.key")).join(y, (F.col("b") == F.col("y.key")) & _may_be_alike("x", "y")).select("a", "b")
    edges = _alike(save(stars, "stars"), firsts, docs)
    comp = connected_components(edges)

    placed = dealt.where("members > 3").select("band", "key").join(comp.withColumnRenamed("id", "key"), "key", "left").withColumn("c", F.coalesce("component", "key")).drop("component")
    placed = save(placed, "placed")
    open_ = placed.groupBy("band").agg((F.min("c") < F.max("c")).alias("open")).where("open").drop("open")
    left = save(placed.join(open_, "band", "left_semi").join(what, "key"), "open")
    x, y = left.alias("x"), left.alias("y")
    on = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & _may_be_alike("x", "y")
    rest = save(x.join(y, on).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct(), "rest")
    if not rest.isEmpty():
        comp = connected_components(edges.unionByName(_alike(rest, firsts, docs)))
    known = save(groups.join(comp.withColumnRenamed("id", "key"), "key", "left").select("key", "first", F.coalesce("component", "key").alias("root")), "roots")
    least = known.groupBy("root").agg(F.min("first").alias("component"))
    names = save(known.join(least, "root").select("key", "component"), "names")
    out = save(prints.select("id", "key").join(names, "key").select("id", "component"), "components")
    drop(prints, groups, near, dealt, edges, placed, left, comp, rest, known, names)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component of :func:`similar_documents` the row with the smallest id stays.

    Rows without an id stay.  Of rows repeated with the same smallest id, one stays.
    """
    out = similar_documents(docs.select(id_col, text_col), id_col, text_col)
    per_id = out.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("_skein_id")).agg(F.count_if(F.col("id") == F.col("component")).alias("_skein_n"))
    # ids with one row that stays need no mention; the others are few, and where they are not, the texts are shuffled once
    odd = save(per_id.where("_skein_n <> 1"), "odd")
    few = dict(docs.dtypes)[id_col] in FIXED and odd.count() <= BROADCAST_KEYS
    sent = F.broadcast if few else lambda df: df
    rows = lambda ids, how: docs.join(sent(ids), docs[id_col] == F.col("_skein_id"), how)
    once, repeated = rows(odd, "left_anti"), odd.where("_skein_n > 1")
    return once if repeated.isEmpty() else once.unionByName(rows(repeated, "left_semi").dropDuplicates([id_col]))
