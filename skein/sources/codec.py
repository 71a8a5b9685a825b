"""Packed adjacency files: fixed-width entries (CSR) and delta-coded lists (CAL), read and written per vertex range."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.model import Graph


def pack_csr(entries: list[tuple[int, bool]], bits: int) -> tuple[int, int]:
    """Entries ``nbr * 2 + incoming`` of ``bits`` bits each, lowest first, as (integer, bits)."""
    value = 0
    for k, (nbr, incoming) in enumerate(entries):
        value |= (nbr << 1 | incoming) << k * bits
    return value, len(entries) * bits


def unpack_csr(value: int, count: int, bits: int) -> list[tuple[int, bool]]:
    mask = (1 << bits) - 1
    return [((x := value >> k * bits & mask) >> 1, bool(x & 1)) for k in range(count)]


def pack_cal(self_id: int, entries: list[tuple[int, bool]]) -> tuple[int, int]:
    """A list in order of delta length: for each entry the delta with its leading one moved to the end, then sign and direction; a 0 first raises the length."""
    bits: list[int] = []
    length = 1
    for nbr, incoming in sorted(entries, key=lambda e: (abs(self_id - e[0]).bit_length(), e[0])):
        delta = abs(self_id - nbr)
        while length < delta.bit_length():
            bits.append(0)
            length += 1
        bits.append(1)
        bits += [delta >> i & 1 for i in range(length - 1)]
        bits += [int(nbr > self_id), int(incoming)]
    return sum(b << i for i, b in enumerate(bits)), len(bits)


def unpack_cal(self_id: int, value: int, count: int) -> list[tuple[int, bool]]:
    out, at, length = [], 0, 1
    for _ in range(count):
        while not value >> at & 1:
            at, length = at + 1, length + 1
        at += 1
        delta = 1 << length - 1 | value >> at & (1 << length - 1) - 1
        at += length - 1
        up, incoming = value >> at & 1, value >> at + 1 & 1
        at += 2
        out.append((self_id + delta if up else self_id - delta, bool(incoming)))
    return out


def encode(g: Graph, form: str = "csr") -> DataFrame:
    """``(id, degree, bits, data)``: each vertex's entries as little-endian bytes, in tasks by id range; a vertex's list is what a task must hold."""
    width = max(1, (g.vertices.count() - 1).bit_length()) + 1
    lists = g.adjacency().groupBy("id").agg(F.sort_array(F.collect_list(F.struct("nbr", "incoming"))).alias("e"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, e in zip(f["id"], f["e"], strict=True):
                entries = [(int(x["nbr"]), bool(x["incoming"])) for x in e]
                value, bits = pack_csr(entries, width) if form == "csr" else pack_cal(int(i), entries)
                rows.append((i, len(entries), bits, value.to_bytes((bits + 7) // 8, "little")))
            yield pd.DataFrame(rows, columns=["id", "degree", "bits", "data"])

    return lists.repartitionByRange("id").mapInPandas(run, "id long, degree long, bits long, data binary")


def decode(packed: DataFrame, vertices: int, form: str = "csr") -> DataFrame:
    """``(id, nbr, incoming)`` of :func:`encode`'s rows."""
    width = max(1, (vertices - 1).bit_length()) + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, n, data in zip(f["id"], f["degree"], f["data"], strict=True):
                value = int.from_bytes(data, "little")
                rows += [(i, b, c) for b, c in (unpack_csr(value, n, width) if form == "csr" else unpack_cal(int(i), value, n))]
            yield pd.DataFrame(rows, columns=["id", "nbr", "incoming"])

    return packed.mapInPandas(run, "id long, nbr long, incoming boolean")


def round_trip(g: Graph, form: str = "csr") -> DataFrame:
    """One row: entries, those that differ after packing and unpacking, and the packed bytes."""
    back = decode(encode(g, form), g.vertices.count(), form)
    lost = g.adjacency().exceptAll(back.select("id", "nbr", "incoming")).count()
    return encode(g, form).agg(F.sum("degree").alias("entries"), F.lit(lost).cast("long").alias("lost"), F.expr("(sum(bits) + 7) div 8").alias("alist_bytes"))
