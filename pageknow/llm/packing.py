"""Best-fit packing: token pieces into sequences of a fixed length, by bounded-space online best-fit.

A packer has a fixed number of open bins. A bitset has one bit for each amount of free space that some open bin has; the
lowest bit at or above a piece's length names the fullest bin that takes it. A piece that fits nowhere opens a bin; if too
many are open then, the fullest closes for good. A full bin closes by itself. Placing a piece costs the same whatever was
placed before.

Pieces are dealt into groups of about ``group_tokens`` tokens by their row numbers, so copies, one source or one very long
document spread over all groups; each group is a stream, the longer pieces first, and is packed by a packer of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageknow.llm.bpe import Outcome, encode_documents
from pageknow.llm.common import materialize


@dataclass(frozen=True)
class Params:
    size: int = 2048  # tokens of a sequence
    open_bins: int = 512
    group_tokens: int = 1 << 21  # tokens that one packer gets, about
    end_id: int = 0  # follows each document


class Packer:
    """Bins of ``size``, at most ``open_bins`` of them open."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        got = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        return got

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece of 1 to ``size`` tokens."""
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if n < self.size and self.n_open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.n_open -= 1
            free, at = self.size, self.n_bins
            self.n_bins += 1
            self.n_open += 1
        if free > n:
            self.by_free[free - n].append(at)
            self.bits |= 1 << (free - n)
        else:
            self.n_open -= 1
        return at, self.size - free


def ids_of(ids: bytes) -> bytes:
    return ids


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids)


#: What a piece carries of its ids: the ids themselves (little-endian, unsigned 32-bit), or their CRC-32.
IDS = ("ids", "binary", pa.binary(), ids_of)
CRC32 = ("ids_crc32", "long", pa.int64(), crc32_of)


def _cut(p: Params, of: Callable[[bytes], object], ids: bytes, _: bytes) -> tuple:
    ids += p.end_id.to_bytes(4, "little")
    return len(ids) // 4, [of(ids[k : k + 4 * p.size]) for k in range(0, len(ids), 4 * p.size)]


def pieces(docs: DataFrame, path: str, keep: list[str], p: Params = Params(), payload: tuple = IDS) -> DataFrame:
    """Pieces of the encoded documents: the columns ``keep``, piece, start, length and the payload of the piece's ids."""
    name, kind, arrow, of = payload
    held = {c: f"c{i}" for i, c in enumerate(keep)}
    outcome = Outcome(lambda ids, text: _cut(p, of, ids, text), (("n_all", "long", pa.int64()), ("cuts", f"array<{kind}>", pa.list_(arrow))), decoded=False)
    coded = encode_documents(docs.select(*[docs[c].alias(h) for c, h in held.items()], docs["text"]), path, keep=list(held.values()), outcome=outcome)
    cut = coded.select(*held.values(), "n_all", F.posexplode("cuts").alias("piece", "payload"))
    start = F.col("piece").cast("long") * p.size
    return cut.select(
        *[F.col(h).alias(c) for c, h in held.items()], "piece", start.alias("start"), F.least(F.col("n_all") - start, F.lit(p.size)).alias("length"), F.col("payload").alias(name)
    )


def _pack(p: Params, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds sequence_id and offset; the rows of a group follow each other, also across batches."""
    group, packer = None, Packer(p.size, p.open_bins)
    for b in batches:
        ids, offsets = [], []
        for g, n in zip(b.column("__group").to_pylist(), b.column("length").to_pylist(), strict=True):
            if g != group:
                group, packer = g, Packer(p.size, p.open_bins)
            at, offset = packer.place(n)
            ids.append((g << 32) + at)
            offsets.append(offset)
        names = [c for c in b.schema.names if not c.startswith("__")]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"])


def pack(cut: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows with a ``length`` of 1 to ``size``, with sequence_id and offset: no two overlap, and a sequence has no gaps.

    Rows are dealt to packers and come to them by their number in ``cut``, written once; so a task that runs again places
    them alike. ``cut`` must not have columns that start with two underscores, nor sequence_id or offset."""
    cut = materialize(cut.withColumn("__no", F.monotonically_increasing_id()), "pack-pieces")
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, round(total / p.group_tokens))
    dealt = cut.withColumn("__turn", F.xxhash64("__no")).withColumn("__group", F.pmod("__turn", F.lit(groups)))
    dealt = dealt.repartition("__group").sortWithinPartitions("__group", F.col("length").desc(), "__turn", "__no").drop("__no", "__turn")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name != "__group")
    return dealt.mapInArrow(lambda it: _pack(p, it), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), p: Params = Params(), payload: tuple = IDS) -> DataFrame:
    """Each row of ``docs`` as one or more pieces: the columns ``keep``, piece (from 0), start, length, the payload (by default
    ids, binary), sequence_id, offset.

    A document is its ids and ``end_id``; only one of more than ``size`` tokens is cut. A null text is empty, so the document
    is its end alone. Nulls in ``keep`` pass through, repeated rows are packed each, a very long text is encoded by several
    tasks, an empty table gives an empty result; other columns of ``docs`` are ignored, and one in ``keep`` that is named like
    a result is replaced. Reruns over the same files agree.
    """
    new = {"piece", "start", "length", payload[0], "sequence_id", "offset"}
    return pack(pieces(docs, path, [c for c in keep if c not in new], p, payload), p)


def _join(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table.column("offset").to_pylist(), table.column("ids").to_pylist(), strict=True))
    ids = b"".join(r[1] for r in rows)
    return pa.table({"sequence_id": table.column("sequence_id")[:1], "n_tokens": pa.array([len(ids) // 4], pa.int64()), "ids": pa.array([ids], pa.binary())})


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of pieces that carry their ids: the sequences themselves, each of bounded length."""
    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(_join, "sequence_id long, n_tokens long, ids binary")
