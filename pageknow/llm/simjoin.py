"""From signatures to verified links, without emitting the pairs of any group.

Members that share a signature are candidates. Each is first verified against the smallest member of its bucket.
Components are then formed, and a bucket whose members all fell into one component is done. An open bucket with a bounded
number of pairs across components has those verified. Larger open buckets are crowded. A member that meets all its similar
sets in other buckets as well leaves the crowded ones; the caller's signatures say which (``bound_to``). The others
are signed anew, once each, by their first elements: sets of similarity t share an element among the first ``(1 - t) * size + 1`` of either, in any order
that is the same for all. In the order used here the elements that many of these sets hold come last, the commonest at the
very end, so sets that only have a passage or a template in common no longer meet. These sets may be computed anew wherever
they are used (``Sets``), so that no table of them is kept. What is open after that is compared in
blocks of bounded size: a task counts the common elements of two blocks by a matrix product over the elements that occur
twice, and returns a spanning set of the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageknow.llm.common import BROADCAST_ROWS, discard, materialize, slices
from pageknow.llm.graph import components

BLOCK = 512
#: and at most so many elements, about; a block of large sets has fewer members.
BLOCK_ELEMENTS = 400_000
#: An open bucket with at most so many pairs across components has them verified one by one, before and after its members
#: are signed anew.
FEW = (200, 1_000)
#: Cells of the matrices that a task holds.
CELLS = 4_000_000
#: One document of so many is signed beforehand to find the hot signatures, those that hold at least HOT rows of it.
SAMPLE = 64
HOT = 64
#: The same for the members of open buckets, of which one in so many is signed anew beforehand.
SAMPLE_AGAIN, HOT_AGAIN = 8, 16
#: At most so many signatures are hot.
MOST_HOT = 50_000
#: Elements that are put last when sets are signed anew, at most.
LATE = 200_000
#: Up to so many crowded signatures are sent to the tasks; beyond, all their members are signed anew.
MOST_CROWDED = 1_000_000
#: Rows of a hot signature are dealt into so many cells.
SALTS = 64


@dataclass(frozen=True)
class Sets:
    """Sets (id, elements) that ``of`` makes of the batches of ``rows`` in the task that uses them; ``keys`` tell rows apart."""

    rows: DataFrame
    keys: tuple[str, ...] = ("id",)
    of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter

    def then(self, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        of = self.of
        return self.rows.mapInArrow(lambda it: f(of(it)), schema)

    def some(self, one_of: int) -> Sets:
        return Sets(self.rows.where(F.pmod(F.xxhash64(*self.keys), F.lit(one_of)) == 0), self.keys, self.of)

    def count(self) -> int:
        return self.then(lambda it: (b.select(["id"]) for b in it), "id long").count()


def in_part(sigs: np.ndarray, part: int, parts: int) -> np.ndarray | slice:
    """Which signatures are in a part; a part is shuffled at a time."""
    return (sigs >> np.uint64(32)) % np.uint64(parts) == part if parts > 1 else slice(None)


def hot_signatures(sample: DataFrame, least: int) -> DataFrame:
    """(sig): those with at least ``least`` signed rows in a sample."""
    n = sample.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return n.orderBy(F.col("n").desc(), "sig").limit(MOST_HOT).select("sig")


def shared(signed: list[DataFrame], sample: DataFrame, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """(sig, id, hub, hot): distinct members of signatures that at least two ids share, and the smallest one; and the written
    tables they are read from. ``signed`` are parts that share no signature, taken one after the other, so only one is in shuffle files.
    A hot signature is dealt into cells, whose smallest members are joined afterwards."""
    hot = materialize(hot_signatures(sample, least), "hot")
    written = [_met(part, hot) for part in signed]
    discard(hot)
    some = reduce(DataFrame.unionAll, written)
    split = some.where("hot")
    hubs = split.groupBy("sig").agg(F.min("hub").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("sig", F.col("lo").alias("hub"))
    return some.where("hot IS NULL").select("sig", "id", "hub", "hot").unionAll(split.select("sig", "id", "hot").join(F.broadcast(hubs), "sig").select("sig", "id", "hub", "hot")), written


def _met(signed: DataFrame, hot: DataFrame) -> DataFrame:
    """Of each signature and cell the distinct members and the smallest one, written; without those that are alone."""
    dealt = signed.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "sig", "left").withColumn("cell", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    w = W.partitionBy("sig", "cell")
    some = dealt.withColumns({"lo": F.min("id").over(w), "hi": F.max("id").over(w)}).where("hot OR lo <> hi")
    return materialize(some.select("sig", "cell", "id", F.col("lo").alias("hub"), "hot").distinct(), "met")


def spanning(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between positions i and j a set of edges (id, smallest id) that connects the same."""
    label = ids.copy()
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == label).all():
            break
        label = new
    at = np.unique(np.concatenate([i, j])) if len(i) else np.zeros(0, dtype=int)
    at = at[ids[at] != label[at]]
    return label[at], ids[at]


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of common elements of the sets at ``left`` and at ``right``."""
    sizes = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, at, n = np.unique(every, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(n > 1)
    column = np.full(len(n), -1)
    column[twice] = np.arange(len(twice))
    col = column[at]
    owner, col = owner[col >= 0], col[col >= 0]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    width = max(1, CELLS // max(1, len(sets)))
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    for a in range(0, len(twice), width):
        lo, hi = np.searchsorted(col, [a, a + width])
        m = np.zeros((len(sets), min(width, len(twice) - a)), dtype=np.float32)
        m[owner[lo:hi], col[lo:hi] - a] = 1
        out += m[left] @ m[right].T
    return out


def _compare(num: int, den: int, table: pa.Table) -> pa.Table:
    block = table.column("block").to_numpy()
    ids = table.column("id").to_numpy()
    sets = [np.frombuffer(e, np.uint64) for e in table.column("elements").to_pylist()]
    p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
    left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
    if not len(left) or not len(right):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    both = common(sets, left, right)
    n = np.array([len(s) for s in sets])
    total = n[left][:, None] + n[right][None, :]
    i, j = np.nonzero(den * both >= num * (total - both))
    a, b = spanning(ids, left[i], right[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def link_clumps(clumps: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) inside clumps (id, clump) by exact similarity of their sets (id, elements), as spanning edges. Blocks are
    bounded by members and by elements, so a task holds two blocks of bounded size whatever the sets are (a set is never split)."""
    sized = clumps.join(sets.select("id", (F.octet_length("elements") / 8).alias("size")), "id")
    blocks = sized.groupBy("clump").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_ELEMENTS)).cast("int").alias("nb"))
    x = clumps.join(blocks, "clump").withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).join(sets, "id")
    x = x.select("clump", "id", "elements", "block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    x = x.select("clump", "id", "elements", "block", F.greatest("block", "o").alias("p"), F.least("block", "o").alias("q"))
    return x.groupBy("clump", "p", "q").applyInArrow(lambda t: _compare(num, den, t), "a long, b long")


def _across(rows: DataFrame) -> DataFrame:
    """Pairs a < b of a bucket's members in different components, but those with the hub, which were verified before."""
    x = rows.where("id <> hub").select("sig", F.col("id").alias("i"), F.col("c").alias("ci"))
    y = rows.where("id <> hub").select("sig", F.col("id").alias("j"), F.col("c").alias("cj"))
    return x.join(y, "sig").where("ci < cj").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(element, n) of the elements that several sets of a batch hold."""
    for b in slices(batches):
        if b.num_rows:
            e, n = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in b.column("elements").to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(e[n > 1]), pa.array(n[n > 1])], ["element", "n"])


def common_elements(sets: Sets) -> np.ndarray:
    """The elements that most sets (id, elements) hold, the rarer first. At most LATE of them reach the driver, and only what
    repeats within a batch is counted: which ones these are decides what the work costs, not what it results in."""
    e = sets.then(_frequent, "element long, n long").groupBy("element").agg(F.sum("n").alias("n"))
    e = e.orderBy(F.col("n").desc(), "element").limit(LATE).select("element")
    return e.toArrow().column(0).to_numpy()[::-1].astype(np.int64).view(np.uint64)


def first_elements(s: np.ndarray, last: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first ``size - ceil(size * num / den) + 1`` elements of a set, those among ``last`` (sorted, with ranks) at the end."""
    n = len(s) - -(-len(s) * num // den) + 1
    at = np.minimum(np.searchsorted(last, s), max(0, len(last) - 1))
    is_last = last[at] == s if len(last) else np.zeros(len(s), dtype=bool)
    first = s[~is_last][:n]
    if len(first) < n:
        late = s[is_last]
        first = np.concatenate([first, late[np.argsort(rank[at[is_last]], kind="stable")][: n - len(first)]])
    return first


def _sign_first(late: np.ndarray, num: int, den: int, part: int, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rank = np.argsort(late, kind="stable")
    last = late[rank]
    for b in slices(batches):
        sigs = [first_elements(np.frombuffer(e, np.uint64), last, rank, num, den) for e in b.column("elements").to_pylist()]
        sigs = [s[in_part(s, part, parts)] for s in sigs] or [np.zeros(0, np.uint64)]
        at = np.repeat(np.arange(len(sigs)), [len(s) for s in sigs])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), b.column("id").take(pa.array(at))], ["sig", "id"])


def link_buckets(
    signed: DataFrame | list[DataFrame], sample: DataFrame, verify: Callable[[DataFrame], DataFrame], sets_of: Callable[[DataFrame], DataFrame], num: int, den: int,
    bound_to: Callable[[DataFrame, np.ndarray], DataFrame] | None = None, sets_again: Callable[[DataFrame], Sets] | None = None,
) -> DataFrame:
    """Links (a, b) that hold all connections between similar ids.

    ``signed``: (sig, id), or its parts without a common signature, ``sample``: the same of a sample. ``verify``: written candidate pairs (a < b, distinct) to those that
    link, written. ``sets_of``: distinct (id) to (id, elements), written. ``bound_to``: of members (id) of crowded buckets those that
    need one of the crowded signatures (sorted, unsigned) to meet all their similar sets; without it, all do. ``sets_again``: like
    ``sets_of``, for the sets that are signed anew, but nothing is written; others may be among them.
    """
    signed = signed if isinstance(signed, list) else [signed]
    none = sample.sparkSession.createDataFrame([], "a long, b long")

    def check(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.distinct(), "candidates")
        found = none if pairs.isEmpty() else verify(pairs)
        discard(pairs)
        return found

    def open_rows(rows_: DataFrame, links_: DataFrame) -> DataFrame:
        """Rows of the buckets that still hold several components, and the number of pairs across these."""
        comp = materialize(components(links_), "components")
        named = rows_.join(F.broadcast(comp) if comp.count() <= BROADCAST_ROWS else comp, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        one, all_ = W.partitionBy("sig", "c"), W.partitionBy("sig")
        cold = named.where("hot IS NULL").repartition("sig").withColumn("k", F.count(F.lit(1)).over(one))
        cold = cold.withColumn("across", ((F.count(F.lit(1)).over(all_) * F.count(F.lit(1)).over(all_) - F.sum("k").over(all_)) / 2))
        split = named.where("hot")
        mates = split.groupBy("sig", "c").agg(F.count(F.lit(1)).alias("k"))
        mates = mates.groupBy("sig").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("across"))
        kept = ["sig", "id", "hub", "hot", "c", "across"]
        both = cold.select(*kept).unionAll(split.join(F.broadcast(mates), "sig").select(*kept))
        both = materialize(both.where("across > 0"), "open")
        discard(comp)
        return both

    def settle(met: tuple[DataFrame, list[DataFrame]], links_: DataFrame, few: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The rows of the buckets that are open with too many pairs, links so far, and the written table of the rows."""
        rows_, written = met
        links_ = links_.unionAll(check(rows_.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))))
        rows_ = open_rows(rows_, links_)
        discard(*written)
        links_ = links_.unionAll(check(_across(rows_.where(F.col("across") <= few))))
        return rows_.where(F.col("across") > few).select("sig", "id", "hub", "hot"), links_, rows_

    rows, links, table = settle(shared(signed, sample, HOT), none, FEW[0])
    if rows.isEmpty():
        discard(table)
        return links
    ids = materialize(rows.select("id").distinct(), "open-ids")
    crowded = rows.select("sig").distinct().limit(MOST_CROWDED + 1)
    if bound_to is not None and (sigs := crowded.toArrow().column(0).to_numpy().view(np.uint64)).size <= MOST_CROWDED:
        ids = materialize(bound_to(ids, np.sort(sigs)).distinct(), "bound-ids")
        if ids.isEmpty():
            discard(table)
            return links
    discard(table)
    sets = sets_again(ids) if sets_again is not None else Sets(sets_of(ids))
    late = common_elements(sets)

    def again(some: Sets, part: int = 0, parts: int = 1) -> DataFrame:
        return some.then(lambda it: _sign_first(late, num, den, part, parts, it), "sig long, id long")

    met = shared([again(sets, k, len(signed)) for k in range(len(signed))], again(sets.some(SAMPLE_AGAIN)), HOT_AGAIN)
    discard(sets.rows)
    rows, links, table = settle(met, links, FEW[1])
    if rows.isEmpty():
        discard(table)
        return links
    clumps = components(rows.where("id <> hub").select("hub", "id").distinct(), "hub", "id").withColumnRenamed("component", "clump")
    clumps = materialize(clumps, "clumps")
    discard(table)
    sets = sets_of(clumps.select("id"))
    found = materialize(link_clumps(clumps, sets, num, den), "links")
    discard(sets)
    return links.unionAll(found)
