"""N-gram Jaccard join of whole documents by PartEnum signatures.

Documents with the same set of shingles are one class. A representative of each class signs (see ``shingles.PartEnum``),
classes that share a signature are verified exactly on their sets, and components join classes and their copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageknow.llm.common import checked_semi, discard, fill_partitions, materialize, slices, text_key, without
from pageknow.llm.graph import components
from pageknow.llm.shingles import PartEnum, overlap, set_digest, shingle_sets
from pageknow.llm.simjoin import SAMPLE, Sets, in_part, link_buckets

CHUNK = 400_000
#: Sets that a task remembers to sign copies once; it signs the copies of others again.
SEEN = 400_000
#: Signatures are cut to 48 bits, which shuffle in fewer bytes; of 10^13 rows one in 30 then meets another by chance, and
#: what meets is verified.
SIG_BITS = np.uint64(2**64 - 2**16)
#: Signatures are shuffled in so many parts at most, one after the other, each with about so many elements of sets at least. For
#: each part all texts are signed again.
PARTS, PART_ELEMENTS = 3, 20_000_000
#: Up to so many doc_ids are sent to the tasks that sign some sets anew; beyond, all sets are signed anew.
MOST_IDS = 2_000_000


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def _digests(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = shingle_sets(_texts(b), k)
        d = [set_digest(s)[0] if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d, pa.int64()), pa.array([counts(s) for s in sets], pa.binary())],
            ["doc_id", "key", "n_shingles", "d1", "counts"],
        )


def counts(s: np.ndarray) -> bytes:
    """Elements in each part of the domain, modulo 256; a power of two of parts, about one for five elements."""
    bits = min(14, max(5, int(len(s) // 5).bit_length()))
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the elements in which two sets differ, from their counts; the finer one is folded to the coarser."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(p) > len(q):
        p = p[::2] + p[1::2]
    while len(q) > len(p):
        q = q[::2] + q[1::2]
    return int(np.abs((p - q).view(np.int8).astype(np.int64)).sum())


def _may_link(num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose part counts allow the similarity: at most (total - apart) / 2 in common, at least (total + apart) / 2 in all."""
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("cx", "cy", "nx", "ny")]
        ok = []
        for x, y, n, m in zip(*cols, strict=True):
            apart = least_difference(x, y)
            ok.append(den * (n + m - apart) >= num * (n + m + apart))
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def sign_batches(pe: PartEnum, k: int, batches: Iterator[pa.RecordBatch], part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    """(sig, id) of each text in one of ``parts`` of the signatures, id being the first half of the set's digest; copies within
    a task sign once."""
    seen: set[int] = set()
    for b in slices(batches):
        fresh = {}
        for s in shingle_sets(_texts(b), k):
            if len(s) and (d := set_digest(s)[0]) not in seen:
                fresh[d] = s
                if len(seen) < SEEN:
                    seen.add(d)
        ids = np.array(list(fresh), dtype=np.int64)
        sigs, at = pe.sign(list(fresh.values()))
        here = in_part(sigs, part, parts)
        sigs, at = sigs[here], at[here]
        for c in range(0, len(sigs), CHUNK):
            yield _rows([sigs[c : c + CHUNK] & SIG_BITS], [ids[at[c : c + CHUNK]]])


def _bound(pe: PartEnum, k: int, crowded: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id) of the texts whose sets need a crowded signature."""
    for b in slices(batches):
        sets = [s for s in shingle_sets(_texts(b), k) if len(s)]
        ids = [set_digest(s)[0] for s, y in zip(sets, pe.bound_to(sets, crowded, SIG_BITS), strict=True) if y]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["id"])


def _rows(sigs: list, ids: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(ids))], ["sig", "id"])


def _among(doc_ids: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows without a doc_id or with one of ``doc_ids`` (sorted)."""
    for b in batches:
        if doc_ids is None:
            yield b
            continue
        own = b.column("doc_id")
        d = own.fill_null(0).to_numpy()
        near = np.minimum(np.searchsorted(doc_ids, d), max(0, len(doc_ids) - 1))
        met = doc_ids[near] == d if len(doc_ids) else np.zeros(len(d), dtype=bool)
        yield b.filter(pa.array(met | own.is_null().to_numpy(zero_copy_only=False)))


def _sets(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = [s for s in shingle_sets(_texts(b), k) if len(s)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([set_digest(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "elements"]
        )


def _verify(num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
        ok = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = overlap(p, q)
            ok.append(den * both >= num * (len(p) + len(q) - both))
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def verify_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sets reach num/den. ``sets``: (id, elements), one row per id."""
    size = F.octet_length("elements")
    x = sets.select(F.col("id").alias("a"), F.col("elements").alias("x"), size.alias("nx"))
    y = sets.select(F.col("id").alias("b"), F.col("elements").alias("y"), size.alias("ny"))
    met = pairs.join(x, "a").join(y, "b").where((F.col("nx") * den >= F.col("ny") * num) & (F.col("ny") * den >= F.col("nx") * num))
    return met.select("a", "b", "x", "y").mapInArrow(lambda it: _verify(num, den, it), "a long, b long")


def _components(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text): its rows (doc_id, key, n_shingles, d1), d1 being null without words, and the classes
    (d1, root, component_id), root being the same for all classes that are reachable by links."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    keyed = docs.withColumn("key", text_key(F.col("text")))
    rows = materialize(fill_partitions(keyed).mapInArrow(lambda it: _digests(k, it), "doc_id long, key long, n_shingles long, d1 long, counts binary"), "ngram-digests")
    classes = rows.where("d1 IS NOT NULL").groupBy("d1").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("counts").alias("counts"))
    classes = materialize(classes, "ngram-classes")
    elements = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = min(PARTS, 1 + elements // PART_ELEMENTS)

    def signed(some: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
        return fill_partitions(some).mapInArrow(lambda it: sign_batches(PartEnum(num, den), k, it, part, parts), "sig long, id long")

    def texts_of(ids: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """Texts that hold those of the classes, the classes (doc_id, id) and their number."""
        reps = materialize(classes.join(ids, classes["d1"] == ids["id"]).select(F.col("rep").alias("doc_id"), "id"), "ngram-needed")
        n = reps.agg(F.count("doc_id").alias("known"), F.count(F.lit(1)).alias("all")).first()
        texts = checked_semi(docs, reps.where("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", n.known)
        if n.known < n.all:  # classes of rows without a doc_id
            texts = texts.unionByName(docs.where("doc_id IS NULL"))
        return texts, reps, n.all

    def sets_of(ids: DataFrame) -> DataFrame:
        texts, reps, n = texts_of(ids)
        sets = texts.mapInArrow(lambda it: _sets(k, it), "id long, elements binary")
        sets = materialize(checked_semi(sets, reps.select("id"), "id", n), "ngram-sets")
        # only a doc_id that repeats gives a set twice; the ids are looked at before whole sets are shuffled
        twice = sets.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        discard(reps)
        if twice.isEmpty():
            return sets
        one = materialize(sets.dropDuplicates(["id"]), "ngram-sets")
        discard(sets)
        return one

    def holders(ids: DataFrame) -> np.ndarray | None:
        """The sorted doc_ids of texts that hold the sets of the classes; none if they are too many."""
        reps = classes.join(ids, classes["d1"] == ids["id"], "left_semi").where("rep IS NOT NULL").select("rep")
        got = np.unique(reps.limit(MOST_IDS + 1).toArrow().column(0).to_numpy())
        return got if len(got) <= MOST_IDS else None

    def bound_to(ids: DataFrame, crowded: np.ndarray) -> DataFrame:
        some = holders(ids)
        return fill_partitions(docs).mapInArrow(lambda it: _bound(PartEnum(num, den), k, crowded, _among(some, it)), "id long")

    def sets_again(ids: DataFrame) -> Sets:
        some = holders(ids)
        return Sets(fill_partitions(docs), ("doc_id", "text"), lambda it: _sets(k, _among(some, it)))

    def verify(every: DataFrame) -> DataFrame:
        ids = materialize(every.select(F.explode(F.array("a", "b")).alias("d1")).distinct(), "ngram-candidate-ids")
        some = checked_semi(classes, ids, "d1", ids.count())
        x = some.select(F.col("d1").alias("a"), F.col("n").alias("nx"), F.col("counts").alias("cx"))
        y = some.select(F.col("d1").alias("b"), F.col("n").alias("ny"), F.col("counts").alias("cy"))
        near = (F.col("nx") * den >= F.col("ny") * num) & (F.col("ny") * den >= F.col("nx") * num)
        met = every.join(x, "a").join(y, "b").where(near)
        pairs = materialize(met.mapInArrow(lambda it: _may_link(num, den, it), "a long, b long"), "ngram-pairs")
        discard(ids)
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        links = materialize(verify_pairs(pairs, sets, num, den), "links")
        discard(pairs, sets)
        return links

    sample = signed(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0))
    links = link_buckets([signed(docs, p, parts) for p in range(parts)], sample, verify, sets_of, num, den, bound_to, sets_again)
    comp = components(links)
    named = classes.join(comp, classes["d1"] == comp["id"], "left").withColumn("root", F.coalesce("component", "d1"))
    names = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialize(named.select("d1", "root").join(names, "root").select("d1", "root", "component_id"), "ngram-components")
    discard(classes)
    return rows, named


def jaccard_classes(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text; other columns are ignored).

    Null or empty texts have no shingles and link with nothing (their component is their own id). Rows with a null doc_id
    link like others, but are never a component's name; a component of such rows alone has none. Repeated rows repeat;
    rows of one doc_id with several texts are judged each. Long texts are used whole. An empty table gives an empty result.
    """
    rows, classes = _components(docs, k, num, den)
    out = rows.where("d1 IS NOT NULL").join(classes, "d1", "left").select("doc_id", "n_shingles", "component_id")
    return out.unionAll(rows.where("d1 IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_per_class(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``docs`` without those that are near-copies of another: of each component one row stays, the one with the smallest
    doc_id (those without come last; of several texts of a doc_id the one with the smallest hash). Rows without words stay.
    Rows are told apart by doc_id and text, whatever the other columns hold."""
    rows, classes = _components(docs, k, num, den)
    full = rows.where("d1 IS NOT NULL").join(classes, "d1").select("root", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key").alias("row"))
    many = full.groupBy("root", "row").agg(F.count(F.lit(1)).alias("k"))
    first = many.groupBy("root").agg(F.min("row").alias("first"), F.sum("k").alias("n")).where("n > 1")
    some = materialize(many.join(first, "root").select("row.doc_id", "row.key", (F.col("row") == F.col("first")).alias("stays"), "k"), "ngram-drop")
    discard(rows, classes)
    again = some.where("stays AND k > 1")
    kept = without(docs, some.where("NOT stays OR k > 1"))
    if again.isEmpty():
        return kept
    held = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = without(docs, again, "left_semi").select(docs["doc_id"], docs["text"], F.struct(F.lit(0), *[docs[c] for c in held]).alias("__held"))
    one = one.groupBy("doc_id", "text").agg(F.first("__held").alias("__held"))
    return kept.unionByName(one.select(*[F.col(c) if c in ("doc_id", "text") else F.col("__held")[c].alias(c) for c in docs.columns]))
