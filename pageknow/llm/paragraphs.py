"""Substring dedup: near-repeated paragraphs by MinHash banding.

The paragraphs of a text are its lines of at least ``window`` words. They are shingled; equal ones are one class. Bands are
tuned so that paragraphs at the threshold collide with the wanted probability; colliding classes are verified by exact
Jaccard similarity, and verified links are joined into components.

A passage may also repeat inside paragraphs that are otherwise unlike, or be wrapped into other lines. Texts are therefore
cut, across line ends, into windows of words that start at winnowed places: of every ``spread`` neighbouring places the one
with the least hash of its two words. A passage of at least ``window + spread + 1`` words is cut at the same places wherever
it stands, so each of its repeats shares a window with it; equal windows are one class, like equal paragraphs.

In each component the units of the document with the first place (smallest doc_id, then position) stay, those of the others are
cut out; so a repeat inside one document alone stays too. With ``within`` overlapping units of a text are one place, and all
places but the first are cut. A window is cut together with all words around it that are the same, word by word, around the first
place of its class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageknow.llm.common import BROADCAST_ROWS, checked_semi, discard, fill_partitions, materialize, slices
from pageknow.llm.graph import components
from pageknow.llm.ngram_join import _rows, verify_pairs
from pageknow.llm.shingles import batch_words, mixed
from pageknow.llm.simjoin import SAMPLE, link_buckets

#: Bytes of text that are worked on at once.
PART_BYTES = 700_000


@dataclass(frozen=True)
class Params:
    window: int = 24  # words of a window; shorter lines are not units of their own
    spread: int = 24  # of so many neighbouring places one starts a window
    long_line: int = 50  # windows are taken in texts of so many words (at least window + spread)
    shingle: int = 5
    num: int = 8  # similarity num / den
    den: int = 10
    recall: float = 0.98  # wanted chance that two units at the threshold collide
    rows: int = 2  # hashes in a band
    within: bool = False  # whether repeats inside one document are cut as well

    @property
    def bands(self) -> int:
        return tune_bands(self.num / self.den, self.recall, self.rows)


def tune_bands(threshold: float, recall: float, rows: int) -> int:
    """Fewest bands of ``rows`` hashes with 1 - (1 - threshold^rows)^bands >= recall."""
    b = 1
    while 1 - (1 - threshold**rows) ** b < recall:
        b += 1
    return b


@dataclass
class Layout:
    """Texts side by side: word hashes, of each paragraph its words, text and the text's first word, of each long text its words and number."""

    words: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    text: np.ndarray
    base: np.ndarray
    long_start: np.ndarray
    long_stop: np.ndarray
    long_text: np.ndarray


def layouts(texts: list[bytes | None], p: Params) -> Iterator[Layout]:
    """The batch in parts of bounded size (a text is never split)."""
    def part(some: list[bytes], k: int) -> Layout:
        words, start, text, joined = batch_words(some)
        ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
        line = np.searchsorted(start, np.concatenate([[0], ends, [len(joined)]]))
        first, stop = (x[np.diff(line) >= p.window] for x in (line[:-1], line[1:]))
        of = np.searchsorted(text, first, side="right") - 1
        long = np.flatnonzero(np.diff(text) >= p.long_line)
        return Layout(words, first, stop, of + k, text[of], text[long], text[long + 1], long + k)

    some: list[bytes] = []
    size = 0
    for k, text in enumerate(texts, 1):
        some.append((text or b"").lower())
        size += len(some[-1])
        if size >= PART_BYTES or k == len(texts):
            at = part(some, k - len(some))
            if len(at.start) or len(at.long_start):
                yield at
            some, size = [], 0


def window_starts(at: Layout, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(first words, places among the long texts) of the winnowed windows of the long texts."""
    if not len(at.long_start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = mixed(at.words[:-1] + at.words[1:] * np.uint64(3))
    # of each run of `spread` places that lie inside one text, the place with the least hash
    n = at.long_stop - at.long_start - p.window + 1 - p.spread + 1
    runs = np.repeat(at.long_start - np.cumsum(n) + n, n) + np.arange(n.sum())
    view = np.lib.stride_tricks.sliding_window_view(g, p.spread)
    least, width = g, 1
    while width < p.spread:
        by = min(width, p.spread - width)
        least, width = np.minimum(least[:-by], least[by:]), width + by
    # a run whose first place is not its least has the same one as the next run, unless what enters there is less
    own = least[runs] == g[runs]
    looked = np.ones(len(runs), dtype=bool)
    looked[:-1] = (np.diff(runs) != 1) | (least[runs[1:]] < least[runs[:-1]])
    looked = runs[looked & ~own]
    first = np.unique(np.concatenate([runs[own], view[looked].argmin(axis=1) + looked]))
    return first, np.searchsorted(at.long_start, first, side="right") - 1


def shingle_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places are not used."""
    with np.errstate(over="ignore"):
        h = np.full(len(w), k, dtype=np.uint64)
        for i in range(k):
            h[: len(w) - i] = mixed(h[: len(w) - i] * np.uint64(0x9E3779B97F4A7C15) + w[i:])
    return h


def digests(g: np.ndarray, first: np.ndarray, stop: np.ndarray, k: int) -> np.ndarray:
    """Of each run of words one number for its shingles, whatever their order."""
    with np.errstate(over="ignore"):
        acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(g), dtype=np.uint64)])
        n = (stop - first - k + 1).astype(np.uint64)
        return mixed(acc[stop - k + 1] - acc[first] + n * np.uint64(0x9E3779B97F4A7C15))


def _perms(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def band_signatures(g: np.ndarray, first: np.ndarray, stop: np.ndarray, k: int, bands: int, rows: int) -> np.ndarray:
    """(paragraphs, bands): signatures of the shingles ``g[first : stop - k + 1]`` of each paragraph."""
    a, c = _perms(bands * rows)
    edges = np.stack([first, stop - k + 1], axis=1).ravel()
    with np.errstate(over="ignore"):
        h = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(first), axis=0)
        for n in range(bands * rows):
            low = np.minimum.reduceat(np.append(g * a[n] + c[n], np.uint64(2**64 - 1)), edges)[::2]
            h[:, n // rows] = mixed(h[:, n // rows] * np.uint64(0x9E3779B97F4A7C15) + low)
    return h


def _texts(b: pa.RecordBatch) -> list[bytes | None]:
    return b.column("text").cast(pa.binary()).to_pylist()


def _units(p: Params, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs and windows: (doc_id, copy, start, stop, id, whole, sigs); start and stop count the words of the text. sigs:
    signatures of a paragraph, empty for windows; equal ones of a part sign once."""
    for b in slices(batches):
        doc, copy = b.column("doc_id").to_numpy(), b.column("copy").to_numpy()
        for at in layouts(_texts(b), p):
            g = shingle_hashes(at.words, p.shingle)
            first, of = window_starts(at, p)
            first, stop = np.concatenate([at.start, first]), np.concatenate([at.stop, first + p.window])
            whole = np.arange(len(first)) < len(at.start)
            text, base = np.concatenate([at.text, at.long_text[of]]), np.concatenate([at.base, at.long_start[of]])
            ids = digests(g, first, stop, p.shingle).view(np.int64)
            cols = [pa.array(c) for c in (doc[text], copy[text], (first - base).astype(np.int32), (stop - base).astype(np.int32), ids, whole)]
            one = np.sort(np.unique(ids[whole], return_index=True)[1])
            n = np.zeros(len(first) + 1, dtype=np.int32)
            n[one + 1] = p.bands
            sigs = band_signatures(g, first[one], stop[one], p.shingle, p.bands, p.rows) if len(one) else np.zeros(0, np.uint64)
            cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum(n, dtype=np.int32)), pa.array(sigs.ravel().view(np.int64))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "copy", "start", "stop", "id", "whole", "sigs"])


def _unit_sets(p: Params, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, elements) of the paragraphs whose ids a text is asked for."""
    for b in slices(batches):
        asked = b.column("asked").to_pylist()
        for at in layouts(_texts(b), p):
            g = shingle_hashes(at.words, p.shingle)
            ids = digests(g, at.start, at.stop, p.shingle).view(np.int64)
            take = [i for i, (d, t) in enumerate(zip(ids.tolist(), at.text.tolist(), strict=True)) if d in asked[t]]
            sets = [np.unique(g[at.start[i] : at.stop[i] - p.shingle + 1]).tobytes() for i in take]
            yield pa.RecordBatch.from_arrays([pa.array(ids[take], pa.int64()), pa.array(sets, pa.binary())], ["id", "elements"])


def unit_components(units: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """(id, component) of classes of paragraphs that link with another class."""
    signed = units.where("size(sigs) > 0").select(F.explode("sigs").alias("sig"), "id", "doc_id", "copy")
    owners = materialize(units.where("whole").groupBy("id").agg(F.min("doc_id").alias("doc_id")), "unit-owners")

    def sets_of(ids: DataFrame) -> DataFrame:
        need = materialize(owners.join(ids, "id"), "unit-needed")
        asked = need.groupBy("doc_id").agg(F.collect_list("id").alias("asked"))  # at most one document's paragraphs
        from_docs = docs.join(F.broadcast(asked) if need.count() <= BROADCAST_ROWS else asked, "doc_id").select("text", "asked")
        sets = from_docs.mapInArrow(lambda it: _unit_sets(p, it), "id long, elements binary")
        one = materialize(sets.dropDuplicates(["id"]), "unit-sets")
        discard(need)
        return one

    def verify(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        links = materialize(verify_pairs(pairs, sets, p.num, p.den), "links")
        discard(sets)
        return links

    sample = signed.where(F.pmod(F.xxhash64("doc_id", "copy"), F.lit(SAMPLE)) == 0).select("sig", "id")
    comp = materialize(components(link_buckets(signed.select("sig", "id"), sample, verify, sets_of, p.num, p.den)), "unit-components")
    discard(owners)
    return comp


def same_spans(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Of windows that start at words i of ``x`` and j of ``y``: the longest spans of ``x`` around them whose words are those
    of ``y`` at the same distance. A window that is not the same word by word is a span of its own."""
    out: set[tuple[int, int]] = set()
    apart = j - i
    for d in np.unique(apart).tolist():
        starts = i[apart == d]
        lo, hi = max(0, -d), min(len(x), len(y) - d)
        other = np.concatenate([[lo - 1], lo + np.flatnonzero(x[lo:hi] != y[lo + d : hi + d]), [hi]])
        k = np.searchsorted(other, starts)
        a, b = other[k - 1] + 1, other[k]
        same = b >= starts + window
        out.update(zip(np.where(same, a, starts).tolist(), np.where(same, b, starts + window).tolist(), strict=True))
    return sorted(out)


def _extend(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sides = [batch_words([(t or b"").lower() for t in b.column(c).cast(pa.binary()).to_pylist()]) for c in ("x", "y")]
        (x, _, ex, _), (y, _, ey, _) = sides
        edge = b.column("seeds").offsets.to_numpy()
        i, j = (b.column("seeds").flatten().field(c).to_numpy() for c in ("i", "j"))
        edge = edge - edge[0]
        spans = [same_spans(x[ex[k] : ex[k + 1]], y[ey[k] : ey[k + 1]], i[edge[k] : edge[k + 1]], j[edge[k] : edge[k + 1]], window) for k in range(b.num_rows)]
        at = pa.array(np.repeat(np.arange(len(spans)), [len(s) for s in spans]), pa.int64())
        cols = [b.column(c).take(at) for c in ("doc_id", "copy")] + [pa.array([e[n] for s in spans for e in s], pa.int32()) for n in (0, 1)]
        yield pa.RecordBatch.from_arrays([*cols, b.column("first_doc").take(at)], ["doc_id", "copy", "start", "stop", "kept_doc_id"])


def extended(windows: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """``windows``: (doc_id, copy, start, first), first being another place (doc_id, copy, start) of the same words. The spans
    of words (doc_id, copy, start, stop, kept_doc_id) around them that are the same there."""
    seeds = windows.groupBy("doc_id", "copy", F.col("first.doc_id").alias("first_doc"), F.col("first.copy").alias("first_copy")).agg(
        F.collect_list(F.struct(F.col("start").alias("i"), F.col("first.start").alias("j"))).alias("seeds"),  # at most the windows of a text
    )
    seeds = materialize(seeds, "unit-seeds")
    need = materialize(seeds.select(F.explode(F.array("doc_id", "first_doc")).alias("doc_id")).distinct(), "unit-extended")
    texts = materialize(checked_semi(docs, need, "doc_id", need.count()).dropDuplicates(["doc_id", "copy"]), "unit-texts")
    x = texts.select("doc_id", "copy", F.col("text").alias("x"))
    y = texts.select(F.col("doc_id").alias("first_doc"), F.col("copy").alias("first_copy"), F.col("text").alias("y"))
    met = seeds.join(x, ["doc_id", "copy"]).join(y, ["first_doc", "first_copy"]).select("doc_id", "copy", "first_doc", "seeds", "x", "y")
    spans = materialize(met.mapInArrow(lambda it: _extend(p.window, it), "doc_id long, copy long, start int, stop int, kept_doc_id long"), "unit-spans")
    discard(seeds, need, texts)
    return spans


def removals(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, copy, start, stop, kept_doc_id): the spans to cut out, as words of the text, and a document that holds the
    words at an earlier place. ``docs``: (doc_id, copy, text), doc_id not null."""
    units = materialize(fill_partitions(docs).mapInArrow(lambda it: _units(p, it), "doc_id long, copy long, start int, stop int, id long, whole boolean, sigs array<long>"), "units")
    comp = unit_components(units, docs, p)
    # classes that are alone and have one unit need no further look: only the others are joined
    many = units.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("doc_id", "copy", "start")).alias("first"))
    many = materialize(many.join(comp, "id", "left").where("k > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "id")), "unit-classes")
    top = many.groupBy("component").agg(F.min("first").alias("own"))
    classes = materialize(many.select("id", "component", "first").join(top, "component"), "unit-kept")
    found = units.drop("sigs").join(F.broadcast(classes) if classes.count() <= 200_000 else classes, "id")
    stays = (F.col("doc_id") == F.col("own.doc_id")) & (F.col("copy") == F.col("own.copy"))
    if p.within:
        place = W.partitionBy("component", "doc_id", "copy").orderBy("start", F.col("stop").desc())
        reach = F.max("stop").over(place.rowsBetween(W.unboundedPreceding, -1))
        apart = reach.isNull() | (reach <= F.col("start"))
        found = found.withColumn("apart", apart.cast("int")).withColumn("place", F.sum("apart").over(place.rowsBetween(W.unboundedPreceding, 0)))
        stays = (F.col("place") == 1) & stays
    gone = materialize(found.where(~stays).select("doc_id", "copy", "start", "stop", "whole", "first", F.col("own.doc_id").alias("kept_doc_id")), "unit-gone")
    discard(units, comp, many, classes)
    alone = F.col("whole") | (F.col("first") == F.struct("doc_id", "copy", "start"))
    spans = gone.where(alone).select("doc_id", "copy", "start", "stop", "kept_doc_id")
    return spans.unionAll(extended(gone.where(~alone).select("doc_id", "copy", "start", "first"), docs, p))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words as spans that do not meet, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words (first, end); a line that loses all of its words goes."""
    out, at, k, spans = [], 0, 0, _merged(spans)
    for line in text.split(b"\n"):
        words = line.split()
        end, left, done = at + len(words), [], at
        while k < len(spans) and spans[k][0] < end:
            left += words[done - at : max(done, spans[k][0]) - at]
            done = min(end, spans[k][1])
            if spans[k][1] > end:
                break
            k += 1
        left += words[done - at :]
        at = end
        if len(left) < len(words):
            line = b" ".join(left)
            if not line:
                continue
        out.append(line)
    return b"\n".join(out)


def _apply(keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts, removed = [], []
        for t, spans in zip(b.column("__text").cast(pa.binary()).to_pylist(), b.column("__spans").to_pylist(), strict=True):
            s = [(x["start"], x["stop"]) for x in spans or []]
            new = cut_spans(t, s) if s else t
            texts.append(None if new is None else new.decode())
            removed.append(len(t.split()) - len(new.split()) if s else 0)
        yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(texts, pa.string()), pa.array(removed, pa.int64())], [*keep, "new_text", "removed_words"])


def dedup_paragraphs(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, and n_removed (spans), removed_words, kept_doc_ids (documents that hold
    what was cut here).

    Null texts stay null and empty ones empty. A row without doc_id keeps its text and lends none. Equal rows keep
    or lose alike; rows of one doc_id with different texts count as two documents. Ties go to the smallest doc_id, then place. Long texts are treated
    whole; an empty table gives an empty result; columns with the new names are replaced.
    """
    new = ("n_removed", "removed_words", "kept_doc_ids")
    rest = [c for c in docs.columns if c not in new and c != "text"]
    held = [f"k{i}" for i in range(len(rest))]
    base = docs.select(*[docs[c].alias(h) for c, h in zip(rest, held, strict=True)], docs["text"].cast("string").alias("__text"), docs["doc_id"].cast("long").alias("__id"))
    # rows that repeat a doc_id are told apart by their text; equal rows share their cuts
    base = base.withColumn("__copy", F.xxhash64("__text"))
    plain = base.where("__id IS NOT NULL AND __text IS NOT NULL").select(F.col("__id").alias("doc_id"), F.col("__copy").alias("copy"), F.col("__text").alias("text"))
    cut = removals(plain, p).groupBy("doc_id", "copy").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "kept_doc_id"))).alias("all"))
    # of a span the least of the documents that hold it counts; the others are cut there themselves
    before = lambda i, c: F.get(F.col("all"), i - 1)[c]
    cut = cut.withColumn("all", F.filter("all", lambda x, i: (i == 0) | (before(i, "start") != x["start"]) | (before(i, "stop") != x["stop"])))
    spans = F.transform("all", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    cut = cut.select("doc_id", "copy", spans.alias("__spans"), F.array_sort(F.array_distinct("all.kept_doc_id")).alias("kept_doc_ids"))
    cut = materialize(cut, "unit-cuts")
    n = cut.agg(F.coalesce(F.sum(F.size("__spans") + F.size("kept_doc_ids")), F.lit(0))).first()[0]
    side = F.broadcast(cut) if n <= 200_000 else cut
    met = base.join(side, (base["__id"] == cut["doc_id"]) & (base["__copy"] == cut["copy"]), "left").withColumn("n_removed", F.coalesce(F.size("__spans"), F.lit(0)))
    met = met.select(*held, "__text", "__spans", "n_removed", "kept_doc_ids")
    carry = [*held, "n_removed", "kept_doc_ids"]
    kinds = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in carry) + ", new_text string, removed_words long"
    out = met.mapInArrow(lambda it: _apply(carry, it), kinds)
    named = dict(zip(rest, held, strict=True))
    return out.select(*[F.col("new_text").alias(c) if c == "text" else F.col(named[c]).alias(c) for c in docs.columns if c not in new], "n_removed", "removed_words", "kept_doc_ids")
