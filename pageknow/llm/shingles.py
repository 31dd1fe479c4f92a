"""Word shingles of whole texts as sorted 64-bit hashes, and PartEnum signatures over them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

_A = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(32)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _S30)) * _M1
        h = (h ^ (h >> _S27)) * _M2
        return h ^ (h >> _S31)


#: Bytes whose words are hashed at once.
SPAN = 1 << 18
#: Longer words, in bytes, are hashed one by one.
LONG_WORD = 64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base for each place of a span, and what they are multiplied by to get 1."""
    base = 0x2545F4914F6CDD1D | 3
    up, down = (np.full(SPAN, x, dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def text_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text, runs of other than ASCII white space, and the places of their first bytes."""
    data = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(np.diff(_SPACE[data], prepend=True, append=True))
    start, stop = at[::2], at[1::2]
    h, k = np.zeros(len(start), dtype=np.uint64), 0
    up, down = _powers()
    with np.errstate(over="ignore"):
        while k < len(start):
            a = start[k]
            end = max(k + 1, int(np.searchsorted(stop, a + SPAN, side="right")))
            if (b := stop[end - 1]) - a <= SPAN:
                acc = np.zeros(b - a + 1, dtype=np.uint64)
                np.cumsum(_BYTE[data[a:b]] * up[: b - a], out=acc[1:])
                h[k:end] = (acc[stop[k:end] - a] - acc[start[k:end] - a]) * down[start[k:end] - a]
            k = end
        h = mixed(h + (stop - start).astype(np.uint64) * _A)
    for k in np.flatnonzero(stop - start > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(text[start[k] : stop[k]])
    return h, start


def batch_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Word hashes of texts side by side, the places of their first bytes, of each text the number of its first word (and of all
    words, at the end), and the joined texts, between which stands a line end."""
    joined = b"\n".join(texts)
    words, start = text_words(joined)
    edge = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return words, start, np.searchsorted(start, edge), joined


def shingle_set(text: bytes | None, k: int, lower: bool = True) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words: the whole sequence as one; no words: empty.

    Words are runs of other than ASCII white space; A-Z are lower-cased."""
    text = text or b""
    return shingles_of(text_words(text.lower() if lower else text)[0], k)


def shingles_of(w: np.ndarray, k: int) -> np.ndarray:
    n = len(w)
    if not n:
        return w
    with np.errstate(over="ignore"):
        m = min(n, k)
        h = np.full(n - m + 1, m, dtype=np.uint64)
        for i in range(m):
            h = mixed(h * _A + w[i : n - m + 1 + i])
    return np.unique(h)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """``shingle_set`` of many texts at once."""
    w, _, edge, _ = batch_words([(t or b"").lower() for t in texts])
    g = np.zeros(0, dtype=np.uint64)
    if len(w) >= k:
        with np.errstate(over="ignore"):
            g = np.full(len(w) - k + 1, k, dtype=np.uint64)
            for i in range(k):
                g = mixed(g * _A + w[i : len(w) - k + 1 + i])
    out = []
    for at, end in zip(edge.tolist(), edge[1:].tolist(), strict=False):
        n = end - at
        s = np.sort(g[at : at + n - k + 1]) if n >= k else shingles_of(w[at : at + n], k)
        if n > k:
            new = np.empty(len(s), dtype=bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            s = s[new]
        out.append(s)
    return out


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


class PartEnum:
    """Signatures such that two sets of Jaccard similarity >= num/den share at least one (both non-empty).

    Sizes fall into bands. Two sets of sizes up to r differ in at most ``k = 2 (den-num) r / (den+num)`` elements. The
    domain of hashes is cut into ``first`` partitions of three parts each; with ``2 * (first - slack) > k`` at least
    ``slack + 1`` of the partitions hold at most one difference, hence agree in two of their three parts: one signature
    per partition and dropped part. Partitions in which a set has almost nothing give signatures that say little; a set
    may leave out up to ``slack / 2`` of them, and if it has more it leaves out none. What is left of this allowance it may
    spend on partitions that turn out to be shared by many (``bound_to``). A set signs for its own band and for those of
    larger partners.
    """

    GROWTH = 1.3

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    @lru_cache(maxsize=100_000)  # noqa: B019  one object per job
    def band(self, size: int) -> tuple[int, int]:
        """(number of the band, its largest size)."""
        r, i = 1, 0
        while size > r:
            r, i = max(r + 1, int(r * self.GROWTH)), i + 1
        return i, r

    def plan(self, r: int) -> tuple[int, int]:
        """(first-level partitions, slack) for sets of at most r elements."""
        k = 2 * (self.den - self.num) * r // (self.den + self.num)
        base = k // 2 + 1
        slack = 2 * (base // 16)
        return base + slack, slack

    @lru_cache(maxsize=100_000)  # noqa: B019
    def bands_of(self, size: int) -> list[tuple[int, int]]:
        out, (i, r) = [], self.band(size)
        while True:
            out.append((i, r))
            if (r + 1) * self.num > size * self.den:  # no partner is larger than this band
                return out
            i, r = self.band(r + 1)

    def signatures(self, s: np.ndarray) -> np.ndarray:
        return self.sign([s])[0]

    def sign(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(signatures, places of their sets in the list)."""
        got, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for (i, r), at in self._by_band(sets).items():
            sigs, use = self._partitions([sets[n] for n in at], i, r)
            got.append(sigs[use].ravel())
            places.append(np.repeat(np.array(at), 3 * use.sum(1)))
        return np.concatenate(got), np.concatenate(places)

    def bound_to(self, sets: list[np.ndarray], crowded: np.ndarray, bits: np.uint64) -> np.ndarray:
        """Whether each set needs one of the ``crowded`` signatures (sorted, cut to ``bits``). A set does not if in each of its bands
        the partitions with a crowded signature and those it left out are no more than ``slack / 2``: with any similar set it
        then agrees in another partition, of whose signatures none is crowded."""
        out = np.zeros(len(sets), dtype=bool)
        for (i, r), at in self._by_band(sets).items():
            sigs, use = self._partitions([sets[n] for n in at], i, r)
            sigs &= bits
            place = np.minimum(np.searchsorted(crowded, sigs), max(0, len(crowded) - 1))
            hit = (crowded[place] == sigs).any(2) & use if len(crowded) else np.zeros(use.shape, dtype=bool)
            out[at] |= hit.any(1) & ((hit | ~use).sum(1) > self.plan(r)[1] // 2)
        return out

    def _by_band(self, sets: list[np.ndarray]) -> dict[tuple[int, int], list[int]]:
        by: dict[tuple[int, int], list[int]] = {}
        for n, s in enumerate(sets):
            for band in self.bands_of(len(s)) if len(s) else ():
                by.setdefault(band, []).append(n)
        return by

    def _partitions(self, sets: list[np.ndarray], band: int, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each set and partition the three signatures, and whether the set uses the partition."""
        first, slack = self.plan(r)
        parts = 3 * first
        s = np.concatenate(sets)
        with np.errstate(over="ignore"):
            part = ((s >> _S32) * np.uint64(parts)) >> _S32  # rises with the elements of a set
            part += np.repeat(np.arange(len(sets), dtype=np.uint64) * np.uint64(parts), [len(x) for x in sets])
            edge = np.searchsorted(part, np.arange(parts * len(sets) + 1, dtype=np.uint64))
            acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s + _A), dtype=np.uint64)])
            total, count = acc[edge[1:]] - acc[edge[:-1]], np.diff(edge)
            h = mixed(total + count.astype(np.uint64) * _A).reshape(len(sets), first, 3)
            c = count.reshape(len(sets), first, 3)
            weak = (c.sum(2) - c.max(2)) < 2
            spare = (weak.sum(1) <= slack // 2) if slack else np.zeros(len(sets), dtype=bool)
            use = ~(weak & spare[:, None])
            tag = np.uint64(band) * np.uint64(1 << 40) + np.arange(first, dtype=np.uint64) * np.uint64(4)
            out = [mixed(mixed(h[:, :, i] + tag + np.uint64(d)) * _A + h[:, :, j]) for d, (i, j) in enumerate(((1, 2), (0, 2), (0, 1)))]
        return np.stack(out, axis=2), use
