"""Evaluation texts leaking into training text.

Equal passages: a SimHash of every window of ``WINDOW`` words (the size of the
passage an item is recognised by), over its five-word shingles, each weighted by
how few items hold it.  The items' window fingerprints are cut into
``RADIUS + 1`` blocks: two fingerprints within ``RADIUS`` bits agree in at least
one block, so looking every block up finds all of them.  Candidates are verified
by exact weighted-shingle similarity, and those of equal words by the words.

Near leaks: no radius holds all windows of similarity ``SIMILAR``, so these are
not looked up by fingerprint.  Two windows that similar share shingles; the
shared ones bound the similarity from above, and every pair of windows whose
bound reaches ``SIMILAR`` is verified.  Compared are windows of ``WINDOW`` words
with each other and windows of an item's size with the whole item.

The items are the stated query set: they are searched in blocks of at most
``BLOCK_WINDOWS`` windows (about 200 bytes each) and one item, however many items
there are.  Shingle weights are counted over all items by an aggregation; the
driver and the executors hold one block at a time, with the weights of its own
shingles.  The corpus is read once per block and never shuffled; only found pairs
are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.prefix import running_sums
from tracewell.session import written

WINDOW = 12
SHINGLE = 5
RADIUS = 3
SIMILAR = 0.8
BLOCK_WINDOWS = 500_000
#: Words of a very long text that are taken at once; windows overlap the seams.
SLICE = 65_536
#: Shared shingles, and window pairs, that are compared at once.
SHARED = 8_192

WORD = re.compile(r"[^\W_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BITS = np.arange(64, dtype=np.uint64)


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits in lower case."""
    return WORD.findall(text.lower()) if text else []


class Codes(dict):
    """Word -> 64-bit code, made when first asked for."""

    def __missing__(self, word: str) -> int:
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


def word_codes(words: list[str], cache: Codes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_codes(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        h = h * _MUL + codes[k : k + n]
    return _mix(h)


def window_hashes(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SimHash of each window: sign of the weighted sum of its shingles' bits."""
    per = WINDOW - SHINGLE + 1
    n = len(shingles) - per + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    signed = bits.astype(np.int32)
    signed *= 2
    signed -= 1
    signed *= weights.astype(np.int32)[:, None]
    total = np.zeros((len(shingles) + 1, 64), dtype=np.int32)
    np.cumsum(signed, axis=0, out=total[1:])
    packed = np.packbits((total[per:] - total[:-per]) > 0, axis=1, bitorder="little")
    return packed.reshape(n, 8).copy().view(np.uint64).reshape(n)


class ItemIndex:
    """Fingerprints of some items' windows, by block."""

    def __init__(self, items: list[tuple[int, str]], weights: dict[int, int], top: int):
        cache = Codes()
        self.ids: list[int] = []
        self.words: list[list[str]] = []
        self.known = np.array(sorted(weights), dtype=np.uint64)
        self.weight = np.array([weights[int(k)] for k in self.known], dtype=np.int32)
        self.top = top
        hashes, owner, start, shing = [], [], [], []
        self.sets: list[np.ndarray] = []
        codes, holder, at = [], [], []
        for n, (item, text) in enumerate(items):
            words = words_of(text)
            self.ids.append(item)
            self.words.append(words)
            s = shingle_codes(word_codes(words, cache))
            h = window_hashes(s, self.weigh(s))
            self.sets.append(np.unique(s))
            if len(h):
                codes.append(s)
                holder.append(np.full(len(s), n))
                at.append(np.arange(len(s)))
            hashes.append(h)
            owner.append(np.full(len(h), n))
            start.append(np.arange(len(h)))
            if len(h):
                shing.append(np.lib.stride_tricks.sliding_window_view(s, WINDOW - SHINGLE + 1))
        self.hash = np.concatenate([np.empty(0, np.uint64), *hashes])
        self.owner = np.concatenate([np.empty(0, np.int64), *owner]).astype(np.int64)
        self.start = np.concatenate([np.empty(0, np.int64), *start]).astype(np.int64)
        self.shingles = np.concatenate(shing) if shing else np.empty((0, WINDOW - SHINGLE + 1), np.uint64)
        # where each shingle stands in the items, by shingle
        codes = np.concatenate([np.empty(0, np.uint64), *codes])
        order = np.argsort(codes, kind="stable")
        self.codes = codes[order]
        self.holder = np.concatenate([np.empty(0, np.int64), *holder]).astype(np.int64)[order]
        self.at = np.concatenate([np.empty(0, np.int64), *at]).astype(np.int64)[order]
        sizes = np.array([len(h) for h in hashes], dtype=np.int64)
        self.windows, self.first_window = sizes, np.cumsum(sizes) - sizes
        self.total = np.array([int(self.weigh(x).sum()) for x in self.sets], dtype=np.int64)
        self.width = 64 // (RADIUS + 1)
        self.order, self.first = [], []
        for b in range(RADIUS + 1):
            v = self.block(self.hash, b)
            order = np.argsort(v, kind="stable")
            self.order.append(order)
            self.first.append(np.searchsorted(v[order], np.arange((1 << self.width) + 1)))

    def block(self, h: np.ndarray, b: int) -> np.ndarray:
        return ((h >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def weigh(self, shingles: np.ndarray) -> np.ndarray:
        """Rare among the items weighs most; what no item holds weighs as the rarest."""
        if not len(self.known):
            return np.full(len(shingles), self.top, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[at] == shingles, self.weight[at], self.top).astype(np.int32)

    def knows(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles some item holds."""
        if not len(self.known):
            return np.zeros(len(shingles), dtype=bool)
        return self.known[np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)] == shingles

    def near(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (position in h, window of the index) within RADIUS bits."""
        left, right = [], []
        for b in range(RADIUS + 1):
            v = self.block(h, b)
            lo, n = self.first[b][v], self.first[b][v + 1] - self.first[b][v]
            rep = np.repeat(np.arange(len(h)), n)
            if not len(rep):
                continue
            off = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
            win = self.order[b][np.repeat(lo, n) + off]
            ok = np.bitwise_count(h[rep] ^ self.hash[win]) <= RADIUS
            left.append(rep[ok])
            right.append(win[ok])
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.concatenate(left) * len(self.hash) + np.concatenate(right))
        return pairs // len(self.hash), pairs % len(self.hash)

    def similarity(self, mine: np.ndarray, win: np.ndarray) -> np.ndarray:
        """Weighted Jaccard of the shingle sets of window pairs."""
        theirs = self.shingles[win]
        same = mine[:, :, None] == theirs[:, None, :]
        wm, wt = self.weigh(mine.ravel()).reshape(mine.shape), self.weigh(theirs.ravel()).reshape(theirs.shape)
        a, b = (wm * same.any(2)).sum(1), (wt * same.any(1)).sum(1)
        both = np.minimum(a, b)
        return both / np.maximum(wm.sum(1) + wt.sum(1) - both, 1)

    def shared(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (position in s, entry of ``codes``) of equal shingles."""
        lo = np.searchsorted(self.codes, s, "left")
        n = np.searchsorted(self.codes, s, "right") - lo
        rep = np.repeat(np.arange(len(s)), n)
        return rep, np.repeat(lo, n) + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)

    def passages(self, s: np.ndarray, pos: np.ndarray, post: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start in s, window of the index, similarity) of all window pairs at least SIMILAR."""
        per = WINDOW - SHINGLE + 1
        weights = self.weigh(s).astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(weights)])
        own = sums[per:] - sums[:-per]
        view = np.lib.stride_tricks.sliding_window_view(s, per)
        step = np.arange(per)
        start = 0
        while start < len(own) and (lo := int(np.searchsorted(pos, start))) < len(pos):
            # the next window starts, as many as SHARED shared shingles allow, but at least one
            start = max(start, int(pos[lo]) - per + 1)
            end = max(start + 1, int(pos[lo + SHARED]) - per + 1) if lo + SHARED < len(pos) else len(own)
            hi = int(np.searchsorted(pos, end + per - 1))
            p, e = pos[lo:hi], post[lo:hi]
            a = p[:, None, None] - step[None, :, None]
            b = self.at[e][:, None, None] - step[None, None, :]
            ok = (a >= start) & (a < min(end, len(own))) & (b >= 0) & (b < self.windows[self.holder[e]][:, None, None])
            key = (a * len(self.hash) + b + self.first_window[self.holder[e]][:, None, None])[ok]
            pairs, back = np.unique(key, return_inverse=True)
            bound = np.bincount(back, weights=np.broadcast_to(weights[p][:, None, None], ok.shape)[ok], minlength=len(pairs))
            x, w = pairs // len(self.hash), pairs % len(self.hash)
            may = bound >= SIMILAR * own[x] - 1e-6
            x, w = x[may], w[may]
            for i in range(0, len(x), SHARED):
                sim = self.similarity(view[x[i : i + SHARED]], w[i : i + SHARED])
                good = sim >= SIMILAR
                yield x[i : i + SHARED][good], w[i : i + SHARED][good], sim[good]
            start = end

    def whole(self, s: np.ndarray, pos: np.ndarray, n: int) -> np.ndarray:
        """Similarities at least SIMILAR of item n and the windows of its size, given the shared positions; a shorter text is one window."""
        size = min(int(self.windows[n]) + WINDOW - SHINGLE, len(s))
        sums = np.concatenate([[0], np.cumsum(self.weigh(s[pos]).astype(np.int64))])
        a = np.arange(max(0, int(pos[0]) - size + 1), min(len(s) - size, int(pos[-1])) + 1)
        bound = sums[np.searchsorted(pos, a + size)] - sums[np.searchsorted(pos, a)]
        a = a[bound >= SIMILAR * self.total[n] - 1e-6]
        view = np.lib.stride_tricks.sliding_window_view(s, size)
        out = [np.empty(0)]
        rows = max(1, (1 << 18) // size)
        for i in range(0, len(a), rows):
            mine = np.sort(view[a[i : i + rows]], axis=1)
            w = self.weigh(mine.ravel()).reshape(mine.shape).astype(np.int64)
            w[:, 1:][mine[:, 1:] == mine[:, :-1]] = 0
            both = (w * np.isin(mine, self.sets[n])).sum(1)
            sim = both / (w.sum(1) + self.total[n] - both)
            out.append(sim[sim >= SIMILAR])
        return np.concatenate(out)

    def search_near(self, text: str | None, cache: Codes) -> dict[int, tuple[bool, float, int]]:
        """As ``search``, with all window pairs at least SIMILAR."""
        found: dict[int, tuple[bool, float, int]] = {}
        words = words_of(text)
        s = shingle_codes(word_codes(words, cache))
        pos, post = self.shared(s)
        if len(s) < WINDOW - SHINGLE + 1 or not len(pos):
            return found
        for start, win, sim in self.passages(s, pos, post):
            for p, w, x in zip(start.tolist(), win.tolist(), sim.tolist()):
                n, i = int(self.owner[w]), int(self.start[w])
                exact = words[p : p + WINDOW] == self.words[n][i : i + WINDOW]
                old = found.get(self.ids[n], (False, 0.0, 0))
                found[self.ids[n]] = (old[0] or exact, max(old[1], x), old[2] + 1)
        holder = self.holder[post]
        most = np.bincount(holder, weights=self.weigh(s[pos]), minlength=len(self.ids))
        for n in np.flatnonzero((most > 0) & (most >= SIMILAR * self.total - 1e-6) & (self.windows > 1)).tolist():
            sim = self.whole(s, np.unique(pos[holder == n]), n)
            if len(sim):
                old = found.get(self.ids[n], (False, 0.0, 0))
                found[self.ids[n]] = (old[0], max(old[1], float(sim.max())), old[2] + len(sim))
        return found

    def search(self, text: str | None, cache: Codes) -> dict[int, tuple[bool, float, int]]:
        """item -> (twelve equal words?, best similarity, windows) of one text."""
        found: dict[int, tuple[bool, float, int]] = {}
        words = words_of(text)
        for at in range(0, max(1, len(words) - WINDOW + 1), SLICE):
            part = words[at : at + SLICE + WINDOW - 1]
            s = shingle_codes(word_codes(part, cache))
            # a window that shares no shingle with any item is similar to none: it needs no fingerprint
            known = np.flatnonzero(self.knows(s))
            if not len(known):
                continue
            per = WINDOW - SHINGLE + 1
            lo, hi = max(0, int(known[0]) - per + 1), min(len(s), int(known[-1]) + per)
            s = s[lo:hi]
            h = window_hashes(s, self.weigh(s))
            if not len(h):
                continue
            reach = np.searchsorted(known, np.arange(lo, lo + len(h)))
            may = np.flatnonzero((reach < len(known)) & (known[np.minimum(reach, len(known) - 1)] < np.arange(lo, lo + len(h)) + per))
            pos, win = self.near(h[may])
            if not len(pos):
                continue
            pos = may[pos]
            mine = np.lib.stride_tricks.sliding_window_view(s, per)[pos]
            pos = pos + lo
            sim = self.similarity(mine, win)
            for p, w, x in zip(pos[sim >= SIMILAR].tolist(), win[sim >= SIMILAR].tolist(), sim[sim >= SIMILAR].tolist()):
                n, i = int(self.owner[w]), int(self.start[w])
                exact = part[p : p + WINDOW] == self.words[n][i : i + WINDOW]
                old = found.get(self.ids[n], (False, 0.0, 0))
                found[self.ids[n]] = (old[0] or exact, max(old[1], x), old[2] + 1)
        return found


def weight(items: int, holders: int) -> int:
    """Integer weight of a shingle: 1 + log2(items / items that hold it), times eight."""
    return int(round(8 * (1 + np.log2(items / holders))))


def shingle_weights(items: list[tuple[int, str]]) -> tuple[dict[int, int], int]:
    """The weight of each shingle of some items, and of one that a single item holds."""
    df: Counter[int] = Counter()
    cache = Codes()
    for _, text in items:
        df.update(set(shingle_codes(word_codes(words_of(text), cache)).tolist()))
    n = max(1, len(items))
    return {s: weight(n, d) for s, d in df.items()}, weight(n, 1)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text, size): each item's windows, one at least."""
    for batch in batches:
        size = [max(0, len(words_of(t)) - WINDOW + 1) + 1 for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64())], names=["item_id", "text", "size"])


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, shingle): each distinct shingle of each item, as a signed number."""
    cache = Codes()
    for batch in batches:
        for block, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = np.unique(shingle_codes(word_codes(words_of(text.as_py()), cache))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), block)), pa.array(s)], names=["block", "shingle"])
        if len(cache) > 500_000:
            cache.clear()


def item_blocks(items: DataFrame, block_windows: int = BLOCK_WINDOWS) -> Iterator[ItemIndex]:
    """The indexes of all items, block by block."""
    given = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    sized = running_sums(given.mapInArrow(_sizes, "item_id long, text string, size long"), [], [F.col("item_id"), F.xxhash64("text")], {"upto": F.col("size")})
    placed = written(sized.select("item_id", "text", F.floor((F.col("upto") - F.col("size")) / block_windows).alias("block")), "items")
    n, last = placed.agg(F.count(F.lit(1)), F.max("block")).first()
    if not n:
        return
    each = written(placed.select("block", "text").mapInArrow(_item_shingles, "block long, shingle long"), "shingles")
    held = written(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "weights")
    for block in range(last + 1):
        rows = [tuple(r) for r in placed.where(F.col("block") == block).select("item_id", "text").collect()]
        own = held.join(each.where(F.col("block") == block), "shingle", "left_semi").toArrow()
        shingles = own["shingle"].to_numpy().view(np.uint64).tolist()
        yield ItemIndex(rows, {s: weight(n, d) for s, d in zip(shingles, own["n"].to_pylist())}, weight(n, 1))


def _finder(shared, near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        search = index.search_near if near else index.search
        cache = Codes()
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += [(key, item, *v) for item, v in search(text.as_py(), cache).items()]
                if len(cache) > 500_000:
                    cache.clear()
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.int64()))], names=["doc_id", "item_id", "exact", "similarity", "windows"])

    return run


def leaks(docs: DataFrame, items: DataFrame, block_windows: int = BLOCK_WINDOWS, near: bool = True) -> DataFrame:
    """(doc_id, item_id, exact, similarity, windows): documents holding a passage of an item.

    ``exact``: at least ``WINDOW`` consecutive words are equal; else the best
    weighted-shingle similarity of a window of ``WINDOW`` words and one of the
    item, or of a window of the item's size and the item, is at least
    ``SIMILAR``.  Without ``near`` only the exact ones are sure to be found, by
    fingerprints.  ``windows`` counts the window pairs at least that similar.  Null and
    empty texts, and texts of fewer words than a window, hold and leak nothing.
    Repeated rows of a doc_id count as one document.
    """
    corpus = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= 2 * WINDOW - 1)
    schema = "doc_id long, item_id long, exact boolean, similarity double, windows long"
    out = docs.sparkSession.createDataFrame([], schema)
    for n, index in enumerate(item_blocks(items, block_windows)):
        got = corpus.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(index), near), schema)
        out = got if n == 0 else out.unionByName(got)
    return out.groupBy("doc_id", "item_id").agg(F.max("exact").alias("exact"), F.max("similarity").alias("similarity"), F.sum("windows").alias("windows"))
