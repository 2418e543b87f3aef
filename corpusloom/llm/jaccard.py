"""Operator 9, n-gram Jaccard join: documents whose sets of word shingles are similar, and their components.

Equal sets form a class, found by a grouped minimum; one member stands for it. For the others the search is
T-occurrence search after DivideSkip. Two sets of m and n shingles link if and only if they share at least
A = ceil(0.75 (m + n) / 1.75) of them, so of the inverted lists of a set some long ones may be set aside: in
one order of all shingles by rarity, the first L shared ones lie in both sets before place ``size - A + L``.

1. Every task counts shingles in a sketch of fixed size; the sum, in logarithms, orders all shingles by rarity
   (any fixed order is exact, rarity makes lists short). The short lists of a set are those of its
   ``n - ceil(0.75 n) + 1`` rarest shingles. Only these postings are exchanged, by hash range, 48 bits each.
   A list that the sketch puts above ``TILE`` documents is dealt out in tiles by a hash of the document, so no
   task ever holds more of it.
2. A range merges its postings into lists, built once. In the last round the lists' occurrences of each pair
   are counted, within a range and then over all ranges; a pair stays only if the short lists alone hold L
   shared shingles, L from 1 to ``OCCURRENCES`` by the two sizes. More occurrences leave fewer pairs but ask
   longer lists: on documents with a common passage 3 left 1,833 pairs of 287,110 that met, 1 leaves 2,502 of
   6,997, so 1 it is, and all other required occurrences are set aside. Bitmaps (exact upper bounds of the
   overlap) drop more. For the rest ``divide_skip`` merges the short lists of a local index on a heap that skips,
   probes the long ones by binary search, and decides by the exact overlap.
3. Pairs are proposed in rounds, so that a group of copies is never expanded into all pairs: first each list's
   smallest document with the others; then, in longer lists whose documents are not yet in one component, a
   few members of the largest component with the documents outside it; last, every pair of two components that
   a list still holds, where documents outside a tiled list's main component go to its tiles, and those inside
   stay where they are. A pair inside a component changes no component, so nothing is lost.

Components are the minimum reachable doc_id, by rounds of minimum over neighbours and pointer jumping.

Defined results. Null or empty text, or no words: n_shingles 0, its own component. Fewer words than a shingle:
the whole sequence is the one shingle. Null doc_id: linked with nothing, component null. Rows that repeat a
doc_id are one document: they share a component, and each keeps its n_shingles. Shingles are compared by
64-bit hashes, sets of equal ones by 128. Very long texts count whole. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch
from corpusloom.llm.substring import ranges
from corpusloom.llm.wordhash import Block, blocks, mix, runs, unpack

WORDS, PERCENT = 5, 75
SKETCH_BITS, SEGMENTS = 22, 64
#: Members of a longer list's largest component that meet the documents outside it, in the second round.
LONG, PIVOTS = 16, 8
#: Documents of one list in one task; shared shingles asked of the short lists in the last round; pairs in one batch.
TILE, OCCURRENCES, BATCH = 8192, 1, 1 << 21


def shingle_sets(block: Block, length: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, size per document): each document's distinct shingles, sorted."""
    starts, ends, doc = block.spans()
    hashes = block.hashes(starts, ends, 0, lower=True)
    n_docs = len(block.sizes)
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    count = np.diff(first)
    full = runs(hashes, length, 0)
    inside = doc[: len(full)] == doc[length - 1 :] if len(full) else np.zeros(0, dtype=bool)
    own, key = doc[: len(full)][inside], full[inside]
    for n in range(1, length):  # the whole sequence is the shingle; its length is part of the hash
        short = np.flatnonzero(count == n)
        own = np.concatenate((own, short))
        key = np.concatenate((key, runs(hashes, n, n)[first[short]]))
    order = np.lexsort((key, own))
    own, key = own[order], key[order]
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])))[: len(key)]
    return key[new], np.bincount(own[new], minlength=n_docs)


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values)))
    ends = np.cumsum(size)
    return total[ends] - total[ends - size]


SIGNED = "kind int, block long, place int, doc_id long, n long, f1 long, f2 long, data binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document size and fingerprint of its set (kind 0); at the end the task's counts of shingles (kind 1)."""
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    names, kinds = [x.split()[0] for x in SIGNED.split(", ")], [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        for row in batch.to_pylist():
            block = unpack(row)
            key, size = shingle_sets(block)
            sketch += np.bincount((key >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
            f1, f2 = mix(_sums(mix(key + np.uint64(1)), size)).view(np.int64), mix(_sums(mix(key ^ np.uint64(0x5851F42D4C957F2D)), size)).view(np.int64)
            n = len(size)
            none = np.zeros(n, dtype=np.int64)
            columns = [none, none + row["block"], np.arange(n), pa.array(block.doc_ids, mask=~block.has_id), size, f1, f2, pa.nulls(n)]
            yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(k) for c, k in zip(columns, kinds, strict=True)], names)
    if sketch.any():
        part = sketch.reshape(SEGMENTS, -1)
        data = [pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in part]
        ones, task = np.ones(SEGMENTS, dtype=np.int64), np.int64(row["block"] >> 32)
        columns = [ones, ones * task, np.arange(SEGMENTS), *[pa.nulls(SEGMENTS)] * 4, pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(k) for c, k in zip(columns, kinds, strict=True)], names)


def _add_counts(group: pa.Table) -> pa.Table:
    width = (1 << SKETCH_BITS) // SEGMENTS
    total = np.zeros(width, dtype=np.uint64)
    for data in group.column("data").to_pylist():
        total += np.frombuffer(pa.decompress(data, decompressed_size=4 * width, codec="zstd", asbytes=True), dtype=np.uint32)
    total = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return pa.table([group.column("place").slice(0, 1), group.column("task").slice(0, 1), pa.array([pa.compress(total.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["place", "task", "data"])


def rarity(signed: DataFrame, tasks: int) -> np.ndarray:
    """For every slot of the sketch the logarithm of its count, in eighths: a table of fixed size (4 MB)."""
    parts = signed.filter("kind = 1").select("place", F.col("block").alias("task"), "data")
    while True:  # at most 128 sketches meet in one task
        tasks = -(-tasks // 128)
        parts = parts.withColumn("task", F.floor(F.col("task") / 128)).groupBy("place", "task").applyInArrow(_add_counts, "place int, task long, data binary")
        if tasks <= 1:
            break
    width = (1 << SKETCH_BITS) // SEGMENTS
    out = np.zeros((SEGMENTS, width), dtype=np.uint32)
    for r in parts.collect():
        out[r["place"]] = np.frombuffer(pa.decompress(bytes(r["data"]), decompressed_size=4 * width, codec="zstd", asbytes=True), dtype=np.uint32)
    return np.minimum(255, 8 * np.log2(1.0 + out)).astype(np.uint8).reshape(-1)


POSTED = "part int, doc_id binary, n binary, held binary, place binary, keys binary, tiles binary"


def _post(parts: int, order, tile: int) -> object:
    """The short lists' postings of the documents that stand for a class."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            row = left.to_pylist()[0]
            block = unpack(row)
            key, size = shingle_sets(block)
            wanted = np.zeros(len(size), dtype=bool)
            wanted[np.asarray(right.column("place"))] = True
            doc = np.repeat(np.arange(len(size)), size)
            keep = wanted[doc]
            key, doc = key[keep], doc[keep]
            rare = order.value[(key >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            by = np.lexsort((key, rare, doc))
            key, doc, rare = key[by], doc[by], rare[by]
            first = np.concatenate(([0], np.cumsum(np.where(wanted, size, 0))))[:-1]
            short = size - least_overlap(size) + 1
            place = np.arange(len(key)) - first[doc]
            keep = place < short[doc]
            key, doc, place, rare = key[keep], doc[keep], place[keep], rare[keep]
            tiles = np.maximum(1, np.exp2(rare / 8) // tile).astype(np.int64)
            salt = (mix(block.doc_ids[doc].astype(np.uint64)) % tiles.astype(np.uint64)).astype(np.int64)
            spread = np.where(tiles > 1, mix(key ^ mix(salt.astype(np.uint64))), key)
            part = ((spread & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            part = 2 * part + (tiles > 1)  # an odd one while tiled postings are told from the others
            by = np.lexsort((doc, part))
            key, doc, part, place = key[by] >> np.uint64(8), doc[by], part[by], place[by].astype("<i4")
            dealt = np.stack([salt[by], tiles[by]], axis=1).astype("<i4")
            for a, b in _groups(part):
                held, n = np.unique(doc[a:b], return_counts=True)
                raw = np.ascontiguousarray(key[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                out.append((int(part[a]) >> 1, block.doc_ids[held].tobytes(), size[held].astype("<i8").tobytes(), n.astype("<i4").tobytes(), place[a:b].tobytes(), raw, dealt[a:b].tobytes() if part[a] & 1 else b""))
        names = [x.split()[0] for x in POSTED.split(", ")]
        return pa.table([pa.array([r[i] for r in out], pa.int32() if i == 0 else pa.binary()) for i in range(len(names))], names)

    return run


LISTED = "part int, list long, salt int, tiles int, doc_id long, n long, place int"


def _merge_lists(group: pa.Table) -> pa.Table:
    """Inverted lists, or tiles of them, with documents of comparable size: (list, document, size of its set, place in its order of rarity)."""
    doc, n, place, key, dealt = [], [], [], [], []
    for d, s, h, p, k, t in zip(*(group.column(c).to_pylist() for c in ("doc_id", "n", "held", "place", "keys", "tiles")), strict=True):
        held = np.frombuffer(h, dtype="<i4")
        doc.append(np.repeat(np.frombuffer(d, dtype=np.int64), held))
        n.append(np.repeat(np.frombuffer(s, dtype=np.int64), held))
        place.append(np.frombuffer(p, dtype="<i4"))
        raw = np.zeros((len(k) // 6, 8), dtype=np.uint8)
        raw[:, :6] = np.frombuffer(k, dtype=np.uint8).reshape(-1, 6)
        key.append(raw.reshape(-1).view("<u8"))
        dealt.append(np.frombuffer(t, dtype="<i4").reshape(-1, 2) if t else np.tile(np.array([[0, 1]], dtype="<i4"), (len(key[-1]), 1)))
    doc, n, place, key, dealt = np.concatenate(doc), np.concatenate(n), np.concatenate(place), np.concatenate(key), np.concatenate(dealt)
    by = np.lexsort((n, dealt[:, 0], key))
    doc, n, place, key, salt, tiles = doc[by], n[by], place[by], key[by], dealt[by, 0], dealt[by, 1]
    # in order of size, a document without a neighbour near enough in size has no partner in the list
    near = (key[1:] == key[:-1]) & (n[1:] * PERCENT <= n[:-1] * 100)
    kept = np.concatenate(([False], near)) | np.concatenate((near, [False])) | (tiles > 1)
    part = group.column("part")[0].as_py()
    columns = [np.full(len(key), part, dtype=np.int32), key.view(np.int64), salt, tiles, doc, n, place]
    return pa.table([pa.array(c[kept]) for c in columns], [x.split()[0] for x in LISTED.split(", ")])


def _groups(key: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, dtype=np.int64)
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Fewer shared shingles than this link a set of n to nothing."""
    return -(-n * PERCENT // 100)


def required(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the overlap at which sets of these sizes link, how many shared shingles their short lists must then show)."""
    overlap = -(-(na + nb) * PERCENT // (100 + PERCENT))
    return overlap, np.minimum(OCCURRENCES, overlap + 1 - least_overlap(np.maximum(na, nb)))


class Pairs:
    """Pairs (a, b), a < b, with their sizes and counts; those given twice are added up before they leave.

    A doc_id that repeats has more than one size; each is a pair of its own.
    """

    NAMES = ("a", "b", "n_a", "n_b", "shared")

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.rows = 0

    def add(self, doc: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        turn = doc[a] > doc[b]
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        if len(a):
            self.held.append(np.stack([doc[a], doc[b], n[a], n[b], np.ones(len(a), dtype=np.int64)]))
            self.rows += len(a)

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            every = np.concatenate(self.held, axis=1)
            every = every[:, np.lexsort(every[3::-1])]
            begin = np.flatnonzero(np.concatenate(([True], (every[:4, 1:] != every[:4, :-1]).any(axis=0))))
            shared = np.add.reduceat(every[4], begin)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in every[:4, begin]), pa.array(shared)], list(self.NAMES))
        self.held, self.rows = [], 0


PAIRED = "a long, b long, n_a long, n_b long, shared long"


def _read(batches: Iterator[pa.RecordBatch], *columns: str) -> list[np.ndarray]:
    whole = pa.Table.from_batches(list(batches))
    return [whole.column(c).to_numpy() for c in columns]


def _propose(stage: str):
    """Pairs that the lists, or tiles, of a range put forward in this round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, salt, doc, n, comp, place = _read(batches, "list", "salt", "doc_id", "n", "comp", "place")
        by = np.lexsort((doc, n, salt, key)) if stage == "rest" else np.lexsort((doc, salt, key))
        key, salt, doc, n, comp, place = key[by], salt[by], doc[by], n[by], comp[by], place[by]
        begin = np.concatenate(([True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
        at = np.flatnonzero(begin)
        which = np.cumsum(begin) - 1
        # lists whose documents are all in one component are done
        open_ = (np.minimum.reduceat(comp, at) != np.maximum.reduceat(comp, at))[which]
        key, doc, n, comp, place, which = key[open_], doc[open_], n[open_], comp[open_], place[open_], which[open_]
        found = Pairs()

        def pair(a: np.ndarray, b: np.ndarray) -> None:
            overlap, shared = required(n[a], n[b])
            shared = shared if stage == "rest" else 1  # the first shared shingle alone, where not all lists are asked
            fit = (comp[a] != comp[b]) & (place[a] < n[a] - overlap + shared) & (place[b] < n[b] - overlap + shared)
            fit &= np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * PERCENT
            found.add(doc, n, a[fit], b[fit])

        size = np.bincount(which, minlength=0 if len(which) == 0 else which[-1] + 1)
        if stage == "first":
            start = np.cumsum(size) - size
            pair(start[which], np.arange(len(which)))
        elif stage == "rest":
            # neighbours at every distance, for all lists of middling length at once; sizes ascend within a list
            left, far = np.flatnonzero(size[which] <= 4 * LONG), 0
            while len(left):
                far += 1
                left = left[left + far < len(which)]
                left = left[(which[left + far] == which[left]) & (n[left + far] * PERCENT <= n[left] * 100)]
                pair(left, left + far)
                if found.rows > BATCH:
                    yield from found.take()
        for a, b in _groups(which):
            if stage == "first" or b - a <= (LONG if stage == "pivots" else 4 * LONG):
                continue
            _, own, held = np.unique(comp[a:b], return_inverse=True, return_counts=True)
            inside = own == held.argmax()
            outside = a + np.flatnonzero(~inside)
            if stage == "pivots":
                most = a + np.flatnonzero(inside)
                for p in most[np.argsort(mix(doc[most].astype(np.uint64)))[:PIVOTS]].tolist():
                    pair(np.full(len(outside), p), outside)
            else:
                main = np.concatenate(([0], np.cumsum(inside)))
                for p in outside.tolist():  # with those near in size: all of the main component, and others that come later
                    low, high = np.searchsorted(n[a:b], [least_overlap(n[p]), n[p] * 100 // PERCENT + 1])
                    others = a + np.arange(low, high)[inside[low:high] | (np.arange(a + low, a + high) > p)] if main[high] > main[low] else np.arange(max(a + low, p + 1), a + high)
                    pair(np.full(len(others), p), others)
                    if found.rows > BATCH:
                        yield from found.take()
            if found.rows > BATCH:
                yield from found.take()
        yield from found.take()

    return run


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a tile of one list: the documents that ask, with the tile's own."""
    doc, n, comp, place, asks, main = _read(batches, "doc_id", "n", "comp", "place", "asks", "main")
    by = np.lexsort((doc, n, asks))
    doc, n, comp, place, main = doc[by], n[by], comp[by], place[by], main[by]
    own = int((~asks.astype(bool)).sum())
    found = Pairs()
    for p in range(own, len(doc)):
        low, high = np.searchsorted(n[:own], [least_overlap(n[p]), n[p] * 100 // PERCENT + 1])
        others = np.arange(low, high)
        # two that are both outside the main component ask each other; the smaller id's question counts
        others = others[(comp[others] != comp[p]) & ((comp[others] == main[others]) | (doc[others] > doc[p]))]
        overlap, shared = required(n[p], n[others])
        found.add(doc, n, *(x[(place[p] < n[p] - overlap + shared) & (place[others] < n[others] - overlap + shared)] for x in (np.full(len(others), p), others)))
        if found.rows > BATCH:
            yield from found.take()
    yield from found.take()


def _hot_pairs(hot: DataFrame, tile: int) -> DataFrame:
    """Pairs of two components from tiled lists. Only documents outside a list's main component travel to other tiles."""
    per = hot.groupBy("list", "comp").agg(F.count("*").alias("held"))
    main = per.groupBy("list").agg(F.max(F.struct("held", "comp")).alias("m"), F.sum("held").alias("all"))
    main = main.select("list", F.col("m.comp").alias("main"), F.ceil((F.col("all") - F.col("m.held")) / tile).cast("int").alias("askers")).filter("askers > 0")
    rows = hot.join(main, "list").select("list", "salt", "tiles", "doc_id", "n", "comp", "place", "main", "askers")
    own = rows.withColumns({"asks": F.lit(False), "deal": F.explode(F.sequence(F.lit(0), F.col("askers") - 1))})
    asking = rows.filter("comp <> main").withColumns({"asks": F.lit(True), "salt": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)), "deal": F.pmod(F.xxhash64("doc_id"), F.col("askers")).cast("int")})
    return own.unionByName(asking).groupBy("list", "salt", "deal").applyInArrow(_cross, PAIRED)


def propose(lists: DataFrame, stage: str, tile: int, tiled: bool) -> DataFrame:
    """a, b: the pairs of this round, from all ranges. In the last round the short lists must show enough shared shingles."""
    if stage != "rest":
        pairs = lists.groupBy("part").applyInArrow(_propose(stage), PAIRED)
        if stage == "first" and tiled:  # the smallest documents of a list's tiles meet as a list of their own
            first = lists.filter("tiles > 1").groupBy("list", "salt").agg(F.min(F.struct("doc_id", "n", "comp", "place")).alias("d"))
            tops = first.select("list", F.lit(0).alias("salt"), "d.doc_id", "d.n", "d.comp", "d.place")
            pairs = pairs.union(tops.groupBy("list").applyInArrow(_propose(stage), PAIRED))
        return pairs.select("a", "b").distinct()
    pairs = lists.filter("tiles = 1").groupBy("part").applyInArrow(_propose(stage), PAIRED)
    if tiled:
        pairs = pairs.union(_hot_pairs(lists.filter("tiles > 1"), tile))
    counted = pairs.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    overlap = F.ceil((F.col("n_a") + F.col("n_b")) * PERCENT / F.lit(100 + PERCENT))
    least = F.least(F.lit(OCCURRENCES), overlap + 1 - F.ceil(F.greatest("n_a", "n_b") * PERCENT / F.lit(100)))
    return counted.filter(F.col("shared") >= least).select("a", "b").distinct()


VECTOR = "doc_id long, n long, bits binary, keys binary"


def bitmap(key: np.ndarray) -> np.ndarray:
    """Which of about 4 n slots, a power of 2, the set reaches."""
    bits = max(6, int(4 * len(key) - 1).bit_length())
    out = np.zeros(1 << bits, dtype=bool)
    out[(key >> np.uint64(64 - bits)).astype(np.int64)] = True
    return out


def overlap_bound(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> int:
    """An upper bound of the overlap: each slot that one set reaches and the other doesn't costs a shingle."""
    if len(a) > len(b):
        a = a.reshape(len(b), -1).any(axis=1)
    elif len(b) > len(a):
        b = b.reshape(len(a), -1).any(axis=1)
    return min(na - int((a & ~b).sum()), nb - int((b & ~a).sum()))


def _vectors(left: pa.Table, right: pa.Table) -> pa.Table:
    out = []
    if left.num_rows and right.num_rows:
        block = unpack(left.to_pylist()[0])
        key, size = shingle_sets(block)
        ends = np.cumsum(size)
        for p in np.unique(np.asarray(right.column("place"))).tolist():
            own = key[ends[p] - size[p] : ends[p]]
            out.append((int(block.doc_ids[p]), len(own), np.packbits(bitmap(own)).tobytes(), own.astype("<u8").tobytes()))
    return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), *(pa.array([r[i] for r in out], pa.binary()) for i in (2, 3))], ["doc_id", "n", "bits", "keys"])


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for na, nb, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
            x, y = (np.unpackbits(np.frombuffer(v, dtype=np.uint8)).astype(bool) for v in (x, y))
            bound = overlap_bound(x, y, na, nb)
            keep.append(100 * bound >= PERCENT * (na + nb - bound))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def merge_skip(lists: list[list[int]], need: int) -> dict[int, int]:
    """Members of at least ``need`` of the sorted lists, and of how many; a heap of the lists' heads, which skip what can't reach ``need``."""
    heads = [(x[0], i) for i, x in enumerate(lists) if x]
    heapq.heapify(heads)
    at, found = [0] * len(lists), {}
    while len(heads) >= need:
        top, same = heads[0][0], []
        while heads and heads[0][0] == top:
            same.append(heapq.heappop(heads)[1])
        if len(same) >= need:
            found[top] = len(same)
            for i in same:
                at[i] += 1
        else:  # with need - 1 lists off the heap, nothing below its head is in need lists
            while heads and len(same) < need - 1:
                same.append(heapq.heappop(heads)[1])
            if not heads:
                break
            for i in same:
                at[i] = bisect_left(lists[i], heads[0][0], at[i])
        for i in same:
            if at[i] < len(lists[i]):
                heapq.heappush(heads, (lists[i][at[i]], i))
    return found


def divide_skip(query: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The overlap of ``query`` with each of ``sets``, where it reaches the threshold; 0 elsewhere.

    The inverted lists of the query's shingles are sorted by length. Of the longest, fewer than the required
    occurrences are set aside; the short ones are merged on a heap, and members of enough of them are
    looked for in the long ones by binary search.
    """
    size = np.array([len(s) for s in sets])
    if len(sets) == 1:  # one list entry a shingle: nothing to merge
        count = np.array([np.isin(sets[0], query, assume_unique=True).sum()])
        return np.where(100 * count >= PERCENT * (len(query) + size - count), count, 0)
    owner = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets)
    by = np.lexsort((owner, flat))
    flat, owner = flat[by], owner[by]
    low, high = np.searchsorted(flat, query), np.searchsorted(flat, query, side="right")
    length = high - low
    least = int(least_overlap(len(query)))  # no smaller overlap links, whatever the other size
    order = np.argsort(length, kind="stable").tolist()
    aside = min(least - 1, int(least / (1 + 0.1 * np.log2(1 + length.max()))))
    lists = [owner[low[k] : high[k]].tolist() for k in order]
    short, long = lists[: len(order) - aside], lists[len(order) - aside :]
    out = np.zeros(len(sets), dtype=np.int64)
    for member, count in merge_skip(short, least - aside).items():
        for posting in long:
            i = bisect_left(posting, member)
            count += i < len(posting) and posting[i] == member
        if 100 * count >= PERCENT * (len(query) + size[member] - count):
            out[member] = count
    return out


def _decide(left: pa.Table, right: pa.Table) -> pa.Table:
    a, b = [], []
    if left.num_rows and right.num_rows:
        others = right.column("b").to_pylist()
        sets = [np.frombuffer(k, dtype="<u8") for k in right.column("held").to_pylist()]
        for x, keys in zip(left.column("a").to_pylist(), left.column("keys").to_pylist(), strict=True):
            for y, overlap in zip(others, divide_skip(np.frombuffer(keys, dtype="<u8"), sets).tolist(), strict=True):
                if overlap:
                    a.append(x)
                    b.append(y)
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def verify(pairs: DataFrame, vectors: DataFrame, scratch: Scratch, name: str, group: int = 256) -> DataFrame:
    """Those of the pairs that link. A document with many partners is handled in groups of about ``group``."""
    small = vectors.select("doc_id", "n", "bits")
    of = lambda side, v: v.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
    likely = pairs.join(of("a", small), "a").join(of("b", small), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_may_link, "a long, b long").distinct()
    likely = scratch.save(likely, f"{name}-likely")
    share = likely.groupBy("a").agg(F.ceil(F.count("*") / group).alias("shares"))
    dealt = likely.join(share, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"))
    right = dealt.join(vectors.select(F.col("doc_id").alias("b"), "keys"), "b").select(F.col("a").alias("of"), F.col("share").alias("part"), "b", F.col("keys").alias("held"))
    left = dealt.select("a", "share").distinct().join(vectors.select(F.col("doc_id").alias("a"), "keys"), "a").select("a", "share", "keys")
    return scratch.save(left.groupBy("a", "share").cogroup(right.groupBy("of", "part")).applyInArrow(_decide, "a long, b long").distinct(), f"{name}-links")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """doc_id and comp, the smallest doc_id reachable, for the documents in ``links`` (a, b)."""
    edges = scratch.save(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.save(edges.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = edges.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "doc_id").select("doc_id", "comp", F.least("comp", "near").alias("low"))
        lower = scratch.save(lower, f"{name}-{step}-low")
        jump = lower.select(F.col("doc_id").alias("low"), F.col("low").alias("far"))
        new = lower.join(jump, "low").select("doc_id", F.least("low", "far").alias("comp"), (F.col("comp") != F.least("low", "far")).alias("changed"))
        new = scratch.save(new, f"{name}-{step}")
        if not new.filter("changed").head(1):
            return new.select("doc_id", "comp")
        labels = new.select("doc_id", "comp")


def join(docs: DataFrame, block_bytes: int = 4 << 20, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles and component_id for each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = scratch.save(blocks(docs, block_bytes), "blocks", compression="none")
    parts = ranges(texts)
    signed = scratch.save(texts.mapInArrow(_sign, SIGNED), "signed")
    tasks = (signed.filter("kind = 1").agg(F.max("block")).first()[0] or 0) + 1
    order = spark.sparkContext.broadcast(rarity(signed, tasks))
    every = signed.filter("kind = 0").select("doc_id", "n", "f1", "f2", "block", "place")
    sets = every.filter("doc_id is not null and n > 0")
    classes = sets.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "block", "place")).alias("r"))
    classes = scratch.save(classes.select("f1", "f2", "n", F.col("r.doc_id").alias("rep"), F.col("r.block").alias("block"), F.col("r.place").alias("place")), "classes")
    posted = texts.groupBy("block").cogroup(classes.select("block", "place").groupBy("block")).applyInArrow(_post(parts, order, tile), POSTED)
    lists = scratch.save(posted.groupBy("part").applyInArrow(_merge_lists, LISTED), "lists")
    scratch.free()
    tiled = bool(lists.filter("tiles > 1").head(1))

    partners = lists.select("doc_id").distinct().join(classes.select(F.col("rep").alias("doc_id"), "block", "place"), "doc_id")
    vectors = scratch.save(texts.groupBy("block").cogroup(partners.select("block", "place").groupBy("block")).applyInArrow(_vectors, VECTOR), "vectors", compression="none")
    scratch.free("blocks")

    links, labels = None, None
    for name in ("first", "pivots", "rest"):
        comp = lists.withColumn("comp", F.col("doc_id")) if labels is None else lists.join(labels, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
        pairs = scratch.save(propose(comp, name, tile, tiled), f"{name}-pairs")
        if not pairs.head(1):
            continue
        new = verify(pairs, vectors, scratch, name)
        scratch.free(f"{name}-pairs", f"{name}-likely")
        if not new.head(1):
            continue
        links = new if links is None else links.union(new)
        labels = components(links, scratch, name)

    rep = sets.select("doc_id", "f1", "f2", "n").join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"]).select("doc_id", "rep").distinct()
    # a doc_id that stands in two classes joins them
    twice = rep.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
    if twice.head(1):
        more = rep.join(twice.select("doc_id"), "doc_id").select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b"))
        links = more if links is None else links.union(more)
        labels = components(links, scratch, "repeated")
    if labels is None:
        least = rep.select("doc_id", F.col("rep").alias("comp"))
    else:
        least = rep.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("comp"))
    least = least.groupBy("doc_id").agg(F.min("comp").alias("comp"))
    return every.join(least, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns as they are: that with the smallest doc_id, of rows that repeat it that with the smallest text.

    Rows without an id stay. Only ids that do repeat are looked at row by row; which of two rows that agree in id
    and text is kept is left open.
    """
    gone = join(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    many = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    if not many.head(1):
        return left
    single = left.join(many, "doc_id", "left_anti").select(*docs.columns)
    again = left.join(many, "doc_id").select("doc_id", F.struct(F.col("text").isNull(), "text").alias("by"), F.struct(*docs.columns).alias("row"))
    return single.unionByName(again.groupBy("doc_id").agg(F.min_by("row", "by").alias("row")).select("row.*"))
