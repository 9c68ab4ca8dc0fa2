"""Exact n-gram Jaccard join: lists cut into blocks that sizes and positions skip, and answers derived from similar sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import PARTIAL_SUMS, SlotCounter, Workspace, by_marks, components, id_bitmap, id_marks, id_slots, session, sum_slots, text_groups

#: Counters of the frequency sketch that orders shingles, as a power of two. Any order is right; a wider sketch tells
#: rarer shingles apart in a larger corpus.
SKETCH_BITS = 20
#: Lists of at most so many sets give all their pairs at once; longer ones are compared with pivots first.
FEW = 8
#: Entries of a list that one task takes (by the sketch, which never counts too few): longer lists are cut into pieces.
PIECE = 4096
#: Sets of a block that a list or a component is cut into.
BLOCK = 256
#: Pivots, at most, of a list that lies in several components after the first comparisons (fewer in shorter lists).
PIVOTS = 8
#: Rounds in which such lists are compared with pivots, each with others, before bounds and answers follow.
TURNS = 3
#: Bits of the longest signature, as a power of two. Larger sets share its bits: that rules out fewer pairs, and loses none.
SIGN_BITS = 16
#: Ids of which a bitmap is made and sent to the tasks; of more, texts are joined or all of them read.
BITMAP_IDS = 1 << 20
#: Words whose hashes a worker keeps.
CACHE = 300_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


class Shingler:
    """Sets of distinct shingles, as sorted 64-bit hashes; texts of fewer than n words have their whole sequence as one."""

    def __init__(self, n: int = 5):
        self.n, self.words = n, _Words()
        self.odd = np.array([int(_ODD[k % 5]) + 2 * (k // 5) for k in range(n)], dtype=np.uint64)

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        found, sizes = [], []
        for t in texts:
            words = t.encode().translate(_LOWER).split() if t else []
            found += words
            sizes.append(len(words))
        codes = np.array(list(map(self.words.__getitem__, found)), dtype=np.uint64)
        n, total = self.n, len(codes)
        if total >= n:
            rolled = self._mix(sum(codes[k : total - n + 1 + k] * self.odd[k] for k in range(n)))
        out, at = [], 0
        for size in sizes:
            if size >= n:
                h = np.sort(rolled[at : at + size - n + 1])
                out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
            elif size:
                part = codes[at : at + size]
                out.append(self._mix((part * self.odd[:size]).sum(keepdims=True) + np.uint64(size)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            at += size
        return out


def similar(i: Column, a: Column, b: Column, num: int, den: int) -> Column:
    """Whether sets of a and b shingles with i in common link."""
    return F.lit(den) * i >= F.lit(num) * (a + b - i)


def may_link(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Sizes a, b and places i, j (from 0) of the first common shingle: whether what is left can still suffice."""
    rest = np.minimum(a - i, b - j)
    return (den * np.minimum(a, b) >= num * np.maximum(a, b)) & ((den + num) * rest >= num * (a + b))


def blocks_may_link(sizes: np.ndarray, left: np.ndarray, num: int, den: int, block: int) -> Iterator[tuple[slice, slice]]:
    """Pairs of blocks (the second not before the first) of a list sorted by size, in which some pair may link; `left` is
    what follows each set's place. All others are skipped, by their least and greatest sizes and places alone."""
    cuts = [slice(k, min(k + block, len(sizes))) for k in range(0, len(sizes), block)]
    low, high, most = (np.array([f(v[c]) for c in cuts]) for f, v in ((np.min, sizes), (np.max, sizes), (np.max, left)))
    for x, cut in enumerate(cuts):
        # sizes grow along the list, so once a block is too large for this one all later ones are
        for y in range(x, len(cuts)):
            if num * low[y] > den * high[x]:
                break
            if (den + num) * min(most[x], most[y]) >= num * (low[x] + low[y]):
                yield cut, cuts[y]


def _scan(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """One pass: of each document n_shingles, its set's hash (node) and signature; of each task its counts of the sketch."""
    schema = f"doc_id long, n_shingles long, node long, sign binary, {PARTIAL_SUMS}"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counter = Shingler(n), SlotCounter(1 << bits)
        for batch in batches:
            for ids, texts in text_groups(batch.column(0).to_pylist(), batch.column(1)):
                sets = shingler.sets(texts)
                counter.add((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64))
                none = pa.nulls(len(ids), pa.int64())
                cols = [pa.array(ids, pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array(nodes(sets)), pa.array(signatures(sets), pa.binary()), none, none, pa.nulls(len(ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)
        rows = counter.rows()
        cols = [*[[None] * len(rows)] * 4, *zip(*rows, strict=True)] if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.mapInArrow(run, schema)


def nodes(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each set."""
    return np.frombuffer(b"".join(hashlib.blake2b(h.tobytes(), digest_size=8).digest() for h in sets), dtype=np.int64)


def signatures(sets: list[np.ndarray]) -> list[bytes]:
    """Of each set, for 2^k places (k by its size), whether an odd number of its shingles falls there. A place where two
    signatures differ takes a shingle that only one of the sets holds, so they bound what two sets have in common."""
    out = []
    for h in sets:
        bits = min(SIGN_BITS, max(6, (2 * len(h)).bit_length()))
        odd = np.bincount((h & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1
        out.append(np.packbits(odd.astype(bool), bitorder="little").tobytes())
    return out


def signatures_allow(signs: list[bytes], size: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the sets at i and j can link by their signatures; the longer one of a pair is folded to the other's length."""
    width, good = np.array([len(s) for s in signs], dtype=np.int64), np.zeros(len(i), dtype=bool)
    least = np.minimum(width[i], width[j])
    for w in np.unique(least).tolist():
        at = np.flatnonzero(least == w)
        used, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        rows = np.stack([np.bitwise_xor.reduce(np.frombuffer(signs[k], np.uint64).reshape(-1, w // 8), axis=0) for k in used.tolist()])
        x, y = place[: len(at)], place[len(at) :]
        step = max(1, (1 << 23) // w)
        for cut in (slice(k, k + step) for k in range(0, len(at), step)):
            differ = np.bitwise_count(rows[x[cut]] ^ rows[y[cut]]).sum(1, dtype=np.int64)
            total = size[i[at[cut]]] + size[j[at[cut]]]
            good[at[cut]] = differ <= total - 2 * -(-num * total // (num + den))
    return good


def _likely(pairs: DataFrame, signs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that signatures (node, size, sign) don't rule out."""
    side = lambda c: signs.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sign").alias(f"sign_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            size = np.concatenate([t.column(c).to_numpy(zero_copy_only=False) for c in ("size_a", "size_b")])
            k = np.arange(len(t))
            good = signatures_allow(t.column("sign_a").to_pylist() + t.column("sign_b").to_pylist(), size, k, k + len(t), num, den)
            yield t.select(["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "size_a", "size_b", "sign_a", "sign_b").mapInArrow(run, "a long, b long")


def _wanted(ids: DataFrame, column: str):
    """A bitmap that all ids of the column pass, for the tasks; None for more ids than BITMAP_IDS."""
    some = ids.select(column).where(F.col(column).isNotNull()).distinct()
    if some.count() > BITMAP_IDS:
        return None
    return ids.sparkSession.sparkContext.broadcast(id_bitmap(some, column))


def _texts(batches: Iterator[pa.RecordBatch], known) -> Iterator[tuple[list, list[str | None]]]:
    """Some MB of ids and texts at a time, of the ids that pass the bitmap."""
    for batch in batches:
        if known is not None:
            slots = id_slots(batch.column(0).to_numpy(zero_copy_only=False), len(known.value).bit_length() - 1)
            batch = batch.take(pa.array(np.flatnonzero(known.value[slots])))
        if len(batch):
            yield from text_groups(batch.column(0).to_pylist(), batch.column(1))


def _entries(docs: DataFrame, reps: DataFrame, counts: np.ndarray, n: int, bits: int, num: int, den: int) -> DataFrame:
    """The prefix of every set: token, cut, node, size, pos. Rare shingles (by the sketch) come first in the order; cut
    holds how many pieces the list has (above 32 bits) and the number of the entry's. A list that may be long has as many pieces as it needs; a set's hash decides its piece. Copies that the bitmap
    lets through give their set's entries again (once in a task while it remembers)."""
    levels = np.floor(64 * np.log2(counts.astype(np.float64) + 1)).astype(np.uint16)  # counts end at 2^32
    spread = docs.sparkSession.sparkContext.broadcast(levels)  # of the sketch's size
    known = _wanted(reps, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, shingler, told = spread.value, Shingler(n), set()
        for _, some in _texts(batches, known):
            tokens, owners, sizes, places = [], [], [], []
            sets = shingler.sets(some)
            for node, h in zip(nodes(sets).tolist(), sets, strict=True):
                if not len(h) or node in told:
                    continue
                if len(told) >= CACHE:
                    told.clear()
                told.add(node)
                take = len(h) - -(-num * len(h) // den) + 1
                order = np.argsort(levels[(h >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")[:take]
                tokens.append(h[order])
                owners.append(np.full(take, node))
                sizes.append(np.full(take, len(h)))
                places.append(np.arange(take))
            if tokens:
                t, who = np.concatenate(tokens), np.concatenate(owners)
                most = np.exp2((levels[(t >> np.uint64(64 - bits)).astype(np.int64)] + 1) / 64)
                pieces = np.ceil(most / PIECE).astype(np.int64)
                piece = (who.view(np.uint64) >> np.uint64(16)).astype(np.int64) % pieces
                cols = (t.view(np.int64), pieces << 32 | piece, who, np.concatenate(sizes).astype(np.int32), np.concatenate(places).astype(np.int32))
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["token", "cut", "node", "size", "pos"])

    return docs.where("doc_id is not null").mapInArrow(run, "token long, cut long, node long, size int, pos int")


MET = ["long", "token", "piece", "pieces", "a", "b", "size", "pos"]


def scan_lists(batches: Iterator[pa.RecordBatch], num: int, den: int, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Entries sorted by token, cut, size, pos and node -> pairs (a, b) to compare, and the entries of long lists.

    Lists of one set vanish, those of up to FEW give every pair that sizes and places let through. Of longer ones, and of
    lists in several pieces, the set of the least hash is the pivot, which is paired with all others let through; their
    entries are handed on for what is then left open.
    """
    held, size = [], 0

    def emit(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        token, cut, node, sizes, pos = cols
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (cut[1:] != cut[:-1]) | (node[1:] != node[:-1])])
        token, cut, node, sizes, pos = (c[new] for c in cols)
        piece, pieces = (cut & 0xFFFFFFFF).astype(np.int32), (cut >> 32).astype(np.int32)
        begins = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (cut[1:] != cut[:-1])]))
        lengths = np.diff(np.append(begins, len(token)))
        split = pieces[begins] > 1
        found = []

        def pair(x: np.ndarray, y: np.ndarray) -> None:
            x, y = x.ravel(), y.ravel()
            good = may_link(sizes[x], pos[x], sizes[y], pos[y], num, den)
            found.append(np.stack([node[x[good]], node[y[good]]], 1))

        for n in range(2, FEW + 1):
            rows = begins[(lengths == n) & ~split]
            i, j = np.triu_indices(n, 1)
            pair(rows[:, None] + i[None, :], rows[:, None] + j[None, :])
        some = np.flatnonzero((lengths > FEW) | split)
        keep = [np.arange(begins[k], begins[k] + lengths[k]) for k in some.tolist()]
        for rows in keep:
            pivot = rows[node[rows].argmin()]
            rest = rows[rows != pivot]
            pair(np.full(len(rest), pivot), rest)
        pairs = np.unique(np.sort(np.concatenate(found), 1), axis=0)
        if len(pairs):
            none = [pa.nulls(len(pairs), t) for t in (pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(pairs), dtype=bool)), *none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *[pa.nulls(len(pairs), pa.int32())] * 2], MET)
        if keep:
            at = np.concatenate(keep)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), dtype=bool)), pa.array(token[at]), pa.array(piece[at]), pa.array(pieces[at]), pa.array(node[at]), pa.nulls(len(at), pa.int64()), pa.array(sizes[at]), pa.array(pos[at])], MET)

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        cols = [np.concatenate([h[k] for h in held]) for k in range(5)] if held else []
        held, size = [], 0
        if not cols or not len(cols[0]):
            return
        stop = len(cols[0])
        if not last:  # the last list may go on
            stop = int(np.flatnonzero(np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]))[-1])
            held, size = [[c[stop:] for c in cols]], len(cols[0]) - stop
        if stop:
            yield from emit([c[:stop] for c in cols], last)

    for batch in batches:
        held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)])
        size += len(batch)
        if size >= most:
            yield from flush(False)
    yield from flush(True)


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node, size and the set itself of the nodes asked for (node, rep), once each."""
    known = _wanted(wanted, "rep")
    if known is None:
        ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
        docs = by_marks(docs.where("doc_id is not null"), "doc_id", id_marks(ids, "doc_id"))[1].join(ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, told = Shingler(n), set()
        for _, texts in _texts(batches, known):
            sets = shingler.sets(texts)
            rows = [(k, h) for k, h in zip(nodes(sets).tolist(), sets, strict=True) if len(h) and k not in told]
            if len(told) >= CACHE:
                told.clear()
            told.update(k for k, _ in rows)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([len(h) for _, h in rows], pa.int32()), pa.array([h.tobytes() for _, h in rows], pa.binary())], ["node", "size", "set"])

    found = docs.where("doc_id is not null").mapInArrow(run, "node long, size int, set binary")
    return found.join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, size_a, size_b, overlap of each pair of nodes, from the sets themselves."""
    # only the sets of that side are shuffled, where their names are few enough to be sent to all tasks
    of = lambda c: sets.join(pairs.select(F.col(c).alias("node")).distinct(), "node", "left_semi")
    side = lambda c: of(c).select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("set").alias(f"set_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n = [len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True)) for x, y in zip(t.column("set_a").to_pylist(), t.column("set_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[t.column(c) for c in ("a", "b", "size_a", "size_b")], pa.array(n, pa.int32())], ["a", "b", "size_a", "size_b", "overlap"])

    return both.select("a", "b", "size_a", "size_b", "set_a", "set_b").mapInArrow(run, "a long, b long, size_a int, size_b int, overlap int")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of lists (token, piece, pieces) -> the same for every pair of pieces (i, j) with i <= j that theirs is in."""
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    return rows.withColumn("_o", other).withColumn("i", F.least("piece", "_o")).withColumn("j", F.greatest("piece", "_o")).drop("_o")


class _List:
    """The entries of a list, or of two of its pieces, as arrays in the order of size, pos and node."""

    def __init__(self, rows: pa.Table):
        self.size, self.pos, self.comp, self.piece, self.node = (rows.column(c).to_numpy() for c in ("size", "pos", "comp", "piece", "node"))
        self.size = self.size.astype(np.int64)
        self.across = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        self.rows = rows

    def open_pairs(self, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the pairs that lie in different components and may link."""
        size, comp, left = self.size, self.comp, self.size - self.pos
        for x, y in blocks_may_link(size, left, num, den, BLOCK):
            a, b = size[x][:, None], size[y][None, :]
            good = (comp[x][:, None] != comp[y][None, :]) & (den * np.minimum(a, b) >= num * np.maximum(a, b))
            good &= (den + num) * np.minimum(left[x][:, None], left[y][None, :]) >= num * (a + b)
            if self.across:
                good &= self.piece[x][:, None] != self.piece[y][None, :]
            if x == y:
                good = np.triu(good, 1)
            i, j = np.nonzero(good)
            if len(i):
                yield i + x.start, j + y.start

    def pivot_pairs(self, num: int, den: int, turn: int = 0) -> np.ndarray:
        """(a, b) of the list's pivots (of the least hashes, by another hash each turn) with the sets open to them."""
        node, found = self.node, []
        is_pivot = np.zeros(len(node), dtype=bool)
        is_pivot[np.argsort(node.view(np.uint64) * _ODD[turn])[: min(PIVOTS, max(1, len(node).bit_length() - 2))]] = True
        for i, j in self.open_pairs(num, den):
            some = is_pivot[i] | is_pivot[j]
            i, j = np.where(is_pivot[i], i, j)[some], np.where(is_pivot[i], j, i)[some]
            found.append(np.stack([node[i], node[j]], 1))
        return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)

    def derived(self, num: int, den: int) -> np.ndarray:
        """(a, b, 1 if linked or 0 if undecided) of the open pairs, by both sets' overlaps with pivots: those of the list
        that most of its sets were compared with. Pairs that can't link, by these or by signatures, are left out."""
        node, size, signs = self.node, self.size, self.rows.column("sign").to_pylist()
        told = self.rows.column("pivots").combine_chunks()
        counts = told.value_lengths().fill_null(0).to_numpy()
        owner = np.repeat(np.arange(len(node)), counts)
        flat = told.flatten()
        names, overlap, wide = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        pivots, which, times = np.unique(names, return_inverse=True, return_counts=True)
        top = np.argsort(-times, kind="stable")[: 2 * PIVOTS]
        place = np.full(len(pivots), -1, dtype=np.int64)
        place[top] = np.arange(len(top))
        shared, width = np.full((len(node), len(top)), -1, dtype=np.int64), np.zeros(len(top), dtype=np.int64)
        at = place[which]
        keep = at >= 0
        shared[owner[keep], at[keep]] = overlap[keep]
        width[at[keep]] = wide[keep]
        for c, k in enumerate(pivots[top].tolist()):
            own = np.flatnonzero(node == k)
            shared[own, c] = size[own]
            width[c] = size[own[0]] if len(own) else width[c]
        out = []
        for i, j in self.open_pairs(num, den):
            a, b = size[i], size[j]
            enough = -(-num * (a + b) // (num + den))
            yes, no = np.zeros(len(i), dtype=bool), np.zeros(len(i), dtype=bool)
            for c in range(len(top)):
                x, y = shared[i, c], shared[j, c]
                both = (x >= 0) & (y >= 0)
                yes |= both & (x + y - width[c] >= enough)
                no |= both & (np.minimum(x, y) + np.minimum(a - x, b - y) < enough)
            keep = ~no
            still = np.flatnonzero(keep & ~yes)
            keep[still] = signatures_allow(signs, size, i[still], j[still], num, den)
            out.append(np.stack([np.minimum(node[i], node[j])[keep], np.maximum(node[i], node[j])[keep], yes[keep]], 1))
        return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def _by_list(rows: DataFrame, what: str, num: int, den: int, *more: int) -> DataFrame:
    """Applies a method of _List to every list (token) or pair of its pieces (i, j). Lists come sorted in a stream, so a
    task holds some lists at a time, and a list has at most the entries of two pieces."""
    names = ["a", "b", "linked"][: 2 if what == "pivot_pairs" else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = [getattr(_List(table.slice(x, y - x)), what)(num, den, *more) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if y - x > 1]
            pairs = np.unique(np.concatenate(found), axis=0) if found else ()
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(len(names))], names)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= 50_000:
                table = pa.Table.from_batches(held).combine_chunks()
                cuts = _cuts(table)
                yield from done(table.slice(0, int(cuts[-2])), cuts[:-1])
                table = table.slice(int(cuts[-2]))
                held, size = table.to_batches(), len(table)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from done(table, _cuts(table))

    dealt = _in_blocks(rows).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "size", "pos", "node")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _cuts(table: pa.Table) -> np.ndarray:
    """Where lists begin, and the end."""
    t, i, j = (table.column(c).to_numpy() for c in ("token", "i", "j"))
    new = np.flatnonzero((t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
    return np.concatenate([[0], new, [len(t)]])


def bit_rows(sets: list[np.ndarray], width: int = 1 << 16) -> Iterator[np.ndarray]:
    """The sets as rows of bits over the shingles that several of them hold, `width` shingles at a time."""
    tokens, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    places = np.full(len(tokens), -1, dtype=np.int64)
    often = np.flatnonzero(times > 1)
    places[often] = np.arange(len(often))
    owner, place = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), places[which]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for at in range(0, len(often), width):
        lo, hi = np.searchsorted(place, [at, at + width])
        wide = -(-(min(len(often), at + width) - at) // 64) * 64
        dense = np.zeros((len(sets), wide), dtype=bool)
        dense[owner[lo:hi], place[lo:hi] - at] = True
        yield np.packbits(dense, axis=1).view(np.uint64)


def linked_matrix(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of sets[rows] links with which of sets[cols], as a matrix of booleans.

    All are compared with the first one. From both overlaps follow the least and the most that any two can share; only
    the pairs that this leaves open are compared themselves."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    parts = list(bit_rows(sets))
    shared = sum((np.bitwise_count(p & p[0]).sum(1, dtype=np.int64) for p in parts), np.zeros(len(sets), dtype=np.int64))
    shared[0] = size[0]  # shingles of one set alone are no bits
    a, b, x, y = size[rows][:, None], size[cols][None, :], shared[rows][:, None], shared[cols][None, :]
    enough = -(-num * (a + b) // (num + den))
    linked = x + y - size[0] >= enough
    still = ~linked & (np.minimum(x, y) + np.minimum(a - x, b - y) >= enough)
    for r in np.flatnonzero(still.any(1)).tolist():
        at = np.flatnonzero(still[r])
        n = sum((np.bitwise_count(p[cols[at]] & p[rows[r]]).sum(1, dtype=np.int64) for p in parts), np.zeros(len(at), dtype=np.int64))
        linked[r, at] = n >= enough[r, at]
    return linked


def _component_links(members: DataFrame, num: int, den: int, pairs: bool) -> DataFrame:
    """members: comp, members, node, weight, set -> node and n, partial sums of the weights of the sets that each links
    with; or the linked pairs (a, b) themselves. Components are cut into blocks of about BLOCK sets; a pair of blocks is
    one group."""
    dealt = members.withColumn("pieces", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        i, j, piece = group["i"].iloc[0], group["j"].iloc[0], group["piece"].to_numpy()
        rows, cols = np.flatnonzero(piece == i), np.flatnonzero(piece == j)
        node, weight = group["node"].to_numpy(), group["weight"].to_numpy()
        linked = linked_matrix([np.frombuffer(x, np.int64) for x in group["set"]], rows, cols, num, den) if len(rows) and len(cols) else np.zeros((len(rows), len(cols)), dtype=bool)
        if i == j:
            np.fill_diagonal(linked, False)
        if pairs:
            x, y = np.nonzero(np.triu(linked) if i == j else linked)
            x, y = node[rows[x]], node[cols[y]]
            return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})
        parts = [(node[rows], linked @ weight[cols])] + ([] if i == j else [(node[cols], linked.T @ weight[rows])])
        return pd.DataFrame({"node": np.concatenate([p for p, _ in parts]), "n": np.concatenate([n for _, n in parts])})

    return _in_blocks(dealt).groupBy("comp", "i", "j").applyInPandas(run, "a long, b long" if pairs else "node long, n long")


def linked_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 75, den: int = 100, bits: int = SKETCH_BITS) -> DataFrame:
    """a, b: every linked pair of different sets, once, named by their nodes; join_documents has each row's node."""
    return _join(df, key, text, n, num, den, bits, "pairs")


def join_documents(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 75, den: int = 100, bits: int = SKETCH_BITS, links: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, representative_id, node, component_node, and with `links`
    n_links.

    Documents link when den * intersection >= num * union of their sets of word n-grams; component_id is the smallest
    id reachable by links. Every link between different sets is either verified, derived, or implied by links already
    found, so components are exact (up to collisions of 64-bit hashes of shingles and of sets); no group is expanded into
    rows for all its pairs:

    1. Equal sets are one node (the set's hash); representative_id is the smallest id that holds the set. component_node
       names a component by one of its nodes.
    2. Each set lists the shingles of its prefix, rarest first by a sketch of all counts. Lists of few sets give every
       pair that sizes and positions let through. In longer ones one set is the pivot, and all others are compared with
       it. Before sets are compared, signatures of a few bits for each shingle rule out pairs that differ in too much.
    3. Long lists that now lie within one component are done. The others are taken block by block: pairs of blocks whose
       sizes and positions can't suffice are skipped whole. Some pivots more are compared with what is open to them;
       from both sets' overlaps with the pivots follow bounds of their own overlap, and only pairs that no pivot and no
       signature decides are compared.
    4. For n_links each component is taken in pairs of blocks of sets, where likewise the overlaps with one set decide
       most pairs; blocks give sums, not pairs.

    n_links is the number of other documents that a row's text links with, where a document is an id with one set: exact
    copies under other ids count, repeated rows don't. It is 0 for blank texts and null for null ids.

    Rows that share an id but not their words are documents of their own, which need not link; both are called by that
    id. Rows with a null id take no part: their component_id and representative_id are null. Null and blank texts have 0
    shingles and link with nothing (component_id is their own id). Repeated rows are kept; other columns are not read;
    an empty table gives an empty result.
    """
    return _join(df, key, text, n, num, den, bits, "links" if links else "components")


def _join(df: DataFrame, key: str, text: str, n: int, num: int, den: int, bits: int, what: str) -> DataFrame:
    spark = session(df)
    ws = Workspace(spark, "ngram")
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scanned = ws.table(_scan(docs, n, bits), "scan")
    counts = sum_slots(scanned.where("sums is not null").select("slice", "who", "sums"), 1 << bits)
    seen = scanned.where("sums is null").select("doc_id", "n_shingles", "node")
    full = seen.where("n_shingles > 0 and doc_id is not null")
    reps = ws.table(full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("weight")), "reps")

    entries = _entries(docs, reps, counts, n, bits, num, den).repartition("token", "cut").sortWithinPartitions("token", "cut", "size", "pos", "node")
    met = ws.table(entries.mapInArrow(lambda batches: scan_lists(batches, num, den), "long boolean, token long, piece int, pieces int, a long, b long, size int, pos int"), "met")
    pairs = ws.table(met.where("not long").select("a", "b").distinct(), "pairs")
    lists = met.where("long").select("token", "piece", "pieces", F.col("a").alias("node"), "size", "pos")

    listed = named_by(reps, _either(pairs).unionByName(lists.select("node")).distinct()).withColumnRenamed("rep", "doc_id")
    signs = scanned.where("n_shingles > 0").join(listed, ["node", "doc_id"], "left_semi")
    signs = ws.table(signs.select("node", F.col("n_shingles").alias("size"), "sign").dropDuplicates(["node"]), "signs")
    likely = ws.table(_likely(pairs, signs, num, den), "likely")
    sets = ws.table(_sets(docs, named_by(reps, _either(likely)), n), "sets")
    linked = similar(F.col("overlap"), F.col("size_a"), F.col("size_b"), num, den)
    known = ws.table(_verified(likely, sets), "known")
    links = known.where(linked).select(F.col("a").alias("u"), F.col("b").alias("v"))
    comps = ws.table(components(links, ws, "first"), "comps")

    # Long lists in several components
    def placed(comps: DataFrame, name: str) -> DataFrame:
        rows = lists.join(comps.select(F.col("id").alias("node"), "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        several = rows.groupBy("token").agg(F.min("comp").alias("_l"), F.max("comp").alias("_m")).where("_l <> _m").select("token")
        return ws.table(rows.join(several, "token", "left_semi"), name)

    joined = lambda more, comps: more.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(comps.select(F.col("id").alias("u"), F.col("comp").alias("v")))
    mixed = placed(comps, "mixed")
    told = None
    for turn in range(TURNS):
        if mixed.isEmpty():
            break
        stars = ws.table(_likely(_by_list(mixed, "pivot_pairs", num, den, turn).distinct(), signs, num, den), f"stars{turn}")
        lacking = ws.table(_either(stars).join(sets.select("node"), "node", "left_anti"), f"lacking{turn}")
        if not lacking.isEmpty():
            sets = sets.unionByName(ws.table(_sets(docs, named_by(reps, lacking), n), f"sets{turn}"))
        new = ws.table(_verified(stars, sets), f"told{turn}")
        told = new if told is None else told.unionByName(new)
        # what the pivots join needs no answers of its own
        comps = ws.table(components(joined(new.where(linked), comps), ws, f"turn{turn}"), f"comps{turn}")
        mixed = placed(comps, f"mixed{turn}")
    if not mixed.isEmpty():
        to_pivots = told.groupBy(F.col("b").alias("node")).agg(F.collect_set(F.struct("a", F.col("overlap").cast("long").alias("overlap"), F.col("size_a").cast("long").alias("size_a"))).alias("pivots"))
        answers = _by_list(mixed.join(to_pivots, "node", "left").join(signs.select("node", "sign"), "node"), "derived", num, den)
        answers = ws.table(answers.groupBy("a", "b").agg((F.max("linked") > 0).alias("linked")), "answers")
        asked = ws.table(answers.where("not linked").select("a", "b"), "asked")
        lacking = ws.table(_either(asked).join(sets.select("node"), "node", "left_anti"), "unasked")
        if not lacking.isEmpty():
            sets = sets.unionByName(ws.table(_sets(docs, named_by(reps, lacking), n), "sets_asked"))
        more = _verified(asked, sets).where(linked).select("a", "b").unionByName(answers.where("linked").select("a", "b"))
        comps = ws.table(components(joined(more, comps), ws, "last"), "final")

    members = comps.select(F.col("id").alias("node"), "comp").join(reps, "node")
    if what != "components":
        # of two sets in a component the link is known; larger ones are taken in blocks
        held = members.join(members.groupBy("comp").agg(F.count("*").alias("members"), F.sum("weight").alias("total")), "comp")
        held = ws.table(held, "held")
        two, held = held.where("members = 2"), held.where("members > 2")
        lacking = ws.table(held.select("node", "rep").join(sets.select("node"), "node", "left_anti"), "unheld")
        if not lacking.isEmpty():
            sets = sets.unionByName(ws.table(_sets(docs, lacking, n), "sets_held"))
        some = held.select("node", "comp", "members", "weight").join(sets.select("node", "set"), "node")
        counted = _component_links(some, num, den, what == "pairs")
        if what == "pairs":
            counted = counted.unionByName(two.groupBy("comp").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b"))
        else:
            counted = counted.unionByName(two.select("node", (F.col("total") - F.col("weight")).alias("n")))
        counted = ws.table(counted, "counted")
        if what == "pairs":
            ws.drop(*TEMPORARY)
            return counted
        counted = counted.groupBy("node").agg(F.sum("n").alias("_l"))
    least = members.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = members.join(least, "comp").select("node", "comp", "component_id")
    of = reps.join(of, "node", "left").select("node", "rep", "weight", F.coalesce("comp", "node").alias("component_node"), F.coalesce("component_id", "rep").alias("comp_id"))
    extra = []
    if what == "links":
        of = of.join(counted, "node", "left").withColumn("_links", F.coalesce("_l", F.lit(0)) + F.col("weight") - 1)
        extra = [F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("_links")).otherwise(0)).alias("n_links")]
    out = seen.join(ws.table(of, "of"), "node", "left")
    own = lambda c: F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col(c))).otherwise(F.col("doc_id"))
    out = ws.table(out.select("doc_id", "n_shingles", own("comp_id").alias("component_id"), own("rep").alias("representative_id"), "node", "component_node", *extra), "result")
    ws.drop(*TEMPORARY, "counted")
    return out


TEMPORARY = ("scan", "reps", "met", "pairs", "signs", "likely", "sets", "sets_asked", "sets_held", "unasked", "unheld", "known", "comps", "mixed", *[f"{t}{k}" for t in ("stars", "told", "sets", "comps", "mixed", "lacking") for k in range(3)], "answers", "asked", "final", "held", "of")


def _either(*frames: DataFrame) -> DataFrame:
    """The nodes of pairs (a, b)."""
    out = None
    for f in frames:
        for c in ("a", "b"):
            part = f.select(F.col(c).alias("node"))
            out = part if out is None else out.unionByName(part)
    return out.distinct()


def named_by(reps: DataFrame, some: DataFrame) -> DataFrame:
    return reps.select("node", "rep").join(some, "node", "left_semi")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, **how: int) -> DataFrame:
    """The rows of `df`, with all their columns, that stand for their component: one row of its smallest id (where an id
    has several texts, that of the least node in the component). A row goes only if its own text is equal or linked, by
    however many links, to a kept one; so rows without words and rows with a null id, which take no part in links, stay."""
    joined = join_documents(df, key, text, n=n, **how)
    ws = Workspace(session(df), "kept")
    ids = joined.where("doc_id is not null").groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_rows"), F.max(F.expr("n_shingles = 0 or doc_id = component_id")).alias("_any"))
    ids = ws.table(ids.select("_kept", "_any", (F.col("_any") & (F.col("_rows") == 1)).alias("_single")), "ids")
    # texts are not shuffled: ids that go or repeat are marked, rows that meet no mark stay as they are; of the others
    # those stay that meet one by chance
    marks = ws.table(id_marks(ids.where("not _single"), "_kept"), "marks")
    clear, rows = by_marks(df.where(F.col(key).isNotNull()), key, marks)
    met = ws.table(by_marks(ids.where("_single").select("_kept"), "_kept", marks)[1], "met")
    single = clear.unionByName(rows.join(met, F.col(key) == F.col("_kept"), "left_semi"))
    several = ids.where("_any and not _single").select("_kept")
    if not several.isEmpty():
        single = single.unionByName(_one_each(rows.join(several, F.col(key) == F.col("_kept"), "left_semi"), joined, ws, key, text, n))
    return single.unionByName(df.where(F.col(key).isNull()))


def _one_each(rows: DataFrame, joined: DataFrame, ws: Workspace, key: str, text: str, n: int) -> DataFrame:
    """Of rows whose ids repeat: those without words, and one row for each id and set that stands for its component."""
    cols = rows.columns

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                sets = shingler.sets(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([len(h) for h in sets], pa.int64()), pa.array(nodes(sets)), *part.columns[1:]], ["_size", "_node", *kept])

    kept = [f"_k{i}" for i in range(len(cols))]
    some = rows.select(F.col(text).cast("string").alias("_t"), *[F.col(c).alias(k) for c, k in zip(cols, kept, strict=True)])
    fields = ", ".join(f"{k} {some.schema[k].dataType.simpleString()}" for k in kept)
    named = ws.table(some.mapInArrow(name, "_size long, _node long, " + fields), "named")
    back = [F.col(k).alias(c) for c, k in zip(cols, kept, strict=True)]
    id_ = F.col(kept[cols.index(key)]).cast("long")
    chosen = joined.where("n_shingles > 0 and doc_id = component_id").groupBy(F.col("doc_id").alias("_id"), "component_node").agg(F.min("node").alias("_node"))
    worded = named.where("_size > 0").withColumn("_id", id_).join(chosen, ["_id", "_node"], "left_semi")
    # the row of the least hash of all of its columns, by a partial aggregate, so that no id gathers in one task
    one = worded.groupBy("_id", "_node").agg(F.min_by(F.struct(*kept), F.xxhash64(F.to_json(F.struct(*kept)))).alias("_r")).select("_r.*")
    return one.select(*back).unionByName(named.where("_size = 0").select(*back))
