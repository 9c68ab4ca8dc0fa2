"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.workspace import Workspace, least_hashes, session

#: Vectors that the codes are learned from, at most: those with the smallest hashes of their ids.
SAMPLE = 8192
#: Share of the sample's true neighbours that the radius must reach.
AIM = 0.98
#: Bits of a substring, each of which has an index of its own.
SUB = 16
#: Vectors and queries that meet in one task, and the blocks of vectors that smaller tables are cut into.
BASE_BLOCK, QUERY_BLOCK, BLOCKS = 32_768, 8192, 6
#: Vector lengths that hold less than one in this many vectors have no codes: their queries meet all of that length.
RARE_LENGTH = 64


@dataclass(frozen=True)
class Codes:
    """Rotations (one for every group of bits), the mean they are taken about, the largest norm, and the radius."""

    mean: np.ndarray
    turns: np.ndarray
    top: float
    radius: int

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """One more dimension that brings all vectors to the largest norm, so that the largest inner product is the
        smallest angle; a query's is 0 and its norm is brought to the same."""
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            return np.concatenate([x * (self.top / np.maximum(norm, 1e-300)), np.zeros((len(x), 1))], 1)
        return np.concatenate([x, np.sqrt(np.maximum(self.top**2 - norm**2, 0))], 1)

    def encode(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Codes as rows of bytes."""
        return np.packbits((self.lifted(x, query) - self.mean) @ self.turns > 0, axis=1)


def learn(x: np.ndarray, top: float, k: int, groups: int = 2, rounds: int = 15, seed: int = 0) -> Codes:
    """Iterative quantization: rotates the principal axes until signs lose least, from `groups` random starts; then the
    least radius at which AIM of the sample's own k nearest are within reach."""
    rng = np.random.default_rng(seed)
    codes = Codes(np.zeros(x.shape[1] + 1), np.eye(x.shape[1] + 1), top, 0)
    y = codes.lifted(x, False)
    mean = y.mean(0)
    z = y - mean
    _, _, axes = np.linalg.svd(z, full_matrices=False)
    bits = -(-x.shape[1] // SUB) * SUB
    axes = axes[: min(bits, len(axes))].T
    if axes.shape[1] < bits:  # fewer vectors or dimensions than bits
        axes = np.concatenate([axes, np.zeros((len(axes), bits - axes.shape[1]))], 1)
    p, turns = z @ axes, []
    for _ in range(groups):
        turn, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(p @ turn > 0, 1.0, -1.0).T @ p)
            turn = (u @ v).T
        turns.append(axes @ turn)
    codes = Codes(mean, np.concatenate(turns, 1), top, 0)
    some = x[:: max(1, len(x) // 512)]
    q, b = codes.encode(some, True), codes.encode(x, False)
    order = np.argsort(-(some @ x.T), axis=1, kind="stable")[:, : k + 1]
    apart = np.array([np.bitwise_count(b[row] ^ code).sum(1, dtype=np.int64) for row, code in zip(order, q, strict=True)])
    return Codes(mean, codes.turns, top, int(np.quantile(apart, AIM, method="higher")) if apart.size else b.shape[1] * 8)


#: The values of a substring in the order of their bits, and how many have at most 0, 1, .. bits.
_FLIPS = np.argsort(np.bitwise_count(np.arange(1 << SUB, dtype=np.uint32)), kind="stable")
_UP_TO = np.cumsum([math.comb(SUB, k) for k in range(SUB + 1)])


class Index:
    """Codes with, for each substring, the list of the codes that hold each of its values.

    `probed` and `passed` count the searches that went through the lists, and those whose lists would have named half of
    all codes or more, so that all codes were compared in turn.
    """

    def __init__(self, codes: np.ndarray):
        wide = -(-codes.shape[1] // 8) * 8
        padded = np.zeros((len(codes), wide), dtype=np.uint8)
        padded[:, : codes.shape[1]] = codes
        self.wide, self.words, self.parts = wide, padded.view(np.uint64), self.substrings(codes)
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []
        self.probed = self.passed = 0

    @staticmethod
    def substrings(codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes).view(">u2").astype(np.int64)

    def distances(self, code: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        word = np.zeros(self.wide, dtype=np.uint8)
        word[: len(code)] = code
        return np.bitwise_count((self.words if at is None else self.words[at]) ^ word.view(np.uint64)).sum(1, dtype=np.int64)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every code within the radius. By pigeonhole such a code is within radius // substrings in some substring, and
        within one less in all substrings past the remainder; the lists of those values are probed."""
        n, m = self.parts.shape
        each, rest = divmod(radius, m)
        reach = [min(SUB, each if s <= rest else each - 1) for s in range(m)]
        named = sum(int(_UP_TO[near]) for near in reach if near >= 0)
        if 2 * named * max(n, 1 << SUB) < n << SUB:
            if not self.lists:
                for s in range(m):
                    order = np.argsort(self.parts[:, s], kind="stable")
                    self.lists.append((order, np.searchsorted(self.parts[order, s], np.arange((1 << SUB) + 1))))
            found, own = [], self.substrings(code[None, :])[0]
            for s, near in enumerate(reach):
                if near >= 0:
                    order, starts = self.lists[s]
                    values = _FLIPS[: _UP_TO[near]] ^ own[s]
                    begin, size = starts[values], starts[values + 1] - starts[values]
                    shift = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                    found.append(order[shift + np.arange(len(shift))])
            at = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            if 2 * len(at) < n:
                self.probed += 1
                at = np.unique(at)
                return at[self.distances(code, at) <= radius]
        self.passed += 1
        return np.flatnonzero(self.distances(code) <= radius)

    def nearest(self, code: np.ndarray, k: int) -> np.ndarray:
        """The k nearest codes, and all that are as near as the last of them."""
        far = self.distances(code)
        return np.flatnonzero(far <= np.partition(far, k - 1)[k - 1]) if k < len(far) else np.arange(len(far))


def best(x: np.ndarray, ids: np.ndarray, at: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of the k best of x[at], ties to the smaller id. Products are added up alike for every row,
    so that equal vectors tie."""
    scores = x[at] @ q
    if len(at) > k:
        least = np.partition(scores, len(at) - k)[len(at) - k]
        at = at[scores >= least - 1e-9 * max(1.0, abs(least))]
    scores = (x[at] * q).sum(1)
    top = np.lexsort((ids[at], -scores))[:k]
    return ids[at[top]], scores[top]


def _usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0)


def neighbours(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, sample: int = SAMPLE) -> DataFrame:
    """The k vectors of largest inner product with each query (ids divisible by `every`): query_id, rank, vec_id, score.

    Scores are inner products of the original vectors in double precision, nearest first, ties to the smaller id. The
    codes are learned from a bounded sample; every vector is coded, and the coded vectors are written to the shared
    folder once. Vectors and queries meet block by block (at most about BASE_BLOCK by QUERY_BLOCK): there the substrings'
    lists give every code within the radius, and those are reranked; where fewer than k are, the radius grows until k
    are. Blocks are dealt by a row's place in its input too, so that equal vectors and repeated ids in any number never
    gather in one task, and a query has k neighbours wherever there are as many.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids. Vectors meet
    those of their own length; where a length is rare (RARE_LENGTH), all of them. Rows that repeat an id are as many more
    vectors, and as many queries; a query never meets rows of its own id. Other columns are not read; an empty table
    gives an empty result.
    """
    spark = session(df)
    ws = Workspace(spark, "hamming")
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null").where(_usable(F.col("v")))
    rows = rows.select("vec_id", "v", F.size("v").alias("d"), F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("spread"))
    shapes = ws.table(rows.groupBy("d").agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("top")), "shapes")
    total = shapes.agg(F.sum("n")).first()[0] or 0
    shape = {r["d"]: r["top"] for r in shapes.where(F.col("n") * RARE_LENGTH >= total).collect()}  # RARE_LENGTH rows at most
    few = least_hashes(rows.where(F.col("d").isin(list(shape))), "spread", sample, total).select("d", "v").toPandas() if shape else None
    codes = {d: learn(np.stack(few["v"][few["d"] == d]), top, k) for d, top in shape.items() if (few["d"] == d).any()}
    known = spark.sparkContext.broadcast(codes)

    names = ["vec_id", "d", "spread", "v", "code", "asked"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = known.value
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for d in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                x = part.column("v").flatten().to_numpy().reshape(-1, d).astype("<f8")
                none = [b""] * len(x)
                coded = [c.tobytes() for c in codes[d].encode(x, False)] if d in codes else none
                asked = [c.tobytes() for c in codes[d].encode(x, True)] if d in codes else none
                ids = part.column("vec_id")
                asked = [c if i % every == 0 else None for c, i in zip(asked, ids.to_pylist(), strict=True)]
                cols = [ids, part.column("d"), part.column("spread"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(coded, pa.binary()), pa.array(asked, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

    coded = ws.table(rows.mapInArrow(encode, "vec_id long, d int, spread long, v binary, code binary, asked binary"), "coded")
    n_base = max(1, math.ceil(total / BASE_BLOCK), min(BLOCKS, total // 4096))
    n_query = max(1, math.ceil(total / every / QUERY_BLOCK))
    block = lambda salt, n: F.pmod(F.xxhash64("spread", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = coded.select("d", "vec_id", "v", "code", block("base", n_base).alias("b"), each(n_query).alias("q"))
    queries = coded.where("asked is not null").select("d", "vec_id", "v", "asked", "spread", block("query", n_query).alias("q"), each(n_base).alias("b"))

    def search(group: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        d, who, spreads, found, scores = int(group[0]), [], [], [], []
        if len(left) and len(right):
            codes = known.value.get(d)
            matrix = lambda column, kind, n: np.frombuffer(b"".join(column), dtype=kind).reshape(-1, n)
            ids, x, y = left["vec_id"].to_numpy(), matrix(left["v"], "<f8", d), matrix(right["v"], "<f8", d)
            everyone = np.arange(len(ids))
            if codes:
                index, asked = Index(matrix(left["code"], np.uint8, codes.turns.shape[1] // 8)), matrix(right["asked"], np.uint8, codes.turns.shape[1] // 8)
            for n, (q, own, spread) in enumerate(zip(y, right["vec_id"].tolist(), right["spread"].tolist(), strict=True)):
                at = index.within(asked[n], codes.radius) if codes else everyone
                at = at[ids[at] != own]
                if codes and len(at) < k:
                    at = index.nearest(asked[n], k + int((ids == own).sum()))
                    at = at[ids[at] != own]
                some, values = best(x, ids, at, q, k)
                found.append(some)
                scores.append(values)
                who.append(np.full(len(some), own))
                spreads.append(np.full(len(some), spread))
        parts = [np.concatenate(p) if p else np.zeros(0, dtype=t) for p, t in ((who, np.int64), (spreads, np.int64), (found, np.int64), (scores, np.float64))]
        return pd.DataFrame(dict(zip(("query_id", "spread", "vec_id", "score"), parts, strict=True)))

    found = base.groupBy("d", "b", "q").cogroup(queries.groupBy("d", "b", "q")).applyInPandas(search, "query_id long, spread long, vec_id long, score double")
    if n_base > 1:
        found = ws.table(found, "found")
        ws.drop("coded")
    ranks = Window.partitionBy("query_id", "spread").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
