"""A quality classifier of sparse rules: tree paths over text statistics, lasso logistic weights, Spark columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import least_hashes, session

#: Labelled rows that the fit reads at most; beyond it, those with the smallest hashes of their ids are taken.
SAMPLE = 20_000
#: Scores of at least this predict label 1.
CUT = 0.3

#: Statistics of a text. All are numbers of the text alone.
STATS = ("bytes", "words", "word_bytes", "long_words", "upper", "digits", "stops", "marks", "shout", "symbols", "bars", "lines", "line_bytes", "same_lines", "distinct_words", "top_word", "same_triples", "wide", "marked_words", "short_words")

_CLASS = np.zeros(256, dtype=np.int64)
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:'\"?()-", b"!", b"#$%&*@^~=+<>\\/{}[]_`", b"|", b"\n", b" \t\r\x0b\x0c", range(128, 256)), 1):
    _CLASS[list(_bytes)] = _k


def statistics(text: str) -> tuple[float, ...]:
    """The STATS of a text; an empty text has zeros."""
    b = text.encode()
    words = b.split()
    if not words:
        return (float(len(b)), *[0.0] * (len(STATS) - 1))
    n, w = len(b), len(words)
    by = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256), minlength=11)
    letters = max(1.0, by[1] + by[2] + by[10])
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=w)
    _, codes, counts = np.unique(np.fromiter(map(hash_word, words), dtype=np.int64, count=w), return_inverse=True, return_counts=True)
    lines = [x for x in b.split(b"\n") if x]
    triples = 0.0
    if w > 2:
        _, pairs = np.unique(codes[:-1] * w + codes[1:], return_inverse=True)
        triples = 1 - len(np.unique(pairs[:-1] * w + codes[2:])) / (w - 2)
    marked = sum(1 for x in words if x[-1] in b"#$%&*!|")
    return (float(n), float(w), sizes.mean(), (sizes > 12).mean(), by[1] / letters, by[3] / n, by[4] / w, (by[5] + by[6] + by[7]) / n, by[5] / w, by[6] / w, by[7] / w, float(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), len(counts) / w, counts.max() / w, triples, by[10] / letters, marked / w, (sizes <= 3).mean())


def hash_word(word: bytes) -> int:
    return hash(word)


def with_statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep`, and the statistics of the text as the struct `_stats`."""
    session(df)
    kept = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text"))
    schema = "struct<" + ",".join(f"{s}:double" for s in STATS) + ">"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(x.as_py() or "") for x in batch.column(len(keep))], dtype=np.float64).reshape(-1, len(STATS))
            stats = pa.StructArray.from_arrays([pa.array(rows[:, j]) for j in range(len(STATS))], names=list(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], stats], [*[f"_k{i}" for i in range(len(keep))], "_stats"])

    fields = [f"_k{i} {kept.schema[f'_k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    out = kept.mapInArrow(run, ", ".join([*fields, f"_stats {schema}"]))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "_stats")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether above, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for j, above, t in self.terms:
            out &= (x[:, j] > t) if above else (x[:, j] <= t)
        return out

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for j, above, t in self.terms:
            c = stats[STATS[j]]
            out = out & ((c > F.lit(t)) if above else (c <= F.lit(t)))
        return out


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in self.rules:
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: Column) -> Column:
        z = F.lit(self.bias)
        for rule, w in self.rules:
            z = z + F.when(rule.column(stats), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], codes: np.ndarray, columns: np.ndarray, depth: int, least: int) -> list[tuple[Rule, np.ndarray, float]]:
    """Leaves of a regression tree on the gradients: (path, rows, value)."""
    leaves = []

    def grow(rows: np.ndarray, path: tuple, left: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None, None)
        if left and len(rows) >= 2 * least:
            for j in columns.tolist():
                size = len(cuts[j]) + 1
                if size < 2:
                    continue
                c = codes[rows, j]
                gs, hs, ns = (np.cumsum(np.bincount(c, weights=v, minlength=size))[:-1] for v in (grad[rows], hess[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        if best[1] is None:
            if path:
                leaves.append((Rule(path), rows, -g / (h + 1)))
            return
        _, j, k = best
        t = float(cuts[j][k])
        low = codes[rows, j] <= k
        grow(rows[low], (*path, (j, False, t)), left - 1)
        grow(rows[~low], (*path, (j, True, t)), left - 1)

    grow(np.arange(len(x)), (), depth)
    return leaves


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 64, penalty: float = 2e-4, steps: int = 600, seed: int = 0) -> Ensemble:
    """Rules from boosted trees (each on a random half of the statistics), then weights by lasso logistic regression.

    With no rows, or with labels of one kind only, the ensemble is a constant.
    """
    x, y = np.asarray(x, dtype=np.float64).reshape(-1, len(STATS)), np.asarray(y, dtype=np.float64)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(rate / (1 - rate)))
    if len(y) < 20 or y.min() == y.max():
        return Ensemble(bias, ())
    rng = np.random.default_rng(seed)
    cuts = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        cuts.append(q[q < x[:, j].max()])
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    rules, z = {}, np.full(len(y), bias)
    least = max(5, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        columns = np.sort(rng.choice(x.shape[1], size=-(-x.shape[1] // 2), replace=False))
        for rule, rows, value in _tree(x, p - y, p * (1 - p), cuts, codes, columns, depth, least):
            z[rows] += 0.3 * value
            for k in range(1, len(rule.terms) + 1):
                rules[Rule(rule.terms[:k])] = None
    found = {}
    for r in rules:
        hits = r.holds(x)
        if 0 < hits.sum() < len(y):
            found.setdefault(np.packbits(hits).tobytes(), (r, hits))
    rules = [r for r, _ in found.values()]
    m = np.stack([h for _, h in found.values()], 1).astype(np.float32)
    # accelerated proximal gradient steps; the bias is not penalised
    mean = m.mean(0)
    m -= mean
    step = 4 / (np.linalg.eigvalsh(m.T @ m)[-1] / len(y) + 1)
    y = y.astype(np.float32)
    w = v = np.zeros(m.shape[1], dtype=np.float32)
    b = u = bias
    t = 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(m @ v + np.float32(u)))) - y
        new = v - np.float32(step / len(y)) * (r @ m)
        new = np.sign(new) * np.maximum(np.abs(new) - np.float32(step * penalty), 0)
        nb = u - step * float(r.mean())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, u = new + np.float32((t - 1) / nt) * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    kept = [(r, float(c)) for r, c in zip(rules, w, strict=True) if abs(c) > 1e-4]
    return Ensemble(float(b - mean @ w), tuple(kept))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Ensemble:
    """Fits on at most `sample` labelled ids that are not held out.

    Ids with labels of both kinds are left out. Where rows repeat an id, one of them counts, that of the least
    statistics; so what reaches the driver is bounded by `sample` whatever repeats.
    """
    rows = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(~held_out(F.col("_id")))
    rows = rows.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").drop("_z")
    rows = least_hashes(rows, "_id", sample, rows.count())
    some = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(rows), "_id")
    one = with_statistics(some, "_text", ["_id", "_y"]).groupBy("_id", "_y").agg(F.min("_stats").alias("_stats"))
    got = one.select("_id", "_y", "_stats.*").toPandas().sort_values(["_id", *STATS], ignore_index=True)
    return fit(got[list(STATS)].to_numpy(), got["_y"].to_numpy())


def score_documents(docs: DataFrame, model: Ensemble, key: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Scores depend on the text alone; a null text is scored as an empty one. Repeated rows get equal scores, a row with a
    null id is scored and not held out, other columns are not read, and an empty table gives an empty result.
    """
    out = with_statistics(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_t")), "_t", ["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), model.column(F.col("_stats")).alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, model: Ensemble, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of `docs`, with all their columns, that the model scores at least `cut`."""
    scored = with_statistics(docs, text, docs.columns)
    return scored.where(model.column(F.col("_stats")) >= cut).select(*docs.columns)
