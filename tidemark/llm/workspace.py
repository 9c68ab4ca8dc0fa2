"""Shared intermediate tables, and numpy arrays of fixed size summed over a whole table."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_dir

#: Rows that Spark hands a Python worker at once. Texts vary from a few bytes to many MB, so this stays small.
ROWS_PER_BATCH = "1000"


def session(df_or_spark) -> SparkSession:
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    return spark


class Workspace:
    """Tables written under the shared folder, so that a lost executor costs no more than the running stage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = shared_dir(spark, label)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_groups(ids: list, texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[list, list[str | None]]]:
    """Some MB of a batch's texts at a time, with their ids."""
    some, who, size = [], [], 0
    for i, x in zip(ids, texts, strict=True):
        t = x.as_py()
        some.append(t)
        who.append(i)
        size += len(t or "")
        if size >= most:
            yield who, some
            some, who, size = [], [], 0
    if some:
        yield who, some


#: Slots of an array that one row of partial sums holds.
SLICE = 1 << 16
#: Partial sums added up by one group of one pass.
FAN_IN = 32


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.astype("<u4").tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype="<u4").astype(np.uint64)


PARTIAL_SUMS = "slice long, who long, sums binary"


class SlotCounter:
    """A task's own counts of the slots 0..size-1, and the rows of partial sums that stand for them."""

    def __init__(self, size: int):
        self.size, self.total = size, np.zeros(size, dtype=np.uint32)

    def add(self, slots: np.ndarray) -> None:
        if len(slots) * 8 > self.size:
            self.total += np.bincount(slots, minlength=self.size).astype(np.uint32)
        elif len(slots):
            np.add.at(self.total, slots, 1)

    def rows(self) -> list[tuple[int, int, bytes]]:
        who = uuid.uuid4().int & ((1 << 62) - 1)
        parts = ((k // SLICE, self.total[k : k + SLICE]) for k in range(0, self.size, SLICE))
        return [(k, who, _pack(part)) for k, part in parts if part.any()]


def sum_slots(parts: DataFrame, size: int) -> np.ndarray:
    """Adds up PARTIAL_SUMS into one array of fixed size (so safe to hold on the driver), FAN_IN at a time: no task
    holds more than FAN_IN slices of SLICE counters. Counters saturate at 2^32 - 1."""

    def add(group):
        total = _unpack(group.sums.iloc[0])
        for b in group.sums.iloc[1:]:
            total = total + _unpack(b)
        group = group.iloc[:1].copy()
        group["sums"] = [_pack(np.minimum(total, (1 << 32) - 1))]
        return group[["slice", "who", "sums"]]

    ws = Workspace(session(parts), "sums")
    most, level = parts.groupBy("slice").count().agg(F.max("count")).first()[0] or 0, 0
    while most > FAN_IN:
        level += 1
        groups = -(-most // FAN_IN)
        parts = ws.table(parts.groupBy("slice", F.pmod(F.col("who"), F.lit(groups)).alias("part")).applyInPandas(add, PARTIAL_SUMS), f"p{level}")
        if level > 1:
            ws.drop(f"p{level - 1}")
        most = groups
    out = np.zeros(size, dtype=np.uint64)
    for r in parts.toLocalIterator():
        a = _unpack(bytes(r["sums"]))
        out[r["slice"] * SLICE : r["slice"] * SLICE + len(a)] += a
    ws.drop(f"p{level}")
    return out


def count_slots(df: DataFrame, slots_of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Counts how often each slot of 0..size-1 occurs over all rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = SlotCounter(size)
        for batch in batches:
            counter.add(slots_of(batch))
        for k, who, sums in counter.rows():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int64()), "who": pa.array([who], pa.int64()), "sums": pa.array([sums], pa.binary())})

    ws = Workspace(session(df), "slots")
    out = sum_slots(ws.table(df.mapInArrow(partial, PARTIAL_SUMS), "parts"), size)
    ws.drop("parts")
    return out


def id_slots(ids: np.ndarray, bits: int) -> np.ndarray:
    """A slot of 2^bits for each 64-bit id."""
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def id_bitmap(df: DataFrame, column: str, bits: int = 21) -> np.ndarray:
    """Booleans of a fixed number of slots: true where some id of `column` falls. Rows outside can be passed over before
    a join; what is let in by chance, the join itself drops."""
    ids = df.select(F.col(column).cast("long").alias("id")).where("id is not null")
    return count_slots(ids, lambda b: id_slots(b.column(0).to_numpy(zero_copy_only=False), bits), 1 << bits) > 0


#: Bits that ids mark, as a power of two: 2 MB, and at most 2^18 rows of 64 bits.
MARK_BITS = 24


def _slot(column: str) -> Column:
    return F.xxhash64(F.col(column).cast("long")).bitwiseAND(F.lit((1 << MARK_BITS) - 1))


def id_marks(ids: DataFrame, column: str) -> DataFrame:
    """_word, _bits: the bits that the ids mark, 64 in a row; words without any are left out. No more rows than ids, nor
    than 2^MARK_BITS / 64, however many ids there are."""
    some = ids.select(_slot(column).alias("_s"))
    return some.groupBy(F.shiftright("_s", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_s & 63 as int)))").alias("_bits"))


def by_marks(df: DataFrame, column: str, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `df` whose id in the column marks none of the bits, so is surely none of those ids, and the others,
    which may be. The marks are sent to all tasks, and no row of `df` is shuffled. Ids are not null."""
    told = df.withColumn("_s", _slot(column)).join(F.broadcast(marks), F.shiftright("_s", 6) == F.col("_word"), "left")
    is_set = F.expr("coalesce(shiftrightunsigned(_bits, cast(_s & 63 as int)) & 1, 0) = 1")
    return told.where(~is_set).select(*df.columns), told.where(is_set).select(*df.columns)


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """id, comp: for each id of the undirected edges (u, v), the smallest id that it reaches.

    Alternates large-star and small-star steps (each a min per id and a join back) until the edges stand still; every
    step is written to the shared folder, and hot ids are split by the join.
    """
    u, v = F.col("u"), F.col("v")

    def step(e: DataFrame, least: DataFrame, large: bool) -> DataFrame:
        joined = e.join(least, "u")
        if large:
            return joined.where("v > u").select(v.alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return joined.select(F.when(v == F.col("m"), u).otherwise(v).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    now = ws.table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}-0")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
    before, turn = state(now), 0
    while before[0]:
        turn += 1
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = ws.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-m{turn}")
        large = ws.table(step(both, least, True), f"{name}-l{turn}")
        least = ws.table(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-n{turn}")
        # (u, m) of every u as well as (v, m) of its other neighbours
        small = step(large, least, False).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = ws.table(small, f"{name}-{turn}")
        ws.drop(f"{name}-m{turn}", f"{name}-l{turn}", f"{name}-n{turn}", f"{name}-{turn - 1}")
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select(v.alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return now.select(u.alias("id"), v.alias("comp")).unionByName(roots)


def least_hashes(df: DataFrame, column: str, n: int, total: int) -> DataFrame:
    """The n rows of the least hashes of `column`, of `total` rows with different values there. Hashes beyond what n rows
    can need are dropped first, so that what the tasks send to the driver together is bounded by n, and not by n for each
    of them."""
    h, share = F.xxhash64(column), (n + 8 * n**0.5 + 64) / max(1, total)
    some = df if share >= 1 else df.where(h < F.lit(int(share * 2**64) - (1 << 63)))
    return some.orderBy(h, column).limit(n)
