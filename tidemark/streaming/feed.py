"""Changefeeds over outcomes: pages, a streaming source with sequence offsets, and exactly-once derived views."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.sources.shared import Files, remove, shared_dir

#: Records and bytes of a page unless said otherwise.
PAGE_RECORDS, PAGE_BYTES = 1024, 256 << 20


class BatchTooSmall(ValueError):
    """The first record alone exceeds the byte limit."""

    def __init__(self, required: int):
        super().__init__(f"a page needs {required} bytes")
        self.required = required


class Gap(ValueError):
    """A feed batch whose sequences don't follow on; never late data."""


def page(outcomes: DataFrame, after: int, max_records: int = PAGE_RECORDS) -> DataFrame:
    """The first whole records after `after`; 0 records is an empty poll."""
    return outcomes.where(F.col("seq") > after).orderBy("seq").limit(max_records)


def page_end(outcomes: DataFrame, after: int, record_bytes, max_records: int = PAGE_RECORDS, max_bytes: int = PAGE_BYTES) -> int:
    """Where a page ends that holds whole records within both limits. Only max_records rows come to the driver."""
    sizes = page(outcomes, after, max_records).select("seq", record_bytes.alias("_b")).orderBy("seq").collect()
    end, total = after, 0
    for k, r in enumerate(sizes):
        total += r["_b"]
        if total > max_bytes:
            if not k:
                raise BatchTooSmall(r["_b"])
            break
        end = r["seq"]
    return end


def check_consecutive(batch: DataFrame, after: int) -> tuple[int, int]:
    """(first, last) of a batch that must be after + 1, after + 2, ... without gap or repeat."""
    r = batch.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count("*").alias("n"), F.count_distinct("seq").alias("u")).first()
    if r["n"] and (r["lo"] != after + 1 or r["n"] != r["hi"] - r["lo"] + 1 or r["u"] != r["n"]):
        raise Gap(f"{r['n']} records {r['lo']}..{r['hi']} after {after}")
    return (r["lo"], r["hi"]) if r["n"] else (after + 1, after)


class _Range(InputPartition):
    def __init__(self, path: str, after: int, end: int):
        self.path, self.after, self.end = path, after, end


class FeedReader(DataSourceStreamReader):
    """Reads (after, end] of an outcome table; offsets are {'seq': n} and batches hold at most maxRecords records. The end
    is `frontier`, or, where that isn't given, wherever the table's sequences have come without a gap.

    A consumer that restarts trusts its own view's position: it starts a new query from there by startingSequence.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.start, self.top = int(options.get("startingsequence", "0")), int(options["frontier"]) if "frontier" in options else None
        self.most, self.parts = int(options.get("maxrecords", PAGE_RECORDS)), int(options.get("partitions", "8"))
        self.at = self.start

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = min(self.at + self.most, self.arrived() if self.top is None else self.top)
        return {"seq": self.at}

    def arrived(self) -> int:
        """The end of what has come without a gap so far; looks at the next maxRecords sequences only."""
        import numpy as np

        seqs = np.unique(self.table(self.at, self.at + self.most, ["seq"]).column("seq").to_numpy())
        gaps = np.flatnonzero(seqs != self.at + 1 + np.arange(len(seqs)))
        return self.at + (int(gaps[0]) if len(gaps) else len(seqs))

    def table(self, after: int, end: int, columns: list[str] | None = None):
        """The rows of (after, end]; files are looked for anew, so those that came meanwhile are seen."""
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        return ds.dataset(path, format="parquet", filesystem=store).to_table(columns=columns, filter=(ds.field("seq") > after) & (ds.field("seq") <= end))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["seq"])
        a, z = start["seq"], end["seq"]
        width = max(1, -(-(z - a) // self.parts))
        return [_Range(self.path, k, min(k + width, z)) for k in range(a, z, width)]

    def read(self, partition: _Range):
        yield from self.table(partition.after, partition.end).sort_by("seq").to_batches()

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """format('tidemark_feed'): options path (a folder that all executors see), frontier, startingSequence, maxRecords."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_feed"

    def schema(self) -> str:
        return self.options["schema"]

    def streamReader(self, schema) -> FeedReader:  # noqa: N802
        return FeedReader(self.options)


def watermark(database_id: str, seq: int) -> str:
    """A consumer's position as text."""
    return json.dumps({"database_id": database_id, "seq": seq}, sort_keys=True)


def mirror(before: DataFrame | None, effects: DataFrame, drops: DataFrame | None = None) -> DataFrame:
    """The view after a batch: table_id, key, value. The last effect of each address in the batch wins over the view;
    deletes remove; a table's drop removes all its rows up to the drop's sequence."""
    last = effects.where("effect is not null").groupBy("table_id", "key").agg(F.max(F.struct("seq", "effect", "value")).alias("_e"))
    last = last.select("table_id", "key", F.col("_e.seq").alias("seq"), F.col("_e.effect").alias("effect"), F.col("_e.value").alias("value"))
    new = last.where("effect = 'put'").select("table_id", "key", "seq", "value")
    if before is not None:
        kept = before.join(last.select("table_id", "key"), ["table_id", "key"], "left_anti")
        new = kept.select("table_id", "key", F.lit(0).cast("bigint").alias("seq"), "value").unionByName(new)
    if drops is not None:
        ends = drops.groupBy("table_id").agg(F.max("seq").alias("_d"))
        new = new.join(ends, "table_id", "left").where(F.col("_d").isNull() | (F.col("seq") > F.col("_d")))
    return new.select("table_id", "key", "value")


def mirror_in_batches(outcomes: DataFrame, n: int) -> DataFrame:
    """The view after applying the outcomes in n consecutive batches; equal to one batch."""
    spark, path = outcomes.sparkSession, shared_dir(outcomes.sparkSession, "mirror")
    outcomes.write.parquet(path)  # what they come from runs once, not once a batch
    outcomes = spark.read.schema(outcomes.schema).parquet(path)
    top = outcomes.agg(F.max("seq")).first()[0] or 0
    view, width = None, -(-top // n) if top else 1
    for k in range(n):
        view = mirror(view, outcomes.where((F.col("seq") > k * width) & (F.col("seq") <= (k + 1) * width)))
    return view


class DerivedView:
    """A view whose rows and position are published by one rename, so a batch that comes again changes nothing.

    It lies on any file system that Spark reaches. Besides the rows it keeps a record of every sequence that it took in
    (seq and abort, aborts too) and the tables that were dropped. Acknowledge a cursor only after `apply` returned; on
    restart trust the view's own position.
    """

    def __init__(self, spark: SparkSession, root: str, database_id: str = "tidemark"):
        self.spark, self.files, self.database_id = spark, Files(spark, root), database_id

    def _current(self) -> dict:
        if not self.files.exists("CURRENT"):
            return {"database_id": self.database_id, "seq": 0, "rows": None, "records": [], "drops": {}}
        now = json.loads(self.files.read("CURRENT"))
        if now["database_id"] != self.database_id:
            raise ValueError(f"a view of {now['database_id']}")
        return now

    @property
    def position(self) -> int:
        return self._current()["seq"]

    def rows(self) -> DataFrame | None:
        at = self._current()["rows"]
        return self.spark.read.parquet(f"{self.files.root}/{at}") if at else None

    def records(self) -> DataFrame:
        """seq and abort of everything that the view took in."""
        at = self._current()["records"]
        return self.spark.read.parquet(*[f"{self.files.root}/{p}" for p in at]) if at else self.spark.createDataFrame([], "seq bigint, abort int")

    def drops(self) -> dict[int, int]:
        return {int(t): s for t, s in self._current()["drops"].items()}

    def apply(self, batch: DataFrame, drops: DataFrame | None = None) -> int:
        """Applies what of the batch lies after the position; returns the new position."""
        now = self._current()
        fresh = batch.where(F.col("seq") > now["seq"])
        first, last = check_consecutive(fresh, now["seq"])
        if last < first:
            return now["seq"]
        rows, records = f"rows-{last}", f"records-{last}"
        mirror(self.rows(), fresh, drops).write.mode("overwrite").parquet(f"{self.files.root}/{rows}")
        abort = F.col("abort") if "abort" in fresh.columns else F.lit(0)
        fresh.select("seq", abort.cast("int").alias("abort")).write.mode("overwrite").parquet(f"{self.files.root}/{records}")
        ended = {} if drops is None else {str(r["table_id"]): r["s"] for r in drops.groupBy("table_id").agg(F.max("seq").alias("s")).collect()}
        self.files.write("CURRENT", json.dumps({"database_id": self.database_id, "seq": last, "rows": rows, "records": [*now["records"], records], "drops": now["drops"] | ended}))
        return last


def stream_feed(spark: SparkSession, path: str, schema: str, frontier: int | None = None, after: int = 0, max_records: int = PAGE_RECORDS) -> DataFrame:
    """A stream of outcomes up to `frontier`, or of whatever arrives."""
    spark.dataSource.register(FeedSource)
    reader = spark.readStream.format("tidemark_feed").option("path", path).option("schema", schema).option("startingSequence", after).option("maxRecords", max_records)
    return (reader if frontier is None else reader.option("frontier", frontier)).load()


def drain(spark: SparkSession, outcomes: DataFrame, max_records: int = 1 << 20) -> DataFrame:
    """Writes the outcomes, streams them through the feed source to its end, and returns what arrived."""
    root = shared_dir(spark, "feed")
    source, out, mark = (f"{root}/{x}" for x in ("outcomes", "out", "mark"))
    outcomes.write.parquet(source)
    stored = spark.read.parquet(source)
    ends = stored.agg(F.min("seq"), F.max("seq")).first()
    if ends[0] is None:
        return stored
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema.fields)
    feed = stream_feed(spark, source, schema, ends[1], ends[0] - 1, max_records)
    query = feed.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).start()
    query.processAllAvailable()
    query.stop()
    remove(spark, source)
    return spark.read.schema(stored.schema).parquet(out)
