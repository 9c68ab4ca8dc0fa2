"""Replay of general transaction programs: what shares no address, directly or through others, runs apart.

A log row has seq, program (a name) and args (a JSON object). The addresses that the whole log links are its components.
Each component runs in one stream in order of seq by the serial interpreter, side by side with the others, and only its
addresses are held, not its records. A component with more than a SHARE of the log or more than HELD addresses goes by
epochs of `window` records instead, one after another, since within an epoch its transactions may fall apart into smaller
groups; there, reads come by a join with the newest versions of the addresses that the epoch names. Neither the state nor
the log is ever on the driver.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.functions.types import Invalid, fits, key_bytes
from tidemark.operators import history as H
from tidemark.plans.program import CEILINGS, Program, execute, key_type, scopes, validate
from tidemark.sources.shared import shared_dir
from tidemark.sources.store import _plain, _typed

#: Records of an epoch unless said otherwise: the most that the task which finds the groups takes.
WINDOW = 1 << 16
#: A component of more than this share of the log (and more than an epoch), or of more addresses, goes by epochs.
SHARE, HELD = 1 / 8, 1 << 18
#: Tasks of the components, so that few of the large ones meet in one. Epochs after which the state is made compact.
TASKS, COMPACT = 200, 16
EFFECTS = "array<struct<table_id:bigint,key_hex:string,key:string,is_delete:boolean,value:string>>"
OUTCOMES = f"seq long, status string, reason int, instruction int, user_code long, detail int, result string, effects {EFFECTS}"
NAMES = ["seq", "status", "reason", "instruction", "user_code", "detail", "result", "effects"]
SPANS = "seq long, program string, args string, touches array<struct<table_id:bigint,key_hex:string>>"
STATE = "table_id long, key_hex string, seq long, is_delete boolean, key string, value string"


def keys_of(p: Program) -> list[tuple[str, tuple, Program]]:
    """Each different key of a program's point scopes: its table, its expression and a program that returns it."""
    return [(t, e, Program({}, p.captures, [("return", e)], key_type(p, e))) for t, e in sorted({(s.table, s.key) for s in scopes(p)}, key=repr)]


def addresses(p: Program, tables: Mapping[str, int], args: Mapping[str, object], keys: list | None = None) -> list[tuple[int, str]]:
    """The addresses that a transaction may touch, as table ids and canonical keys in hexadecimal. keys: keys_of(p)."""
    out = set()
    for table, e, returns in keys_of(p) if keys is None else keys:
        if e[0] == "arg" and fits(args.get(e[1]), p.captures[e[1]]):
            value = args[e[1]]
        else:
            o = execute(returns, args, None)
            if o.status != "success":  # a key that can't be computed aborts the transaction before it is used
                continue
            value = o.value
        out.add((tables[table], key_bytes(value, p.tables[table][0]).hex().upper()))
    return sorted(out)


def components(links: DataFrame, where: str) -> DataFrame:
    """node, root of the components of links (u, v; u = v for a node alone), root being the smallest node. Stars are made
    larger and smaller by turns until nothing changes, in rounds that grow with the logarithm of the nodes squared at most."""
    spark, low = links.sparkSession, F.min("v").alias("m")
    links.write.parquet(f"{where}/links")
    links = spark.read.schema("u string, v string").parquet(f"{where}/links")
    nodes = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    now, mark, n = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(both.groupBy("u").agg(low), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(low)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small.write.parquet(f"{where}/stars/{n}")
        now = spark.read.schema("u string, v string").parquet(f"{where}/stars/{n}")
        was, mark, n = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first(), n + 1
        if was == mark:
            return nodes.join(now.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("root"))


def replay_programs(log: DataFrame, programs: Mapping[str, Program], tables: Mapping[str, int], initial: DataFrame | None = None, window: int = WINDOW, policy: Sequence[tuple[int, Mapping[int, int]]] = ()) -> DataFrame:
    """The outcome of every record, equal to running the log in order: seq, status, reason, instruction, user_code,
    detail, result (JSON) and effects.

    initial: table_id, key_hex, seq, is_delete, key, value (JSON) before the log. policy: (seq, limits) from which on
    limits hold. Programs whose scopes take a whole table are refused: they would serialise their epoch.
    """
    for name, p in programs.items():
        validate(p)
        if any(s.kind == 1 for s in scopes(p)):
            raise Invalid(f"{name} takes a whole table")
    spark, where = log.sparkSession, shared_dir(log.sparkSession, "waves")
    changes = sorted(policy)
    starts, tables = [s for s, _ in changes], dict(tables)
    types = {tables[t]: kv for p in programs.values() for t, kv in p.tables.items()}
    keys = {name: keys_of(p) for name, p in programs.items()}
    held_limits = [CEILINGS, *({**CEILINGS, **limits} for _, limits in changes)]

    def typed_args(name: str, text: str) -> dict:
        plain = json.loads(text)
        return {k: _typed(plain[k], t) for k, t in programs[name].captures.items()}

    arrow = {ddl: to_arrow_schema(StructType.fromDDL(ddl)) for ddl in (SPANS, OUTCOMES)}

    def batch(ddl: str, columns: Iterable) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow[ddl], strict=True)], schema=arrow[ddl])

    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs, names, texts = (c.to_pylist() for c in b.columns)
            found = [[{"table_id": t, "key_hex": k} for t, k in addresses(programs[n], tables, typed_args(n, a), keys[n])] for n, a in zip(names, texts, strict=True)]
            yield batch(SPANS, (seqs, names, texts, found))

    spans = log.select("seq", "program", "args").mapInArrow(analyse, SPANS)
    spans.write.parquet(f"{where}/spans")
    spans = spark.read.schema(spans.schema).parquet(f"{where}/spans")
    (initial if initial is not None else spark.createDataFrame([], STATE)).select(*[c.split()[0] for c in STATE.split(", ")]).write.parquet(f"{where}/state/0")
    parts = [f"{where}/state/0"]

    def outcome(seq: int, name: str, args: str, held: dict) -> tuple:
        """A record's outcome against what is held (table id, key: value), which is brought up to date."""
        p, limits = programs[name], held_limits[bisect_right(starts, seq)]
        o = execute(p, typed_args(name, args), lambda t, k: held.get((tables[t], k)), None, limits)
        effects = []
        for t, k, v in o.effects:
            effects.append({"table_id": tables[t], "key_hex": key_bytes(k, p.tables[t][0]).hex().upper(), "key": json.dumps(_plain(k)), "is_delete": v is None, "value": None if v is None else json.dumps(_plain(v))})
            if v is None:
                held.pop((tables[t], k), None)
            else:
                held[tables[t], k] = v
        result = json.dumps(_plain(o.value)) if o.status == "success" else None
        return seq, o.status, o.reason, o.instruction, o.user_code, o.detail, result, effects

    def known(table_id: int, key: str, value: str) -> tuple:
        return (table_id, _typed(json.loads(key), types[table_id][0])), _typed(json.loads(value), types[table_id][1])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by component and seq, those of the state first."""
        now, held = None, {}
        for b in batches:
            rows = []
            for home, seq, name, args, table_id, key, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if home != now:
                    now, held = home, {}
                if name is None:
                    address, value = known(table_id, key, value)
                    held[address] = value
                else:
                    rows.append(outcome(seq, name, args, held))
            if rows:
                yield batch(OUTCOMES, zip(*rows, strict=True))

    def grouped(frame: pd.DataFrame) -> pd.DataFrame:
        """Groups of an epoch's records by union-find over what they touch."""
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for seq, touches in zip(frame["seq"], frame["touches"], strict=True):
            for t in touches:
                root[find((t["table_id"], t["key_hex"]))] = find(seq)
        return pd.DataFrame({"seq": frame["seq"], "grp": [find(s) for s in frame["seq"]]})

    def run(frame: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        held = dict(known(*row) for row in state[["t", "k", "v"]].itertuples(index=False, name=None))
        return pd.DataFrame([outcome(r.seq, r.program, r.args, held) for r in frame.sort_values("seq").itertuples()], columns=NAMES)

    node = lambda t: F.concat(t["table_id"].cast("string"), F.lit(":"), t["key_hex"])
    first = F.coalesce(node(F.get("touches", F.lit(0))), F.concat(F.lit("#"), F.col("seq").cast("string")))
    components(spans.select(first.alias("u"), F.explode("touches").alias("t")).select("u", node(F.col("t")).alias("v")).distinct(), where).write.parquet(f"{where}/roots")
    roots = spark.read.schema("node string, root string").parquet(f"{where}/roots")
    # a record without any address is a component of its own
    homed = spans.withColumn("node", first).join(roots, "node", "left").withColumn("home", F.coalesce("root", "node")).drop("node", "root")
    most = max(window, int(spans.count() * SHARE))
    large = homed.groupBy("home").agg(F.count("*").alias("n")).where(F.col("n") > most).select("home")
    large = large.unionByName(roots.groupBy(F.col("root").alias("home")).agg(F.count("*").alias("n")).where(F.col("n") > HELD).select("home")).distinct()
    large.write.parquet(f"{where}/large")
    large = spark.read.schema("home string").parquet(f"{where}/large")

    before = H.latest(spark.read.schema(STATE).parquet(*parts), None, ("table_id", "key_hex"), ("is_delete", "key", "value")).where("not is_delete")
    before = before.withColumn("node", F.concat(F.col("table_id").cast("string"), F.lit(":"), "key_hex")).join(roots, "node").withColumnRenamed("root", "home")
    nothing = F.lit(None).cast("string")
    rows = homed.select("home", F.lit(1).alias("turn"), "seq", "program", "args", F.lit(0).cast("bigint").alias("table_id"), nothing.alias("key"), nothing.alias("value"))
    rows = rows.unionByName(before.select("home", F.lit(0).alias("turn"), "seq", nothing.alias("program"), nothing.alias("args"), "table_id", "key", "value"))
    rows = rows.join(large, "home", "left_anti").repartition(max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions"))), "home").sortWithinPartitions("home", "turn", "seq")
    rows.drop("turn").mapInArrow(stream, OUTCOMES).write.parquet(f"{where}/outcomes/part=0")
    if large.isEmpty():
        return spark.read.schema(OUTCOMES).parquet(f"{where}/outcomes")

    homed.join(large, "home", "left_semi").drop("home").write.parquet(f"{where}/linked")
    spans = spark.read.schema(spans.schema).parquet(f"{where}/linked")
    epoch, tasks = F.floor(F.col("seq") / window), 2 * spark.sparkContext.defaultParallelism
    epochs = sorted(r[0] for r in spans.select(epoch).distinct().collect())
    for n, at in enumerate(epochs, 1):
        now = spans.where((F.col("seq") >= at * window) & (F.col("seq") < (at + 1) * window))
        groups = now.select("seq", "touches", F.lit(0).alias("_one")).groupBy("_one").applyInPandas(lambda f: grouped(f), "seq long, grp long")
        groups.write.parquet(f"{where}/groups/part={n}")
        now = now.join(spark.read.schema("seq long, grp long").parquet(f"{where}/groups/part={n}"), "seq")
        wanted = now.select(F.col("grp").alias("home"), F.explode("touches").alias("t")).select("home", "t.*").distinct()
        state = spark.read.schema(STATE).parquet(*parts).join(wanted, ["table_id", "key_hex"])
        state = H.latest(state, None, ("home", "table_id", "key_hex"), ("is_delete", "key", "value")).where("not is_delete")
        state = state.select(F.col("home").alias("of"), F.col("table_id").alias("t"), F.col("key").alias("k"), F.col("value").alias("v"))
        done = now.select("grp", "seq", "program", "args").repartition(tasks, "grp").groupBy("grp").cogroup(state.repartition(tasks, "of").groupBy("of")).applyInPandas(run, OUTCOMES)
        done.write.parquet(f"{where}/outcomes/part={n}")
        fresh = spark.read.schema(OUTCOMES).parquet(f"{where}/outcomes/part={n}").select("seq", F.explode("effects").alias("e"))
        fresh.select("e.table_id", "e.key_hex", "seq", "e.is_delete", "e.key", "e.value").write.parquet(f"{where}/state/{n}")
        parts.append(f"{where}/state/{n}")
        if len(parts) > COMPACT:  # else each epoch would read all versions since the first
            H.latest(spark.read.schema(STATE).parquet(*parts), None, ("table_id", "key_hex"), ("is_delete", "key", "value")).where("not is_delete").write.parquet(f"{where}/state/{n}-all")
            parts = [f"{where}/state/{n}-all"]
    return spark.read.schema(OUTCOMES).parquet(f"{where}/outcomes")
