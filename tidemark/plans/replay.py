"""Replay of a transaction log: programs, a serial interpreter as referee, and the set-oriented strategies.

A log row has seq, table_id, key, op and arg. Programs of one address:

    store    t[k] = arg                 blind
    delete   delete t[k]                blind
    insert   insert t[k] = arg          aborts with KeyExists
    add      t[k] += arg                aborts with MissingKey or IntegerOverflow
    load     return t[k]                aborts with MissingKey

An abort keeps its sequence and has no effect. Strategies: `blind` (no reads: one select), `algebraic` (windows; proven
per address, else that address goes to the fold), `fold` (the interpreter, address by address).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import INTEGER_OVERFLOW, KEY_EXISTS, MISSING_KEY
from tidemark.functions.types import I64_MAX, I64_MIN
from tidemark.operators.scans import blocked, running, spread

READS, WRITES = ("insert", "add", "load"), ("store", "delete", "insert", "add")
OUTCOME = "seq long, table_id long, key long, abort int, effect string, value long"


def step(state: int | None, op: str, arg: int) -> tuple[int, str | None, int | None, int | None]:
    """One program against what its address holds: (abort, effect, effect's or result's value, new state)."""
    if op == "store":
        return 0, "put", arg, arg
    if op == "delete":
        return 0, "delete", None, None
    if op == "insert":
        return (0, "put", arg, arg) if state is None else (KEY_EXISTS, None, None, state)
    if state is None:
        return MISSING_KEY, None, None, None
    if op == "load":
        return 0, None, state, state
    if op != "add":
        raise ValueError(f"no program {op}")
    new = state + arg
    return (0, "put", new, new) if I64_MIN <= new <= I64_MAX else (INTEGER_OVERFLOW, None, None, state)


def serial(log: Iterable[tuple[int, int, int, str, int]], state: dict | None = None) -> Iterator[tuple]:
    """The referee: (seq, table_id, key, abort, effect, value) of each record in order; `state` is updated."""
    state = {} if state is None else state
    for seq, table_id, key, op, arg in log:
        abort, effect, value, new = step(state.get((table_id, key)), op, arg)
        if new is None:
            state.pop((table_id, key), None)
        else:
            state[table_id, key] = new
        yield seq, table_id, key, abort, effect, value


def blind(log: DataFrame) -> DataFrame:
    """Outcomes of logs of stores and deletes only: nothing is read, so no order and no shuffle are needed."""
    put = F.col("op") == "store"
    return log.select("seq", "table_id", "key", F.lit(0).alias("abort"), F.when(put, "put").otherwise("delete").alias("effect"), F.when(put, F.col("arg")).alias("value"))


def fold(log: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Outcomes by the interpreter, each address in order of seq. initial: table_id, key, value at the log's start."""

    def run(frame: pd.DataFrame, start: pd.DataFrame | None = None) -> pd.DataFrame:
        state = {} if start is None or start.empty else {(int(start.table_id.iloc[0]), int(start.key.iloc[0])): int(start.value.iloc[0])}
        frame = frame.sort_values("seq")
        rows = list(serial(frame[["seq", "table_id", "key", "op", "arg"]].itertuples(index=False, name=None), state))
        out = pd.DataFrame([r[:5] for r in rows], columns=["seq", "table_id", "key", "abort", "effect"])
        out["value"] = pd.array([r[5] for r in rows], dtype="Int64")  # never through floats
        return out

    grouped = log.groupBy("table_id", "key")
    if initial is None:
        return grouped.applyInPandas(lambda frame: run(frame), OUTCOME)
    return grouped.cogroup(initial.groupBy("table_id", "key")).applyInPandas(lambda a, b: run(a, b), OUTCOME)


def algebraic(log: DataFrame) -> DataFrame:
    """Outcomes by running values: whether an address is there follows from the last store, insert or delete (an insert
    leaves it there whether or not it aborts), and its value is the last reset's plus what was added since. All of them
    run block by block (operators.scans), so a hot address is spread over tasks. An address that leaves the 64-bit range
    goes to the fold instead, since an overflow's abort changes what follows."""
    at, op = ("table_id", "key"), F.col("op")
    sets = F.when(op.isin("store", "insert"), True).when(op == "delete", False)
    # dealt without the table: a literal one drops out of the windows' partitions, and all would be dealt again
    rows = running(spread(blocked(log.select("seq", *at, "op", "arg")), "key", "_block"), at, {"_was": ("last", sets)})
    rows = rows.withColumn("_there", F.coalesce("_was", F.lit(False)))
    wide = "decimal(38,0)"
    resets = op.isin("store", "delete") | ((op == "insert") & ~F.col("_there"))
    adds = F.when((op == "add") & F.col("_there"), F.col("arg").cast(wide)).otherwise(F.lit(0).cast(wide))
    rows = running(rows.withColumn("_adds", adds), at, {"_added": ("sum", F.col("_adds"))}, inclusive=True)
    base = F.when(resets, F.when(op == "delete", F.lit(0).cast(wide)).otherwise(F.col("arg").cast(wide)) - F.col("_added"))
    rows = running(rows, at, {"_base": ("last", base)}, inclusive=True)
    rows = rows.withColumn("_value", (F.coalesce("_base", F.lit(0).cast("decimal(38,0)")) + F.col("_added")).cast(wide))
    far = rows.groupBy(*at).agg(F.max(F.abs("_value")).alias("_most")).where(F.col("_most") > F.lit(Decimal(I64_MAX)).cast(wide)).select(*at)
    near = rows.join(far, list(at), "left_anti")
    there, value = F.col("_there"), F.expr("try_cast(_value as bigint)")
    abort = F.when((op == "insert") & there, KEY_EXISTS).when(op.isin("add", "load") & ~there, MISSING_KEY).otherwise(0)
    effect = F.when(abort != 0, None).when(op == "delete", "delete").when(op == "load", None).otherwise("put")
    done = near.select("seq", *at, abort.alias("abort"), effect.alias("effect"), F.when((abort == 0) & (op != "delete"), value).alias("value"))
    return done.unionByName(fold(log.join(far, list(at), "left_semi").select("seq", "table_id", "key", "op", "arg")))


def replay(log: DataFrame, strategy: str = "algebraic") -> DataFrame:
    return {"blind": blind, "fold": fold, "algebraic": algebraic}[strategy](log)


def state_after(outcomes: DataFrame) -> DataFrame:
    """table_id, key, seq, value of what is live after the outcomes."""
    effects = outcomes.where("effect is not null").groupBy("table_id", "key").agg(F.max(F.struct("seq", "effect", "value")).alias("_e"))
    return effects.where("_e.effect = 'put'").select("table_id", "key", F.col("_e.seq").alias("seq"), F.col("_e.value").alias("value"))


def levels(log: DataFrame) -> DataFrame:
    """The wave of each record: 0 if it waits for no earlier writer, else one more than the highest of those it waits for.
    Of one address, only a record that both reads and writes raises the wave of later readers."""
    at, reads, writes = ("table_id", "key"), F.col("op").isin(*READS), F.col("op").isin(*WRITES)
    rows = running(blocked(log), at, {"_first": ("min", F.when(writes, F.col("seq")))})
    # both reading and writing, and behind a writer: each such record is a wave of its own
    climbs = (reads & writes & F.col("_first").isNotNull()).cast("int")
    rows = running(rows, at, {"_climbed": ("sum", climbs)})
    level = F.when(reads & F.col("_first").isNotNull(), 1 + F.col("_climbed")).otherwise(0)
    return rows.select("seq", level.cast("bigint").alias("level"))
