import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions.types import BOOL, I64, I64_MAX, I64_MIN, U64, U64_MAX, Bytes, Invalid, Rows, String, Tuple, Type, encoded_len, encoded_len_column, fits, key_bytes, key_hex_column
from tidemark.operators import history as H
from tidemark.operators import scans
from tidemark.plans import replay as R
from tidemark.plans.program import Aborted, Program, Scope, admit, abort, apply_op, arg, assign, const, delete, execute, exists, insert, let, load, op, require, ret, scan, scopes, store, update, validate, var, when
from tidemark.streaming import feed


def test_types():
    t = Tuple(U64, String(3), Tuple(BOOL, Bytes(2)))
    assert Type.from_json(t.to_json()) == t and t.same_shape(Tuple(U64, String(9), Tuple(BOOL, Bytes(0))))
    assert fits((1, "éa", (True, b"xy")), t) and not fits((1, "éaa", (True, b"")), t) and not fits((-1, "", (True, b"")), t)
    assert encoded_len((1, "éa", (True, b"xy")), t) == 8 + 4 + 3 + 1 + 4 + 2
    assert encoded_len([(1, 2), (3, 4)], Rows(I64, I64, 9)) == 4 + 32
    deep = I64
    for _ in range(15):
        deep = Tuple(deep)
    with pytest.raises(Invalid):
        Tuple(deep)
    with pytest.raises(Invalid):
        Tuple(Rows(I64, I64, 1))


def test_canonical_keys_sort_as_values(spark):
    longs = [I64_MIN, -2, -1, 0, 1, 255, 256, I64_MAX]
    assert sorted(longs, key=lambda v: key_bytes(v, I64)) == longs
    texts = ["", "\x00", "\x00\x00", "\x00\x01", "\x01", "a", "a\x00", "a\x00b", "aa", "é"]
    assert sorted(texts, key=lambda v: key_bytes(v, String(9))) == sorted(texts, key=str.encode)
    pair = Tuple(String(9), I64)
    rows = [(s, n) for s in texts for n in longs]
    assert sorted(rows, key=lambda v: key_bytes(v, pair)) == sorted(rows, key=lambda v: (v[0].encode(), v[1]))
    df = spark.createDataFrame([((s, n),) for s, n in rows], "k struct<_0:string,_1:bigint>")
    got = [r[0] for r in df.select(key_hex_column(df.k, pair)).collect()]
    assert got == [key_bytes(v, pair).hex().upper() for v in rows]
    sizes = [r[0] for r in df.select(encoded_len_column(df.k, pair)).collect()]
    assert sizes == [encoded_len(v, pair) for v in rows]


EDGES = [I64_MIN, I64_MIN + 1, -3, -1, 0, 1, 2, 7, 1 << 32, I64_MAX - 1, I64_MAX]
U_EDGES = [0, 1, 2, 3, 1 << 32, (1 << 63) - 1, 1 << 63, U64_MAX - 1, U64_MAX]


@pytest.mark.parametrize("unsigned", [False, True])
def test_columns_agree_with_the_interpreter(spark, unsigned):
    from decimal import Decimal

    edges, kind = (U_EDGES, U64) if unsigned else (EDGES, I64)
    wrap = Decimal if unsigned else int
    pairs = list(itertools.product(edges, edges))
    df = spark.createDataFrame([(wrap(a), wrap(b)) for a, b in pairs], f"a {'decimal(20,0)' if unsigned else 'bigint'}, b {'decimal(20,0)' if unsigned else 'bigint'}").coalesce(1)
    columns = {"+": S.add, "-": S.sub, "*": S.mul, "/": S.div, "%": S.rem}
    bits = {"&": "and", "|": "or", "^": "xor"}
    got = df.select(*[f(df.a, df.b, unsigned).alias(str(k)) for k, f in enumerate(columns.values())], *[S.bit(df.a, df.b, w, unsigned).alias(w) for w in bits.values()]).collect()
    for (a, b), row in zip(pairs, got, strict=True):
        for name, cell in zip([*columns, *bits], row, strict=True):
            try:
                want = (apply_op(name, [a, b], [kind, kind]), 0)
            except Aborted as e:
                want = (None, e.reason)
            assert (cell["value"], cell["abort"]) == want, (name, a, b)


def test_shifts_and_conversions(spark):
    from decimal import Decimal

    df = spark.createDataFrame([(a, n) for a in EDGES for n in (0, 1, 63, 64, 70)], "a bigint, n bigint").coalesce(1)
    for row in df.select("a", "n", S.shift(df.a, df.n, True).alias("l"), S.shift(df.a, df.n, False).alias("r"), S.neg(df.a).alias("g"), S.to_u64(df.a).alias("u")).collect():
        for name, cell, args in (("<<", row.l, [row.a, row.n]), (">>", row.r, [row.a, row.n]), ("neg", row.g, [row.a]), ("to_u64", row.u, [row.a])):
            try:
                want = (apply_op(name, args, [I64]), 0)
            except Aborted as e:
                want = (None, e.reason)
            assert (cell.value, cell.abort) == want, (name, args)
    u = spark.createDataFrame([(Decimal(a), n) for a in U_EDGES for n in (0, 1, 63, 64)], "a decimal(20,0), n bigint").coalesce(1)
    for row in u.select("a", "n", S.shift(u.a, u.n, True, True).alias("l"), S.shift(u.a, u.n, False, True).alias("r"), S.bit_not(u.a, True).alias("i"), S.to_i64(u.a).alias("s")).collect():
        a = int(row.a)
        assert row.l.value == (None if row.n > 63 else (a << row.n) & U64_MAX) and row.r.value == (None if row.n > 63 else a >> row.n)
        assert row.i.value == a ^ U64_MAX and row.s.value == (a if a <= I64_MAX else None)


T = {"t": (I64, I64), "n": (I64, String(4))}


def run(body, args=None, state=None, result=None, captures=None, **how):
    p = Program(T, captures or {}, body, result or Type("unit"))
    validate(p)
    state = state or {}
    return execute(p, args or {}, lambda t, k: state.get((t, k)), lambda t: {k: v for (x, k), v in state.items() if x == t}, **how)


def c(x):
    return const(x, I64)


def test_statements():
    assert run([insert("t", c(7), c(40)), update("t", c(7), "+", c(2)), ret(load("t", c(7)))], result=I64).value == 42
    assert run([store("t", c(1), c(1)), abort(9)]).effects == []
    o = run([let("x", c(0)), when(op("==", var("x"), c(1)), [abort(1)], [assign("x", c(5))]), require(op("==", var("x"), c(6)), 77)])
    assert (o.reason, o.user_code, o.instruction) == (3, 77, 4)
    assert run([delete("t", c(5))]).effects == [("t", 5, None)]
    o = run([insert("t", c(1), c(1))], state={("t", 1): 1})
    assert o.reason == S.KEY_EXISTS
    # the skipped side can neither read nor abort
    lazy = op("&&", const(False, BOOL), op("==", op("/", c(1), c(0)), c(1)))
    assert run([ret(lazy)], result=BOOL).value is False
    assert run([ret(op("||", const(False, BOOL), op("==", op("/", c(1), c(0)), c(1))))], result=BOOL).reason == S.DIVISION_BY_ZERO
    assert run([store("n", c(1), op("concat", const("abc", String(3)), const("de", String(3))))]).reason == S.BOUND_EXCEEDED
    # effects are sorted by table and canonical key
    assert [e[:2] for e in run([store("t", c(3), c(0)), store("n", c(1), const("", String(1))), store("t", c(-3), c(0))]).effects] == [("n", 1), ("t", -3), ("t", 3)]


def test_scans():
    state = {("t", k): k * 10 for k in (1, 2, 3, 4)}
    body = [delete("t", c(2)), store("t", c(9), c(90)), let("r", scan("t", c(1), c(9), 2, 1000)), ret(op("rows_key", var("r"), const(1, U64)))]
    assert run(body, state=state, result=I64).value == 3
    assert run([ret(op("rows_len", scan("t", c(9), c(1), 5, 100)))], state=state, result=U64).value == 0  # reversed: empty
    assert run([ret(op("rows_len", scan("t", None, None, 3, 48)))], state=state, result=U64).value == 3
    o = run([ret(op("rows_len", scan("t", None, None, 3, 47)))], state=state, result=U64)
    assert (o.reason, o.detail) == (7, 14)
    assert run([ret(op("rows_value", scan("t", None, None, 3, 48), const(3, U64)))], state=state, result=I64).reason == S.INDEX_OUT_OF_BOUNDS


def test_refused_programs():
    bad = [
        [ret(c(1)), ret(c(2))],
        [store("x", c(1), c(1))],
        [ret(var("y"))],
        [store("t", const(1, U64), c(1))],
        [ret(op("+", c(1), const(1, U64)))],
        [let("x", const("abcde", String(4)))],
        [when(c(1), [ret(c(1))])],
        [when(const(True, BOOL), [let("z", c(1))]), ret(var("z"))],
        [],
    ]
    for body in bad:
        with pytest.raises(Invalid):
            validate(Program(T, {}, body, I64))
    with pytest.raises(Invalid):
        admit(Program(T, {"k": I64}, []), {"k": 1}, {15: 1 << 20})


def test_scopes():
    p = Program(T, {"k": I64, "b": BOOL}, [when(arg("b"), [store("t", arg("k"), c(1))], [let("q", load("t", c(5)))]), let("v", load("t", op("+", arg("k"), c(1)))), store("n", var("v"), const("", String(1)))])
    assert scopes(p) == {Scope("t", 0, ("arg", "k"), 2), Scope("t", 0, c(5), 1), Scope("t", 0, ("op", "+", ("arg", "k"), c(1)), 1), Scope("n", 1, None, 2)}
    joined = Program(T, {"b": BOOL}, [let("x", c(1)), when(arg("b"), [assign("x", c(2))]), ret(exists("t", var("x")))], BOOL)
    assert scopes(joined) == {Scope("t", 1, None, 1)}


@pytest.mark.parametrize(("seed", "width"), [(17, 7), (91, 50), (831, 1 << 20)])
def test_random_logs_agree_with_the_serial_referee(spark, seed, width, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", width)
    rng = random.Random(seed)
    ops = ["store", "delete", "insert", "add", "load"]
    log = [(n, rng.randint(1, 2), rng.randint(1, 5), rng.choice(ops), rng.choice([1, 5, -7, I64_MAX, I64_MIN, I64_MAX - 3])) for n in range(1, 200)]
    want = list(R.serial(log))
    df = spark.createDataFrame(log, "seq bigint, table_id bigint, key bigint, op string, arg bigint")
    for strategy in ("fold", "algebraic"):
        got = sorted(tuple(r) for r in R.replay(df, strategy).select("seq", "table_id", "key", "abort", "effect", "value").collect())
        assert got == want, strategy
    blind = [r for r in log if r[3] in ("store", "delete")]
    got = sorted(tuple(r) for r in R.blind(spark.createDataFrame(blind, df.schema)).collect())
    assert got == list(R.serial(blind))
    state = {}
    list(R.serial(log, state))
    assert {(r["table_id"], r["key"]): r["value"] for r in R.state_after(R.replay(df)).collect()} == state


def test_levels_follow_the_edges(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", 10)
    rng = random.Random(5)
    log = [(n, 1, rng.randint(1, 3), rng.choice(["store", "delete", "insert", "add", "load"]), 1) for n in range(1, 60)]
    df = spark.createDataFrame(log, "seq bigint, table_id bigint, key bigint, op string, arg bigint")
    acc = df.selectExpr("seq", "table_id", "0 as kind", "key", "op in ('insert','add','load') as reads", "op <> 'load' as writes")
    edges = {}
    for r in H.dependencies(acc).collect():
        edges.setdefault(r["dst"], []).append(r["src"])
    level = {}
    for n, *_ in log:
        level[n] = 1 + max((level[s] for s in edges[n])) if n in edges else 0
    assert {r["seq"]: r["level"] for r in R.levels(df).collect()} == level
    waits = {r["seq"]: (r["n_writers"], r["last_writer"]) for r in H.writers_before(acc).collect() if r["n_writers"]}
    assert waits == {d: (len(s), max(s)) for d, s in edges.items()}


def test_table_scopes_overlap_points(spark):
    acc = spark.createDataFrame([(1, 1, 0, 5, False, True), (2, 1, 1, None, True, False), (3, 1, 1, None, False, True), (4, 1, 0, 7, True, False), (5, 2, 0, 5, True, True)], "seq bigint, table_id bigint, kind int, key bigint, reads boolean, writes boolean")
    assert sorted(tuple(r) for r in H.dependencies(acc).collect()) == [(1, 2), (3, 4)]


def test_edges_are_counted_over_the_whole_log(spark, monkeypatch):
    """Also from a writer in one block of the log to a reader in a later one, such as 499 and 500."""
    from tidemark.operators import scans

    monkeypatch.setattr(scans, "BLOCK", 64)
    rng = random.Random(5)
    log = [(n, rng.randint(1, 3), kind := int(rng.random() < 0.2), -1 if kind else rng.randint(0, 9), (reads := rng.random() < 0.5), not reads or rng.random() < 0.1) for n in range(600)]
    log += [(1499, 9, 0, 1, False, True), (1500, 9, 0, 1, True, False), (1501, 9, 0, 2, True, False), (1502, 9, 1, -1, True, False)]
    acc = spark.createDataFrame(log, "seq bigint, table_id bigint, kind int, key bigint, reads boolean, writes boolean")
    want = {r["dst"]: r["count"] for r in H.dependencies(acc).groupBy("dst").count().collect()}
    got = {r["seq"]: r["n_writers"] for r in H.edges_before(acc).collect()}
    assert got == {n: want.get(n, 0) for n, _, _, _, reads, _ in log if reads}
    assert (got[1500], got[1501], got[1502]) == (1, 0, 1)


def test_feed_positions(spark, tmp_path):
    rows = spark.createDataFrame([(n, 1, n % 3, "put" if n % 4 else "delete", n * 10 if n % 4 else None) for n in range(1, 21)], "seq bigint, table_id bigint, key bigint, effect string, value bigint")
    view = feed.DerivedView(spark, str(tmp_path / "view"))
    assert view.apply(rows.where("seq <= 8")) == 8
    assert view.apply(rows.where("seq <= 8")) == 8  # again: nothing changes
    with pytest.raises(feed.Gap):
        view.apply(rows.where("seq >= 10"))
    assert view.apply(rows) == 20 == view.position
    want = {}
    for n in range(1, 21):
        want[n % 3] = n * 10 if n % 4 else None
    assert {r["key"]: r["value"] for r in view.rows().collect()} == {k: v for k, v in want.items() if v is not None}
    more = spark.createDataFrame([(21, 2, 1, "put", 5, 0), (22, 2, 1, None, None, 4)], "seq bigint, table_id bigint, key bigint, effect string, value bigint, abort int")
    drops = spark.createDataFrame([(1, 21)], "table_id bigint, seq bigint")
    assert view.apply(more, drops) == 22 and view.drops() == {1: 21}
    assert [(r["table_id"], r["key"], r["value"]) for r in view.rows().collect()] == [(2, 1, 5)]
    assert sorted((r["seq"], r["abort"]) for r in view.records().collect()) == [(n, 4 if n == 22 else 0) for n in range(1, 23)]
    with pytest.raises(ValueError):
        feed.DerivedView(spark, str(tmp_path / "view"), "another").apply(more)
    from pyspark.sql import functions as F

    assert feed.page_end(rows, 0, F.lit(100), 50, 450) == 4
    with pytest.raises(feed.BatchTooSmall):
        feed.page_end(rows, 0, F.lit(100), 50, 99)


def test_streamed_feed_arrives_in_batches(spark):
    rows = spark.range(1, 101).selectExpr("id as seq", "id * 2 as value")
    assert sorted(tuple(r) for r in feed.drain(spark, rows, 32).collect()) == [(n, 2 * n) for n in range(1, 101)]


def test_a_feed_without_end_follows_what_arrives(spark, tmp_path):
    """Without a frontier the stream goes as far as sequences have come without a gap, and on when more arrive."""
    path, out = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    put = lambda *seqs: spark.createDataFrame([(n, n * 2) for n in seqs], "seq bigint, value bigint").coalesce(1).write.mode("append").parquet(path)
    put(1, 2, 3, 6)
    query = feed.stream_feed(spark, path, "seq bigint, value bigint", max_records=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/mark").start()
    seen = lambda: sorted(r["seq"] for r in spark.read.schema("seq bigint, value bigint").parquet(out).collect())
    query.processAllAvailable()
    assert seen() == [1, 2, 3]
    put(4, 5)
    query.processAllAvailable()
    query.stop()
    assert seen() == [1, 2, 3, 4, 5, 6]


def test_the_frontier_ends_at_a_gap(spark):
    for seqs, open_, base, want in (([1, 2, 4], [], 0, 2), ([2, 3], [], 0, 0), ([2, 3, 4], [4], 1, 3), ([], [], 5, 5), ([6, 6, 7], [], 5, 7)):
        df = spark.createDataFrame([(n, n not in open_) for n in seqs], "seq bigint, resolved boolean")
        assert H.frontier(df, base).first()[0] == want


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from tidemark.sources import shared

    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            @staticmethod
            def getConf():  # noqa: N802
                return {}

        conf = {}

    with pytest.raises(ValueError):
        shared.shared_root(Elsewhere)
    Elsewhere.conf = {"spark.checkpoint.dir": "hdfs:///x/"}
    assert shared.shared_root(Elsewhere) == "hdfs:///x"


def test_no_task_of_a_check_grows_with_the_log(spark, monkeypatch):
    """The number of tasks of a replay and of the count of sequences follows the size of the log."""
    monkeypatch.setattr(scans, "SPREAD", 1 << 10)
    log = spark.createDataFrame([(n, 1, n % 7, "store", n) for n in range(1, 400)], "seq bigint, table_id bigint, key bigint, op string, arg bigint")
    tasks = lambda df: [int(n) for n in re.findall(r"hashpartitioning\([^\n]*?, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())]
    assert max(tasks(R.replay(log))) > 8
    told = log.unionByName(log.where("seq % 100 = 4")).where("seq % 50 <> 9")
    assert max(tasks(H.told_counts(told))) > 8
    assert tuple(H.told_counts(told).first()) == (1, 399, 391 + 4, 391)
    assert tuple(H.told_counts(told.limit(0)).first()) == (None, None, 0, 0)


def test_history_checks_find_what_is_wrong(spark):
    log = spark.createDataFrame([(1, 5, 3, False, 1), (1, 5, 9, False, 2), (2, 5, 4, True, None)], "table_id bigint, key bigint, seq bigint, is_delete boolean, value bigint")
    lives = spark.createDataFrame([(1, 8)], "table_id bigint, dropped_seq bigint")
    assert sorted(r["seq"] for r in H.outside_lifetime(log, lives).collect()) == [4, 9]
    other = log.selectExpr("table_id", "key", "seq", "is_delete", "case when seq = 9 then 7 else value end as value")
    assert [r["seq"] for r in H.effects_without_version(other, log).collect()] == [9]
    assert H.snapshot(log.limit(0), 9).count() == 0


def test_write_sets_sort_no_rows(spark, monkeypatch):
    """Ties of an ordinal take the most bytes; no aggregate sorts its input, and the tasks grow with it."""
    rng = random.Random(4)
    rows = [(rng.randrange(4), 1, rng.randrange(3), rng.randrange(1, 4), rng.random() < 0.3, "x" * rng.randrange(5)) for _ in range(120)]
    want = {}
    for tx, _, key, ordinal, gone, value in rows:
        size = 8 + (0 if gone else 4 + len(value)) + 9
        n, most = want.setdefault(tx, {}).get(key, (0, (-1, 0)))
        want[tx][key] = (n + 1, max(most, (ordinal, size)))
    df = spark.createDataFrame(rows, "tx bigint, table_id bigint, key bigint, ordinal bigint, is_delete boolean, value string")
    monkeypatch.setattr(scans, "SPREAD", 512)
    out = H.write_set(df, F.lit(8), 4 + F.length("value"))
    assert {r["tx"]: (r["point_accesses"], r["distinct_keys"], r["overlay_bytes"]) for r in out.collect()} == {tx: (sum(n for n, _ in k.values()), len(k), sum(m[1] for _, m in k.values())) for tx, k in want.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert scans.spread(df, "tx").rdd.getNumPartitions() > 4 >= scans.spread(df.limit(1), "tx").rdd.getNumPartitions()


@pytest.mark.parametrize("width", [3, 1000])
def test_asof_in_blocks(spark, width, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", width)
    rng = random.Random(2)
    log = [(1, rng.randint(1, 3), n, rng.random() < 0.3, n) for n in range(1, 60)]
    df = spark.createDataFrame(log, "table_id bigint, key bigint, seq bigint, is_delete boolean, value bigint")
    want = {}
    for _, k, n, _, _ in log:
        older = [r for r in log if r[1] == k and r[2] < n]
        want[n] = (older[-1][2], older[-1][3], older[-1][4]) if older else (None, None, None)
    got = {r["seq"]: (r["prior_seq"], *(r["prior"] or (None, None))) for r in H.asof_prior(df.select("table_id", "key", "seq"), df).collect()}
    assert got == want
