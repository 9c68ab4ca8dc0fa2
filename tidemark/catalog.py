"""The registry of queries over the sample tables, with the SQL each must equal.

`events` stands in for a version log (seq = event_id + 2, key user_id, 'error' a tombstone) and for a transaction log
(click store, signup insert, purchase add, view load, error delete); `orders`, `customer`, `part` and `documents` for
keyed tables and byte strings. Outputs are integers, booleans and strings only.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions.types import I64, U64, Bytes, String, Tuple, encoded_len_column, from_bit_pattern, key_hex_column
from tidemark.operators import history as H
from tidemark.plans import replay as R
from tidemark.sources.shared import shared_dir

_REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def _query(sql: str | None):
    def add(f):
        _REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def versions(spark: SparkSession, d: str) -> DataFrame:
    """events as a version log of table 1."""
    return _table(spark, d, "events").select(F.lit(1).cast("bigint").alias("table_id"), F.col("user_id").alias("key"), (F.col("event_id") + 2).alias("seq"), (F.col("event_type") == "error").alias("is_delete"), F.struct(F.col("event_type").alias("t"), _cents("value").alias("cents")).alias("value"))


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """events as a transaction log of table 1."""
    kind = F.col("event_type")
    op = F.when(kind == "click", "store").when(kind == "signup", "insert").when(kind == "purchase", "add").when(kind == "view", "load").otherwise("delete")
    return _table(spark, d, "events").select((F.col("event_id") + 2).alias("seq"), F.lit(1).cast("bigint").alias("table_id"), F.col("user_id").alias("key"), op.alias("op"), _cents("value").alias("arg"))


_V = "v AS (SELECT event_id + 2 AS seq, user_id AS key, event_type = 'error' AS is_delete, event_type AS t, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
_T = "tx AS (SELECT event_id + 2 AS seq, user_id AS key, CASE event_type WHEN 'click' THEN 'store' WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'add' WHEN 'view' THEN 'load' ELSE 'delete' END AS op, CAST(round(value * 100) AS BIGINT) AS arg FROM events)"
_REPLAY = (
    _T
    + """, a AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('store','insert') THEN true WHEN op = 'delete' THEN false END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS there FROM tx),
b AS (SELECT *, sum(CASE WHEN op IN ('store','delete') OR (op = 'insert' AND NOT there) THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS run FROM a),
c AS (SELECT *, sum(CASE WHEN op = 'store' OR (op = 'insert' AND NOT there) OR (op = 'add' AND there) THEN arg ELSE 0 END) OVER (PARTITION BY key, run ORDER BY seq) AS total,
 CASE WHEN op = 'insert' AND there THEN 2 WHEN op IN ('add','load') AND NOT there THEN 1 ELSE 0 END AS abort FROM b),
outcomes AS (SELECT seq, key, abort, CASE WHEN abort <> 0 OR op = 'load' THEN NULL WHEN op = 'delete' THEN 'delete' ELSE 'put' END AS effect, CASE WHEN abort = 0 AND op <> 'delete' THEN CAST(total AS BIGINT) END AS value FROM c)"""
)


def _flat(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.col("value.t").alias("t"), F.col("value.cents").alias("cents"))


# ---- snapshots, scans, as-of lookups ----


@_query(f"WITH {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM v WHERE seq <= 5000) SELECT key, seq, t, cents FROM r WHERE n = 1 AND NOT is_delete")
def mvcc_snapshot(spark, d):
    return _flat(H.snapshot(versions(spark, d), 5000, 1), "key", "seq")


@_query(f"WITH {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM v WHERE seq <= 7500 AND key IN (3, 17, 42, 99)) SELECT key, seq, t, cents FROM r WHERE n = 1 AND NOT is_delete")
def mvcc_point_get(spark, d):
    return _flat(H.point_get(versions(spark, d), 7500, 1, [3, 17, 42, 99]), "key", "seq")


@_query(f"WITH {_V}, s AS (SELECT UNNEST([0, 100, 2500, 5000, 1000000]) AS pos), r AS (SELECT pos, v.*, row_number() OVER (PARTITION BY pos, key ORDER BY seq DESC) AS n FROM v JOIN s ON v.seq <= s.pos) SELECT CAST(pos AS BIGINT) AS pos, count(*) AS live, CAST(sum(cents) AS BIGINT) AS cents FROM r WHERE n = 1 AND NOT is_delete GROUP BY pos")
def snapshots_at_many_sequences(spark, d):
    log = versions(spark, d)
    parts = [_flat(H.snapshot(log, at, 1), "key").select(F.lit(at).cast("bigint").alias("pos"), "cents") for at in (0, 100, 2500, 5000, 1000000)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("pos").agg(F.count("*").alias("live"), F.sum("cents").alias("cents"))


@_query(f"WITH {_V} SELECT key, seq, max(seq) OVER w AS prior_seq, last_value(is_delete) OVER w AS prior_delete, last_value(cents) OVER w AS prior_cents FROM v WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def mvcc_history_asof_prior(spark, d):
    log = versions(spark, d)
    out = H.asof_prior(log.select("table_id", "key", "seq"), log)
    return out.select("key", "seq", "prior_seq", F.col("prior.is_delete").alias("prior_delete"), F.col("prior.value.cents").alias("prior_cents"))


@_query(f"WITH {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM v WHERE seq < 6000 AND key >= 20 AND key < 120) SELECT key, cents, row_number() OVER (ORDER BY key) AS ordinal FROM r WHERE n = 1 AND NOT is_delete ORDER BY key LIMIT 25")
def range_scan_row_limit(spark, d):
    rows = H.bounded_scan(versions(spark, d), 6000, 1, 20, 120, 25, 1 << 20, F.lit(16))
    return rows.select("key", F.col("value.cents").alias("cents"), F.col("ordinal").cast("bigint").alias("ordinal"))


@_query(f"WITH {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM v WHERE seq < 6000), l AS (SELECT key, t FROM r WHERE n = 1 AND NOT is_delete ORDER BY key LIMIT 100), s AS (SELECT key, CAST(sum(8 + 4 + strlen(t) + 8) OVER (ORDER BY key) AS BIGINT) AS bytes_so_far FROM l) SELECT key, bytes_so_far, bytes_so_far > 1500 AS over_limit FROM s")
def range_scan_byte_limit(spark, d):
    size = F.lit(8) + encoded_len_column(F.struct(F.col("value.t").alias("_0"), F.col("value.cents").alias("_1")), Tuple(String(16), I64))
    return H.bounded_scan(versions(spark, d), 6000, 1, None, None, 100, 1500, size).select("key", "bytes_so_far", "over_limit")


@_query(f"WITH {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM v WHERE seq <= 8000), l AS (SELECT key FROM r WHERE n = 1 AND NOT is_delete) SELECT f.flags, count(key) AS n, min(key) AS low, max(key) AS high FROM (VALUES ('ii', 10, 60, true, true), ('ie', 10, 60, true, false), ('ei', 10, 60, false, true), ('ee', 10, 60, false, false), ('eq', 30, 30, true, true), ('no', 30, 30, true, false)) f(flags, lo, hi, li, hi_in) LEFT JOIN l ON (key > lo OR (li AND key = lo)) AND (key < hi OR (hi_in AND key = hi)) GROUP BY f.flags")
def scan_endpoint_flags(spark, d):
    log, out = versions(spark, d), None
    for flags, lo, hi, li, ri in (("ii", 10, 60, True, True), ("ie", 10, 60, True, False), ("ei", 10, 60, False, True), ("ee", 10, 60, False, False), ("eq", 30, 30, True, True), ("no", 30, 30, True, False)):
        one = H.snapshot_scan(log, 8000, 1, lo, hi, li, ri).agg(F.count("key").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).select(F.lit(flags).alias("flags"), "n", "low", "high")
        out = one if out is None else out.unionByName(one)
    return out


@_query("WITH o AS (SELECT o_orderkey % 2000 AS key, o_orderkey AS seq, o_orderstatus = 'F' AS gone, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM o) WHERE n = 1), b AS (SELECT c_custkey AS key, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer) SELECT coalesce(w.key, b.key) AS key, CASE WHEN w.key IS NULL THEN b.cents ELSE w.cents END AS cents FROM b FULL JOIN w ON b.key = w.key WHERE w.key IS NULL OR NOT w.gone")
def overlay_merge(spark, d):
    base = _table(spark, d, "customer").select(F.col("c_custkey").alias("key"), _cents("c_acctbal").alias("value"))
    writes = _table(spark, d, "orders").select((F.col("o_orderkey") % 2000).alias("key"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "F").alias("is_delete"), _cents("o_totalprice").alias("value"))
    return H.overlay_merge(base, H.latest(writes, None, ("key",)).drop("seq"), ("key",)).select("key", F.col("value").alias("cents"))


_DDL = "c AS (SELECT o_custkey AS table_id, o_orderkey AS seq, o_orderstatus <> 'F' AS live, o_orderpriority AS name FROM orders)"


def _catalogue(spark, d):
    return _table(spark, d, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") != "F").alias("live"), F.col("o_orderpriority").alias("name"))


@_query(f"WITH {_DDL}, r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY seq DESC) AS n FROM c WHERE seq <= 9000) SELECT table_id, seq, live, name FROM r WHERE n = 1")
def catalogue_asof(spark, d):
    return H.catalogue_asof(_catalogue(spark, d), 9000)


@_query(f"WITH {_DDL}, r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY seq DESC) AS n FROM c WHERE seq <= 9000) SELECT name, count(*) AS tables, CAST(sum(table_id) AS BIGINT) AS ids FROM r WHERE n = 1 AND live GROUP BY name")
def catalogue_live_names(spark, d):
    return H.catalogue_asof(_catalogue(spark, d), 9000, live_only=True).groupBy("name").agg(F.count("*").alias("tables"), F.sum("table_id").alias("ids"))


@_query("WITH p AS (SELECT p_partkey * 7 AS seq, CAST(p_size AS BIGINT) AS rows_limit FROM part), e AS (SELECT event_id + 2 AS seq FROM events) SELECT e.seq, p.rows_limit FROM e ASOF LEFT JOIN p ON e.seq > p.seq")
def policy_per_record(spark, d):
    """The limits that each record of the log runs under."""
    policy = _table(spark, d, "part").select((F.col("p_partkey") * 7).alias("seq"), F.col("p_size").cast("bigint").alias("limits"))
    return H.policies_for(_table(spark, d, "events").select((F.col("event_id") + 2).alias("seq")), policy).select("seq", F.col("limits").alias("rows_limit"))


@_query(f"WITH {_DDL}, e AS (SELECT event_id + 2 AS seq, user_id AS table_id FROM events) SELECT e.seq, e.table_id, c.seq AS entry_seq, c.live, c.name FROM e ASOF LEFT JOIN c ON e.table_id = c.table_id AND e.seq > c.seq")
def schema_per_record(spark, d):
    """The catalogue entry that each record of the log is bound to."""
    log = _table(spark, d, "events").select((F.col("event_id") + 2).alias("seq"), F.col("user_id").alias("table_id"))
    return H.schemas_for(log, _catalogue(spark, d)).select("seq", "table_id", F.col("entry.seq").alias("entry_seq"), "entry.live", "entry.name")


@_query("WITH p AS (SELECT p_partkey AS seq, CAST(p_size AS BIGINT) AS l FROM part) SELECT seq, l AS rows_limit, l * 64 AS bytes_limit FROM p WHERE seq <= 777 ORDER BY seq DESC LIMIT 1")
def policy_asof(spark, d):
    size = F.col("p_size").cast("bigint")
    policy = _table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.array(size, size * 64).alias("limits"))
    return H.policy_asof(policy, 777).select("seq", F.col("limits")[0].alias("rows_limit"), F.col("limits")[1].alias("bytes_limit"))


@_query("SELECT o_orderkey AS seq, o_custkey AS key, CASE WHEN c_custkey IS NULL THEN 1 ELSE 0 END AS abort, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey")
def lookup_computed_key(spark, d):
    live = _table(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("key"), _cents("c_acctbal").alias("cents"))
    out = _table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("key")).join(live.withColumn("_hit", F.lit(True)), "key", "left")
    return out.select("seq", "key", F.when(F.col("_hit").isNull(), S.MISSING_KEY).otherwise(0).alias("abort"), "cents")


@_query("WITH o AS (SELECT o_orderkey AS seq, o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), e AS (SELECT DISTINCT c_custkey AS key FROM customer WHERE c_nationkey < 10) SELECT o.seq, o.key, CASE WHEN e.key IS NOT NULL OR n > 1 THEN 2 ELSE 0 END AS abort FROM o LEFT JOIN e ON o.key = e.key")
def exists_insert_guard(spark, d):
    there = _table(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("key"), F.lit(True).alias("_there"))
    first = Window.partitionBy("key").orderBy("seq")
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("key")).withColumn("_n", F.row_number().over(first))
    out = rows.join(there, "key", "left")
    return out.select("seq", "key", F.when(F.col("_there").isNotNull() | (F.col("_n") > 1), S.KEY_EXISTS).otherwise(0).alias("abort"))


# ---- checked scalars ----

_BIG = "9223372036854775807"
_IN = "x AS (SELECT event_id AS id, (CASE WHEN event_id % 5 = 0 THEN 9223372036854775807 - user_id WHEN event_id % 5 = 1 THEN -9223372036854775807 - 1 + user_id ELSE event_id * 1000003 - 500000000 END) AS a, (user_id - 3) * (CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) AS b FROM events)"


def _operands(spark, d):
    e = _table(spark, d, "events")
    a = F.when(F.col("event_id") % 5 == 0, F.lit((1 << 63) - 1) - F.col("user_id")).when(F.col("event_id") % 5 == 1, F.lit(-(1 << 63)) + F.col("user_id")).otherwise(F.col("event_id") * 1000003 - 500000000)
    b = (F.col("user_id") - 3) * F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)
    return e.select(F.col("event_id").alias("id"), a.alias("a"), b.cast("bigint").alias("b"))


def _results(df: DataFrame, key: str, **made: Column) -> DataFrame:
    """Values as strings, since nulls beside 64-bit integers tempt some readers into floats."""
    out = df.select(key, *[c.alias(f"_{n}") for n, c in made.items()])
    return out.select(key, *[x for n in made for x in (F.col(f"_{n}.value").cast("string").alias(n), F.col(f"_{n}.abort").alias(f"{n}_abort"))])


def _guarded(name: str, expr: str, extra: str = "") -> str:
    over = f"({expr}) NOT BETWEEN -9223372036854775808 AND 9223372036854775807"
    return f"CASE WHEN {over} THEN NULL ELSE CAST({expr} AS VARCHAR) END AS {name}, CASE WHEN {over} THEN 5 ELSE 0 END AS {name}_abort"


@_query(f"WITH {_IN}, h AS (SELECT id, a::HUGEINT AS a, b::HUGEINT AS b FROM x) SELECT id, {_guarded('added', 'a + b')}, {_guarded('subtracted', 'a - b')}, {_guarded('multiplied', 'a * b')} FROM h")
def checked_add_sub_mul(spark, d):
    a, b = F.col("a"), F.col("b")
    return _results(_operands(spark, d), "id", added=S.add(a, b), subtracted=S.sub(a, b), multiplied=S.mul(a, b))


@_query(f"WITH {_IN}, h AS (SELECT id, CASE WHEN id % 11 = 0 THEN -9223372036854775808 ELSE a END AS a, CASE WHEN id % 11 = 0 THEN -1 ELSE b END AS b FROM x), g AS (SELECT *, CASE WHEN b = 0 THEN 8 WHEN a = -9223372036854775808 AND b = -1 THEN 5 ELSE 0 END AS r FROM h) SELECT id, CASE WHEN r = 0 THEN CAST(a::HUGEINT // (CASE WHEN b = 0 THEN 1 ELSE b END) AS VARCHAR) END AS divided, r AS divided_abort, CASE WHEN r = 0 THEN CAST(a::HUGEINT % (CASE WHEN b = 0 THEN 1 ELSE b END) AS VARCHAR) END AS remainder, r AS remainder_abort FROM g")
def checked_div_rem(spark, d):
    edge = F.col("id") % 11 == 0
    df = _operands(spark, d).select("id", F.when(edge, F.lit(-(1 << 63))).otherwise(F.col("a")).alias("a"), F.when(edge, F.lit(-1)).otherwise(F.col("b")).cast("bigint").alias("b"))
    return _results(df, "id", divided=S.div(F.col("a"), F.col("b")), remainder=S.rem(F.col("a"), F.col("b")))


@_query(f"WITH {_IN}, h AS (SELECT id, CASE WHEN id % 11 = 0 THEN -9223372036854775808 ELSE a END AS a FROM x) SELECT id, CASE WHEN a <> -9223372036854775808 THEN CAST(-(a::HUGEINT) AS VARCHAR) END AS negated, CASE WHEN a = -9223372036854775808 THEN 5 ELSE 0 END AS negated_abort, CASE WHEN a >= 0 THEN CAST(a AS VARCHAR) END AS as_u64, CASE WHEN a < 0 THEN 5 ELSE 0 END AS as_u64_abort FROM h")
def checked_neg_convert(spark, d):
    df = _operands(spark, d).withColumn("a", F.when(F.col("id") % 11 == 0, F.lit(-(1 << 63))).otherwise(F.col("a")))
    return _results(df, "id", negated=S.neg(F.col("a")), as_u64=S.to_u64(F.col("a")))


_UIN = "u AS (SELECT event_id AS id, (CASE WHEN event_id % 4 = 0 THEN 18446744073709551615 - user_id ELSE event_id * 4000000007 END)::HUGEINT AS a, (user_id % 9)::HUGEINT * (CASE WHEN event_id % 2 = 0 THEN 1 ELSE 3000000019 END) AS b FROM events)"


def _u_guarded(name: str, expr: str) -> str:
    over = f"({expr}) NOT BETWEEN 0 AND 18446744073709551615"
    return f"CASE WHEN {over} THEN NULL ELSE CAST({expr} AS VARCHAR) END AS {name}, CASE WHEN {over} THEN 5 ELSE 0 END AS {name}_abort"


@_query(f"WITH {_UIN} SELECT id, {_u_guarded('added', 'a + b')}, {_u_guarded('subtracted', 'a - b')}, {_u_guarded('multiplied', 'a * b')}, CASE WHEN b <> 0 THEN CAST(a // (CASE WHEN b = 0 THEN 1 ELSE b END) AS VARCHAR) END AS divided, CASE WHEN b = 0 THEN 8 ELSE 0 END AS divided_abort, CASE WHEN b <> 0 THEN CAST(a % (CASE WHEN b = 0 THEN 1 ELSE b END) AS VARCHAR) END AS remainder, CASE WHEN b = 0 THEN 8 ELSE 0 END AS remainder_abort, CASE WHEN a <= 9223372036854775807 THEN CAST(a AS VARCHAR) END AS as_i64, CASE WHEN a > 9223372036854775807 THEN 5 ELSE 0 END AS as_i64_abort FROM u")
def checked_u64(spark, d):
    e, u = _table(spark, d, "events"), "decimal(20,0)"
    top = F.lit(Decimal((1 << 64) - 1)).cast(u)
    a = F.when(F.col("event_id") % 4 == 0, top - F.col("user_id")).otherwise((F.col("event_id") * F.lit(4000000007)).cast(u)).cast(u)
    b = ((F.col("user_id") % 9) * F.when(F.col("event_id") % 2 == 0, F.lit(1)).otherwise(F.lit(3000000019))).cast(u)
    df = e.select(F.col("event_id").alias("id"), a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    return _results(df, "id", added=S.add(a, b, True), subtracted=S.sub(a, b, True), multiplied=S.mul(a, b, True), divided=S.div(a, b, True), remainder=S.rem(a, b, True), as_i64=S.to_i64(a))


@_query("WITH x AS (SELECT event_id AS id, event_id * 37 AS a, user_id AS b, event_id % 70 AS n FROM events) SELECT id, a & b AS anded, a | b AS ored, xor(a, b) AS xored, ~a AS inverted, CASE WHEN n < 64 THEN (CASE WHEN n < 30 THEN a << CAST(n AS BIGINT) ELSE NULL END) END AS lefted, CASE WHEN n < 64 THEN (-a) >> n END AS righted, CASE WHEN n >= 64 THEN 9 ELSE 0 END AS righted_abort FROM x")
def bitwise_shift(spark, d):
    df = _table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 37).alias("a"), F.col("user_id").alias("b"), (F.col("event_id") % 70).alias("n"))
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    return df.select("id", S.bit(a, b, "and")["value"].alias("anded"), S.bit(a, b, "or")["value"].alias("ored"), S.bit(a, b, "xor")["value"].alias("xored"), S.bit_not(a)["value"].alias("inverted"), F.when(n < 30, S.shift(a, n, True)["value"]).alias("lefted"), S.shift(-a, n, False)["value"].alias("righted"), S.shift(-a, n, False)["abort"].alias("righted_abort"))


@_query("WITH x AS (SELECT event_id AS id, 18446744073709551615 - event_id::HUGEINT * 99991 AS a, event_id % 64 AS n FROM events) SELECT id, CAST(a // CAST(pow(2, n) AS HUGEINT) AS VARCHAR) AS righted, CAST(18446744073709551615 - a AS VARCHAR) AS inverted, CAST(a % 4294967296 AS VARCHAR) AS low FROM x")
def u64_bits(spark, d):
    df = _table(spark, d, "events").select(F.col("event_id").alias("id"), from_bit_pattern(F.lit(-1) - F.col("event_id") * 99991).alias("a"), (F.col("event_id") % 64).alias("n"))
    a = F.col("a")
    mask = F.lit(4294967295).cast("decimal(20,0)")
    return df.select("id", S.shift(a, F.col("n"), False, True)["value"].cast("string").alias("righted"), S.bit_not(a, True)["value"].cast("string").alias("inverted"), S.bit(a, mask, "and", True)["value"].cast("string").alias("low"))


@_query("WITH x AS (SELECT doc_id AS id, lang, source, text, (doc_id % 40) AS s FROM documents) SELECT id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, CASE WHEN strlen(source) + strlen(lang) <= 6 THEN source || lang END AS joined, CASE WHEN strlen(source) + strlen(lang) > 6 THEN 6 ELSE 0 END AS joined_abort, CASE WHEN s <= strlen(source) AND 3 <= strlen(source) - s THEN upper(substr(hex(encode(source)), CAST(2 * s + 1 AS BIGINT), 6)) END AS sliced, CASE WHEN s > strlen(source) OR 3 > strlen(source) - s THEN 10 ELSE 0 END AS sliced_abort, upper(sha256(text)) AS digest FROM x")
def bytes_ops(spark, d):
    df = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "text", (F.col("doc_id") % 40).alias("s"))
    joined, sliced = S.concat(F.col("source"), F.col("lang"), 6), S.slice_bytes(F.col("source").cast("binary"), F.col("s"), F.lit(3).cast("bigint"))
    return df.select("id", S.byte_len(F.col("text"))["value"].alias("bytes"), joined["value"].alias("joined"), joined["abort"].alias("joined_abort"), F.hex(sliced["value"]).alias("sliced"), sliced["abort"].alias("sliced_abort"), F.hex(S.sha256(F.col("text").cast("binary"))["value"]).alias("digest"))


@_query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 11 ELSE 0 END AS parsed_abort, CASE WHEN doc_id % 3 <> 0 THEN text END AS parsed FROM documents")
def parse_utf8(spark, d):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))).otherwise(F.col("text").cast("binary"))
    out = S.parse_utf8(raw)
    return _table(spark, d, "documents").select(F.col("doc_id").alias("id"), out["abort"].alias("parsed_abort"), out["value"].alias("parsed"))


@_query("WITH g AS (SELECT o_custkey AS id, list(o_orderkey ORDER BY o_orderkey) AS k, list(CAST(round(o_totalprice * 100) AS BIGINT) ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey) SELECT id, CAST(len(k) AS BIGINT) AS n, k[id % 12 + 1] AS key_at, v[id % 12 + 1] AS value_at, CASE WHEN id % 12 >= len(k) THEN 10 ELSE 0 END AS abort FROM g")
def rows_ops(spark, d):
    rows = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), _cents("o_totalprice").alias("value"))))
    df = _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(rows.alias("r"))
    at = F.col("id") % 12
    k, v = S.rows_at(F.col("r"), at, "key"), S.rows_at(F.col("r"), at, "value")
    return df.select("id", S.rows_len(F.col("r"))["value"].alias("n"), k["value"].alias("key_at"), v["value"].alias("value_at"), k["abort"].alias("abort"))


@_query("SELECT o_orderkey AS id, printf('%016X', o_orderkey) AS u64_key, '8' || substr(printf('%016X', o_orderkey), 2) AS i64_key, hex(encode(o_orderpriority)) || '0000' AS string_key, printf('%016X', o_custkey) || hex(encode(o_orderstatus)) || '0000' AS tuple_key FROM orders")
def canonical_key_order(spark, d):
    o = _table(spark, d, "orders")
    pair = F.struct(F.col("o_custkey").cast("decimal(20,0)").alias("_0"), F.col("o_orderstatus").alias("_1"))
    return o.select(F.col("o_orderkey").alias("id"), key_hex_column(F.col("o_orderkey").cast("decimal(20,0)"), U64).alias("u64_key"), key_hex_column(F.col("o_orderkey"), I64).alias("i64_key"), key_hex_column(F.col("o_orderpriority"), String(32)).alias("string_key"), key_hex_column(pair, Tuple(U64, String(4))).alias("tuple_key"))


@_query("SELECT o_orderkey AS id, (o_custkey % 10, o_orderstatus) < (5, 'O') AS lt, (o_custkey % 10, o_orderstatus) <= (5, 'O') AS le, (o_custkey % 10, o_orderstatus) = (5, 'O') AS eq, (o_custkey % 10, o_orderstatus) > (5, 'O') AS gt, (o_custkey % 10, o_orderstatus) >= (5, 'O') AS ge, (o_custkey % 10, o_orderstatus) <> (5, 'O') AS ne FROM orders")
def tuple_compare(spark, d):
    a = F.struct((F.col("o_custkey") % 10).alias("_0"), F.col("o_orderstatus").alias("_1"))
    b = F.struct(F.lit(5).cast("bigint").alias("_0"), F.lit("O").alias("_1"))
    names = {"lt": "<", "le": "<=", "eq": "==", "gt": ">", "ge": ">=", "ne": "!="}
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), *[S.compare(a, b, op)["value"].alias(n) for n, op in names.items()])


@_query("WITH x AS (SELECT event_id AS id, user_id % 2 = 0 AS p, event_id % 3 = 0 AS q, user_id % 4 AS z FROM events) SELECT id, p AND q AS eager_and, p OR q AS eager_or, p <> q AS eager_xor, NOT p AS inverted, CASE WHEN z <> 0 THEN 100 // z > 40 ELSE false END AS short_and, 0 AS short_abort, CASE WHEN z = 0 THEN 8 ELSE 0 END AS eager_abort FROM x")
def booleans(spark, d):
    df = _table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 2 == 0).alias("p"), (F.col("event_id") % 3 == 0).alias("q"), (F.col("user_id") % 4).alias("z"))
    p, q, z = F.col("p"), F.col("q"), F.col("z")
    quotient = S.then(S.div(F.lit(100).cast("bigint"), z), lambda v: S.compare(v, F.lit(40).cast("bigint"), ">"))
    short = S.branch(z != 0, quotient, S.ok(F.lit(False)))
    return df.select("id", S.both(p, q)["value"].alias("eager_and"), S.either(p, q)["value"].alias("eager_or"), S.differ(p, q)["value"].alias("eager_xor"), (~p).alias("inverted"), short["value"].alias("short_and"), short["abort"].alias("short_abort"), quotient["abort"].alias("eager_abort"))


@_query("WITH x AS (SELECT event_id AS id, event_type, props FROM events) SELECT id, CAST(8 + 4 + strlen(event_type) + 4 + strlen(props) AS BIGINT) AS encoded, CASE WHEN strlen(event_type) > 6 THEN 6 WHEN 8 + 4 + strlen(event_type) + 4 + strlen(props) > 40 THEN 7 ELSE 0 END AS abort FROM x")
def encoded_lengths(spark, d):
    t = Tuple(I64, String(6), Bytes(1 << 20))
    row = F.struct(F.col("event_id").alias("_0"), F.col("event_type").alias("_1"), F.col("props").cast("binary").alias("_2"))
    checked = S.then(S.bounded(row, t), lambda v: S.within(v, t, 40))
    return _table(spark, d, "events").select(F.col("event_id").alias("id"), encoded_len_column(row, t).alias("encoded"), checked["abort"].alias("abort"))


# ---- accounting, manifests, dependencies ----


@_query("WITH w AS (SELECT l_orderkey AS tx, l_partkey AS key, CAST(l_linenumber AS BIGINT) * 100000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT) AS ordinal, l_returnflag = 'R' AS gone, strlen(l_linestatus || l_returnflag) AS bytes FROM lineitem), f AS (SELECT tx, key, count(*) AS n, max(ROW(ordinal, 8 + CASE WHEN gone THEN 0 ELSE 4 + bytes END + 9)) AS l FROM w GROUP BY tx, key) SELECT tx, CAST(sum(n) AS BIGINT) AS point_accesses, count(*) AS distinct_keys, CAST(sum(l[2]) AS BIGINT) AS overlay_bytes FROM f GROUP BY tx")
def write_set_accounting(spark, d):
    l = _table(spark, d, "lineitem")
    w = l.select(F.col("l_orderkey").alias("tx"), F.lit(1).alias("table_id"), F.col("l_partkey").alias("key"), (F.col("l_linenumber").cast("bigint") * 100000000 + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("bigint")).alias("ordinal"), (F.col("l_returnflag") == "R").alias("is_delete"), F.concat("l_linestatus", "l_returnflag").alias("value"))
    return H.write_set(w, F.lit(8), encoded_len_column(F.col("value"), String(16)))


_SCOPES = "s AS (SELECT event_id // 20 AS tx, user_id % 3 AS table_id, CASE WHEN event_type = 'view' AND event_id % 4 = 0 THEN 1 ELSE 0 END AS kind, CASE WHEN event_type = 'view' AND event_id % 4 = 0 THEN -1 ELSE user_id % 10 END AS key, CASE WHEN event_type IN ('view', 'signup') THEN 1 ELSE 2 END AS mode FROM events)"


def _scopes(spark, d, *more):
    whole = (F.col("event_type") == "view") & (F.col("event_id") % 4 == 0)
    return _table(spark, d, "events").select(F.floor(F.col("event_id") / 20).alias("tx"), (F.col("user_id") % 3).alias("table_id"), F.when(whole, 1).otherwise(0).alias("kind"), F.when(whole, F.lit(-1).cast("bigint")).otherwise(F.col("user_id") % 10).alias("key"), F.when(F.col("event_type").isin("view", "signup"), 1).otherwise(2).cast("bigint").alias("mode"), *more)


@_query(f"WITH {_SCOPES}, g AS (SELECT tx, table_id, kind, key, CAST(bit_or(mode) AS BIGINT) AS mode FROM s GROUP BY ALL), w AS (SELECT tx, table_id, mode AS m FROM g WHERE kind = 1) SELECT tx, table_id, kind, key, mode & ~coalesce(m, 0) AS mode FROM g LEFT JOIN w USING (tx, table_id) WHERE kind = 0 AND mode & ~coalesce(m, 0) <> 0 UNION ALL SELECT tx, table_id, kind, key, mode FROM g WHERE kind = 1")
def manifest_normalise(spark, d):
    return H.normalise_manifest(_scopes(spark, d))


@_query(f"WITH {_SCOPES}, g AS (SELECT tx, table_id, kind, key, CAST(bit_or(mode) AS BIGINT) AS mode FROM s GROUP BY ALL), h AS (SELECT * FROM g WHERE key % 2 <> 0), w AS (SELECT tx, table_id, bit_or(mode) AS m FROM h WHERE kind = 1 GROUP BY ALL), p AS (SELECT tx, table_id, key, bit_or(mode) AS m FROM h WHERE kind = 0 GROUP BY ALL), r AS (SELECT g.tx, g.table_id, g.kind, g.key, g.mode & ~(coalesce(w.m, 0) | CASE WHEN g.kind = 0 THEN coalesce(p.m, 0) ELSE 0 END) AS mode FROM g LEFT JOIN w ON g.tx = w.tx AND g.table_id = w.table_id LEFT JOIN p ON g.tx = p.tx AND g.table_id = p.table_id AND g.key = p.key) SELECT * FROM r WHERE mode <> 0")
def manifest_uncovered(spark, d):
    derived = _scopes(spark, d).groupBy("tx", "table_id", "kind", "key").agg(F.bit_or("mode").alias("mode"))
    return H.uncovered(derived, derived.where("key % 2 <> 0"))


@_query(f"WITH {_T} SELECT seq, key, n_writers, first_writer, last_writer FROM (SELECT seq, key, op IN ('insert','add','load') AS reads, count(CASE WHEN op <> 'load' THEN seq END) OVER w AS n_writers, min(CASE WHEN op <> 'load' THEN seq END) OVER w AS first_writer, max(CASE WHEN op <> 'load' THEN seq END) OVER w AS last_writer FROM tx WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE reads")
def raw_dependencies(spark, d):
    log = transactions(spark, d)
    acc = log.select("seq", "table_id", "key", F.col("op").isin(*R.READS).alias("reads"), F.col("op").isin(*R.WRITES).alias("writes"))
    return H.writers_before(acc).select("seq", "key", "n_writers", "first_writer", "last_writer")


@_query(f"WITH {_SCOPES.replace('event_id // 20 AS tx', 'event_id + 2 AS seq, event_id // 500 AS epoch')}, w AS (SELECT * FROM s WHERE mode = 2), r AS (SELECT * FROM s WHERE mode = 1) SELECT r.epoch, count(DISTINCT (w.seq, r.seq)) AS edges FROM w JOIN r ON w.epoch = r.epoch AND w.table_id = r.table_id AND w.seq < r.seq AND (w.kind = 1 OR r.kind = 1 OR w.key = r.key) GROUP BY r.epoch")
def dependency_edges(spark, d):
    """Within epochs of 500 records, as the execution window bounds them; the epoch is part of the address."""
    e = _table(spark, d, "events")
    whole = (F.col("event_type") == "view") & (F.col("event_id") % 4 == 0)
    reads = F.col("event_type").isin("view", "signup")
    epoch = F.floor(F.col("event_id") / 500)
    acc = e.select((F.col("event_id") + 2).alias("seq"), (epoch * 3 + F.col("user_id") % 3).alias("table_id"), F.when(whole, 1).otherwise(0).alias("kind"), F.when(whole, F.lit(-1).cast("bigint")).otherwise(F.col("user_id") % 10).alias("key"), reads.alias("reads"), (~reads).alias("writes"))
    return H.dependencies(acc).groupBy(F.floor((F.col("dst") - 2) / 500).alias("epoch")).agg(F.count("*").alias("edges"))


@_query(f"WITH {_SCOPES.replace('event_id // 20 AS tx', 'event_id + 2 AS seq')}, t AS (SELECT *, sum(CASE WHEN mode = 2 THEN 1 ELSE 0 END) OVER e AS n_all, sum(CASE WHEN mode = 2 AND kind = 1 THEN 1 ELSE 0 END) OVER e AS n_wide, sum(CASE WHEN mode = 2 AND kind = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY table_id, key ORDER BY seq) AS n_key FROM s WINDOW e AS (PARTITION BY table_id ORDER BY seq)) SELECT seq, CAST(CASE WHEN kind = 1 THEN n_all ELSE n_wide + n_key END AS BIGINT) AS edges FROM t WHERE mode = 1")
def dependency_edges_whole_log(spark, d):
    """How many earlier writers each reader waits for over the whole log, whichever block they are in; dependency_edges
    counts within blocks only."""
    acc = _scopes(spark, d, F.col("event_id")).select((F.col("event_id") + 2).alias("seq"), "table_id", "kind", "key", (F.col("mode") == 1).alias("reads"), (F.col("mode") == 2).alias("writes"))
    return H.edges_before(acc).select("seq", F.col("n_writers").alias("edges"))


_LEVELS = f"""WITH RECURSIVE {_T}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM tx),
l(key, i, seq, op, level, top) AS (SELECT key, i, seq, op, 0, CASE WHEN op = 'load' THEN -1 ELSE 0 END FROM n WHERE i = 1
 UNION ALL SELECT n.key, n.i, n.seq, n.op, CASE WHEN n.op IN ('insert','add','load') THEN l.top + 1 ELSE 0 END, CASE WHEN n.op = 'load' THEN l.top ELSE greatest(l.top, CASE WHEN n.op IN ('insert','add') THEN l.top + 1 ELSE 0 END) END FROM l JOIN n ON n.key = l.key AND n.i = l.i + 1)
SELECT seq, CAST(level AS BIGINT) AS level FROM l"""


@_query(_LEVELS)
def dependency_levels(spark, d):
    return R.levels(transactions(spark, d))


@_query("WITH done AS (SELECT event_id + 2 AS seq FROM events WHERE value <= 490 AND event_id % 4999 <> 77), n AS (SELECT seq, row_number() OVER (ORDER BY seq) + 1 AS should FROM done) SELECT CAST(1 + count(*) AS BIGINT) AS frontier FROM n WHERE seq = should")
def visible_frontier(spark, d):
    """Some outcomes are open and some are missing altogether; both end the prefix."""
    rows = _table(spark, d, "events").where("event_id % 4999 <> 77")
    return H.frontier(rows.select((F.col("event_id") + 2).alias("seq"), (F.col("value") <= 490).alias("resolved")), base=1)


# ---- replay ----


@_query(f"WITH {_T} SELECT seq, key, 0 AS abort, CASE WHEN op = 'store' THEN 'put' ELSE 'delete' END AS effect, CASE WHEN op = 'store' THEN arg END AS value FROM tx WHERE op IN ('store', 'delete')")
def replay_blind(spark, d):
    return R.replay(transactions(spark, d).where(F.col("op").isin("store", "delete")), "blind").drop("table_id")


@_query(f"WITH {_REPLAY} SELECT seq, key, abort, effect, value FROM outcomes")
def replay_rmw(spark, d):
    return R.replay(transactions(spark, d), "algebraic").drop("table_id")


@_query(f"WITH {_REPLAY} SELECT seq, key, abort, effect, value FROM outcomes")
def replay_fold(spark, d):
    return R.replay(transactions(spark, d), "fold").drop("table_id")


_BANKS, _ACCOUNTS, _OPENING = 16, 8, 60_000


@_query(
    f"""WITH RECURSIVE e AS (SELECT event_id + 2 AS seq, user_id % {_BANKS} AS r, event_id % {_ACCOUNTS} AS a, (event_id // {_ACCOUNTS}) % {_ACCOUNTS} AS b, CAST(round(abs(value) * 100) AS BIGINT) AS n, row_number() OVER (PARTITION BY user_id % {_BANKS} ORDER BY event_id) AS i FROM events),
s(r, i, seq, ok, a, bal) AS (SELECT x, CAST(0 AS BIGINT), CAST(0 AS BIGINT), true, CAST(0 AS BIGINT), list_transform(range({_ACCOUNTS}), lambda y: CAST({_OPENING} AS BIGINT)) FROM range({_BANKS}) t(x)
 UNION ALL SELECT e.r, e.i, e.seq, s.bal[e.a + 1] >= e.n, e.a, CASE WHEN s.bal[e.a + 1] >= e.n THEN list_transform(s.bal, lambda y, k: y - CASE WHEN k = e.a + 1 THEN e.n ELSE 0 END + CASE WHEN k = e.b + 1 THEN e.n ELSE 0 END) ELSE s.bal END FROM s JOIN e ON e.r = s.r AND e.i = s.i + 1)
SELECT seq, CASE WHEN ok THEN 'success' ELSE 'aborted' END AS status, CASE WHEN ok THEN 0 ELSE 3 END AS reason, CASE WHEN ok THEN 0 ELSE 2 END AS user_code, CASE WHEN ok THEN bal[a + 1] END AS balance FROM s WHERE i > 0"""
)
def replay_transfers(spark, d):
    """Transfers between two accounts of a bank, refused where the balance doesn't suffice: programs of two addresses."""
    from tidemark.functions.types import I64, key_bytes
    from tidemark.plans.program import Program, arg, let, load, op, require, ret, update, var
    from tidemark.plans.waves import STATE, replay_programs

    move = Program({"accounts": (I64, I64)}, {"a": I64, "b": I64, "n": I64}, [let("x", load("accounts", arg("a"))), require(op(">=", var("x"), arg("n")), 2), update("accounts", arg("a"), "-", arg("n")), update("accounts", arg("b"), "+", arg("n")), ret(load("accounts", arg("a")))], I64)
    opening = [(1, key_bytes(k, I64).hex().upper(), 1, False, str(k), str(_OPENING)) for k in range(_BANKS * _ACCOUNTS)]
    e, bank = _table(spark, d, "events"), F.col("user_id") % _BANKS * _ACCOUNTS
    args = F.struct((bank + F.col("event_id") % _ACCOUNTS).alias("a"), (bank + F.floor(F.col("event_id") / _ACCOUNTS) % _ACCOUNTS).alias("b"), F.abs(_cents("value")).alias("n"))
    log = e.select((F.col("event_id") + 2).alias("seq"), F.lit("move").alias("program"), F.to_json(args).alias("args"))
    out = replay_programs(log, {"move": move}, {"accounts": 1}, spark.createDataFrame(opening, STATE))
    return out.select("seq", "status", "reason", F.col("user_code").cast("int").alias("user_code"), F.col("result").cast("bigint").alias("balance"))


@_query(f"WITH {_REPLAY} SELECT key, arg_max(value, seq) AS value, max(seq) AS seq FROM outcomes WHERE effect IS NOT NULL GROUP BY key HAVING arg_max(effect, seq) = 'put'")
def replay_state(spark, d):
    return R.state_after(R.replay(transactions(spark, d))).select("key", "value", "seq")


@_query(f"WITH {_REPLAY} SELECT abort, count(*) AS n, min(seq) AS first, max(seq) AS last FROM outcomes GROUP BY abort")
def abort_counts(spark, d):
    return R.replay(transactions(spark, d)).groupBy("abort").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@_query("WITH e AS (SELECT event_id AS seq, user_id AS request, CAST(round(value * 100) AS BIGINT) AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, first_value(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS first FROM events) SELECT seq, request, CASE WHEN n = 1 OR payload = first THEN 0 ELSE 3 END AS abort, CASE WHEN n > 1 AND payload <> first THEN 90 ELSE 0 END AS user_code, n = 1 AS applied FROM e")
def dedup_requests(spark, d):
    """A request id is claimed by its first record; a repeat with another payload fails a require with code 90."""
    w = Window.partitionBy("request").orderBy("seq")
    e = _table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("request"), _cents("value").alias("payload"))
    e = e.withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first("payload").over(w))
    wrong = (F.col("_n") > 1) & (F.col("payload") != F.col("_first"))
    return e.select("seq", "request", F.when(wrong, S.REQUIRE_FAILED).otherwise(0).alias("abort"), F.when(wrong, 90).otherwise(0).alias("user_code"), (F.col("_n") == 1).alias("applied"))


# ---- feeds, views, retention ----


@_query(f"WITH {_REPLAY}, p AS (SELECT seq, abort, effect, value FROM outcomes WHERE seq > 4000 ORDER BY seq LIMIT 1024) SELECT * FROM p")
def outcomes_feed_page(spark, d):
    from tidemark.streaming.feed import page

    return page(R.replay(transactions(spark, d)).drop("table_id", "key"), 4000, 1024)


@_query(f"WITH {_REPLAY} SELECT seq, abort, effect, value FROM outcomes")
def feed_stream_equals_batch(spark, d):
    from tidemark.streaming.feed import drain

    return drain(spark, R.replay(transactions(spark, d)).drop("table_id", "key"))


@_query(f"WITH {_REPLAY}, m AS (SELECT key, arg_max(value, seq) AS value FROM outcomes WHERE effect IS NOT NULL GROUP BY key HAVING arg_max(effect, seq) = 'put') SELECT key, value, upper(sha256(CAST(value AS VARCHAR))) AS value_hash FROM m")
def derived_mirror(spark, d):
    from tidemark.streaming.feed import mirror_in_batches

    return mirror_in_batches(R.replay(transactions(spark, d)), 3).select("key", "value", F.upper(F.sha2(F.col("value").cast("string"), 256)).alias("value_hash"))


@_query(f"WITH {_V}, t AS (SELECT *, key % 4 AS table_id FROM v WHERE NOT (key % 4 = 2 AND seq > 5000)), r AS (SELECT *, row_number() OVER (PARTITION BY table_id, key ORDER BY seq DESC) AS n FROM t) SELECT table_id, key, cents FROM r WHERE n = 1 AND NOT is_delete AND table_id <> 2")
def derived_mirror_after_drop(spark, d):
    """Table 2 is dropped at 5000: the view loses all its rows."""
    from tidemark.streaming.feed import mirror

    log = versions(spark, d).withColumn("table_id", F.col("key") % 4).where("not (table_id = 2 and seq > 5000)")
    effects = log.select("table_id", "key", "seq", F.when(F.col("is_delete"), "delete").otherwise("put").alias("effect"), F.col("value.cents").alias("value"))
    drops = spark.createDataFrame([(2, 5000)], "table_id bigint, seq bigint")
    return mirror(None, effects, drops).select("table_id", "key", F.col("value").alias("cents"))


@_query("SELECT upper(sha256(o_orderpriority || '/' || o_orderstatus)) AS value_hash, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def value_hash_index(spark, d):
    h = F.upper(F.sha2(F.concat_ws("/", "o_orderpriority", "o_orderstatus"), 256))
    return _table(spark, d, "orders").groupBy(h.alias("value_hash")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@_query("SELECT least(9000, min(p_partkey + 40), (SELECT min(s_suppkey + 25) FROM supplier)) AS history_floor, least(801, min(CASE WHEN p_size % 3 + 1 IN (2, 3) THEN p_partkey + 40 END) + 1) AS log_floor FROM part")
def retention_floor(spark, d):
    cursors = _table(spark, d, "part").select((F.col("p_size") % 3 + 1).alias("kind"), (F.col("p_partkey") + 40).alias("baseline"))
    return H.retention_floor(9000, 800, cursors, _table(spark, d, "supplier").select((F.col("s_suppkey") + 25).alias("seq")))


@_query(f"WITH {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY key, seq <= 6000 ORDER BY seq DESC) AS n FROM v) SELECT key, seq, is_delete, t, cents FROM r WHERE seq > 6000 OR n = 1")
def gc_retained(spark, d):
    return _flat(H.gc_retained(versions(spark, d), 6000), "key", "seq", "is_delete")


@_query(f"WITH {_V}, r AS (SELECT v.*, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM v WHERE seq <= 7000) SELECT key, cents FROM r WHERE n = 1 AND NOT is_delete")
def snapshot_after_gc(spark, d):
    """Any snapshot at or after the floor reads the same from what a collection kept."""
    return _flat(H.snapshot(H.gc_retained(versions(spark, d), 6000), 7000, 1), "key").select("key", "cents")


_CHAIN = "own AS (SELECT event_id + 2 AS seq, sha256(concat_ws('|', event_id + 2, event_type, CAST(round(value * 100) AS BIGINT))) AS written, sha256(concat_ws('|', event_id + 2, event_type, CAST(round(value * 100) AS BIGINT) + CASE WHEN event_id % 997 = 13 THEN 1 ELSE 0 END)) AS stored FROM events), breaks AS (SELECT seq FROM (SELECT seq, lag(stored) OVER w AS stored, lag(written) OVER w AS written FROM own WINDOW w AS (ORDER BY seq)) WHERE stored <> written)"


@_query(
    f"""WITH {_REPLAY}, {_CHAIN}, ends AS (SELECT max(seq) - max(seq) // 10 AS dropped FROM outcomes), kept AS (SELECT seq FROM outcomes WHERE seq % 811 <> 9)
SELECT 'effects without version' AS violation, count(*) AS n FROM outcomes WHERE effect IS NOT NULL AND (seq % 501 = 7 OR (seq % 777 = 5 AND effect = 'put'))
UNION ALL SELECT 'versions without effect', count(*) FROM outcomes WHERE effect = 'put' AND seq % 501 <> 7 AND seq % 777 = 5
UNION ALL SELECT 'outside lifetime', count(*) FROM outcomes, ends WHERE effect IS NOT NULL AND seq % 501 <> 7 AND seq >= dropped
UNION ALL SELECT 'missing outcomes', max(seq) - min(seq) + 1 - count(*) FROM kept
UNION ALL SELECT 'repeated outcomes', count(*) FROM kept WHERE seq % 1003 = 4
UNION ALL SELECT 'chain breaks', count(*) FROM breaks"""
)
def history_violations(spark, d):
    """Planted faults are found, and as many: versions that are lost or altered, versions after their table's drop,
    outcomes that are missing or repeated, and records altered after the next one was chained to them."""
    outcomes = R.replay(transactions(spark, d))
    where = shared_dir(spark, "outcomes")
    outcomes.write.parquet(where)  # six checks read them, and each would replay the log
    outcomes = spark.read.schema(outcomes.schema).parquet(where)
    effects = outcomes.where("effect is not null").select("table_id", "key", "seq", (F.col("effect") == "delete").alias("is_delete"), "value")
    stored = effects.where("seq % 501 <> 7").withColumn("value", F.when((F.col("seq") % 777 == 5), F.col("value") + 1).otherwise(F.col("value")))
    lifetimes = _table(spark, d, "events").agg((F.max("event_id") + 2).alias("_m")).select(F.lit(1).cast("bigint").alias("table_id"), (F.col("_m") - F.floor(F.col("_m") / 10)).alias("dropped_seq"))
    told = outcomes.where("seq % 811 <> 9").select("seq")
    told = told.unionByName(told.where("seq % 1003 = 4"))
    seqs = H.told_counts(told)
    checks = {"effects without version": H.effects_without_version(effects, stored), "versions without effect": H.effects_without_version(stored, effects), "outside lifetime": H.outside_lifetime(stored, lifetimes), "chain breaks": H.chain_breaks(_chain(spark, d))}
    out = seqs.select(F.explode(F.array(F.struct(F.lit("missing outcomes").alias("violation"), (F.col("hi") - F.col("lo") + 1 - F.col("u")).alias("n")), F.struct(F.lit("repeated outcomes").alias("violation"), (F.col("n") - F.col("u")).alias("n")))).alias("c")).select("c.*")
    for name, bad in checks.items():
        out = out.unionByName(bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("violation"), "n"))
    return out


def _chain(spark, d) -> DataFrame:
    """events as chained records, of which every 997th was altered, and its digest with it, after the next one had been
    chained to what it was."""
    digest = lambda cents: F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "event_type", cents.cast("string")), 256)
    e = _table(spark, d, "events").select((F.col("event_id") + 2).alias("seq"), "event_type", _cents("value").alias("cents"), (F.col("event_id") % 997 == 13).alias("altered"))
    written = e.select((F.col("seq") + 1).alias("seq"), digest(F.col("cents")).alias("predecessor_digest"))
    return e.select("seq", digest(F.col("cents") + F.col("altered").cast("int")).alias("digest")).join(written, "seq", "left")


@_query(f"WITH {_CHAIN} SELECT seq FROM breaks")
def hash_chain_breaks(spark, d):
    """Whatever follows an altered record no longer fits it."""
    return H.chain_breaks(_chain(spark, d)).select("seq")


@_query("SELECT event_id + 2 AS seq, count(*) AS n FROM events GROUP BY 1")
def versions_per_sequence(spark, d):
    return versions(spark, d).groupBy("seq").agg(F.count("*").alias("n"))
