"""Neighbours, pseudonyms, licences, quality, and the pipeline."""

import hashlib
import itertools
import math
import textwrap
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import hamming, licences, pii, quality

SF = "/root/testdata/sf0.01"


# ---- neighbours ----


def exact(ids, x, k):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        rest = np.flatnonzero(np.arange(len(ids)) != q)
        out[int(ids[q])] = [int(ids[j]) for j in rest[np.lexsort((ids[rest], -s[rest]))][:k]]
    return out


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(hamming, "BASE_BLOCK", 300)
    monkeypatch.setattr(hamming, "QUERY_BLOCK", 20)
    monkeypatch.setattr(hamming, "SAMPLE", 400)
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((1000, 32)) + 2 * rng.standard_normal((8, 32))[rng.integers(0, 8, 1000)]) * rng.uniform(0.5, 2, (1000, 1))
    x = x.astype(np.float32)
    x[500:650] = x[0]  # a hot vector
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, rank int")
    got = {}
    for r in hamming.neighbours(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = exact(np.arange(1000), x.astype(np.float64), 20)
    assert set(got) == set(want)
    hits = 0
    for q, g in got.items():
        assert sorted(g) == list(range(1, 21))
        ids = [g[k][0] for k in range(1, 21)]
        scores = [g[k][1] for k in range(1, 21)]
        assert sorted(zip([-s for s in scores], ids)) == list(zip([-s for s in scores], ids)) and q not in ids
        assert np.allclose(scores, x[ids].astype(np.float64) @ x[q].astype(np.float64), rtol=1e-12)
        hits += len(set(ids) & set(want[q]))
    assert hits >= 0.95 * 20 * len(want)
    assert [i for i, _ in sorted(got[0].values(), key=lambda p: (-p[1], p[0]))][:20] == want[0]  # ties to the smaller id


def test_pigeonhole_finds_every_code():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (4000, 16)).astype(np.uint8)
    index = hamming.Index(codes)
    for radius in (0, 5, 17, 20, 40, 56, 70, 128):
        q = codes[7] ^ np.packbits(rng.random(128) < 0.1)
        d = np.array([bin(int.from_bytes((c ^ q).tobytes(), "big")).count("1") for c in codes])
        assert index.within(q, radius).tolist() == np.flatnonzero(d <= radius).tolist()
        near = index.nearest(q, 9)
        assert near.tolist() == np.flatnonzero(d <= np.sort(d)[8]).tolist()
    assert index.probed == 4 and index.passed == 4  # up to radius 20 the lists of at most 17 * 8 values are read


def test_lists_are_probed_where_neighbours_are_near():
    """Vectors in tight groups: the learned radius is small, and every search goes through the lists."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((400, 64))
    x = centres[rng.integers(0, 400, 20_000)] + 0.05 * rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = hamming.learn(x[:8000], 1.0, 5)
    index, ids = hamming.Index(codes.encode(x, False)), np.arange(len(x))
    hits = 0
    for n in range(0, 20_000, 100):
        at = index.within(codes.encode(x[n : n + 1], True)[0], codes.radius)
        got, _ = hamming.best(x, ids, at[at != n], x[n], 5)
        scores = x @ x[n]
        scores[n] = -2
        hits += len(set(got.tolist()) & set(np.argsort(-scores)[:5].tolist()))
    assert codes.radius <= 24 and index.probed == 200 and index.passed == 0 and hits >= 0.95 * 5 * 200


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = sorted(tuple(r) for r in hamming.neighbours(df, k=3).collect())
    assert out == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 1, 2.0), (20, 3, 0, 0.0)]
    assert hamming.neighbours(df.limit(0)).count() == 0


@pytest.mark.parametrize("rare", [64, 2])
def test_repeated_ids_and_lengths(spark, monkeypatch, rare):
    """An id of a third of all rows, with one vector or many; vectors of several lengths, each searched in its own."""
    monkeypatch.setattr(hamming, "RARE_LENGTH", rare)
    monkeypatch.setattr(hamming, "BASE_BLOCK", 500)
    rng = np.random.default_rng(4)
    unit = lambda d: [round(float(v), 3) for v in rng.standard_normal(d)]
    hot = unit(16)
    rows = [(5, hot)] * 600 + [(5, unit(16)) for _ in range(400)] + [(k, unit(16)) for k in range(6, 1500)] + [(k, unit(8)) for k in range(2000, 2100)] + [(20, unit(16))] * 3 + [(2020, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    out = hamming.neighbours(df, k=7).toPandas()
    queries = [(i, v) for i, v in rows if i % 20 == 0]
    assert len(out) == sum(min(7, sum(len(w) == len(v) and j != i for j, w in rows)) for i, v in queries)
    hits = total = 0
    for i, v in queries:
        if sum(j == i and len(w) == len(v) for j, w in rows) > 1 or i == 2020:
            continue
        want = sorted((-float((np.array(v) * np.array(w)).sum()), j) for j, w in rows if j != i and len(w) == len(v))[:7]
        got = out[out.query_id == i].sort_values("rank")
        assert sorted(zip(-got.score, got.vec_id)) == list(zip(-got.score, got.vec_id))
        total += 7
        hits += len([x for x in zip(-got.score, got.vec_id) if any(abs(x[0] - y[0]) < 1e-9 and x[1] == y[1] for y in want)])
    assert hits >= 0.9 * total
    alone = spark.createDataFrame([(40, hot)] * 3000 + [(60, hot)] * 3, "vec_id bigint, embedding array<double>")
    got = hamming.neighbours(alone, k=2).groupBy("query_id", "vec_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(40, 60, 6000), (60, 40, 6)]


# ---- pseudonyms ----

KEY = b"a key for tests"


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5000), st.data())
def test_permutations(n, data):
    p = pii.Permutation(KEY, "t", n)
    x = data.draw(st.integers(0, n - 1))
    y = p.map(x)
    assert 0 <= y < n and p.map(y, True) == x and (y != x or n == 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([2, 6, 10, 16, 26]), min_size=1, max_size=400), st.randoms())
def test_symbols_of_any_number_map_back(sizes, random):
    values = [random.randrange(n) for n in sizes]
    new = pii.permute_symbols(values, sizes, KEY, "t")
    assert all(0 <= v < n for v, n in zip(new, sizes, strict=True)) and pii.permute_symbols(new, sizes, KEY, "t", True) == values


def test_long_secrets():
    """No part of a long secret stays, one changed letter changes all of it, and the time grows with the length."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    spent = {}
    for n in (10, 43, 44, 60, 100, 200, 1000, 5000, 100_000, 400_000):
        value = "".join(rng.choice(letters, n))
        text = f"token={value} and more"
        begin = time.process_time()
        [(kind, start, end, new)] = pii.find(text, KEY)
        spent[n] = time.process_time() - begin
        assert (kind, start, end) == ("secret", 6, 6 + n) and len(new) == n
        changed = text.replace(value, new)
        assert pii.replaced(changed, pii.find(changed, KEY, True)) == text
        same = sum(a == b for a, b in zip(value, new, strict=True))
        assert same <= n / 16 + 4 * (n / 16) ** 0.5 + 2 and value[: max(8, n // 20)] != new[: max(8, n // 20)]
        other = pii.secret(value[:-1] + ("x" if value[-1] in "abc" else "a" if value[-1].islower() else "B" if value[-1] == "A" else "A" if value[-1].isupper() else str((int(value[-1]) + 1) % 10)), KEY, False)
        assert sum(a == b for a, b in zip(other, new, strict=True)) <= n / 10 + 4 * (n / 10) ** 0.5 + 2
    assert spent[400_000] < 12 * spent[100_000] + 0.5
    assert pii.find("token=" + "=" * 100_000, KEY) == []
    begin = time.process_time()
    assert len(pii.find("token=" + "a.b." * 25_000 + "x@example.com 4111111111111111 " + "1.2.3.4 " * 4000, KEY)) >= 4001
    assert time.process_time() - begin < 20


def by_the_definition(value, sizes, key, tweak, back=False):
    """The permutation of numbers of mixed radix, written once more from its definition."""
    x, n = 0, math.prod(sizes)
    for v, s in zip(value, sizes, strict=True):
        x = x * s + v
    seed = hashlib.blake2b(f"{tweak}|{','.join(map(str, sizes))}|{n}".encode(), key=key, digest_size=32).digest()
    h = lambda data: int.from_bytes(hashlib.blake2b(data, key=seed, digest_size=32).digest(), "big")
    side = math.isqrt(n - 1) + 1

    def forth(x):
        a, b = x // side, x % side
        for r in range(8):
            a, b = b, (a + h(f"{r}|{b}".encode())) % side
        return a * side + b

    def walk(x, f):
        x = f(x)
        while x >= n:
            x = f(x)
        return x

    table = {walk(x, forth): x for x in range(n)}
    turn = 1 + h(b"turn") % (n - 1)
    y = table[(walk(x, forth) + (-turn if back else turn)) % n]
    out = []
    for s in reversed(sizes):
        y, v = y // s, y % s
        out.append(v)
    return out[::-1]


@pytest.mark.parametrize("sizes", [[10, 10], [10, 26, 3], [5], [12, 31, 2]])
def test_permutations_equal_their_definition(sizes):
    for value in itertools.product(*[range(0, n, 3) for n in sizes]):
        for back in (False, True):
            assert pii.permute_symbols(list(value), sizes, KEY, "t", back) == by_the_definition(value, sizes, KEY, "t", back)


VALUES = {"email": "jo.doe42@mail8.example.com", "card": "4041 8949 7460 8795", "phone": "+1 (988) 555-2485", "ip": "42.144.35.254", "iban": "DE89 3704 0044 0532 0130 00", "ssn": "123-45-6789", "date": "1987-02-28", "secret": "b7db7aa4a5fcc78305"}


@pytest.mark.parametrize("kind", list(VALUES))
def test_formats_hold(kind):
    value = VALUES[kind]
    text = f"see {'password=' if kind == 'secret' else ''}{value} and {'password=' if kind == 'secret' else ''}{value}."
    found = pii.find(text, KEY)
    assert [f[0] for f in found] == [kind, kind] and found[0][3] == found[1][3] != value and len(found[0][3]) == len(value)
    assert [c.isdigit() for c in found[0][3]] == [c.isdigit() for c in value] or kind in ("iban", "ip", "secret")
    changed = pii.replaced(text, found)
    assert value not in changed and pii.replaced(changed, pii.find(changed, KEY, True)) == text
    assert pii.find(text, b"another")[0][3] != found[0][3]


def test_what_is_not_valid_stays():
    for text in ("1234567890123456", "999-45-6789", "2024-13-45", "31.02.2001", "300.1.1.1", "127.0.0.1", "v1.2.3", "a@b", "DE00 3704 0044 0532 0130 00", "in 1999 and 2001", "deadbeef", "hello world"):
        assert pii.find(text, KEY) == [], text
    day = {pii.date(f"{d:02d}/{m:02d}/1999", KEY, False) for d in range(1, 13) for m in range(1, 13)}
    assert len(day) == 144  # different dates stay different


@pytest.mark.parametrize("kind,value", [*VALUES.items(), ("card", "4111111111111111"), ("card", "3782 822463 10005"), ("phone", "+44 20 7946 0958"), ("phone", "+442079460958"), ("phone", "826-555-4081"), ("ip", "239.255.12.7"), ("iban", "BE68 5390 0754 7034"), ("secret", "DE9F2C7FD25E1B3AFAD3E85A0BD17D9B100DB4B3"), ("secret", "de9f2C7Fd25e1b3afad3e85a0bd17d9b100db4b3")])
def test_values_hold_beside_numbers(kind, value):
    """A number right before or after a value hides nothing and changes nothing of its pseudonym."""
    mark = "password=" if kind == "secret" and len(value) < 32 else ""
    [(_, _, _, alone)] = pii.find(mark + value, KEY)
    for text in (f"{mark}{value} 12/27", f"{mark}{value} 123", f"{mark}{value} 1999", f"{mark}{value} 25", f"7 {mark}{value}", f"25 {mark}{value} 25", f"1 {mark}{value} 1", f"7 {mark}{value} 8 {mark}{value} 25"):
        found = pii.find(text, KEY)
        changed = pii.replaced(text, found)
        assert changed == text.replace(value, alone), (text, found)
        assert pii.replaced(changed, pii.find(changed, KEY, True)) == text


def test_addresses_from_224_stay_there():
    for value in ("224.0.0.1", "239.255.12.7", "250.1.2.3"):
        [(kind, _, _, new)] = pii.find(value, KEY)
        assert kind == "ip" and new != value and 224 <= int(new.split(".")[0]) <= 255 and pii.ipv4(new, KEY, True) == value


def test_documents(odd, docs):
    rows = [(1, "mail a.b@c.org now"), (2, None), (3, ""), (4, "x a.b@c.org y 42.144.35.254"), (4, "x"), (None, "a.b@c.org"), (5, "plain " * 50_000)]
    out = pii.pseudonymise(docs(rows), KEY, keep=("shard", "id")).collect()
    by = {(r["doc_id"], r["n_found"]): r for r in out}
    assert len(out) == 7 and by[2, 0]["text"] is None and by[3, 0]["text"] == "" and by[5, 0]["text"] == "plain " * 50_000
    assert by[1, 1]["found"][0]["pseudonym"] == by[4, 2]["found"][0]["pseudonym"] == by[None, 1]["text"] and by[1, 1]["shard"] == 7
    assert pii.pseudonymise(docs([]), KEY).count() == 0


# ---- licences ----


def test_licences(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/LICENSE", apache), (2, "a/x.txt", "nothing here"), (3, "a/b/y.txt", "some prose"), (4, "a/b/z.txt", "Some prose.\nReleased under the MIT License.\nMore prose follows and goes on for a while here."),
        (5, "a/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), (6, "a/c/d/e.txt", "text"), (7, "f/g.txt", "text"), (8, None, "text"), (9, "f/h.txt", None), (10, "ab/x.txt", "text"),
        (11, "f/i.txt", "You need a driving licence to rent the car, said the man at the desk."), (12, "h.txt", ("prose " * 3000) + "\nLicensed under CC BY-NC 4.0.\n" + "prose " * 3000), (12, "h.txt", "again"), (None, "a/q.txt", "q"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, where string, text string").withColumn("licence", F.lit("clash")).withColumn("dir", F.lit("x"))
    out = licences.licence_documents(df, F.col("where"))
    assert out.count() == len(rows)
    got = {r["doc_id"]: (r["licence"], r["how"], r["from_dir"]) for r in out.collect()}
    assert got == {
        1: ("Apache-2.0", "file", None), 2: ("Apache-2.0", "inherited", "a"), 3: ("Apache-2.0", "inherited", "a"), 4: ("MIT", "header", None), 5: ("GPL-3.0", "file", None), 6: ("GPL-3.0", "inherited", "a/c"),
        7: (None, None, None), 8: (None, None, None), 9: (None, None, None), 10: (None, None, None), 11: (None, None, None), 12: ("CC-BY-NC-4.0", "header", None), None: ("Apache-2.0", "inherited", "a"),
    }
    assert licences.licence_documents(df.limit(0), F.col("where")).count() == 0


def test_whole_licence_texts(spark):
    """Hard-wrapped texts of licences are files, of the right licence, at any width; below a header they are not."""
    texts = dict(licences.WHOLE_TEXTS)
    assert "Remote Network Interaction" in texts["AGPL-3.0"] and "endorse" not in texts["BSD-2-Clause"]
    rows, want = [], {}
    code = "\n".join(f"def f{k}(a{k}):\n    return a{k} + {k}" for k in range(60))

    def add(where, text, *answer):
        want[len(rows)] = answer
        rows.append((len(rows), where, text))

    for name, text in texts.items():
        for width in (50, 72, 100):
            wrapped = "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))
            add(f"{name}/{width}/LICENSE", f"Copyright (c) 2019 Jane Roe and others\n\n{wrapped}\n", name, "file")
            add(f"{name}/{width}/src/x.txt", "prose", name, "inherited")
    for name in ("MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC"):
        add(f"h/{name}.py", textwrap.indent(texts[name], "# ") + code, name, "header")
    add("h/y.txt", "prose", None, None)
    for k in range(300):
        add(f"other/{k}.txt", "The people of the town and its other parts were free to use the copy that is theirs.", None, None)
    got = {r["doc_id"]: (r["licence"], r["how"]) for r in licences.licence_documents(spark.createDataFrame(rows, "doc_id bigint, where string, text string"), F.col("where")).collect()}
    assert {k: (rows[k][1], got[k]) for k in want if got[k] != want[k]} == {}


def test_every_template_finds_itself():
    counts = np.zeros(licences.SLOTS)
    counts[licences.SLOTS - 1] = 1000
    t = licences.Templates(counts)
    for name, text in licences.TEMPLATES:
        assert t.match(text) == (name, pytest.approx(1.0))
        assert any(t.match(b)[0] == name for b in licences.blocks("Before.\n" + text + "\nAfter it."))
    assert t.match("A novel about the sea and the people near it.")[1] < licences.LEAST


def test_cosines_equal_plain_sums():
    """Templates.match against the cosine written out term by term."""
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 900, licences.SLOTS).astype(float)
    counts[licences.SLOTS - 1] = 1000
    for texts, vocabulary in ((licences.TEMPLATES, licences.VOCABULARY), (licences.WHOLE_TEXTS[:4], {t: k for k, t in enumerate(sorted({t for _, x in licences.WHOLE_TEXTS[:4] for t in licences.terms(x)}))})):
        t = licences.Templates(counts, texts, vocabulary)
        rare = lambda w: math.log(1001 / (counts[licences.SLOT[w]] + 1)) + 1
        weight = lambda term: sum(rare(w) for w in term.split(" ")) / len(term.split(" "))

        def vector(text):
            words, out = licences.terms(text), {}
            for w in set(words):
                if w in vocabulary:
                    out[w] = words.count(w) * weight(w)
                elif " " not in w:
                    out[w] = words.count(w) * (math.log(1001) + 1)
            return out

        for probe in ("Licensed under the MIT License, said the author of this file in 2019.", "Permission is hereby granted, free of charge, to deal in the Software without restriction", texts[2][1] + " and some words more " * 3):
            v = vector(probe)
            cosines = []
            for name, text in texts:
                u = vector(text)
                cosines.append((sum(v[k] * u.get(k, 0) for k in v if k in vocabulary) / math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values())), name))
            name, value = t.match(probe)
            assert value == pytest.approx(max(c for c, _ in cosines)) and any(n == name and c == pytest.approx(value) for c, n in cosines)


# ---- quality ----


def test_rules_as_columns_equal_numpy(spark, odd):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.STATS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] < 0.8)).astype(float)
    m = quality.fit(x, y)
    assert ((m.score(x) >= 0.5) == y).mean() > 0.97 and len(m.rules) < 300
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *quality.STATS]).select("i", F.struct(*quality.STATS).alias("s"))
    got = [r[0] for r in df.orderBy("i").select(m.column(F.col("s"))).collect()]
    assert np.allclose(got, m.score(x))
    assert quality.fit(x[:0], y[:0]).rules == () and 0 < quality.fit(x[:50], np.ones(50)).score(x)[0] < 1


def test_scores_of_odd_rows(odd, docs, spark):
    m = quality.fit(np.random.default_rng(0).random((100, len(quality.STATS))), np.arange(100) % 2)
    out = quality.score_documents(odd, m)
    rows = out.collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == odd.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert quality.score_documents(docs([]), m).count() == 0
    assert quality.keep_good(odd, m).columns == odd.columns


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.score_documents(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert len(out) > 50 and (out.predicted == out.quality).mean() > 0.95


def plain_statistics(text):
    """The statistics by loops over the text's bytes and words."""
    b = text.encode()
    words, n = b.split(), len(b)
    if not words:
        return [n] + [0] * (len(quality.STATS) - 1)
    w = len(words)
    count = lambda chars: sum(c in chars for c in b)
    upper, lower, high = count(range(65, 91)), count(range(97, 123)), count(range(128, 256))
    letters = max(1, upper + lower + high)
    marks, shouts, symbols, bars = count(b".,;:'\"?()-"), count(b"!"), count(b"#$%&*@^~=+<>\\/{}[]_`"), count(b"|")
    lines = [x for x in b.split(b"\n") if x]
    triples = list(zip(words, words[1:], words[2:]))
    top = max(words.count(x) for x in set(words))
    return [n, w, sum(map(len, words)) / w, sum(len(x) > 12 for x in words) / w, upper / letters, count(b"0123456789") / n, marks / w, (shouts + symbols + bars) / n, shouts / w, symbols / w, bars / w, len(lines), n / len(lines), 1 - len(set(lines)) / len(lines), len(set(words)) / w, top / w, 1 - len(set(triples)) / len(triples) if triples else 0, high / letters, sum(x[-1:] in (b"#", b"$", b"%", b"&", b"*", b"!", b"|") for x in words) / w, sum(len(x) <= 3 for x in words) / w]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB é\t\n.!#|9xyz ", max_size=120))
def test_statistics_equal_plain_loops(text):
    assert np.allclose(quality.statistics(text), plain_statistics(text))


def test_statistics_of_a_very_long_text():
    text = " ".join(f"a{k % 1500} b" for k in range(700_000))
    x = dict(zip(quality.STATS, quality.statistics(text), strict=True))
    assert x["words"] == 1_400_000 and x["same_triples"] == pytest.approx(1 - 3000 / (1_400_000 - 2))


def test_training_rows_are_bounded(docs, spark, monkeypatch):
    """Rows that repeat a labelled id give one row, and labels that contradict each other none."""
    rows = [(1, f"text {k} of one id") for k in range(3000)] + [(k, f"good words here {k}") for k in range(2, 60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(4, 1), (6, 0)], "doc_id bigint, quality int")
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.update(x=x, y=y))
    quality.train(docs(rows), labels)
    used = [k for k in range(1, 60) if zlib.crc32(str(k).encode()) % 5 and k != 4]
    assert len(seen["y"]) == len(used) and sorted(seen["y"]) == sorted(k % 2 for k in used)


# ---- pipeline ----


def test_pipeline(spark):
    """run() against plain Python: scores by numpy, links by all pairs of sets, ids by the tokenizers library; sequences
    hold what they may, without gaps."""
    import corpus_pipeline
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from tidemark.llm import packing

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    scores = model.score(np.array([quality.statistics(t or "") for _, t in rows]))
    rows = [r for r, score in zip(rows, scores, strict=True) if score >= 0.3]
    assert 0 < len(rows) < len(scores)

    def shingles(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, a in enumerate(sets):
        for k in range(j):
            b = sets[k]
            if a and b and 100 * min(len(a), len(b)) >= 75 * max(len(a), len(b)) and 100 * (n := len(a & b)) >= 75 * (len(a) + len(b) - n):
                root[find(j)] = find(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    kept = [r for k, r in enumerate(rows) if least[find(k)] == r[0]]
    assert len(kept) < len(rows)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for d, text in kept:
        ids = [*t.encode(pii.replaced(text, pii.find(text, corpus_pipeline.PII_KEY)), add_special_tokens=False).ids, 0] if text else [0]
        want += [(d, k, s, n, zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert out.sequence_id.nunique() <= 1.01 * out.length.sum() / 2048 + 2
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "PII", "best-fit packing"]


def test_stages_on_odd_rows(spark, tmp_path):
    """Empty tables, nulls in any column, repeated rows and ids: each stage returns the columns of documents."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, None), (1, "", None, "s", 0), (2, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5), (None, "x " * 30, "en", "s", 60)], docs.schema)
    for some in (empty, odd):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, SF)
            assert stage is corpus_pipeline.best_fit_packing or out.columns == docs.columns
            assert (out.count() == 0) == (some is empty) or stage is corpus_pipeline.quality_classifier
    assert corpus_pipeline.ngram_jaccard_join(spark, odd, SF).count() == 5
    assert corpus_pipeline.pii_pseudonyms(spark, odd, SF).count() == 6
