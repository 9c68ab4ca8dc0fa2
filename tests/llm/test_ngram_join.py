import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import ngram_join, workspace
from tidemark.llm.workspace import Workspace, components


def shingles(text, n=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute(rows):
    """(doc_id, n_shingles, component_id); sets are the nodes, named by the smallest id that holds them."""
    sets = [(i, frozenset(shingles(t))) for i, t in rows]
    least = {}
    for i, x in sets:
        if i is not None and x:
            least[x] = min(i, least.get(x, i))
    distinct, root = list(least), {x: x for x in least}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(distinct):
        for y in distinct[k + 1 :]:
            if 100 * len(x & y) >= 75 * len(x | y):
                root[find(y)] = find(x)
    comp = {}
    for x in distinct:
        comp[find(x)] = min(least[x], comp.get(find(x), least[x]))
    return sorted(((i, len(x), None if i is None else comp[find(x)] if x else i) for i, x in sets), key=repr)


def got(df):
    return sorted((tuple(r) for r in ngram_join.join_documents(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def corpus(seed, n):
    """Chains of near copies around the threshold, shared passages, exact copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    passage = [word() for _ in range(30)]
    rows, bases = [], [[word() for _ in range(rng.randint(3, 80))] for _ in range(n // 8)]
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.2:
            words += passage
        if rng.random() < 0.3:
            bases.append(words)
        rows.append((i * 3 % n + 1000, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(docs, seed, monkeypatch):
    if seed > 1:  # every list long, and cut into pieces and blocks
        monkeypatch.setattr(ngram_join, "PIECE", 5)
        monkeypatch.setattr(ngram_join, "BLOCK", 4)
        monkeypatch.setattr(ngram_join, "FEW", 2)
        monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    if seed == 3:
        monkeypatch.setattr(ngram_join, "BITMAP_IDS", 10)
    rows = corpus(seed, 200)
    assert got(docs(rows)) == brute(rows)


def paragraphs(n, seed=0):
    """Documents of 4 of 20 paragraphs: all share passages with a fifth of the others, few link."""
    rng = random.Random(seed)
    parts = [" ".join(f"p{k}w{j}" for j in range(40)) for k in range(20)]
    return [(i, " ".join(rng.sample(parts, 4))) for i in range(n)]


def test_shared_paragraphs(docs, monkeypatch):
    """Exact, and the pairs whose sets are compared grow far less than the documents' square."""
    asked = {}
    verify = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, sets: (asked.update(n=asked.get("n", 0) + pairs.distinct().count()), verify(pairs, sets))[1])
    grown = []
    for n in (400, 800):
        asked.clear()
        rows = paragraphs(n)
        assert got(docs(rows)) == brute(rows)
        grown.append(asked["n"])
    assert grown[1] <= 3.5 * grown[0] and grown[1] < 0.05 * 800 * 800 / 2, grown


def brute_links(rows):
    """n_links of each row, and the pairs of different linked sets."""
    nodes = {(i, frozenset(shingles(t))) for i, t in rows if i is not None and shingles(t)}
    sets = {s for _, s in nodes}
    linked = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    mates = {s: [t for t in sets if linked(s, t)] for s in sets}
    holders = {s: sum(t == s for _, t in nodes) for s in sets}
    counts = [(i, None if i is None else sum(holders[t] for t in mates[s]) - 1 if (s := frozenset(shingles(x))) else 0) for i, x in rows]
    return sorted(counts, key=repr), {frozenset((s, t)) for s in sets for t in mates[s] if s != t}


@pytest.mark.parametrize("seed", [1, 2])
def test_every_link_counts(docs, odd, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rows = corpus(seed, 160) + [(r["doc_id"], r["text"]) for r in odd.collect()]
    rng = random.Random(seed)
    rows += [(i + 5000, t) for i, t in rng.sample(rows[:160], 20)]  # exact copies
    rows += [(rows[k][0], rows[k + 1][1]) for k in range(0, 24, 3)] + [(1, "a b c d e f g h")]  # ids with several texts
    base = [f"b{k}" for k in range(120)]
    rows += [(9000 + k, " ".join(base[:j] + ["new"] + base[j + 1 :])) for k, j in enumerate(rng.choices(range(120), k=40))]  # near copies
    rows += rows[:10]
    df = docs(rows)
    counts, pairs = brute_links(rows)
    out = ngram_join.join_documents(df, links=True).cache()
    assert sorted(((r["doc_id"], r["n_links"]) for r in out.collect()), key=repr) == counts
    node = {frozenset(shingles(t)): int(ngram_join.nodes(ngram_join.Shingler().sets([t]))[0]) for _, t in rows}
    linked = [tuple(r) for r in ngram_join.linked_pairs(df).collect()]
    assert len(linked) == len(set(linked)) == len(pairs) > 100
    assert {frozenset(p) for p in linked} == {frozenset(node[s] for s in p) for p in pairs}
    assert {r["node"] for r in out.collect()} == set(node.values())
    assert ngram_join.linked_pairs(docs([])).count() == 0


def test_the_matrix_equals_plain_sets():
    rng = random.Random(7)
    base = list(range(300))
    sets = []
    for _ in range(60):
        gone = set(rng.sample(base, rng.choice([0, 5, 20, 60, 100])))
        sets.append(np.array(sorted(set(base) - gone | {rng.randrange(1000, 2000) for _ in range(rng.choice([0, 5, 40]))}), dtype=np.int64))
    rows, cols = np.arange(25), np.arange(20, 60)
    got = ngram_join.linked_matrix(sets, rows, cols, 75, 100)
    for i, r in enumerate(rows):
        for j, c in enumerate(cols):
            x, y = set(sets[r].tolist()), set(sets[c].tolist())
            assert got[i, j] == (100 * len(x & y) >= 75 * len(x | y))


def test_blocks_that_cannot_link_are_skipped():
    sizes, left = np.repeat([10, 12, 40, 44, 200], 4), np.repeat([10, 12, 4, 44, 190], 4)
    met = [(x.start // 4, y.start // 4) for x, y in ngram_join.blocks_may_link(sizes, left, 75, 100, 4)]
    assert met == [(0, 0), (0, 1), (1, 1), (3, 3), (4, 4)]  # sizes apart, and a block whose places leave too little


def test_odd_rows(odd, docs):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd) == brute(rows)
    assert got(docs([])) == []


def test_keep_one(odd, docs):
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 8, 9, 10] and ids.count(None) == 2


def test_keep_one_loses_no_text(docs):
    """An id of a third of all rows, with one text often and many others: each text or a linked one stays."""
    base = [f"b{k}" for k in range(60)]
    near = lambda k: " ".join(base[:k] + ["new"] + base[k + 1 :])
    rows = [(5, "one text that is there again and again")] * 40 + [(5, f"text {k} of its own and nothing like it at all {k}") for k in range(30)]
    rows += [(5, near(1)), (5, near(2)), (9, near(3)), (5, ""), (5, "  "), (None, near(4)), (7, None)] + [(k, "one text that is there again and again") for k in range(20, 40)]
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs(rows)).collect()]
    assert sorted(t for i, t in kept if i == 5 and t.startswith("text ")) == sorted(t for _, t in rows[40:70])
    assert sum(t == "one text that is there again and again" for _, t in kept) == 1
    assert sum((t or "").startswith("b0") or (t or "").startswith("new") for i, t in kept if i is not None) == 1
    assert sorted((i, t) for i, t in kept if t is not None and not t.strip()) == [(5, ""), (5, "  ")] and (7, None) in kept and (None, near(4)) in kept
    assert len(kept) == 30 + 1 + 1 + 2 + 1 + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t\n", max_size=30), max_size=6))
def test_shingle_counts(texts):
    assert [len(h) for h in ngram_join.Shingler().sets(texts)] == [len(shingles(t)) for t in texts]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    out = {r["id"]: r["comp"] for r in components(df, Workspace(spark, "test"), "c").collect()}
    assert out == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1100), 1000)}


def test_signatures_rule_out_no_link():
    """Sets of all sizes (so signatures of several lengths): no pair that links is ruled out, most others are."""
    rng = random.Random(3)
    sets = []
    for size in (1, 5, 31, 33, 120, 130, 500, 520, 40_000):
        base = [rng.getrandbits(64) for _ in range(size)]
        for share in (0, 0, 0.05, 0.1, 0.14, 0.2, 0.4, 1):
            sets.append(np.array(sorted({rng.getrandbits(64) if rng.random() < share else x for x in base[: rng.randint(size * 9 // 10, size) or 1]}), dtype=np.uint64))
    i, j = np.triu_indices(len(sets), 1)
    size = np.array([len(s) for s in sets])
    shared = np.array([len(np.intersect1d(sets[x], sets[y])) for x, y in zip(i, j, strict=True)])
    linked = 100 * shared >= 75 * (size[i] + size[j] - shared)
    allowed = ngram_join.signatures_allow(ngram_join.signatures(sets), size, i, j, 75, 100)
    assert linked.sum() > 50 and allowed[linked].all()
    far = (shared == 0) & (100 * np.minimum(size[i], size[j]) >= 75 * np.maximum(size[i], size[j])) & (np.maximum(size[i], size[j]) <= 1 << (ngram_join.SIGN_BITS - 1))
    assert far.sum() > 30 and allowed[far].mean() < 0.05


def test_sets_are_fetched_for_likely_pairs_only(docs, monkeypatch):
    """Documents that share a passage, not enough to link: few of them are compared, and few sets are stored and shuffled."""
    asked = []
    fetch = ngram_join._sets
    monkeypatch.setattr(ngram_join, "_sets", lambda rows, wanted, n: (asked.append(wanted.count()), fetch(rows, wanted, n))[1])
    part = lambda name, k: " ".join(f"{name}x{j}" for j in range(k))
    rows = [(3 * k + j, f"{part(f'own{k}q{j}', 60)} {part(f'shared{k}', 60)}") for k in range(40) for j in range(3)]
    rows += [(1000 + k, part(f"copy{k // 2}", 100) + f" end{k}") for k in range(20)]
    assert got(docs(rows)) == brute(rows)
    assert 20 <= sum(asked) <= 30, asked


@pytest.mark.parametrize("bits", [24, 7])
def test_keep_one_shuffles_few_texts(docs, spark, bits, monkeypatch):
    """Where no table is small enough to be sent to all tasks: the rows that stay are not shuffled for the few that go,
    and none is lost where its id shares a mark with theirs (nearly all do with 7 bits)."""
    monkeypatch.setattr(workspace, "MARK_BITS", bits)
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(60)) for _ in range(600)]
    rows = [(7 * k, t) for k, t in enumerate(texts)] + [(7 * k + 1, texts[k] + " end") for k in range(60)]
    rows += [(9000, texts[0] + " more"), (9000, "a text of its own"), (None, texts[3]), (9001, None)]
    sc, limit = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngram_join.keep_one(docs(rows))
        sc.setJobGroup(f"kept{bits}", "the rows themselves")
        got = kept.select("doc_id", "text").collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = rows[:600] + [(9000, "a text of its own"), (None, texts[3]), (9001, None)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(f"kept{bits}") for s in sc.statusTracker().getJobInfo(j).stageIds}
    moved = sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    if bits == 24:
        assert moved < 0.3 * sum(len(t or "") for _, t in rows), moved
