"""Sharding, encoding, media, archives, packing: one row in, described rows out."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe, flac, packing, sharding, warc
from tidemark.llm.workspace import Workspace

P = pytest.importorskip("public_tokenizers")


# ---- sharding ----


def test_shards(odd, docs, spark):
    rows = [(i, f"t{i}") for i in range(3000)]
    out = sharding.assign_shards(docs(rows), 24).toPandas()
    assert set(out["shard"]) == set(range(24)) and (out.law == "key").all()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    moved = out[out.grown_shard != out["shard"]]
    assert (moved.grown_shard == 24).all() and 60 < len(moved) < 200
    again = sharding.assign_shards(docs(rows), 25).toPandas().set_index("doc_id")["shard"]
    assert (again.loc[out.doc_id].to_numpy() == out.grown_shard.to_numpy()).all()
    weighted = sharding.assign_shards(docs(rows), 3, weights=[1, 0, 3]).groupBy("shard").count().collect()
    n = {r["shard"]: r["count"] for r in weighted}
    assert set(n) == {0, 2} and 2.4 < n[2] / n[0] < 3.7
    o = sharding.assign_shards(odd, 4)
    assert o.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and o.count() == odd.count()
    r = {x["doc_id"]: x for x in o.collect()}
    assert r[3]["size"] == 8 and r[3]["text_crc32"] == 0 and r[9]["size"] == 158 and r[9]["text_crc32"] == zlib.crc32(("é " * 50).encode())
    assert sharding.assign_shards(docs([]), 4).count() == 0


def test_shard_choice_equals_its_definition(docs, spark):
    """The least of exponential draws from Spark's own hash of key and shard, computed once more in Python."""
    from pyspark.sql import functions as F

    rows, weights = [(k * 7919, f"t{k}") for k in range(400)], [1.0, 2.5, 0.0, 0.5]
    bits = spark.createDataFrame([(str(i), j) for i, _ in rows for j in range(5)], "k string, j int").select("k", "j", F.xxhash64("k", "j").alias("h")).collect()
    bid = {(r["k"], r["j"]): -math.log(((r["h"] % (1 << 64) >> 11) + 0.5) / (1 << 53)) for r in bits}
    for r in sharding.assign_shards(docs(rows), 4, weights=weights).collect():
        own = {j: bid[str(r["doc_id"]), j] / w for j, w in enumerate([*weights, 1.0]) if w}
        assert r["grown_shard"] == min(own, key=own.get)
        del own[4]
        assert r["shard"] == min(own, key=own.get)


def test_a_repeated_key_spreads(docs, spark, monkeypatch):
    """One key holds a third of the rows, some of them alike altogether: slots stay gapless, pieces small."""
    monkeypatch.setattr(sharding, "ROWS_PER_PIECE", 50)
    rows = [(5, "same")] * 700 + [(5, f"t{k}") for k in range(300)] + [(None, "same")] * 200 + [(k, "x") for k in range(10, 1800)]
    out = sharding.assign_shards(docs(rows).repartition(7), 2).toPandas()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert len(out) == len(rows) and out[out.doc_id == 5]["shard"].nunique() == 1


# ---- BPE ----


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


ENCODER = []


def encoder():
    if not ENCODER:
        ENCODER.append(bpe.TextEncoder(P.path("word_bpe_49k.json")))
    return ENCODER[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="aehrtino s'1", max_size=60)), max_size=5))
def test_encoding_equals_the_library(word_bpe, texts):
    decoder = bpe.Decoder(encoder().words.v)
    for text, ids in zip(texts, encoder().encode(texts), strict=True):
        assert ids == word_bpe.encode(text, add_special_tokens=False).ids
        assert decoder.decode(ids) == word_bpe.decode(ids, skip_special_tokens=False)


def test_every_code_point(word_bpe):
    """Alone and beside letters, digits, marks and a combining accent; plain ones as plain texts, which the library
    doesn't split."""
    plain = [chr(c) for c in range(0x2100) if bpe.TextEncoder.PLAIN.fullmatch(chr(c))]
    other = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not bpe.TextEncoder.PLAIN.fullmatch(chr(c))]
    assert len(plain) > 300
    for points, step, shape in ((plain, 16, "{0} a{0}b 1{0}2 :{0}! {0}{0} '{0}s"), (other, 4096, ":{0}a{0}1")):
        for at in range(0, len(points), step):
            text = " ".join(map(shape.format, points[at : at + step]))
            assert bool(bpe.TextEncoder.PLAIN.fullmatch(text)) == (points is plain)
            [ids] = encoder().encode([text])
            assert ids == word_bpe.encode(text, add_special_tokens=False).ids, points[at]
    for a in plain:  # every pair of plain characters
        text = " ".join(f"{a}{b}" for b in plain)
        assert next(encoder().encode([text])) == word_bpe.encode(text, add_special_tokens=False).ids, a


def test_special_tokens_and_odd_rows(word_bpe, odd, docs):
    texts = ["a<|endoftext|>b<|startoftext|>", "<|endoftext", "ΣΑΣ İ ß ǅ ﬁ", "don't WE'LL", "aaaaaaaaaaaaaaaa" * 40, ":\U0003d000", ":\u0558x", "a\u0c5c1"]
    for text, ids in zip(texts, encoder().encode(texts), strict=True):
        assert ids == word_bpe.encode(text, add_special_tokens=False).ids
    assert encoder().words.failed < encoder().words.speculated
    path = P.path("word_bpe_49k.json")
    for r in bpe.encode_digests(odd, path).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = word_bpe.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(word_bpe.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode_documents(odd, path)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(encoded, path).collect()}
    for r in odd.where("doc_id is not null").collect():
        assert back[r["doc_id"]] == word_bpe.decode(word_bpe.encode(r["text"] or "", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.encode_digests(odd, path).count() == odd.count() == encoded.count()
    assert bpe.encode_digests(docs([]), path).count() == 0 == bpe.decode_documents(bpe.encode_documents(docs([]), path), path).count()


# ---- FLAC ----


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=3000), min_size=1, max_size=4), st.sampled_from([16, 192, 576, 1000]), st.sampled_from([0, 2, 8]))
def test_flac_round_trip(payloads, block, order):
    files = flac.encode_many(payloads, block, order)
    assert flac.decode_many(files) == payloads


def test_flac_kinds_seeks_and_damage():
    rng = np.random.default_rng(0)
    wave = (128 + 100 * np.sin(np.arange(5760) / 20)).astype(np.uint8).tobytes()
    payloads = [bytes(1152), wave, rng.integers(0, 256, 1000).astype(np.uint8).tobytes(), rng.integers(120, 136, 3000).astype(np.uint8).tobytes(), bytes(range(256)) * 9]
    echo = np.zeros(2304)
    for k in range(2, 2304):
        echo[k] = 1.1 * echo[k - 1] - 0.9 * echo[k - 2] + rng.normal() * 12
    payloads.append(np.clip(128 + echo, 0, 255).astype(np.uint8).tobytes())
    files = flac.encode_many(payloads)
    assert flac.decode_many(files) == payloads and len(files[1]) < 0.4 * len(wave) and len(files[0]) < 150
    assert flac.read_samples(files[1], 1000, 2500) == wave[1000:2500]
    reader = flac.Reader(files[1])
    bare = files[1][:4] + b"\x80" + files[1][5:42] + files[1][reader.first :]
    assert flac.decode_many([bare]) == [wave]  # frames found without a seek table
    kinds = {f[flac.frame_header(f, 0)[1]] >> 1 for x in files for f, _ in flac.Reader(x).frames()}
    assert 0 in kinds and 1 in kinds and any(k >= 32 for k in kinds)
    for at in (reader.first + 3, len(files[1]) - 20, 30):
        broken = bytearray(files[1])
        broken[at] ^= 4
        with pytest.raises(flac.Damaged):
            flac.decode_many([bytes(broken)])


def bits(text):
    return np.packbits(np.array([int(c) for c in text], dtype=np.uint8)).tobytes()


def test_flac_partitions_and_escapes():
    """A frame written by hand: fixed order 1, two partitions, one of them escaped to raw 5-bit residuals."""
    x = [3, 5, 4, 4, 2, 9, 10, 1]
    res = [b - a for a, b in zip(x, x[1:])]
    fold = [2 * r if r >= 0 else -2 * r - 1 for r in res]
    rice = "".join("0" * (f >> 1) + "1" + str(f & 1) for f in fold[:3])
    raw = "".join(format(r & 31, "05b") for r in res[3:])
    body = format(9 << 1, "08b") + format(x[0] & 255, "08b") + "00" + "0001" + "0001" + rice + "1111" + "00101" + raw
    frame = flac._header(0, 8) + bits(body + "0" * (-len(body) % 8))
    row = np.frombuffer(frame, dtype=np.uint8)[None, :]
    frame += int(flac.crc16(row, np.array([len(frame)]))[0]).to_bytes(2, "big")
    assert flac.decode_frames([(frame, 8)]).tolist() == [x]


def test_media_columns(odd, docs):
    out = {r["doc_id"]: r for r in flac.media_columns(odd).collect()}
    assert flac.media_columns(odd).count() == odd.count() and flac.media_columns(docs([])).count() == 0
    for r in odd.collect():
        if r["doc_id"] is not None:
            raw = (r["text"] or "").encode()
            pad = flac.padded(raw)
            m = out[r["doc_id"]]
            assert len(pad) % 576 == 0 and len(pad) > 0 and (m["n_bytes"], m["payload_bytes"]) == (len(raw), len(pad))
            assert m["payload_sha256"] == hashlib.sha256(pad).hexdigest() and m["tail_crc32"] == zlib.crc32(pad[-32:])
    assert out[6]["media_sha256"] == out[7]["media_sha256"] and out[3]["feature"] == out[4]["feature"]


def test_stored_blocks(odd, docs):
    """PCM blocks with their offsets, of whole files and of a range of samples; features against a plain loop."""
    media = flac.store_media(odd).cache()
    blocks = flac.read_blocks(media).toPandas()
    texts = {r["doc_id"]: flac.padded((r["text"] or "").encode()) for r in odd.collect() if r["doc_id"] not in (None, 7)}
    files = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    for doc, want in texts.items():
        g = blocks[blocks.doc_id == doc].sort_values("block")
        assert b"".join(map(bytes, g.pcm)) == want and g.sample_offset.tolist() == list(range(0, len(want), 576)) and (g.samples == 576).all()
        for at in g.byte_offset:
            assert files[doc][at : at + 2] == b"\xff\xf8"
    part = flac.read_blocks(media, 600, 1200).toPandas()
    assert set(part.block) == {1, 2} and (part[part.doc_id == 8].sort_values("block").iloc[0].pcm) == texts[8][576:1152]
    assert flac.read_blocks(flac.store_media(docs([]))).count() == 0
    for r in flac.media_columns(odd).collect():
        if r["doc_id"] in texts:
            x = [b - 128 for b in texts[r["doc_id"]]]
            cross = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
            assert r["feature"] == f"n={len(x)};sum={sum(x)};square={sum(v * v for v in x)};cross={cross};peak={max(map(abs, x))}"
            assert r["media_bytes"] == len(files[r["doc_id"]]) and r["media_sha256"] == hashlib.sha256(files[r["doc_id"]]).hexdigest()
    broken = bytearray(files[8])
    broken[-10] ^= 1
    df = docs([]).sparkSession.createDataFrame([(1, bytes(broken))], "doc_id bigint, media binary")
    with pytest.raises(Exception, match="Damaged"):
        flac.read_blocks(df).count()


# ---- WARC ----


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=3000), st.booleans()), max_size=5), st.integers(700, 4000), st.integers(1, 999))
def test_warc_stream_round_trip(records, size, cut):
    stream = b"".join(bytes(p) for k, (body, again) in enumerate(records) for p in warc.record_pieces(f"urn:page:{k}", "http://x/\né", body, "urn:page:7:ab" if again else None, "1970-01-01T00:00:00Z", size))
    got = list(warc.parse(stream[k : k + cut] for k in range(0, len(stream), cut)))
    assert [(r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got] == [(len(b), hashlib.sha1(b).hexdigest(), "revisit" if a else "response", 7 if a else None) for b, a in records]


def test_damaged_streams():
    stream = b"".join(bytes(p) for p in warc.record_pieces("urn:page:1", "u", b"payload" * 50, None, "1970-01-01T00:00:00Z"))
    for bad in (stream[:-5], stream.replace(b"payload", b"paylaod", 1), b"x" + stream):
        with pytest.raises((warc.Damaged, ValueError)):
            list(warc.parse([bad]))


def test_pages(spark):
    same, big = "<p>" + "x" * 2000, "y" * (3 << 20)
    rows = [(1, "u", same, "a"), (2, "u", same, "b"), (3, None, same, "c"), (4, "u", "short", "d"), (5, "u", "short", "e"), (6, "u", None, "f"), (7, "u", big, "g"), (8, "u", big, "h"), (9, "u", "z" * 1000, "i"), (None, "u", same, "j")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type string")
    out = {r["page_id"]: r for r in warc.archive_pages(df).collect()}
    assert len(out) == 10
    assert {i: r["refers_to"] for i, r in out.items()} == {1: 3, 2: 3, 3: None, 4: None, 5: None, 6: None, 7: 8, 8: None, 9: None, None: 3}
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        assert (out[i]["payload_bytes"], out[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert out[8]["chunk_rows"] > 3  # the long payload went through in chunks
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_chunks(spark):
    """Urls of any length, bodies around the bound: chunks number themselves, none is too large, and a revisit names a
    record that is there."""
    size = 5000
    rows = [(k, "u" * (3 * k), "x" * (4000 + 7 * k)) for k in range(0, 300, 5)] + [(1001, "v" * 20_000, "y" * 9999), (1002, "w", "y" * 9999), (1003, "w" * 6000, ""), (1004, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    chunks = warc.write_chunks(df, Workspace(spark, "t"), size=size)
    got = chunks.toPandas().sort_values(["record_id", "chunk"])
    assert got.data.map(len).max() <= size and len(got) > len(rows)
    records, refers = set(), set()
    for _, g in got.groupby("record_id"):
        assert g.chunk.tolist() == list(range(len(g))) and (g.chunks == len(g)).all()
        whole = b"".join(map(bytes, g.data))
        assert g.digest_so_far.iloc[-1] == hashlib.sha1(whole).hexdigest()
        [record] = warc.parse([whole])
        records.add(record["record_id"])
        refers |= {x.split(b"<")[1].split(b">")[0].decode() for x in whole.split(b"\r\n") if x.startswith(b"WARC-Refers-To:")}
    assert len(records) == len(rows) and len(refers) == 1 and refers <= records
    out = {r["page_id"]: r for r in warc.read_chunks(chunks).collect()}
    for i, url, html in rows:
        assert out[i]["payload_digest"] == hashlib.sha1((html or "").encode()).hexdigest()
    assert (out[1001]["refers_to"], out[1002]["refers_to"]) == (1002, None)


# ---- packing ----


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    e = packing.ByteEncoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(max_size=60), st.text(alphabet="ab ' s\n\t1.é　", max_size=60), st.sampled_from(["x<|endoftext|>y", " ", "", "a", "don't  you're"])))
    def check(text):
        assert np.frombuffer(e.encode(text), dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids

    check()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_two_fit_is_a_packing(lengths):
    bins, at = packing.best_two_fit(np.array(lengths, dtype=np.int64), 64)
    ends = {}
    for b, o, n in sorted(zip(bins.tolist(), at.tolist(), lengths, strict=True)):
        assert ends.get(b, 0) == o
        ends[b] = o + n
    assert all(e <= 64 for e in ends.values())
    if lengths:
        bound = max(math.ceil(sum(lengths) / 64), sum(n > 32 for n in lengths))
        assert bound <= len(ends) <= bound * 3 // 2 + 1


def test_two_fill_the_gap_better_than_one():
    # greedy takes 60, then 30; best two: 60 + 20 + 20 fills the bin
    bins, _ = packing.best_two_fit(np.array([60, 30, 20, 20]), 100)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_cut():
    assert packing.cut(10, 4) == [(0, 2), (2, 4), (6, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


def test_pack(odd, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = packing.pack(odd, room=256).toPandas()
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256
    for r in odd.collect():
        if r["doc_id"] not in (7, None):
            ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
            g = out[out.doc_id == r["doc_id"]].sort_values("piece")
            assert g.length.sum() == len(ids) and g.piece.tolist() == list(range(len(g))) and (len(ids) > 256 or len(g) == 1)
            for p in g.itertuples():
                assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
    assert len(out[out.doc_id == 7]) == 2 and out.doc_id.isna().sum() == 2
    assert packing.pack(docs([])).count() == 0


def test_repeated_rows_spread(docs, monkeypatch):
    monkeypatch.setattr(packing, "DOCS_PER_GROUP", 100)
    out = packing.pack(docs([(1, "a b c")] * 2000).repartition(5), room=64).toPandas()
    groups = out.groupby(out.sequence_id // (1 << 32)).size()
    assert len(out) == 2000 and len(groups) == 20 and groups.max() < 200


def test_shared_tables(spark):
    ws = Workspace(spark, "t")
    assert ws.table(spark.range(3), "a").count() == 3
