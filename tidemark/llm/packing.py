"""Best-two-fit packing of tokenized documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import session

#: Documents packed together. With so many, what a group leaves open in its last sequences is lost in rounding.
DOCS_PER_GROUP = 8192
#: Chunks of text whose ids a worker keeps; beyond it the memory starts anew.
CACHE = 300_000


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteEncoder:
    """The ids of a byte-level BPE vocabulary as little-endian unsigned 32-bit bytes.

    Pre-tokens never reach from a non-space into the next space, so a text whose white space comes one at a time
    falls apart at its spaces into chunks that encode on their own; those are kept. Other texts are encoded whole.
    Texts that spell out a special token go through the tokenizers library itself.
    """

    #: White space beside white space, or at an end: there the chunks could differ from the whole.
    RUNS = re.compile(r"\s\s|\s\Z|\A\s")

    def __init__(self, json_path: str, ranks_path: str, pattern: str, special: str = "<|endoftext|>"):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.special, self.whole = json_path, special, None
        core = self.core

        class Kept(dict):
            def __missing__(self, chunk):
                if len(self) >= CACHE:
                    self.clear()
                ids = self[chunk] = np.asarray(core.encode_ordinary(chunk), dtype="<u4").tobytes()
                return ids

        self.kept = Kept()

    def encode(self, text: str) -> bytes:
        if self.special in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json_path)
                self.whole.no_truncation()
                self.whole.no_padding()
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.RUNS.search(text) or len(text) < 2:
            return np.asarray(self.core.encode_ordinary(text), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        get = self.kept.__getitem__
        return b"".join([get(first), *[get(" " + c) for c in rest]])


def cut(n_tokens: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, with the shorter piece, if any, first."""
    head = n_tokens % room
    first = [(0, head)] if head else []
    return first + [(k, room) for k in range(head, n_tokens, room)]


def tokenized(df: DataFrame, room: int, key: str, text: str, json_name: str, ranks_name: str, end_id: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and nth, its place in its partition's output."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = ByteEncoder(_vocabulary(json_name), _vocabulary(ranks_name), public_tokenizers.PATTERN)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        nth = 0
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encoder.encode(value.as_py() or "") + end)
                for k, (start, length) in enumerate(cut(len(ids) // 4, room)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), nth))
                    nth += 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    session(df)
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long")


class Sizes:
    """How many documents of each size are unpacked, with a bit for every size that is left."""

    def __init__(self, lengths: np.ndarray, room: int):
        self.left = np.bincount(lengths, minlength=room + 1).tolist()
        self.room = room
        self.mask = sum(1 << k for k, n in enumerate(self.left) if n)
        #: The same bits, mirrored: bit room - k for size k.
        self.mirror = sum(1 << (room - k) for k, n in enumerate(self.left) if n)

    def take(self, size: int) -> None:
        self.left[size] -= 1
        if not self.left[size]:
            self.mask ^= 1 << size
            self.mirror ^= 1 << (self.room - size)

    def put(self, size: int) -> None:
        if not self.left[size]:
            self.mask |= 1 << size
            self.mirror |= 1 << (self.room - size)
        self.left[size] += 1

    def largest(self, most: int) -> int:
        """The largest size left of at most `most`; 0 if there is none."""
        return max(0, (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def pair(self, most: int, over: int) -> tuple[int, int] | None:
        """Two documents left whose sizes add up to as much as possible in (over, most]; the more uneven pair first."""
        for total in range(most, over, -1):
            # bit k stands for sizes k and total - k both being left
            shift = self.room - total
            both = self.mask & (self.mirror >> shift if shift >= 0 else self.mirror << -shift)
            while both:
                big = both.bit_length() - 1
                small = total - big
                if small < 1 or big < small:
                    break
                if big != small or self.left[big] >= 2:
                    return big, small
                both ^= 1 << big
        return None


def best_two_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (each 1..room). A bin takes the largest document that still fits until none does;
    if it is not full, its smallest document makes way for the two unpacked ones that fill the wider gap best."""
    sizes = Sizes(lengths, room)
    stacks: dict[int, list[int]] = {}
    for i in np.lexsort((np.arange(len(lengths)), lengths))[::-1].tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    n = 0
    while sizes.mask:
        taken, gap = [], room
        while gap and (size := sizes.largest(gap)):
            sizes.take(size)
            taken.append(size)
            gap -= size
        while gap and len(taken) > 1 and (two := sizes.pair(gap + taken[-1], taken[-1])):
            small = taken.pop()
            sizes.put(small)
            for size in two:
                sizes.take(size)
            gap += small - sum(two)
            taken = sorted([*taken, *two], reverse=True)
        at = 0
        for size in taken:
            i = stacks[size].pop()
            bins[i], offsets[i] = n, at
            at += size
        n += 1
    return bins, offsets


def pack(df: DataFrame, room: int = 2048, key: str = "doc_id", text: str = "text", json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken", end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id; a null or empty text is end_id alone. Only a document longer than `room` is cut,
    so that all its pieces but the first fill a sequence each. Groups of about DOCS_PER_GROUP documents, dealt by a
    hash of a piece's id, checksum and place in its partition, are packed on their own: copies and rows that repeat
    altogether spread over groups, no group grows with the corpus, and a group wastes less than a sequence more than one packing of everything. Rows that
    repeat are packed once each; null ids are packed too; columns other than the two named are not read. An empty table
    gives an empty result.
    """
    groups = max(1, math.ceil(df.count() / DOCS_PER_GROUP))
    pieces = tokenized(df, room, key, text, json_name, ranks_name, end_id)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "ids_crc32", "nth"), F.lit(groups)))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "ids_crc32", "length", "nth"], kind="stable", ignore_index=True)
        bins, frame["offset"] = best_two_fit(frame["length"].to_numpy(), room)
        frame["sequence_id"] = frame["_group"].astype("int64") * (1 << 32) + bins
        return frame[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return dealt.groupBy("_group").applyInPandas(packed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
