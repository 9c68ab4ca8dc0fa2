"""BPE by speculation: greedy longest matches, vectorised pair checks, exact merging where a check fails."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import session, text_groups

#: Words whose tokens a worker keeps; beyond it the memory starts anew.
CACHE = 400_000
#: Checked pairs that a worker keeps.
PAIRS = 2_000_000
#: Stands at the end of a word: the vocabulary's end-of-word suffix as one character.
END = "\x01"
NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge_exactly(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merges the pair of least rank, leftmost first, until none is left."""
    symbols, none = list(symbols), (NEVER, 0)
    found = [merges.get(p, none) for p in zip(symbols, symbols[1:])]
    while found:
        least = min(found)
        if least is none:
            break
        at = found.index(least)
        symbols[at : at + 2] = [least[1]]
        del found[at]
        if at:
            found[at - 1] = merges.get((symbols[at - 1], symbols[at]), none)
        if at < len(found):
            found[at] = merges.get((symbols[at], symbols[at + 1]), none)
    return symbols


class Vocabulary:
    """A BPE vocabulary with an end-of-word suffix, and what the pair checks need to know of each token.

    While a token is merged, its first and last part are, one after another, the tokens of its left and right edge;
    each part lasts until the rank of the merge that takes it up. Two tokens can stand side by side unless some part
    at the left one's right edge and some part at the right one's left edge have a merge of their own before either
    is gone (of equal ranks the left merge comes first).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        short = lambda s: s[: -len(suffix)] + END if s.endswith(suffix) else s
        #: The rule by which normalized text falls into words.
        self.rule = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.ids = {short(s): i for s, i in model["vocab"].items()}
        self.shown = {i: s for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.shown |= {i: s for s, i in self.special.items()}
        self.merges = {}
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            a, b = short(a), short(b)
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.longest = max(map(len, self.ids))
        self.size = max(self.shown) + 1
        keys = sorted((a * self.size + b, rank) for (a, b), (rank, _) in self.merges.items())
        self.keys, self.ranks = np.array([k for k, _ in keys], dtype=np.int64), np.array([r for _, r in keys], dtype=np.int64)
        self._edges()

    def symbols(self, word: str) -> list[int]:
        """The single symbols of a word that ends in END; its last letter carries the suffix."""
        return [self.ids[c] for c in word[:-2]] + [self.ids[word[-2:]]] if word.endswith(END) else [self.ids[c] for c in word]

    def _edges(self) -> None:
        """left, right: the tokens at a token's edges, innermost last; until: the rank that ends each. Only tokens that
        merging yields from their own symbols are ever proposed."""
        parts: dict[int, tuple[int, int, int]] = {}
        for (a, b), (rank, c) in self.merges.items():
            if c not in parts or rank < parts[c][2]:
                parts[c] = (a, b, rank)
        self.usable = {}
        for s, i in self.ids.items():
            if i not in parts:
                self.usable[s] = i
            elif merge_exactly(self.symbols(s), self.merges) == [i]:
                self.usable[s] = i
        edges = {}
        for i in self.shown:
            for side in (0, 1):
                chain, now, until = [], i, NEVER
                while True:
                    chain.append((now, until))
                    if now not in parts:
                        break
                    now, until = parts[now][side], parts[now][2]
                edges[i, side] = chain
        depth = max(map(len, edges.values()))
        self.edge = np.full((2, self.size, depth), -1, dtype=np.int64)
        self.until = np.full((2, self.size, depth), -1, dtype=np.int64)
        for (i, side), chain in edges.items():
            self.edge[side, i, : len(chain)], self.until[side, i, : len(chain)] = zip(*chain, strict=True)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays as it is when its text is merged."""
        good = np.ones(len(left), dtype=bool)
        a, a_until = self.edge[1, left], self.until[1, left]
        b, b_until = self.edge[0, right], self.until[0, right]
        for i in range(a.shape[1]):
            for j in range(b.shape[1]):
                at = np.flatnonzero((a[:, i] >= 0) & (b[:, j] >= 0) & good)
                if not len(at):
                    continue
                key = a[at, i] * self.size + b[at, j]
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank = np.where(self.keys[k] == key, self.ranks[k], NEVER)
                good[at[(rank < a_until[at, i]) & (rank <= b_until[at, j]) & (rank < NEVER)]] = False
        return good

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest matches; None where they don't come out."""
        out, at, n, usable = [], 0, len(word), self.usable
        while at < n:
            stop = min(n, at + self.longest)
            while stop > at:
                if stop != n - 1 and (token := usable.get(word[at:stop])) is not None:
                    break
                stop -= 1
            if stop == at:
                return None
            out.append(token)
            at = stop
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class WordEncoder:
    """Tokens of words, by speculation; words and pairs once settled are kept."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.kept: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.letters = byte_letters()
        self.table = {b: self.letters[b] for b in range(256)}
        self.speculated = self.failed = 0

    def spell(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.table) + END

    def encode(self, words: list[str]) -> list[list[int]]:
        spelled = [self.spell(w) for w in words]
        tokens = [self.v.propose(w) for w in spelled]
        self.speculated += len(words)
        known = [k for k, t in enumerate(tokens) if t is not None]
        flat = np.array([x for k in known for x in tokens[k]], dtype=np.int64)
        owner = np.repeat(np.array(known, dtype=np.int64), [len(tokens[k]) for k in known])
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.array([], dtype=np.int64)
        key = flat[inner] * self.v.size + flat[inner + 1]
        unique, which = np.unique(key, return_inverse=True)
        good = np.array([self.pairs.get(k, -1) for k in unique.tolist()], dtype=np.int8)
        new = good < 0
        good[new] = self.v.compatible(unique[new] // self.v.size, unique[new] % self.v.size)
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        self.pairs.update(zip(unique[new].tolist(), good[new].tolist(), strict=True))
        wrong = {k for k, t in enumerate(tokens) if t is None} | set(owner[inner[good[which] == 0]].tolist())
        self.failed += len(wrong)
        for k in wrong:
            tokens[k] = merge_exactly(self.v.symbols(spelled[k]), self.v.merges)
        return tokens

    def settle(self, words: set[str]) -> None:
        if len(self.kept) + len(words) > CACHE:
            self.kept.clear()
        new = [w for w in words if w not in self.kept]
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.kept.update(zip(part, self.encode(part), strict=True))


class TextEncoder:
    """Whole texts: special tokens spelled out, normalization, words, tokens.

    The rule for words is the vocabulary file's own. What a letter, a digit or white space is depends on the Unicode
    tables of whoever applies it, so texts with any character outside PLAIN are normalized and split by the library.
    """

    #: Characters on which this module and the library agree wherever they stand (a test tries each of them).
    PLAIN = regex.compile(r"[\t-\r -~¡-¬®-ſ‐-‧€]*")

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.words = WordEncoder(vocabulary(path))
        self.normalizer = Tokenizer.from_file(path).normalizer
        rule = self.words.v.rule
        self.split, self.library = regex.compile(rule), pre_tokenizers.Split(Regex(rule), "removed", invert=True)
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in self.words.v.special) + ")")

    def split_words(self, text: str) -> list[str]:
        if self.PLAIN.fullmatch(text):
            return self.split.findall(unicodedata.normalize("NFC", text).lower())
        return [w for w, _ in self.library.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def parts(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens that the text spells out."""
        if "<|" not in text:
            return self.split_words(text)
        out: list[str | int] = []
        for k, piece in enumerate(self.specials.split(text)):
            out += [self.words.v.special[piece]] if k % 2 else self.split_words(piece)
        return out

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; a few MB of texts at a time."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= 2_000_000):
                size += len(texts[stop])
                stop += 1
            split = [self.parts(t) for t in texts[at:stop]]
            self.words.settle({w for parts in split for w in parts if isinstance(w, str)})
            kept = self.words.kept
            for parts in split:
                yield list(chain.from_iterable([kept[w] if isinstance(w, str) else [w] for w in parts]))
            at = stop


class Decoder:
    """Texts of ids: the tokens as the vocabulary shows them, joined by spaces; ids that it lacks are left out."""

    def __init__(self, vocab: Vocabulary):
        self.shown = vocab.shown

    def decode(self, ids: list[int]) -> str:
        try:
            return " ".join(map(self.shown.__getitem__, ids))
        except KeyError:
            return " ".join([self.shown[i] for i in ids if i in self.shown])


def encode_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id and ids, the token ids of the whole text (null: none). Repeated rows and null ids
    are kept, columns other than the two named are not read, and an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(path)
        for batch in batches:
            for who, texts in text_groups(batch.column(0).to_pylist(), batch.column(1)):
                ids = pa.array(list(encoder.encode([t or "" for t in texts])), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), ids], ["doc_id", "ids"])

    session(df)
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per input row: doc_id and text, decoded from the ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary(path))
        for batch in batches:
            texts = [decoder.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    session(df)
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def encode_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, all of the whole text.

    The first digest is of the ids, the second of the text decoded from those ids. A null text counts as empty: no
    tokens, and the digests of nothing. Repeated rows and null ids are kept, columns
    other than the two named are not read, and an empty table gives an empty result.
    """

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = TextEncoder(path), Decoder(vocabulary(path))
        written = [str(i) for i in range(vocabulary(path).size)]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            n, told, back = [], [], []
            for ids in encoder.encode([x or "" for x in batch.column(1).to_pylist()]):
                n.append(len(ids))
                told.append(sha(" ".join(map(written.__getitem__, ids))))
                back.append(sha(decoder.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())], names)

    session(df)
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
