"""Byte-pair encoding and decoding of whole texts with a word-end vocabulary.

Byte pairs that occur inside no token are certain cuts: no merge crosses them.  Words fall apart
there, and the fragments of all words of a batch are merged together in numpy.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WORD_END = "</w>"
NEVER = np.int32(2**31 - 1)
#: Unicode's White_Space property.
WHITE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 letters for
    themselves, the others from U+0100 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


@lru_cache(1)
def word_pattern() -> re.Pattern:
    """Contractions, runs of letters, single numbers, runs of other visible characters."""
    def ranges(first: str) -> str:
        out, start = [], None
        for c in range(sys.maxunicode + 2):
            hit = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == first
            if hit and start is None:
                start = c
            elif not hit and start is not None:
                out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        return "".join(out)

    letters, numbers = ranges("L"), ranges("N")
    return re.compile(
        f"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{WHITE}{letters}{numbers}]+"
    )


#: The same words where a text's letters, numbers and white space are those of Python's own classes.
PLAIN_WORDS = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")


#: The only such characters below 128: controls that Python takes for white space.
_CONTROLS = re.compile(r"[\x1c-\x1f]")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(1)
def unlike_plain() -> re.Pattern:
    """Characters below 2^16 that Python's classes and the categories sort differently."""
    odd = []
    for i in range(65536):
        c = chr(i)
        kind = unicodedata.category(c)[0]
        digit, word = c.isdecimal(), c.isalnum()
        if (kind == "L") != (word and not digit) or (kind == "N") != digit or (
            c.isspace() != bool(re.match(f"[{WHITE}]", c)) if c.isspace() or i in (0x85, 0xA0) else False
        ):
            odd.append(f"\\u{i:04x}")
    return re.compile("[" + "".join(odd) + "]")


class Vocabulary:
    """Tokens, merges and certain cuts of a vocabulary file in the tokenizers library's format."""

    def __init__(self, text: str):
        data = json.loads(text)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"] if t["content"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.final = np.array([vocab[c + WORD_END] for c in letters], dtype=np.int32)
        # joined[0]: pairs inside a token; joined[1]: pairs that end a token with a word's end.
        self.joined = np.zeros((2, 65536), dtype=bool)
        for token in vocab:
            ends = token.endswith(WORD_END) and len(token) > len(WORD_END)
            raw = [byte_of[c] for c in (token[: -len(WORD_END)] if ends else token)]
            pairs = [a << 8 | b for a, b in zip(raw, raw[1:])]
            if pairs and ends:
                self.joined[1, pairs.pop()] = True
            self.joined[0, pairs] = True
        keys, made = [], []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(vocab[left] << 16 | vocab[right])
            made.append(vocab[left + right])
        self.made = np.array(made, dtype=np.int32)
        self._index(np.array(keys, dtype=np.int64))

    def _index(self, keys: np.ndarray, bits: int = 19) -> None:
        """Ranks of pairs in an open hash table."""
        self.bits = bits
        self.slots = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, NEVER, dtype=np.int32)
        for rank, key in enumerate(keys.tolist()):
            at = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - bits)
            while self.slots[at] >= 0 and self.slots[at] != key:
                at = (at + 1) & ((1 << bits) - 1)
            if self.slots[at] < 0:
                self.slots[at], self.ranks[at] = key, rank

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 16 | right
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.slots[at]
        out = np.where(found == keys, self.ranks[at], NEVER)
        open_ = np.nonzero((found != keys) & (found >= 0))[0]
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slots[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def fragments(self, words: list[bytes]):
        """Starting symbols of all words, the starts of their fragments, and of their words."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        last = np.zeros(len(raw), dtype=bool)
        last[ends - 1] = True
        symbols = np.where(last, self.final[raw], self.inner[raw])
        pair = raw[:-1].astype(np.int64) << 8 | raw[1:]
        whole = np.where(last[1:], self.joined[1, pair], self.joined[0, pair]) & ~last[:-1]
        starts = np.nonzero(np.concatenate([[True], ~whole]))[0]
        return symbols, starts, ends - sizes

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apply the merges within each fragment; the symbols left and their number by fragment.

        In each round every fragment merges the pairs of its lowest rank, from the left.  Fragments
        that are done leave, so that a long one does not hold up the others.
        """
        out = symbols.copy()
        sizes = np.diff(np.append(starts, len(symbols)))
        home, frag = starts, np.arange(len(starts))
        final = sizes.copy()
        s, n = symbols, sizes
        pos = np.cumsum(n) - n
        r = np.full(len(s), NEVER, dtype=np.int32)
        if len(s) > 1:
            r[:-1] = self.rank(s[:-1], s[1:])
        r[pos + n - 1] = NEVER
        while len(n):
            low = np.minimum.reduceat(r, pos)
            busy = low != NEVER
            if not busy.all():
                self._store(out, final, s, n, pos, home, frag, ~busy)
                keep = np.repeat(busy, n)
                s, r, n, home, frag, low = s[keep], r[keep], n[busy], home[busy], frag[busy], low[busy]
                pos = np.cumsum(n) - n
                if not len(n):
                    break
            hit = r == np.repeat(low, n)
            if (hit[1:] & hit[:-1]).any():  # of equal pairs that overlap, every other one counts
                at = np.nonzero(hit)[0]
                first = np.concatenate([[True], np.diff(at) != 1])
                run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                hit[at[(np.arange(len(at)) - run) % 2 == 1]] = False
            at = np.nonzero(hit)[0]
            s = s.copy()
            s[at] = self.made[r[at]]
            keep = np.ones(len(s), dtype=bool)
            keep[at + 1] = False
            n = n - np.add.reduceat(hit, pos)
            moved = np.cumsum(keep) - 1
            r[at] = r[at + 1]  # a merged symbol that ends its fragment has no pair; others follow below
            s, r = s[keep], r[keep]
            pos = np.cumsum(n) - n
            end = np.zeros(len(s), dtype=bool)
            end[pos + n - 1] = True
            new = moved[at]
            near = np.zeros(len(s) + 1, dtype=bool)
            near[new], near[new - 1] = True, True  # -1 is the spare place at the end
            touched = np.nonzero(near[:-1] & ~end)[0]
            r[touched] = self.rank(s[touched], s[touched + 1])
            r[end] = NEVER
        return out, final

    @staticmethod
    def _store(out, final, s, n, pos, home, frag, done) -> None:
        count = n[done]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(home[done], count) + inside] = s[np.repeat(pos[done], count) + inside]
        final[frag[done]] = count

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and their number by word."""
        if not words:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        symbols, starts, word_starts = self.fragments(words)
        ids, count = self.merge(symbols, starts)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        flat = ids[np.repeat(starts, count) + inside]
        first = np.searchsorted(starts, word_starts)
        return flat, np.add.reduceat(count, first)

    def normal(self, text: str) -> str:
        """Composed form in lower case, each character by itself (no final sigma).  White space only
        separates words here, so runs of it need no replacing."""
        text = unicodedata.normalize("NFC", text)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def words(self, text: str) -> list[str | int]:
        """The words of a text in order; special tokens' strings stand as their ids."""
        def find(part: str) -> list[str]:
            part = self.normal(part)
            if part.isascii():
                plain = not _CONTROLS.search(part)
            else:
                plain = not (_ASTRAL.search(part) or unlike_plain().search(part))
            return (PLAIN_WORDS if plain else word_pattern()).findall(part)

        if not any(s in text for s in self.special):
            return find(text)
        out: list[str | int] = []
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text):
            if part in self.special:
                out.append(self.special[part])
            else:
                out += find(part)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text.  Every different word of the batch is encoded once."""
        split = [self.words(t) for t in texts]
        place: dict[str | int, int] = {}
        for words in split:
            place.update(dict.fromkeys(words, 0))
        place = dict(zip(place, range(len(place))))
        plain = [w.encode("utf-8", "surrogatepass") for w in place if isinstance(w, str)]
        flat, plain_count = self.encode_words(plain)
        count = np.ones(len(place), dtype=np.int64)
        is_word = np.fromiter((isinstance(w, str) for w in place), dtype=bool, count=len(place))
        count[is_word] = plain_count
        begin = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), dtype=np.int32)
        ids[np.repeat(is_word, count)] = flat
        if not is_word.all():
            ids[begin[~is_word]] = [w for w in place if isinstance(w, int)]
        out = []
        for words in split:
            at = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
            n = count[at]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append(ids[np.repeat(begin[at], n) + inside])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Tokens as they stand in the vocabulary, special ones too, with blanks between."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read())


def pieces(texts: list[str], limit: int = 3_000_000):
    """Runs of texts of about ``limit`` characters, so that a batch's arrays stay small."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def encode_documents(df: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (text of the ids) of every row.

    Null and empty texts have no ids and decode to the empty string; repeated rows stay repeated.
    The vocabulary is read once by the driver and sent to the tasks: a few MB, whatever the input.
    """
    sent = df.sparkSession.sparkContext.broadcast(load(vocabulary_path))

    def run(batches):
        for batch in batches:
            ids_col = batch.column("doc_id")
            texts, at = [t or "" for t in batch.column("text").to_pylist()], 0
            for piece in pieces(texts):
                ids = sent.value.encode(piece)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids_col.slice(at, len(piece)),
                        pa.ListArray.from_arrays(pa.array(offsets), values),
                        pa.array([sent.value.decode(x) for x in ids], pa.string()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )
                at += len(piece)

    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def token_digests(df: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: what ``encode_documents`` gives, digested in
    the same task, so that ids and texts do not leave it."""
    sent = df.sparkSession.sparkContext.broadcast(load(vocabulary_path))

    def run(batches):
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes, ids_sha, text_sha = [], [], []
            for piece in pieces(texts):
                for ids in sent.value.encode(piece):
                    sizes.append(len(ids))
                    ids_sha.append(sha(ids.astype("<u4").tobytes()))
                    text_sha.append(sha(sent.value.decode(ids).encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
