"""Byte-pair encoding and decoding with a word-end vocabulary.

``encode_documents`` turns each whole text into token ids the way the
vocabulary's own library does (special tokens in the text included, none
added); ``decode_documents`` turns ids back into the token text.

Words are merged over a contiguous rank array: a short word keeps its parts
and the ranks of neighbouring pairs in two small lists, the minimum is found
by a scan, one boundary is deleted and the two neighbouring ranks are read
anew. Words of more than ``LONG_WORD`` bytes, for which repeated scans grow
with the square of the length, take the same merges from a heap.

Texts are rows of one map stage: no shuffle, nothing gathered. The vocabulary
(a file of under 2 MB, its path is a parameter) is read on the driver and
broadcast; each worker keeps four tables of at most ``CACHE_WORDS`` encoded words,
and two of runs of several words between white space: a full table becomes an old
one, and what is asked for again comes back from there, so frequent words stay.

Null and empty texts have no tokens and decode to the empty text. Repeated
rows give repeated results; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import ship, slices

LONG_WORD = 64
CACHE_WORDS = 30_000  # of a table of words, or of runs
OLD_TABLES = 3  # of words, kept beside the newest
NO_RANK = 1 << 30


def _byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable in Latin-1,
    else the next free code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(free))
        free += b not in plain
    return out


class WordBpe:
    """One vocabulary, ready to encode and decode texts."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for t, i in [*ids.items(), *self.special.items()]:
            self.token[i] = t
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[ids[a] << 32 | ids[b]] = r
            self.merged.append(ids[a + b])
        letters = _byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + self.end] for c in letters]
        # fixed value: the vocabulary's own word pattern and white space rule
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.marks = sorted({s[:2] for s in self.special})
        self.cache: dict[str, bytes] = {}  # by word, and by run of several words between white space
        self.chunks: dict[str, bytes] = {}
        self.old_cache: list[dict[str, bytes]] = []  # those before, whose entries come back when they are asked for
        self.old_chunks: dict[str, bytes] = {}

    def merge(self, parts: list[int]) -> list[int]:
        return self._scan(parts) if len(parts) <= LONG_WORD else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank, merged = self.rank.get, self.merged
        ranks = [rank(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            parts[i] = merged[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 32 | parts[i + 1], NO_RANK)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := rank(parts[x] << 32 | parts[y])) is not None:
                    heapq.heappush(queue, (q, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def word(self, w: str) -> bytes:
        """Ids of a word that the newer words don't hold."""
        out = next((t[w] for t in self.old_cache if w in t), None)
        if out is None:
            raw = w.encode("utf-8", "replace")
            parts = [self.inner[b] for b in raw[:-1]]
            parts.append(self.last[raw[-1]])
            parts = self.merge(parts)
            out = struct.pack(f"<{len(parts)}I", *parts)
        if len(w) <= LONG_WORD:
            if len(self.cache) >= CACHE_WORDS:
                self.old_cache, self.cache = [self.cache, *self.old_cache][:OLD_TABLES], {}
            self.cache[w] = out
        return out

    def chunk(self, c: str) -> bytes:
        """Ids of a run without white space (no word reaches beyond it) that is none of the newer words and runs."""
        if c.isascii() and c.isalpha():
            return self.cache.get(c) or self.word(c)  # letters alone: one word
        out = self.old_chunks.get(c)
        if out is None:
            words = self.words.findall(c)
            out = b"".join([self.cache.get(w) or self.word(w) for w in words])
            if len(words) == 1:
                return out
        if len(c) <= LONG_WORD:
            if len(self.chunks) >= CACHE_WORDS:
                self.old_chunks, self.chunks = self.chunks, {}
            self.chunks[c] = out
        return out

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letters are lower-cased one by one
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split() alone
            return b"".join([self.cache.get(w) or self.word(w) for w in self.words.findall(text)])
        word, known, chunk = self.cache.get, self.chunks.get, self.chunk
        return b"".join([word(c) or known(c) or chunk(c) for c in text.split()])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.special or not any(m in text for m in self.marks):
            return self._plain(text)
        return b"".join(np.array([self.special[s]], dtype="<u4").tobytes() if s in self.special else self._plain(s)
                        for s in self.specials.split(text))

    def decode(self, ids) -> str:
        """Token texts with a space between them (this vocabulary has no decoder of its own)."""
        return " ".join([self.token[i] for i in ids])


_READY: dict[int, WordBpe] = {}


def _coder(shared) -> WordBpe:
    """The worker's one copy of a broadcast vocabulary."""
    key = hash(shared.value)
    if key not in _READY:
        _READY.clear()
        _READY[key] = WordBpe(shared.value)
    return _READY[key]


def _vocabulary(df: DataFrame, path: str):
    spark = df.sparkSession
    ship(spark)
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(df: DataFrame, vocabulary_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of its text column as a binary column ``out``
    (little-endian unsigned 32-bit integers; empty for null and empty texts)."""
    shared = _vocabulary(df, vocabulary_path)

    def run(batches):
        coder = _coder(shared)
        for b in slices(batches):
            ids = [coder.encode(t) if t else b"" for t in b.column(0).to_pylist()]
            rest = [b.column(i) for i in range(1, b.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.large_binary()).cast(pa.binary())], names=names)

    others = [c for c in df.columns if c != out]
    names = [*others, out]
    schema = df.select(*[F.col(f"`{c}`") for c in others]).withColumn(out, F.lit(b"").cast("binary")).schema
    return df.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in others]).mapInArrow(run, schema)


def decode_documents(df: DataFrame, vocabulary_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the token text of its id column as a string column ``out``."""
    shared = _vocabulary(df, vocabulary_path)

    def run(batches):
        coder = _coder(shared)
        for b in slices(batches):
            got = [coder.decode(np.frombuffer(x, dtype="<u4").tolist()) if x else "" for x in b.column(0).to_pylist()]
            rest = [b.column(i) for i in range(1, b.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(got, pa.string())], names=names)

    others = [c for c in df.columns if c != out]
    names = [*others, out]
    schema = df.select(*[F.col(f"`{c}`") for c in others]).withColumn(out, F.lit("").cast("string")).schema
    return df.select(F.col(f"`{ids}`").alias("__ids"), *[F.col(f"`{c}`") for c in others]).mapInArrow(run, schema)
