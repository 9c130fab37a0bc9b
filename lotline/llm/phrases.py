"""Phrase collocations of every language by Toivonen's sampling method.

A phrase is a run of 2 to 4 words inside a piece of text; it is frequent when it
occurs at least ``least`` times in its language. No phrase is frequent unless
both of its parts that are one word shorter are.

1. Documents are sampled by hash. Phrases that occur ``PROPOSE`` times in the
   sample (far below the share of ``least`` that falls to it) are proposed, length by length; their
   hashes become one bitmap a length, sized by their number.
2. One pass over all documents counts exactly the proposed phrases and their negative border:
   the phrases that weren't proposed although both shorter parts were. Every
   single word is counted.
3. A frequent phrase of the border means that longer ones around it may have been missed.
   Then an expansion pass counts what the frequent phrases found so far allow and the first pass hasn't
   counted. A phrase that is still to be decided counts as frequent there, so
   longer phrases around it are counted in the same pass, and one expansion closes the border.

4. Counts go by a 61-bit hash of language and words, which keeps their shuffle small. A last
   pass gives the frequent hashes their words; hashes that turn out to stand for several phrases
   (they can only have been counted too high) are counted once more by the words themselves.

A bitmap lets some further phrases be counted by chance; it never loses one.

Cuts are scored by joins of the frequent phrases with themselves, contained
phrases by one grouping of the parts of longer ones; the best ``top`` of a language
are cut down in every task before they meet.

Null texts are empty; a null language is ``und``. Rows with equal id and text are
counted each. Empty tables and texts give no rows. Other columns take no part,
whatever their names. A text is read in pieces cut at line breaks and
punctuation, so memory grows with the longest piece alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotline.llm.common import _LOWER, Stored, mix, passes, prefix_sums, row_id, ship, slices, span_hashes

LONGEST = 4
LEAST = 30
SAMPLE = 8  # one document in so many is sampled
PROPOSE = 2
TOP = 2_000
CHUNK_BYTES = 1 << 20
HELD = 1 << 19
MAX_BITS = 1 << 28
COVER = 80  # a phrase goes when a longer one around it has so many hundredths of its count
SCALE = 2_000_000

_KIND = np.zeros(256, dtype=np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_K = np.uint64(0x9E3779B97F4A7C15)


def _lang_hash(lang: str) -> np.uint64:
    s = prefix_sums(np.frombuffer(lang.encode("utf-8", "surrogatepass") + b"\0", dtype=np.uint8))
    return mix(s[-1:])[0]


class Words:
    """The words of a chunk of texts: bytes (lower-cased), starts, ends, piece
    numbers and language numbers of each."""

    def __init__(self, parts: list[tuple[int, bytes]], langs: list[str]):
        self.langs = langs
        data = _LOWER[np.frombuffer(b"\n".join(t for _, t in parts) + b"\n", dtype=np.uint8)]
        kind = _KIND[data]
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[1:] = kind == 0
        edge = np.diff(inside)
        self.data, self.starts = data, np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        lengths = np.array([len(t) + 1 for _, t in parts], dtype=np.int64)
        of = np.searchsorted(np.cumsum(lengths), self.starts, side="right")
        self.lang = np.array([k for k, _ in parts], dtype=np.int32)[of] if len(of) else np.zeros(0, dtype=np.int32)
        salt = np.array([_lang_hash(x) for x in langs], dtype=np.uint64)[self.lang]
        self.made = [mix(span_hashes(data, self.starts, self.ends) + salt)]

    def hashes(self, n: int) -> np.ndarray:
        """A hash of the n words from each word on (whatever piece they're in); its last bits say n."""
        while len(self.made) < n:
            k = len(self.made)
            self.made.append(mix(self.made[-1][: max(len(self.starts) - k, 0)] * _K + self.made[0][k:] + np.uint64(k)))
        return self.made[n - 1] & ~np.uint64(7) | np.uint64(n)

    def together(self, n: int) -> np.ndarray:
        """Whether the n words from each word on lie in one piece."""
        last = max(len(self.starts) - n + 1, 0)
        return self.piece[:last] == self.piece[n - 1: n - 1 + last]

    def allowed(self, n: int, bitmaps: list[np.ndarray]) -> np.ndarray:
        """Whether bitmaps hold both shorter parts of the n words from each word on."""
        if n == 1:
            return np.ones(len(self.starts), dtype=bool)
        known = passes(bitmaps[n - 2], self.hashes(n - 1))
        return known[:-1] & known[1:] & self.together(n) if len(known) else known

    def text(self, n: int, at: np.ndarray) -> pa.Array:
        """The n words from each of these words on, joined by one space."""
        ends, starts = self.ends, self.starts
        length = sum((ends[at + k] - starts[at + k] for k in range(n)), np.full(len(at), n - 1, dtype=np.int64))
        to = np.concatenate([[0], np.cumsum(length)])
        out = np.full(to[-1], 0x20, dtype=np.uint8)
        place = to[:-1].copy()
        for k in range(n):
            size = ends[at + k] - starts[at + k]
            before = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(before, size)
            out[np.repeat(place, size) + step] = self.data[np.repeat(starts[at + k], size) + step]
            place += size + 1
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(out)]).cast(pa.string())


def _pieces(text: bytes):
    """A text in parts of about ``CHUNK_BYTES``, cut where pieces end."""
    at = 0
    while len(text) - at > CHUNK_BYTES:
        kind = _KIND[np.frombuffer(text, dtype=np.uint8, offset=at + CHUNK_BYTES // 2)]
        breaks = np.flatnonzero(kind == 2)
        if not len(breaks):
            break
        near = breaks[breaks <= CHUNK_BYTES // 2]
        cut = at + CHUNK_BYTES // 2 + int(near[-1] if len(near) else breaks[0])
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _chunks(batches):
    """The words of Arrow batches of (lang, text), some megabytes at a time."""
    held, size, langs = [], 0, {}
    for b in slices(batches):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            for part in _pieces(text):
                held.append((langs.setdefault(lang, len(langs)), part))
                size += len(part) + 1
                if size >= CHUNK_BYTES:
                    yield Words(held, list(langs))
                    held, size, langs = [], 0, {}
    if held:
        yield Words(held, list(langs))


class Tally:
    """Counts of hashes, added up in a task as long as they fit."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, h: np.ndarray):
        if len(h):
            self.parts.append(np.unique(h, return_counts=True))
            self.rows += len(self.parts[-1][0])
        if self.rows >= 2 * HELD:
            yield from self.flush(HELD)

    def flush(self, least: int = 0):
        """The counts so far, if there are ``least`` different hashes."""
        if not self.parts:
            return
        h, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        if len(self.parts) > 1:
            h, at = np.unique(h, return_inverse=True)
            n = np.bincount(at, weights=n, minlength=len(h)).astype(np.int64)
        self.parts, self.rows = [(h, n)], len(h)
        if self.rows >= least:
            self.parts, self.rows = [], 0
            for i in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[i: i + (1 << 16)].view(np.int64)), pa.array(n[i: i + (1 << 16)], pa.int64())], names=["h", "n"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _bitmap(hashes: DataFrame, rows: int) -> np.ndarray:
    """A bitmap of the one long column, with some 64 bits a value, up to ``MAX_BITS``."""
    bits = 1 << 20
    while bits < min(64 * rows, MAX_BITS):
        bits *= 2
    place = F.pmod(F.col("h"), F.lit(bits)) + 1  # Spark numbers bits from 1 on
    maps = (hashes.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in maps.collect():  # bits / 8 bytes at most in all
        at = (r.bucket - 1) * len(r.bits)
        out[at: at + len(r.bits)] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


def _added_up(counts: DataFrame) -> DataFrame:
    """Sums of counts that tasks have added up already: shuffled as they are, as
    few of them would meet an equal one before."""
    return counts.repartition("h").groupBy("h").agg(F.sum("n").alias("n"))


def _proposed(sample: DataFrame, propose: int, keep: Stored) -> list[np.ndarray]:
    """Bitmaps of the phrases of 1 to LONGEST - 1 words that the sample proposes."""
    sc, maps = sample.sparkSession.sparkContext, []
    for n in range(1, LONGEST):
        shared = sc.broadcast(maps)

        def count(batches, n=n, shared=shared):
            tally = Tally()
            for words in _chunks(batches):
                yield from tally.add(words.hashes(n)[words.allowed(n, shared.value)])
            yield from tally.flush()

        found = keep.put(_added_up(sample.mapInArrow(count, "h long, n long")).where(F.col("n") >= propose).select("h"), f"proposed-{n}")
        maps = [*maps, _bitmap(found, found.count())]
        keep.drop(f"proposed-{n}")
        shared.unpersist()
    return maps


def _counted(rows: DataFrame, proposed: list[np.ndarray], frequent: list[np.ndarray] | None) -> DataFrame:
    """Counts (h, n) of the proposed phrases and their border; with ``frequent`` (bitmaps of
    what that found) of all that was left out and may be frequent."""
    shared = rows.sparkSession.sparkContext.broadcast((proposed, frequent))

    def count(batches):
        proposed, frequent = shared.value
        tallies = [Tally() for _ in range(LONGEST)]
        for words in _chunks(batches):
            may = None  # of one length less: frequent, or still to be counted
            for n, tally in enumerate(tallies, 1):
                at = words.allowed(n, proposed)
                if frequent is not None:
                    at = ~at if n == 1 else may[:-1] & may[1:] & words.together(n) & ~at
                    if n < LONGEST:
                        may = at | passes(frequent[n - 1], words.hashes(n))
                yield from tally.add(words.hashes(n)[at])
        for tally in tallies:
            yield from tally.flush()

    return _added_up(rows.mapInArrow(count, "h long, n long"))


def _named(rows: DataFrame, bitmaps: list[np.ndarray]) -> DataFrame:
    """h, lang and phrase of the phrases that bitmaps hold (and both parts of), seldom more
    than once a task, and rows (null, lang, null, n) of the words of every language."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmaps)
    names = ["h", "lang", "phrase", "n"]

    def run(batches):
        done = np.zeros(0, dtype=np.uint64)
        totals: dict[str, int] = {}
        for words in _chunks(batches):
            for lang, n in zip(words.langs, np.bincount(words.lang, minlength=len(words.langs)).tolist(), strict=True):
                totals[lang] = totals.get(lang, 0) + n
            fresh = [done]
            for n in range(1, LONGEST + 1):
                h = words.hashes(n)
                at = np.flatnonzero(words.allowed(n, shared.value) & passes(shared.value[n - 1], h))
                h, first = np.unique(h[at], return_index=True)
                new = ~np.isin(h, done, assume_unique=True)
                h, at = h[new], at[first[new]]
                fresh.append(h)
                lang = pa.array(words.langs, pa.string()).take(pa.array(words.lang[at]))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), lang, words.text(n, at), pa.nulls(len(h), pa.int64())], names=names)
            done = np.concatenate(fresh)
            if len(done) > 4 * HELD:  # told again, if they come again
                done = done[:0]
        there = {k: v for k, v in totals.items() if v}
        yield pa.RecordBatch.from_arrays([pa.nulls(len(there), pa.int64()), pa.array(list(there), pa.string()), pa.nulls(len(there), pa.string()),
                                          pa.array(list(there.values()), pa.int64())], names=names)

    return rows.mapInArrow(run, "h long, lang string, phrase string, n long")


def settled(counts: DataFrame, names: DataFrame, rows: DataFrame, least: int, keep: Stored) -> DataFrame:
    """lang, phrase, words and n of the counted hashes. A hash that stands for
    several phrases is counted anew by the phrases themselves."""
    met = keep.put(counts.join(names.where("h is not null").select("h", "lang", "phrase"), "h"), "named")
    shared = [r.h for r in met.groupBy("h").count().where("count > 1").collect()]  # none, but for a chance of n * n / 2**62
    alone = met.select("lang", "phrase", _words_of().cast("int").alias("words"), "n", "h")
    if not shared:
        return alone.drop("h")
    return alone.where(~F.col("h").isin(shared)).drop("h").unionByName(_by_text(rows, shared).where(F.col("n") >= least))


def _by_text(rows: DataFrame, hashes: list[int]) -> DataFrame:
    """lang, phrase, words and n of all phrases with one of these hashes."""
    wanted = np.array(hashes, dtype=np.int64).view(np.uint64)

    def run(batches):
        for words in _chunks(batches):
            for n in range(1, LONGEST + 1):
                at = np.flatnonzero(words.together(n) & np.isin(words.hashes(n), wanted))
                lang = pa.array(words.langs, pa.string()).take(pa.array(words.lang[at]))
                yield pa.RecordBatch.from_arrays([lang, words.text(n, at), pa.array(np.full(len(at), n), pa.int32())], names=["lang", "phrase", "words"])

    return rows.mapInArrow(run, "lang string, phrase string, words int").groupBy("lang", "phrase", "words").agg(F.count(F.lit(1)).alias("n"))


def _words_of() -> Column:
    """The number of words of a counted hash."""
    return F.col("h").bitwiseAND(F.lit(7))


def frequent_phrases(docs: DataFrame, least: int = LEAST, sample: int = SAMPLE, propose: int = PROPOSE) -> tuple[DataFrame, DataFrame, int]:
    """lang, phrase, words and n of all phrases of 1 to LONGEST words with at least
    ``least`` occurrences; lang and n of all words; the number of passes that were needed to count."""
    spark = docs.sparkSession
    ship(spark)
    keep = Stored(spark, "phrases")
    rows = _rows(docs)
    taken = keep.put(_rows(docs.where(F.pmod(F.xxhash64(row_id()), F.lit(sample)) == 0)), "sample")
    proposed = _proposed(taken, propose, keep)
    keep.drop("sample")

    def by_length(table: DataFrame) -> list[np.ndarray]:
        table = table.withColumn("words", _words_of())
        sizes = {r.words: r["count"] for r in table.groupBy("words").count().collect()}
        return [_bitmap(table.where(F.col("words") == k).select("h"), sizes.get(k, 0)) for k in range(1, LONGEST + 1)]

    counts = keep.put(_counted(rows, proposed, None).where(F.col("n") >= least), "pass-1")
    shared = spark.sparkContext.broadcast(proposed)

    def unforeseen(batches):
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            n = h & np.uint64(7)
            known = sum(int(passes(shared.value[k - 1], h[n == k]).sum()) for k in range(1, LONGEST))
            yield pa.RecordBatch.from_arrays([pa.array([len(h) - known], pa.int64())], names=["n"])

    passed = 1
    if counts.where(_words_of() < LONGEST).select("h").mapInArrow(unforeseen, "n long").agg(F.sum("n")).first()[0]:
        passed = 2
        counts = counts.unionByName(keep.put(_counted(rows, proposed, by_length(counts)).where(F.col("n") >= least), "pass-2"))
    names = keep.put(_named(rows, by_length(counts)).groupBy("h", "lang", "phrase").agg(F.sum("n").alias("n")), "names")
    found = keep.put(settled(counts, names, rows, least, keep), "frequent")
    words = keep.put(names.where("h is null").select("lang", "n"), "languages")
    for name in ("pass-1", "names", "named"):
        keep.drop(name)
    return found, words, passed


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _words(first: Column, n: Column, of: Column) -> Column:
    return F.array_join(F.slice(of, first, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, sample: int = SAMPLE, propose: int = PROPOSE) -> DataFrame:
    """lang, rank, phrase, a (count), l and r (counts of the parts of the
    lowest-scoring cut), n (words of the language) and score."""
    found, words, _ = frequent_phrases(docs, least, sample, propose)
    count = found.select("lang", "phrase", F.col("n").alias("count"))
    split = F.split("phrase", " ")
    long = found.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), "words", split.alias("w"))
    cuts = long.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words(F.lit(1), F.col("k"), F.col("w")).alias("left"), _words(F.col("k") + 1, F.col("words") - F.col("k"), F.col("w")).alias("right"))
    cuts = cuts.join(count.select("lang", F.col("phrase").alias("left"), F.col("count").alias("l")), ["lang", "left"])
    cuts = cuts.join(count.select("lang", F.col("phrase").alias("right"), F.col("count").alias("r")), ["lang", "right"])
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # for every phrase inside a longer one: the highest count of those
    inner = long.where("words > 2").select("lang", "a", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("first"))
    around = inner.groupBy("lang", _words(F.col("first"), F.col("size"), F.col("w")).alias("phrase")).agg(F.max("a").alias("around"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (_exact(F.col("around")) * 100 < _exact(F.col("a")) * COVER))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
