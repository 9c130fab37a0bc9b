"""Exact Jaccard join of word n-gram sets with signature trees.

Texts with equal sets form a class; classes A, B link when |A & B| is at least
num / den of |A | B|. The result is the connected components of the links.

1. Roots. Two linked sets share one of their first tokens in any common order
   (a set of n tokens: the first n - ceil(n num / den) + 1). The order puts
   tokens that many documents hold last (a bounded table of frequent tokens,
   counted over all documents, affects the order only). All classes that hold
   a token among their first form that token's root. Tokens held once are left
   out by a bitmap of fixed size.
2. Trees. Under a root, leaves hold a few classes, inner nodes the OR of their
   token bitmaps, their range of set sizes and the most tokens that share a
   bit. Two nodes are visited together; a pair of nodes is dropped when its
   sizes are too far apart or the largest overlap that its bitmaps allow is too
   small, or when all it holds is connected already. What is left are pairs of
   classes to verify; of those that would connect the same classes, one is
   taken (a root yields fewer pairs than it has classes).
3. Links. A bitmap of two bits a token, kept for every class, rules out most
   pairs that are far apart; the others are verified on the whole sets. A pair that fails sends the
   roots that hold it into another round, in which it is skipped; links found
   so far count as connected. No pair to verify: the links connect all that any
   further link could. Later rounds take more pairs at once.

A root of more than ``BLOCK`` classes is cut into blocks and visited pair of
blocks by pair of blocks, so no task holds more than two blocks; equal sets
are one class, so exact copies never meet.

Null and empty texts have the empty set and link with nothing. Repeated rows
have equal sets. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotline.llm.common import Stored, mix, passes, repeated_filter, row_id, shingle_set, ship, slices, texts, whole_groups
from lotline.llm.components import components

WORDS, NUM, DEN = 4, 85, 100
BITS = 512  # of a class's token bitmap
LEAF = 16
FAN = 8
BLOCK = 8_192
WIDEST = 1 << 16  # bits of the largest wide bitmap
FREQUENT = 1 << 20  # tokens in the table of frequent ones (9 bytes each)
COUNTED = 2_000_000  # tokens that a task counts at once


def set_digest(s: np.ndarray) -> int:
    """A 64-bit number of a set of tokens; its class."""
    total = mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return int(mix(np.array([total ^ (np.uint64(len(s)) << np.uint64(40))])).view(np.int64)[0])


def bitmap(s: np.ndarray) -> np.ndarray:
    """The token bitmap of a set, as 64-bit words."""
    bits = np.zeros(BITS, dtype=np.uint8)
    bits[(s >> np.uint64(20)) % np.uint64(BITS)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def wide_bitmap(s: np.ndarray) -> bytes:
    """A token bitmap of at least two bits a token, as large as the next power of two."""
    bits = min(WIDEST, max(256, 1 << int(2 * len(s) - 1).bit_length()))
    out = np.zeros(bits, dtype=np.uint8)
    out[(s >> np.uint64(20)) % np.uint64(bits)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def wide_overlap(na: int, a: bytes, nb: int, b: bytes) -> int:
    """The largest overlap of two sets that their wide bitmaps allow."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    while len(x) > len(y):  # a bitmap of half the size is the OR of the halves
        x = x[: len(x) // 2] | x[len(x) // 2:]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2:]
    only_x, only_y = (int(np.bitwise_count(v).sum()) for v in (x & ~y, y & ~x))
    return min(na - only_x, nb - only_y)


def frequent_tokens(mapped, words: int, keep: Stored) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens that several documents hold, the most frequent: values in order, and their levels.
    ``mapped`` applies a function of Arrow batches (text first) to the documents."""
    def run(batches):
        held, n = [], 0
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                held.append(shingle_set(t, words))
                n += len(held[-1])
            if n >= COUNTED:
                yield counted(held)
                held, n = [], 0
        if held:
            yield counted(held)

    def counted(held):
        value, times = np.unique(np.concatenate(held), return_counts=True)
        several = times > 1
        return pa.RecordBatch.from_arrays([pa.array(value[several].view(np.int64)), pa.array(times[several], pa.int64())], names=["token", "n"])

    counts = mapped(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = keep.put(counts.where("n >= 4").select("token", F.floor(F.log2("n")).cast("int").alias("level")), "frequent")
    # whole levels, from the top, as far as they fit
    least, taken = 0, 0
    for r in sorted(counts.groupBy("level").count().collect(), reverse=True):  # at most 64 rows
        taken += r["count"]
        least = r.level if taken <= FREQUENT else max(least, r.level + 1)
    top = counts.where(F.col("level") >= least).toPandas()  # FREQUENT rows at most
    keep.drop("frequent")
    value = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(value)
    return value[order], top["level"].to_numpy(dtype=np.uint8)[order]


def first_tokens(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], num: int, den: int) -> np.ndarray:
    """The first tokens of a set: n - ceil(n num / den) + 1 of n."""
    n = len(s)
    if not n:
        return s
    level = np.zeros(n, dtype=np.uint8)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], s), len(frequent[0]) - 1)
        level = np.where(frequent[0][at] == s, frequent[1][at], np.uint8(0))
    return s[np.lexsort((s, level))[: n + (-n * num // den) + 1]]


class Forest:
    """Connected numbers 0 .. n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


class Tree:
    """Nodes over classes in order: level 0 are the leaves."""

    def __init__(self, size, maps, extra, root):
        self.levels = []
        n = len(size)
        cuts = np.append(np.arange(0, n, LEAF), n)
        low, high = np.minimum.reduceat(size, cuts[:-1]), np.maximum.reduceat(size, cuts[:-1])
        most = np.maximum.reduceat(extra, cuts[:-1])
        ored = np.bitwise_or.reduceat(maps, cuts[:-1], axis=0)
        one = np.where(np.minimum.reduceat(root, cuts[:-1]) == np.maximum.reduceat(root, cuts[:-1]), root[cuts[:-1]], -1)
        while True:
            self.levels.append((low, high, most, ored, one))
            if len(low) == 1:
                break
            at = np.arange(0, len(low), FAN)
            one = np.where(np.minimum.reduceat(one, at) == np.maximum.reduceat(one, at), one[at], -1)
            low, high, most, ored = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(most, at), np.bitwise_or.reduceat(ored, at, axis=0)


def candidate_pairs(size, maps, extra, root, num: int, den: int, apart: int = -1):
    """Pairs (i, j), i < j, of classes that may link and whose roots differ, by
    a dual traversal. ``apart``: a pair has one class before and one from that
    number on (two blocks)."""
    tree = Tree(size, maps, extra, root)
    stack = [(len(tree.levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        depth, a, b = stack.pop()
        if len(a) > 2048:  # a bounded number of node pairs at once
            stack += [(depth, a[:2048], b[:2048]), (depth, a[2048:], b[2048:])]
            continue
        low, high, most, ored, one = tree.levels[depth]
        far = (high[a] * den < low[b] * num) | (high[b] * den < low[a] * num)
        need = -(-(low[a] + low[b]) * num // (num + den))
        shared = np.bitwise_count(ored[a] & ored[b]).sum(axis=1, dtype=np.int64) + np.minimum(most[a], most[b])
        overlap = np.minimum(shared, np.minimum(high[a], high[b]))
        keep = ~far & (overlap >= need) & ~((one[a] == one[b]) & (one[a] >= 0))
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if depth:
            n = len(tree.levels[depth - 1][0])
            x = np.repeat(a[:, None] * FAN + np.arange(FAN), FAN, axis=1).ravel()
            y = np.tile(b[:, None] * FAN + np.arange(FAN), (1, FAN)).ravel()
            inside = (x < n) & (y < n) & (x <= y)
            stack.append((depth - 1, x[inside], y[inside]))
            continue
        for at in range(0, len(a), 64):
            x = np.repeat(a[at: at + 64, None] * LEAF + np.arange(LEAF), LEAF, axis=1).ravel()
            y = np.tile(b[at: at + 64, None] * LEAF + np.arange(LEAF), (1, LEAF)).ravel()
            inside = (x < y) & (y < len(size))
            if apart >= 0:
                inside &= (x < apart) != (y < apart)
            x, y = x[inside], y[inside]
            ok = _may_link(size, maps, extra, x, y, num, den) & (root[x] != root[y])
            yield x[ok], y[ok]


def _may_link(size, maps, extra, x, y, num, den):
    """Whether the largest overlap that two bitmaps allow is enough for a link."""
    both = np.bitwise_count(maps[x] & maps[y]).sum(axis=1, dtype=np.int64)
    bx, by = size[x] - extra[x], size[y] - extra[y]  # bits set
    overlap = np.minimum(np.minimum(size[x] - (bx - both), size[y] - (by - both)), both + np.minimum(extra[x], extra[y]))
    return overlap * (num + den) >= num * (size[x] + size[y])


def spanning_pairs(cls, size, maps, extra, root, tried, num, den, more: int, apart: int = -1):
    """Pairs of classes under one root to verify: of the candidates not tried
    yet, a spanning forest, and with ``more`` above one up to so many further
    pairs of each class (later rounds, so that their number stays small)."""
    n = len(cls)
    forest = Forest(n)
    firsts: dict[int, int] = {}
    for i, r in enumerate(root.tolist()):
        forest.join(firsts.setdefault(r, i), i)
    out: list[tuple[int, int]] = []
    skip = lambda i, j: (cls[i], cls[j]) in tried or (cls[j], cls[i]) in tried
    # the first class against all others: most of a group of near copies connects here
    x0 = np.zeros(n - 1, dtype=np.int64)
    y0 = np.arange(1, n)
    if apart >= 0:
        inside = y0 >= apart
        x0, y0 = x0[inside], y0[inside]
    ok = _may_link(size, maps, extra, x0, y0, num, den)
    for j in y0[ok].tolist():
        if not skip(0, j) and forest.join(0, j):
            out.append((0, j))
    now = np.array([forest.root(i) for i in range(n)])
    if n == 2 or (now == now[0]).all():
        return out
    if apart < 0:
        order = np.lexsort((size, now))
    else:
        order = np.concatenate([np.lexsort((size[:apart], now[:apart])), apart + np.lexsort((size[apart:], now[apart:]))])
    extra_links: dict[int, int] = {}
    for x, y in candidate_pairs(size[order], maps[order], extra[order], now[order], num, den, apart):
        for i, j in zip(order[x].tolist(), order[y].tolist(), strict=True):
            if skip(i, j):
                continue
            if forest.join(i, j):
                out.append((i, j))
            elif more > 1 and extra_links.get(i, 0) < more and extra_links.get(j, 0) < more:
                extra_links[i] = extra_links.get(i, 0) + 1
                extra_links[j] = extra_links.get(j, 0) + 1
                out.append((i, j))
    return out


def cluster(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, block: int = BLOCK) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, class (equal for equal sets)
    and component_id (the smallest doc_id that links reach) of every row."""
    spark = docs.sparkSession
    ship(spark)
    keep = Stored(spark, "jaccard")
    rows = texts(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    sc = spark.sparkContext

    def digests(batches):
        for b in slices(batches):
            s = [shingle_set(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(x) for x in s], pa.int64()), pa.array([set_digest(x) for x in s], pa.int64()),
                                               pa.array([wide_bitmap(x) for x in s], pa.binary())], names=["doc_id", "key", "n", "c", "wide"])

    members = keep.put(rows.mapInArrow(digests, "doc_id long, key long, n long, c long, wide binary"), "members")
    # one row a class, with the document that stands for it in what follows
    classes = keep.put(members.groupBy("c").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("wide").alias("wide"),
                                                F.min(mark()).alias("mark")), "classes")
    marked = rows.select("text", mark())
    some = _of_marks(marked, classes.where("n > 0").select("mark"))
    frequent = sc.broadcast(frequent_tokens(some, words, keep))

    def prefixes(batches):
        seen: set[int] = set()
        for b in slices(batches):
            found = []
            for t in b.column(0).to_pylist():
                s = shingle_set(t, words)
                if len(s) and (c := set_digest(s)) not in seen:
                    seen.add(c)
                    found.append(first_tokens(s, frequent.value, num, den))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], names=["token"])

    shared = sc.broadcast(repeated_filter(some(prefixes, "token long")))

    def roots(batches):
        seen: set[int] = set()
        for b in slices(batches, 64):
            tokens, cs, ns, maps = [], [], [], []
            for t in b.column(0).to_pylist():
                s = shingle_set(t, words)
                if not len(s) or (c := set_digest(s)) in seen:
                    continue
                seen.add(c)
                first = first_tokens(s, frequent.value, num, den)
                first = first[passes(shared.value, first)]
                tokens.append(first.view(np.int64))
                cs += [c] * len(first)
                ns += [len(s)] * len(first)
                maps += [bitmap(s).tobytes()] * len(first)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens) if tokens else [], pa.int64()), pa.array(cs, pa.int64()), pa.array(ns, pa.int64()), pa.array(maps, pa.binary())], names=["token", "c", "n", "map"])

    cells = some(roots, "token long, c long, n long, map binary").groupBy("token", "c").agg(F.first("n").alias("n"), F.first("map").alias("map"))
    cells = keep.put(cells, "roots")
    counts = cells.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    cells = keep.put(cells.join(counts, "token"), "shared-roots")
    keep.drop("roots")

    labels = keep.put(spark.createDataFrame([], "v long, root long"), "no-labels")
    tried = keep.put(spark.createDataFrame([], "a long, b long"), "no-tries")
    links = keep.put(spark.createDataFrame([], "a long, b long"), "no-links")
    names = {"labels": "no-labels", "tried": "no-tries", "links": "no-links", "active": "shared-roots"}

    def replaced(which: str, df: DataFrame, name: str) -> DataFrame:
        """A table that takes the place of an earlier one, which goes."""
        made = keep.put(df, name)
        keep.drop(names[which])
        names[which] = name
        return made

    sets, active, turn = [], cells, 0
    while True:
        turn += 1
        pairs = keep.put(_visit(active, labels, tried, num, den, 16 ** (turn - 1), block), f"pairs-{turn}")
        if pairs.isEmpty():
            break
        likely = keep.put(_likely(pairs, classes, num, den), f"likely-{turn}")
        keep.drop(f"pairs-{turn}")
        far = likely.where("not likely").select("a", "b")
        pairs = likely.where("likely").select("a", "b")
        ends = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
        for known in sets:
            ends = ends.join(known.select("c"), "c", "left_anti")
        ends = keep.put(ends.join(classes.select("c", "mark"), "c"), f"ends-{turn}")
        if not ends.isEmpty():  # sets of later rounds are mostly those of earlier ones
            sets.append(_whole_sets(marked, ends, words, keep, f"sets-{turn}"))
        keep.drop(f"ends-{turn}")
        every = sets[0] if sets else spark.createDataFrame([], "c long, tokens array<long>")
        for more in sets[1:]:
            every = every.unionByName(more)
        a, b = (every.select(F.col("c").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
        size = F.size("ta") + F.size("tb")
        both = F.size(F.array_intersect("ta", "tb"))
        judged = keep.put(pairs.join(a, "a").join(b, "b").select("a", "b", (both * (num + den) >= num * size).alias("ok")), f"judged-{turn}")
        failed = judged.where("not ok").select("a", "b").unionByName(far)
        new = judged.where("ok").select("a", "b")
        if not new.isEmpty():
            links = replaced("links", links.unionByName(new), f"links-{turn}")
            labels = components(links, keep, f"labels-{turn}")
        if failed.isEmpty():
            break
        tried = replaced("tried", tried.unionByName(failed), f"tries-{turn}")
        again = failed.select(F.col("b").alias("c")).unionByName(failed.select(F.col("a").alias("c"))).distinct()
        open_roots = active.join(again, "c", "left_semi").select("token").distinct()
        active = replaced("active", active.join(open_roots, "token", "left_semi"), f"open-{turn}")
        keep.drop(f"likely-{turn}")
        keep.drop(f"judged-{turn}")
    keep.drop(names["active"])
    for i in range(1, turn + 1):
        keep.drop(f"sets-{i}")
    named = classes.join(labels.withColumnRenamed("v", "c"), "c", "left").select("c", "least", F.coalesce("root", "c").alias("root"))
    found = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("c", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return members.drop("wide").join(found, "c", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("c").alias("class"), own.alias("component_id"))


def mark():
    """A number of a document."""
    return F.xxhash64(row_id(), "key").alias("mark")


def _of_marks(marked: DataFrame, wanted: DataFrame):
    """Maps a function of Arrow batches over the texts (text, mark) whose mark is wanted, and
    some more by chance: a bitmap saves work on the others, and shuffling their texts. The choice and
    the function share a Python worker: one a task, and no text passes twice."""
    held = marked.sparkSession.sparkContext.broadcast(repeated_filter(wanted.unionAll(wanted)))

    def chosen(batches):
        for b in batches:
            may = passes(held.value, b.column(1).to_numpy())
            if may.any():
                yield b.filter(pa.array(may))

    return lambda run, schema: marked.mapInArrow(lambda batches: run(chosen(batches)), schema)


def _likely(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, likely: whether the wide bitmaps of a pair allow a link."""
    side = lambda x: classes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}"))

    def run(batches):
        for b in slices(batches, 1024):
            na, wa, nb, wb = (b.column(i).to_pylist() for i in (2, 3, 4, 5))
            ok = [wide_overlap(i, x, j, y) * (num + den) >= num * (i + j) for i, x, j, y in zip(na, wa, nb, wb, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "likely"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "wa", "nb", "wb")
    return both.mapInArrow(run, "a long, b long, likely boolean")


def _whole_sets(marked: DataFrame, ends: DataFrame, words: int, keep: Stored, name: str) -> DataFrame:
    """c, tokens (the whole set) of the classes in ``ends`` (c, mark)."""

    def run(batches):
        seen: set[int] = set()
        for b in slices(batches):
            cs, out = [], []
            for t in b.column(0).to_pylist():
                s = shingle_set(t, words)
                if len(s) and (c := set_digest(s)) not in seen:
                    seen.add(c)
                    cs.append(c)
                    out.append(s.view(np.int64))
            ends_at = np.cumsum([0, *(len(x) for x in out)])
            lists = pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), lists], names=["c", "tokens"])

    made = _of_marks(marked, ends.select("mark"))(run, "c long, tokens array<long>").join(ends, "c", "left_semi")
    return keep.put(made.dropDuplicates(["c"]), name)


def _visit(cells: DataFrame, labels: DataFrame, tried: DataFrame, num: int, den: int, more: int, block: int) -> DataFrame:
    """Distinct pairs (a < b) to verify, from the trees of all roots."""
    partners = tried.groupBy("b").agg(F.collect_list("a").alias("tried")).withColumnRenamed("b", "c")
    given = (cells.join(labels.withColumnRenamed("v", "c"), "c", "left").join(partners, "c", "left")
             .select("token", "c", "n", "map", "m", F.coalesce("root", "c").alias("root"), F.coalesce("tried", F.array().cast("array<long>")).alias("tried")))
    # large roots: blocks of classes, visited pair by pair
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("c"), blocks).cast("int")
    small = given.where(F.col("m") <= block).select(F.col("token").alias("key"), F.lit(0).alias("side"), "c", "n", "map", "root", "tried")
    large = given.where(F.col("m") > block).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    large = large.select(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("key"),
                         F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "c", "n", "map", "root", "tried")

    def run(batches):
        for t in whole_groups(batches, "key", 20_000):
            key, c, n, root, side = (t.column(x).to_numpy() for x in ("key", "c", "n", "root", "side"))
            maps = np.frombuffer(b"".join(t.column("map").to_pylist()), dtype=np.uint64).reshape(len(key), -1)
            extra = n - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
            lists = t.column("tried").combine_chunks()
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            cuts = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
            out = []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                order = s + np.lexsort((c[s:e], side[s:e]))
                apart = int((side[s:e] == 1).sum()) if (side[s:e] == 2).any() else -1
                if apart == 0:
                    continue
                skip = {(int(x), int(c[i])) for i in order.tolist() for x in flat[offsets[i]: offsets[i + 1]]}
                found = spanning_pairs(c[order].tolist(), n[order], maps[order], extra[order], root[order], skip, num, den, more, apart)
                out += [(int(c[order[i]]), int(c[order[j]])) for i, j in found]
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in out], pa.int64()), pa.array([max(p) for p in out], pa.int64())], names=["a", "b"])

    return small.unionByName(large).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The first document (all its columns) of each component: the smallest id,
    of one id the smallest hash of the text. Documents without words all stay;
    of rows equal in id and text one stays."""
    found = cluster(docs, words, num, den).withColumn("id", row_id())
    firsts = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("f")).select("f.id", "f.key")
    stay = firsts.unionByName(found.where("n_shingles = 0").select("id", "key").distinct())
    own = docs.select(row_id().alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    one = Window.partitionBy("id", "key").orderBy("id")
    first = own.join(stay, ["id", "key"], "left_semi").withColumn("n", F.row_number().over(one)).where("n = 1")
    return first.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
