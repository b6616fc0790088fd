"""N-gram Jaccard join by signature trees.

Documents with equal sets of shingles are one class. A first pass over all texts counts shingles in a table of COUNTERS
hashed counters, a size that doesn't follow the data; it gives every shingle a place in one order for the whole corpus, the
rarer first. Two sets of a Jaccard similarity of percent share e shingles among the first n - ceil(percent * n / 100) + e of
either, n its size, whatever e; it is a tenth of the set here. So classes that share less than that with all others have no
links, and of the m shingles that one shares with others m - e + 1 are enough to meet those it is alike. Any order is right; this one keeps
passages that many documents share behind. Chains of such shingles make components, and every link lies within one.

Each component is a forest of signature trees. In a task, the sets of like size are the leaves of a binary tree, sorted
so that likely partners stand side by side; a node holds the OR of its sets' token bitmaps (BITS a shingle), the range of
their sizes, and their component of links if it is one. A dual traversal goes from the pair of roots to pairs of children and
leaves a pair out where the bits that both have, with the most tokens that share a bit within a set, are fewer than
the overlap that their smallest sizes need, where their sizes are too far apart, or where both are of one component.
Pairs of leaves that are left are confirmed on the full sets. Before, neighbours in a few orders are, so that a group
of near copies is one component early and costs little more than its size, with no pair of it written out.

Components of more than CAP shingles are dealt to blocks: each is solved with the next block, then all members are dealt
anew, those that are linked together, and the blocks are the leaves of a distributed tree whose nodes hold the OR of bitmaps of
front shingles and the range of sizes, FANOUT children each. Its dual traversal is a join for each level; pairs
of blocks that are left are solved as above. So no task holds more than two blocks, and no set is cut.

A set holds the distinct shingles of so many words (all words, if fewer), a 64-bit hash each. Null texts and those
without words have an empty set: no link, a component of their own. Every row gives a row; rows that share a doc_id are
separate documents of that id. component_id is the least doc_id of the component that isn't null. Texts of any length are read
whole. An empty table has an empty result. Only the columns doc_id and text are read, so others can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import bitmap, in_small_batches, may_hold, written
from quillspark.llm.graph import components
from quillspark.llm.shingles import alike, identity, mixed, shingle_set

SIZE, PERCENT = 5, 80
COUNTERS, CHUNK = 1 << 20, 1 << 12
#: Shingles of a block, children of a node, bits a shingle in a task's trees.
CAP, FANOUT, BITS = 1 << 19, 16, 16
#: A set's front shares one in so many of its shingles with that of a set that is alike.
EVIDENCE = 10
SEEN = 1_000_000
#: Pairs of nodes whose bitmaps are compared at once, in 64-bit words.
WORDS_AT_ONCE = 1 << 21
#: Pairs of nodes in one slice of a traversal.
AT_ONCE = 1 << 18
_CLASS = "class binary, root long, n long"


def need(a, b, percent: int):
    """The least overlap of sets of a and b elements that are percent alike."""
    return -(-percent * (a + b) // (100 + percent))


def _rows(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, class of each row; and, in rows with a chunk, the task's counters of shingles."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        names = ["doc_id", "n", "class", "chunk", "counts"]
        kind = pa.null()
        for b in batches:
            kind = b.column(0).type
            sets = [shingle_set(t or "", size) for t in b.column(1).to_pylist()]
            if some := [s for s in sets if len(s)]:
                at = (np.concatenate(some) & np.uint64(COUNTERS - 1)).astype(np.int64)
                counts += np.bincount(at, minlength=COUNTERS)
            ids = pa.array([identity(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), ids, pa.nulls(len(b), pa.int32()), pa.nulls(len(b), pa.binary())], names)
        parts = counts.clip(max=2**32 - 1).astype("<u4").reshape(-1, CHUNK)
        some = np.flatnonzero(parts.any(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), kind), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, class binary, chunk int, counts binary")


def _counters(rows: DataFrame) -> np.ndarray:
    """The counters of all tasks, summed in two steps; COUNTERS numbers, whatever the data."""

    def summed(group: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x in group.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), "<u4")
        return pa.table({"chunk": group.column("chunk")[:1], "counts": pa.array([zlib.compress(total.clip(max=2**32 - 1).astype("<u4").tobytes(), 1)], pa.binary())})

    own = rows.filter("chunk is not null").select("chunk", "counts", (F.spark_partition_id() % 64).alias("part"))
    parts = own.groupBy("chunk", "part").applyInArrow(summed, "chunk int, counts binary").groupBy("chunk").applyInArrow(summed, "chunk int, counts binary").collect()
    out = np.zeros((COUNTERS // CHUNK, CHUNK), np.uint32)
    for r in parts:
        out[r.chunk] = np.frombuffer(zlib.decompress(r.counts), "<u4")
    return out.ravel()


def evidence(n, percent: int):
    """Of how many elements of its front a set of n shares at least with that of any set that is percent alike."""
    return max(1, -(-percent * n // 100) // EVIDENCE)


def front(shingles: np.ndarray, counters: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the corpus's order: so many that sets that are percent alike share one in EVIDENCE of the smaller."""
    n = len(shingles)
    k = n + percent * n // -100 + max(1, n // EVIDENCE)
    return shingles[np.lexsort((shingles, counters[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)]))[:k]]


def _postings(docs: DataFrame, counters: np.ndarray, size: int, percent: int) -> DataFrame:
    """token, c: front shingles with the first 64 bits of the class; a task sends a class once, as long as it remembers it."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            tokens, owners = [], []
            for text in b.column(0).to_pylist():
                s = shingle_set(text or "", size)
                if not len(s) or (own := identity(s)) in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(own)
                tokens.append(front(s, counters, percent))
                owners.append(np.full(len(tokens[-1]), int.from_bytes(own[:8], "big", signed=True), np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners))], ["token", "c"])

    return docs.select("text").mapInArrow(apply, "token long, c long")


def _shared(postings: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """token, c: front shingles that several classes have, of the classes (c, n) that share enough of theirs; of the others, links have none.

    Of m shared shingles a class keeps the first m - e + 1, the more frequent first, e what it shares at least with a set that is alike.
    """
    token = W.partitionBy("token")
    several = lambda rows: rows.select("token", "c", F.min("c").over(token).alias("low"), F.max("c").over(token).alias("high")).filter("low < high").select("token", "c")
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / EVIDENCE))
    found = written(several(postings).distinct())
    enough = found.groupBy("c").agg(F.count(F.lit(1)).alias("m")).join(classes.select("c", "n"), "c").filter(F.col("m") >= least).select("c")
    rows = several(found.join(enough, "c", "left_semi")).withColumn("df", F.count(F.lit(1)).over(token)).join(classes.select("c", "n"), "c")
    own = W.partitionBy("c")
    place, m = F.row_number().over(own.orderBy(F.desc("df"), "token")), F.count(F.lit(1)).over(own)
    rows = rows.withColumn("place", place).withColumn("m", m).filter((F.col("m") >= least) & (F.col("place") <= F.col("m") - least + 1))
    return written(several(rows))


def _members(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The wanted rows (doc_id, class and more) with the shingles of their class."""
    kind, columns = dict(docs.dtypes)["doc_id"], [c for c in wanted.columns if c != "doc_id"]
    keys = wanted.select(F.xxhash64("doc_id").alias("h"))
    map_ = bitmap(keys, min(1 << 26, 1 << (max(1 << 16, 16 * keys.count()) - 1).bit_length()))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(may_hold(map_, b.column(2).to_numpy()))).select(["_d", "text"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t or "", size) for t in b.column(0).to_pylist()]
            fits = pa.array([identity(s) == c for s, c in zip(sets, b.column("class").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([s.tobytes() for s in sets], pa.binary())], [*columns, "shingles"]).filter(fits)

    thin = docs.select(F.col("doc_id").alias("_d"), "text", F.xxhash64("doc_id").alias("h")).mapInArrow(likely, f"_d {kind}, text string")
    kinds = ", ".join(f"{c} {k}" for c, k in wanted.dtypes if c != "doc_id")
    return thin.join(wanted, F.col("_d").eqNullSafe(F.col("doc_id"))).select("text", *columns).mapInArrow(apply, f"{kinds}, shingles binary")


class Parts:
    """Components of links among the sets of a task."""

    def __init__(self, known: list):
        first: dict = {}
        self.up = [first.setdefault(k, i) for i, k in enumerate(known)]
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def link(self, i: int, j: int) -> None:
        self.links.append((i, j))
        self.up[self.find(i)] = self.find(j)


def _leaves(sets: list[np.ndarray], own: np.ndarray, words: int) -> np.ndarray:
    """The bitmaps of some sets, in words of 64 bits."""
    out = np.zeros((len(own), words), np.uint64)
    for k, i in enumerate(own):
        bit = sets[i] % np.uint64(words * 64)
        np.bitwise_or.at(out[k], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _tree(sets: list[np.ndarray], sizes: np.ndarray, own: np.ndarray, words: int) -> list[tuple]:
    """Levels from the leaves to the root: OR of bitmaps, least and largest size, most tokens that share a bit within a set."""
    maps = _leaves(sets, own, words)
    level = (maps, sizes[own], sizes[own], sizes[own] - np.bitwise_count(maps).sum(1, dtype=np.int64))
    out = [level]
    while len(level[0]) > 1:
        fold = [f.reduceat(x, np.arange(0, len(x), 2), axis=0) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum), level, strict=True)]
        out.append(level := tuple(fold))
    return out


def _uniform(parts: Parts, own: np.ndarray, levels: int) -> list[np.ndarray]:
    """For each node of each level the component of its sets, -1 where they are of several."""
    now = np.array([parts.find(i) for i in own.tolist()], np.int64)
    out = [now]
    for _ in range(levels - 1):
        even, odd = now[::2], np.append(now[1::2], now[-1:]) if len(now) % 2 else now[1::2]
        out.append(now := np.where(even == odd, even, -1))
    return out


def _traverse(a: list[tuple], b: list[tuple], uniform: Callable[[], tuple[list[np.ndarray], list[np.ndarray]]], percent: int) -> Iterator[np.ndarray]:
    """The pairs of leaves of two trees (or of one with itself) that no bound rules out, depth first in slices of AT_ONCE pairs.

    uniform: the components of both trees' nodes, as far as they are known by then.
    """
    same, words = a is b, a[0][0].shape[1]
    stack = [(len(a) - 1, len(b) - 1, np.zeros((1, 2), np.int64))]
    while stack:
        la, lb, pairs = stack.pop()
        ua, ub = uniform()
        kept = []
        for lo in range(0, len(pairs), step := max(1, WORDS_AT_ONCE // words)):
            i, j = pairs[lo : lo + step].T
            (ma, lowa, higha, ca), (mb, lowb, highb, cb) = a[la], b[lb]
            ok = (100 * highb[j] >= percent * lowa[i]) & (100 * higha[i] >= percent * lowb[j]) & ((ua[la][i] != ub[lb][j]) | (ua[la][i] < 0))
            i, j = i[ok], j[ok]
            bound = np.bitwise_count(ma[i] & mb[j]).sum(1, dtype=np.int64) + np.minimum(ca[i], cb[j])
            ok = bound >= need(lowa[i], lowb[j], percent)
            kept.append(np.stack([i[ok], j[ok]], 1))
        pairs = np.concatenate(kept)
        if la == 0 and lb == 0:
            yield pairs[pairs[:, 0] < pairs[:, 1]] if same else pairs
            continue
        for side, tree, level in ((0, a, la), (1, b, lb)):
            if level > 0:
                pairs = np.repeat(pairs, 2, 0)
                pairs[:, side] = 2 * pairs[:, side] + np.tile([0, 1], len(pairs) // 2)
                pairs = pairs[pairs[:, side] < len(tree[level - 1][0])]
        if same:
            pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
        stack += [(max(la - 1, 0), max(lb - 1, 0), pairs[lo : lo + AT_ONCE]) for lo in range(0, len(pairs), AT_ONCE)]


def solve(sets: list[np.ndarray], known: list, percent: int) -> list[tuple[int, int]]:
    """Links that make, with those that are known (equal entries of known), the components of all links among the sets."""
    parts, sizes = Parts(known), np.array([len(s) for s in sets], np.int64)

    def confirm(pairs) -> None:
        for i, j in pairs:
            if parts.find(i) != parts.find(j) and alike(sets[i], sets[j], percent):
                parts.link(i, j)

    least = [np.array([int(mixed(s ^ np.uint64(seed)).min()) for s in sets], np.uint64) for seed in (0, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
    for k in least:
        order = np.lexsort((sizes, k))
        confirm(zip(order[:-1].tolist(), order[1:].tolist(), strict=True))
    by_size = np.lexsort((least[0], sizes))
    low = 0
    while low < len(by_size):  # sets of [n, n / percent) with one another and with those of the range beyond
        n = int(sizes[by_size[low]])
        mid, high = (int(np.searchsorted(sizes[by_size], -(-n * 100**p // percent**p), side)) for p, side in ((1, "left"), (2, "right")))
        mid = max(mid, low + 1)
        high = max(high, mid)
        words = -(-BITS * int(sizes[by_size[high - 1]]) // 64)
        lower, upper = (x[np.argsort(least[0][x], kind="stable")] for x in (by_size[low:mid], by_size[mid:high]))
        a = _tree(sets, sizes, lower, words) if len(lower) > 1 or len(upper) else None
        if len(lower) > 1:
            for pairs in _traverse(a, a, lambda: (u := _uniform(parts, lower, len(a)), u), percent):  # noqa: B023
                confirm(lower[pairs].tolist())
        if len(upper):
            b = _tree(sets, sizes, upper, words)
            for pairs in _traverse(a, b, lambda: (_uniform(parts, lower, len(a)), _uniform(parts, upper, len(b))), percent):  # noqa: B023
                confirm(np.stack([lower[pairs[:, 0]], upper[pairs[:, 1]]], 1).tolist())
        low = mid
    return parts.links


def _solved(groups, percent: int) -> DataFrame:
    """Links a, b of grouped members (class, root, known, shingles): within each root of a group."""

    def apply(group: pa.Table) -> pa.Table:
        cls, known = group.column("class").to_pylist(), group.column("known").to_pylist()
        root, packed = group.column("root").to_numpy(), group.column("shingles")
        a, b = [], []
        for own in np.split(order := np.argsort(root, kind="stable"), np.flatnonzero(np.diff(root[order])) + 1):
            at = list({cls[i]: i for i in own.tolist()}.values())
            sets = [np.frombuffer(packed[i].as_py(), np.uint64) for i in at]
            for i, j in solve(sets, [known[i] if known[i] is not None else cls[i] for i in at], percent):
                a.append(cls[at[i]]), b.append(cls[at[j]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return groups.applyInArrow(apply, "a binary, b binary")


def _leaf_pairs(large: DataFrame, tokens: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """root, leaf, class of large components' members (class, c, root, n, own), dealt anew, and the pairs of leaves (root, i, j)
    that the distributed tree leaves; tokens: token, c."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)))
    whole = large.groupBy("root", "own").agg(F.sum("n").alias("w")).filter(F.col("w") > CAP // 4).select("root", "own", F.lit(True).alias("big"))
    pooled = large.join(whole, ["root", "own"], "left").withColumn("pile", F.when(F.col("big"), F.col("own"))).withColumn("band", band)
    piles = pooled.groupBy("root", "band", "pile").agg(F.ceil(F.sum("n") / CAP).cast("long").alias("blocks"))
    before = W.partitionBy("root").orderBy("band", F.col("pile").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    piles = piles.withColumn("start", F.coalesce(F.sum("blocks").over(before), F.lit(0)))
    piles = piles.select(*(F.col(x).alias(f"_{x}") for x in ("root", "band", "pile")), "blocks", "start")
    same = (F.col("root") == F.col("_root")) & (F.col("band") == F.col("_band")) & F.col("pile").eqNullSafe(F.col("_pile"))
    leaf = F.col("start") + F.pmod(F.xxhash64("class"), F.col("blocks"))
    dealt = written(pooled.join(piles, same).select("root", leaf.alias("leaf"), "class", "c", "n", "own"))
    maps = dealt.join(tokens, "c").groupBy("root", "leaf").agg(F.expr("bitmap_construct_agg(pmod(token, 32768))").alias("map"))
    nodes = dealt.groupBy("root", "leaf").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.when(F.min("own") == F.max("own"), F.min("own")).alias("own"))
    levels = [written(nodes.join(maps, ["root", "leaf"]).withColumnRenamed("leaf", "node"))]
    while not levels[-1].groupBy("root").count().filter(F.col("count") > FANOUT).isEmpty():
        up = levels[-1].groupBy("root", F.expr(f"node div {FANOUT}").alias("node"))
        levels.append(written(up.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.when((F.min("own") == F.max("own")) & (F.count("own") == F.count(F.lit(1))), F.min("own")).alias("own"), F.expr("bitmap_or_agg(map)").alias("map"))))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(len(b), -1) for c in ("map", "map2"))
            yield b.filter(pa.array((x & y).any(1))).select(["root", "i", "j"])

    pairs: DataFrame | None = None
    for level in reversed(levels):
        side = lambda name, more: level.select(F.col("root"), F.col("node").alias(name), *(F.col(c).alias(c + more) for c in ("low", "high", "own", "map")))  # noqa: B023, E731
        up = lambda name: F.expr(f"{name} div {FANOUT}")
        left, right = side("i", ""), side("j", "2")
        if pairs is None:
            both = left.join(right, "root")
        else:
            both = pairs.withColumnsRenamed({"i": "pi", "j": "pj"}).join(left.withColumn("pi", up("i")), ["root", "pi"]).join(right.withColumn("pj", up("j")), ["root", "pj"])
        able = (F.col("i") <= F.col("j")) & (F.col("high2") * 100 >= F.col("low") * percent) & (F.col("high") * 100 >= F.col("low2") * percent)
        both = both.filter(able & F.coalesce(F.col("own") != F.col("own2"), F.lit(True)))
        pairs = written(both.select("root", "i", "j", "map", "map2").mapInArrow(meet, "root long, i long, j long"))
    return dealt.select("root", "leaf", "class", "own"), pairs


def _links(docs: DataFrame, wanted: DataFrame, tokens: DataFrame, size: int, percent: int) -> DataFrame:
    """Links a, b that make the components of the wanted classes (doc_id, class, c, root, n)."""
    totals = wanted.groupBy("root").agg(F.ceil(F.sum("n") / CAP).cast("long").alias("blocks"))
    wanted = written(wanted.join(totals, "root"))
    shingles, large = wanted.agg(F.sum("n"), F.max("blocks")).first()
    if not shingles:
        return wanted.select(F.col("class").alias("a"), F.col("class").alias("b"))
    bins = -(-shingles // CAP)
    none = F.lit(None).cast("binary").alias("known")
    members = _members(docs, wanted.select("doc_id", "class", "root", "n", "blocks"), size)
    if large > 1:
        members = written(members)
    small = members.filter("blocks = 1").select("class", "root", "shingles", none, F.pmod(F.xxhash64("root"), F.lit(bins)).alias("bin"))
    links = _solved(small.groupBy("bin"), percent)
    if large == 1:
        return written(links)
    block = F.pmod(F.xxhash64("class"), F.col("blocks"))
    chained = members.filter("blocks > 1").select("class", "root", "shingles", none, F.explode(F.array_distinct(F.array(block, F.pmod(block + 1, F.col("blocks"))))).alias("bin"))
    links = written(links.union(_solved(chained.groupBy("root", "bin"), percent)))
    roots = components(links).select(F.col("node").alias("class"), F.col("root").alias("own"))
    spread = wanted.filter("blocks > 1").select("class", "c", "root", "n").join(roots, "class", "left").withColumn("own", F.coalesce("own", "class"))
    leaves, pairs = _leaf_pairs(written(spread), tokens, percent)
    full = leaves.join(members.select("class", "shingles"), "class")
    sides = pairs.select("root", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("leaf"))
    met = sides.join(full, ["root", "leaf"]).select("class", "root", "shingles", F.col("own").alias("known"), "i", "j")
    return links.union(written(_solved(met.groupBy("root", "i", "j"), percent)))


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    docs = in_small_batches(docs).select("doc_id", "text")
    told = written(_rows(docs, size))
    rows = told.filter("chunk is null").select("doc_id", "n", "class")
    counters = _counters(told)
    first = F.conv(F.substring(F.hex("class"), 1, 16), 16, -10).cast("long").alias("c")
    classes = written(rows.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")).select("class", first, "doc_id", "n"))
    shared = _shared(_postings(docs, counters, size, percent), classes, percent)
    edges = shared.select(F.col("c").alias("a"), F.min("c").over(W.partitionBy("token")).alias("b")).filter("a <> b").distinct()
    parts = written(components(edges).select(F.col("node").alias("c"), "root"))
    links = _links(docs, classes.join(parts, "c").select("doc_id", "class", "c", "root", "n"), shared, size, percent)
    roots = written(components(links).select(F.col("node").alias("class"), F.col("root").alias("own")))
    named = classes.select("class", "doc_id").join(roots, "class", "left").withColumn("own", F.coalesce("own", "class"))
    named = named.join(named.groupBy("own").agg(F.min("doc_id").alias("least")), "own").select("class", F.col("least").alias("component_id"))
    out = rows.join(named, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
