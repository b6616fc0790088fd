"""Near-duplicates by a chosen-path set similarity join over minwise tokens.

Documents with equal sets of shingles are one class. Each class has a signature of minwise tokens, one for each of
POSITIONS hash functions; two sets share a token with the probability of their Jaccard similarity. TREES independent
trees grow by recursion: a node picks BRANCHES positions, and its classes are divided by their tokens there, so that a
class follows its own chosen paths. With two branches, a pair at 0.8 or more meets again in some child with a
probability of at least 0.9375 however deep a tree grows, so five trees lose one such pair in a million.

Nodes of up to SMALL classes are compared exhaustively; larger ones branch until they are small. A node of up to LOCAL
classes grows the rest of its tree within its task, since near copies that branching parts slowly would otherwise be
copied, shuffled and written level by level; only larger nodes branch as rows. Only where a large
node's classes agree throughout (with the tokens that prevail in it, in AGREE of the positions on average) branching
can't part them: there every class is compared with a hub, the class that agrees most with those tokens. The same is done
with what is left after DEPTH levels, or once no more than FEW rows are left in nodes above LOCAL. Pairs whose signatures agree in
fewer than 35 of 64 positions are dropped (one pair in a million at 0.8); the others are confirmed on the full sets,
those that agree best first, and never within a component that is known already. Nodes with a hub that then have
several components are compared in blocks on the full sets: the classes outside the main component with
all others. So a group of copies costs a comparison each, and no link between components is left out.

A set holds the distinct shingles of so many words (all words, if fewer), a 64-bit hash each. Null texts and those
without words have an empty set: no link, a component of their own. Every row gives a row; rows that share a doc_id are
separate documents of that id. component_id is the least doc_id of the component that isn't null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import bitmap, in_small_batches, may_hold, written
from quillspark.llm.graph import components
from quillspark.llm.shingles import POSITIONS, alike, identity, mixed, shingle_set, signature

SIZE, PERCENT = 5, 80
TREES, BRANCHES, DEPTH, SMALL = 5, 2, 12, 16
#: Of POSITIONS; the binomial tail below it is 1e-6 at 0.8.
AGREE = 35
BLOCK = 500
#: A node's signatures in a task: 256 KB.
LOCAL = 1_000
FEW = 2_000
FIRST = 3


def classes_of(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, class (null for an empty set), signature of each row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, ids, signatures = [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text or "", size)
                counts.append(len(s))
                ids.append(identity(s) if len(s) else None)
                signatures.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "class", "signature"])

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, class binary, signature binary")


def _tokens(signatures: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint32).reshape(-1, POSITIONS)


def _children(parent: np.ndarray, tokens: np.ndarray) -> Iterator[np.ndarray]:
    """The rows' children, an array for each branch."""
    for branch in range(BRANCHES):
        seed = mixed(parent + np.uint64((branch + 1) * 0x9E3779B97F4A7C15 % 2**64))
        at = (seed % np.uint64(POSITIONS)).astype(np.int64)
        yield mixed(seed + tokens[np.arange(len(tokens)), at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _roots(rows: DataFrame) -> DataFrame:
    """node, class: the children of the roots. Most are alone in their node, so signatures stay behind."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = _tokens(b.column("signature"))
            for t in range(TREES):
                for child in _children(np.full(len(tokens), t, np.uint64), tokens):
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column("class")], ["node", "class"])

    return rows.mapInArrow(apply, "node long, class binary")


def _descend(rows: DataFrame) -> DataFrame:
    """node, class, signature: the children of the rows' nodes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for child in _children(b.column("node").to_numpy().view(np.uint64), _tokens(b.column("signature"))):
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column("class"), b.column("signature")], ["node", "class", "signature"])

    return rows.mapInArrow(apply, "node long, class binary, signature binary")


def _commonest(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each position the commonest token and how often it is there."""
    best, counts = np.empty(POSITIONS, np.uint32), np.empty(POSITIONS, np.int32)
    for i in range(POSITIONS):
        values, n = np.unique(tokens[:, i], return_counts=True)
        best[i], counts[i] = values[n.argmax()], n.max()
    return best, counts


def _grown(rows: DataFrame, level: int) -> DataFrame:
    """node, a, b, agree: what the trees below the rows' nodes (of that level) give, each grown in its task.

    A row is a pair that is to be confirmed, or, where b is null, a class a of a node that has a hub.
    """
    small, depth = SMALL, DEPTH

    def of_node(group: pa.Table) -> pa.Table:
        tokens, ids = _tokens(group.column("signature")), group.column("class").combine_chunks()
        order = np.argsort(np.array(ids.to_pylist(), object))  # so that a < b
        tokens, ids = tokens[order], ids.take(pa.array(order))
        n = len(tokens)
        pairs, nodes, members = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        todo = [(np.uint64(group.column("node")[0].as_py() % 2**64), np.arange(n), level)]
        while todo:
            node, at, deep = todo.pop()
            own = tokens[at]
            if len(at) <= small:
                i, j = np.triu_indices(len(at), 1)
                near = (own[i] == own[j]).sum(1) >= AGREE
                pairs.append(at[i[near]] * n + at[j[near]])
                continue
            agree = (own == _commonest(own)[0]).sum(1)
            if deep < depth - 1 and agree.mean() < AGREE:
                for child in _children(np.full(len(at), node, np.uint64), own):
                    by = np.argsort(child, kind="stable")
                    cuts = np.flatnonzero(np.diff(child[by])) + 1
                    todo += [(child[part[0]], at[part], deep + 1) for part in np.split(by, cuts) if len(part) > 1]
                continue
            hub = len(at) - 1 - agree[::-1].argmax()
            near = np.flatnonzero((own == own[hub]).sum(1) >= AGREE)
            near = near[near != hub]
            pairs.append(np.minimum(at[near], at[hub]) * n + np.maximum(at[near], at[hub]))
            nodes.append(np.full(len(at), node, np.uint64)), members.append(at)
        i, j = np.divmod(np.unique(np.concatenate(pairs)), n)
        member, none = np.concatenate(members), np.full(len(i), 0, np.uint64)
        node = pa.array(np.concatenate([none, *nodes]).view(np.int64))
        agree = pa.array((tokens[i] == tokens[j]).sum(1), pa.int32())
        a, b = ids.take(pa.array(np.concatenate([i, member]))), ids.take(pa.array(j))
        return pa.table({"node": node, "a": a, "b": pa.concat_arrays([b, pa.nulls(len(member), pa.binary())]), "agree": pa.concat_arrays([agree, pa.nulls(len(member), pa.int32())])})

    return rows.select("node", "class", "signature").groupBy("node").applyInArrow(of_node, "node long, a binary, b binary, agree int")


def _agreement(pairs: DataFrame) -> DataFrame:
    """a, b, agree of pairs (a, b, sa, sb) that agree in AGREE positions at least."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, POSITIONS) for c in ("sa", "sb"))
            agree = (x == y).sum(1)
            keep = pa.array(np.flatnonzero(agree >= AGREE))
            yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep), pa.array(agree, pa.int32()).take(keep)], ["a", "b", "agree"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(apply, "a binary, b binary, agree int").filter(F.col("a") != F.col("b"))


def _pairs(rows: DataFrame) -> DataFrame:
    """All pairs within nodes of at most SMALL classes."""
    other = rows.select("node", F.col("class").alias("b"), F.col("signature").alias("sb"))
    return rows.select("node", F.col("class").alias("a"), F.col("signature").alias("sa")).join(other, "node").filter(F.col("a") < F.col("b")).drop("node")


def _prevailing(rows: DataFrame) -> DataFrame:
    """node, prevailing: at each position the commonest token of a node, out of the commonest of its blocks."""

    def of_block(group: pa.Table) -> pa.Table:
        best, counts = _commonest(_tokens(group.column("signature")))
        return pa.table({"node": group.column("node")[:1], "token": pa.array([best.tobytes()], pa.binary()), "times": pa.array([counts.tobytes()], pa.binary())})

    def of_node(group: pa.Table) -> pa.Table:
        token, times = (np.frombuffer(b"".join(group.column(c).to_pylist()), k).reshape(-1, POSITIONS) for c, k in (("token", np.uint32), ("times", np.int32)))
        best = np.empty(POSITIONS, np.uint32)
        for i in range(POSITIONS):
            values, at = np.unique(token[:, i], return_inverse=True)
            best[i] = values[np.bincount(at, times[:, i]).argmax()]
        return pa.table({"node": group.column("node")[:1], "prevailing": pa.array([best.tobytes()], pa.binary())})

    block = F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / BLOCK)).alias("block")
    blocks = rows.select("node", "signature", block).groupBy("node", "block").applyInArrow(of_block, "node long, token binary, times binary")
    return blocks.groupBy("node").applyInArrow(of_node, "node long, prevailing binary")


def _judged(rows: DataFrame) -> DataFrame:
    """node, class, signature, agree (with the tokens that prevail in the node) of the rows of large nodes."""

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, POSITIONS) for c in ("signature", "prevailing"))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array((x == y).sum(1), pa.int32())], ["node", "class", "signature", "agree"])

    return rows.join(_prevailing(rows), "node").select("node", "class", "signature", "prevailing").mapInArrow(agreeing, "node long, class binary, signature binary, agree int")


def _stars(judged: DataFrame) -> DataFrame:
    """Every class of a node with its hub."""
    hubs = judged.groupBy("node").agg(F.max(F.struct("agree", "class", "signature")).alias("h")).select("node", F.col("h.class").alias("hub"), F.col("h.signature").alias("sb"))
    pairs = judged.join(hubs, "node").filter(F.col("class") != F.col("hub"))
    swap = F.col("class") > F.col("hub")
    return pairs.select(F.when(swap, F.col("hub")).otherwise(F.col("class")).alias("a"), F.when(swap, F.col("class")).otherwise(F.col("hub")).alias("b"), F.when(swap, F.col("sb")).otherwise(F.col("signature")).alias("sa"), F.when(swap, F.col("signature")).otherwise(F.col("sb")).alias("sb"))


def _with_root(rows: DataFrame, column: str, roots: DataFrame, name: str) -> DataFrame:
    return rows.join(roots.select(F.col("node").alias(column), F.col("root").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))


def _crowds(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """crowd, class, root: the classes of the large nodes that have several components; nodes with the same main
    component are one crowd, so that a group of copies is one whatever nodes it is in."""
    rows = _with_root(rows.select("node", "class"), "class", roots, "root")
    main = rows.groupBy("node", "root").count().groupBy("node").agg(F.max(F.struct("count", "root"))["root"].alias("crowd"), F.count(F.lit(1)).alias("parts"))
    return rows.join(main.filter(F.col("parts") > 1), "node").select("crowd", "class", "root").distinct()


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all sets a with all sets b, by products of incidence matrices."""
    out = np.zeros((len(a), len(b)), np.float32)
    values, at = np.unique(np.concatenate([*a, *b, np.zeros(0, np.uint64)]), return_inverse=True)
    split = sum(map(len, a))
    sides = [(at[:split], np.repeat(np.arange(len(a)), [len(x) for x in a])), (at[split:], np.repeat(np.arange(len(b)), [len(x) for x in b]))]
    common = np.flatnonzero((np.bincount(sides[0][0], minlength=len(values)) > 0) & (np.bincount(sides[1][0], minlength=len(values)) > 0))
    place = np.full(len(values), -1)
    place[common] = np.arange(len(common))
    sides = [(place[c][place[c] >= 0], r[place[c] >= 0]) for c, r in sides]
    for lo in range(0, len(common), 4096):
        x, y = (np.zeros((n, 4096), np.float32) for n in out.shape)
        for m, (c, r) in zip((x, y), sides, strict=True):
            own = (c >= lo) & (c < lo + 4096)
            m[r[own], c[own] - lo] = 1
        out += x @ y.T
    return out


def _crowd_links(crowds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of each crowd's classes outside its main component with all its classes, in blocks, on the full sets."""
    n = crowds.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = crowds.join(n, "crowd").join(sets, "class")
    mine = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = lambda r, x, y, name: r.select("crowd", x.alias("i"), y.alias("j"), "class", "root", "shingles", F.lit(name).alias("side"))
    dealt = side(rows.filter(F.col("root") != F.col("crowd")), mine, every, "out").union(side(rows, every, mine, "all"))

    def apply(group: pa.Table) -> pa.Table:
        side, cls, root = (np.array(group.column(c).to_pylist(), object) for c in ("side", "class", "root"))
        sets_ = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        out, full = np.flatnonzero(side == "out"), np.flatnonzero(side == "all")
        sizes = np.array([len(x) for x in sets_])
        common = overlaps([sets_[k] for k in out], [sets_[k] for k in full]).astype(np.int64)
        linked = (100 * common >= percent * (sizes[out][:, None] + sizes[full] - common)) & (root[out][:, None] != root[full])
        # One link for each class and component does: the others say nothing new.
        a, b = [], []
        for i in np.flatnonzero(linked.any(1)):
            _, first = np.unique([root[full[k]] for k in np.flatnonzero(linked[i])], return_index=True)
            for k in np.flatnonzero(linked[i])[first]:
                a.append(cls[out[i]]), b.append(cls[full[k]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return dealt.groupBy("crowd", "i", "j").applyInArrow(apply, "a binary, b binary")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """class, shingles of the wanted classes (doc_id, class)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t or "", size) for t in b.column(0).to_pylist()]
            fits = [identity(s) == c for s, c in zip(sets, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, f in zip(b.column(1).to_pylist(), fits, strict=True) if f], pa.binary()), pa.array([s.tobytes() for s, f in zip(sets, fits, strict=True) if f], pa.binary())], ["class", "shingles"])

    key = lambda c: F.xxhash64(F.col(c))
    map_ = bitmap(wanted.select(key("doc_id").alias("h")))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(may_hold(map_, b.column(2).to_numpy()))).select(["_d", "text"])

    kind = dict(docs.dtypes)["doc_id"]
    thin = docs.select(F.col("doc_id").alias("_d"), "text", key("doc_id").alias("h")).mapInArrow(likely, f"_d {kind}, text string")
    texts = thin.join(wanted, F.col("_d").eqNullSafe(F.col("doc_id"))).select("text", "class")
    return texts.mapInArrow(apply, "class binary, shingles binary").dropDuplicates(["class"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = lambda c, name: sets.select(F.col("class").alias(c), F.col("shingles").alias(name))
    return pairs.select("a", "b").join(own("a", "xa"), "a").join(own("b", "xb"), "b").select("a", "b", "xa", "xb").mapInArrow(apply, "a binary, b binary")


def _linked(candidates: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The links among candidates and their components: first each class's FIRST best candidates are confirmed, then all
    that lie between the components these make."""
    rank = lambda c: F.row_number().over(W.partitionBy(c).orderBy(F.desc("agree"), "a", "b")) <= FIRST
    chosen = written(candidates.withColumn("pick", rank("a") | rank("b")))
    links = written(_confirmed(chosen.filter("pick"), sets, percent))
    roots = written(components(links))
    rest = _with_root(_with_root(chosen.filter(~F.col("pick")).select("a", "b"), "a", roots, "ra"), "b", roots, "rb").filter(F.col("ra") != F.col("rb"))
    more = written(_confirmed(rest, sets, percent))
    if more.isEmpty():
        return links, roots
    links = links.union(more)
    return links, written(components(links))


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    docs = in_small_batches(docs).select("doc_id", "text")
    rows = written(classes_of(docs, size))
    classes = written(rows.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = written(_roots(classes.select("class", "signature")))
    found: DataFrame | None = None
    dense: DataFrame | None = None
    both = lambda x, y: y if x is None else x.union(y)
    for level in range(DEPTH):
        crowd = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        shared = nodes.join(crowd, "node")
        shared = written(shared if level else shared.join(classes.select("class", "signature"), "class").select("node", "class", "signature", "n"))
        small, large = F.col("n") <= SMALL, F.col("n") > max(SMALL, LOCAL)
        found = both(found, _agreement(_pairs(shared.filter(small).drop("n"))))
        middle, left = shared.agg(F.count_if(~small & ~large), F.count_if(large)).first()
        if middle:
            grown = written(_grown(shared.filter(~small & ~large), level))
            found = found.union(grown.filter(F.col("b").isNotNull()).select("a", "b", "agree"))
            dense = both(dense, grown.filter(F.col("b").isNull()).select("node", F.col("a").alias("class")))
        if not left:
            break
        last = level == DEPTH - 1 or left <= FEW
        judged = written(_judged(shared.filter(large)))
        alike_ = judged.groupBy("node").agg((F.avg("agree") >= (0 if last else AGREE)).alias("dense"))
        judged = judged.join(alike_, "node")
        stuck = written(judged.filter("dense").drop("dense"))
        found, dense = found.union(_agreement(_stars(stuck))), both(dense, stuck.select("node", "class"))
        if last:
            break
        nodes = written(_descend(judged.filter(~F.col("dense")).select("node", "class", "signature").repartition(tasks)))
    found = written(found.distinct())
    between = lambda c: c.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = written(_sets(docs, classes.select("doc_id", "class").join(between(found), "class"), size))
    links, roots = _linked(found, sets, percent)
    crowds = None if dense is None else written(_crowds(dense, roots))
    if crowds is not None and not crowds.isEmpty():
        more = crowds.select("class").distinct().join(sets.select("class"), "class", "left_anti")
        sets = sets.union(written(_sets(docs, classes.select("doc_id", "class").join(more, "class"), size)))
        inside = written(_crowd_links(crowds, sets, percent))
        roots = written(components(links.union(inside)))
    named = _with_root(classes.select("class", "doc_id"), "class", roots, "root")
    named = named.join(named.groupBy("root").agg(F.min("doc_id").alias("least")), "root")
    out = rows.join(named.select("class", F.col("least").alias("component_id")), "class", "left")
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
