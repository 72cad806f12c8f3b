"""Near duplicates by SimHash fingerprints and BK-trees.

Fingerprints are 64-bit majority votes over the XXH64 hashes of word shingles. Candidate search shards the
*distinct* fingerprints by masked bits, builds one BK-tree per shard (children keyed by their integer Hamming
distance to the parent) and, for each fingerprint routed to the shard, follows only the edges within the radius.

``near_duplicates`` links fingerprints within a small radius: its masks come from the pigeonhole rule, so no link is lost.
``near_copies`` links texts by the share of common shingles: its masks are seeded bit samples, a second fingerprint goes with each
member and drops most chance meetings inside the tree, and links are verified on the shingle sets. Such trees lose some pairs, so a
prefix filter over the shingles then gives every pair that can still join two components.

The trees of a corpus have no size bound, so they are not broadcast: a shard's tree is built in the task that
its members are shuffled to, and a shard over ``CROWD`` members is cut into chunks whose pairs are trees of
their own. All trees of a task are built and searched together, level by level, in numpy arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragline.llm._spark import counted, pinned
from cragline.llm._words import flat, gather, joined, mixed, pieces, word_spans
from cragline.llm.components import components

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Members of one tree; larger shards are cut into chunks.
CROWD = 4096
#: Crowded shards, or links whose ends are broadcast, at most.
FEW = 20_000
#: Keys or groups, and nodes with their numbers, that are broadcast at most.
FEW_KEYS, FEW_NODES = 1_000_000, 300_000
#: Nodes of a component that others meet as single pairs at most, and of one block where it has more.
LARGE = 128
#: One in so many texts at most is counted to order shingles by frequency, and so many frequent ones are known at most (both only order).
SAMPLED, FREQUENT = 16, 200_000
#: Shingles in several components that are broadcast at most.
SHARED = 500_000
#: Allowance for rounding where shares of whole numbers are compared.
TINY = 1e-9


def shingle_hashes(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every shingle of each text, repeats included; A-Z are lower-cased first.

    Fewer words than a shingle has: the whole sequence is one; no words (or null): an empty array.
    """
    data, offsets = flat(column)
    starts, ends, first = word_spans(data, offsets)
    text, starts, ends = joined(LOWER[data], starts, ends)
    raw, digest = text.tobytes(), xxhash.xxh64_intdigest
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if not n:
            yield np.zeros(0, np.uint64)
        elif n <= words:
            yield np.array([digest(raw[starts[a] : ends[b - 1]], 42)], np.uint64)
        else:
            spans = zip(starts[a : b - words + 1].tolist(), ends[a + words - 1 : b].tolist())
            yield np.fromiter((digest(raw[s:e], 42) for s, e in spans), np.uint64, n - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def set_hash(different: np.ndarray) -> int:
    """XXH64 of a sorted set of hashes, as a signed integer."""
    return xxhash.xxh64_intdigest(different.tobytes(), 1) - (1 << 63)


def fingerprints(docs: DataFrame, words: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, node): a row for each row of ``docs``; node is the fingerprint, in which repeats count. Null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                yield pa.record_batch([part.column("k"), pa.array([fingerprint(h) for h in shingle_hashes(part.column("t"), words)], pa.int64())], names=["key", "node"])

    return docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t")).mapInArrow(run, "key long, node long")


def masks(radius: int, members: int) -> list[int]:
    """Masks such that two fingerprints within ``radius`` agree on the masked bits of at least one of them.

    64 bits are cut into m blocks; at most ``radius`` blocks differ, so the others agree. m is the
    smallest number for which a shard has 256 of ``members`` on average at most.
    """
    for m in range(radius + 1, 2 * radius + 5):
        edges = [64 * i // m for i in range(m + 1)]
        blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        if members >> (64 * (m - radius) // m) <= 256:
            break
    return [sum(x) for x in combinations(blocks, m - radius)]


def sampled_masks(apart: float, members: int, recall: float, seed: int = 7) -> list[int]:
    """Seeded bit samples: two fingerprints that differ in a share ``apart`` of the bits agree on one with probability ``recall``."""
    bits = max(8, math.ceil(math.log2(max(members, 2))) - 6)
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - apart) ** bits))
    draw = np.random.default_rng(seed)
    return [sum(1 << int(b) for b in draw.choice(64, bits, replace=False)) for _ in range(tables)]


class Forest:
    """BK-trees of many shards side by side. ``fp``: distinct within a shard; ``shard``: ascending.

    A child hangs under its parent at their Hamming distance; one child for each distance.
    """

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        self.fp, n = fp, len(fp)
        root = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
        self.root = np.repeat(root, np.diff(np.r_[root, n]))
        node, active = self.root.copy(), np.flatnonzero(self.root != np.arange(n))
        keys, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(active):
            apart = np.bitwise_count(fp[active] ^ fp[node[active]]).astype(np.int64)
            key, at, which = np.unique(node[active] * 65 + apart, return_index=True, return_inverse=True)
            child = active[at]
            keys.append(key)
            children.append(child)
            node[active] = child[which]
            active = active[node[active] != active]
        keys, children = np.concatenate(keys), np.concatenate(children)
        order = np.argsort(keys)
        self.keys, self.children = keys[order], children[order]

    def within(self, radius: int, block: int = 1 << 14, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, hit, distance) of all pairs of a shard within the radius, both ways; all of a block's queries at once."""
        for at in range(0, len(self.fp), block):
            queries = np.arange(at, min(at + block, len(self.fp)))
            stack, found = [(queries, self.root[queries])], []
            while stack:
                q, node = stack.pop()
                if len(q) > most:
                    half = len(q) // 2
                    stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                    continue
                apart = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
                hit = (apart <= radius) & (q != node)
                found.append((q[hit], node[hit], apart[hit]))
                low = np.searchsorted(self.keys, node * 65 + np.maximum(apart - radius, 0))
                high = np.searchsorted(self.keys, node * 65 + np.minimum(apart + radius, 64), "right")
                many = high - low
                if many.any():
                    index = np.arange(many.sum()) + np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many)
                    stack.append((np.repeat(q, many), self.children[index]))
                if sum(len(x[0]) for x in found) > 4 * most:
                    yield tuple(np.concatenate(x) for x in zip(*found))
                    found = []
            if found:
                yield tuple(np.concatenate(x) for x in zip(*found))


def merged(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a and b in ``parent`` (each points to the least member of its set, or on the way to it)."""
    while len(a):
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        a, b = parent[a], parent[b]
        off = a != b
        a, b = a[off], b[off]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def forest_links(members: pa.Table, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links within the radius between the members of each tree."""
    node, forest = members["node"].to_numpy(), Forest(members["fp"].to_numpy().view(np.uint64), members["tree"].to_numpy())
    parent = np.arange(len(node))
    for q, hit, _ in forest.within(radius):
        merged(parent, q, hit)
    merged(parent, np.arange(len(node)), parent.copy())
    far = np.flatnonzero(parent != np.arange(len(node)))
    return node[far], node[parent[far]]


def nearest_links(members: pa.Table, radius: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """For each member the nearest earlier one of its tree that both fingerprints and the numbers of shingles allow: at most one link a member and tree."""
    node, n, second = (members[c].to_numpy() for c in ("node", "n", "second"))
    forest, second = Forest(members["fp"].to_numpy().view(np.uint64), members["tree"].to_numpy()), second.view(np.uint64)
    best = np.full(len(node), 1 << 40)  # distance, then place
    for q, hit, apart in forest.within(radius):
        also = np.bitwise_count(second[q] ^ second[hit]).astype(np.int64)
        keep = (hit < q) & (also <= radius) & (n[hit] >= share * n[q]) & (n[q] >= share * n[hit])
        np.minimum.at(best, q[keep], (apart + also)[keep] << 32 | hit[keep])
    found = np.flatnonzero(best < 1 << 40)
    return node[found], node[best[found] & 0xFFFFFFFF]


def candidate_links(distinct: DataFrame, tables: list[int], links: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b): links between the nodes of ``distinct`` (node, fp, ...) that ``links`` finds among the members of a task's trees."""
    columns = distinct.columns
    rows = distinct.select(*columns, F.explode(F.array(*[
        F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("bits"))
        for i, m in enumerate(tables)
    ])).alias("s")).select(*columns, "s.table", "s.bits")
    crowds = (
        rows.groupBy("table", "bits").agg(F.count(F.lit(1)).alias("many"))
        .where(F.col("many") > CROWD).withColumn("chunks", F.ceil(F.col("many") / CROWD).cast("int")).drop("many")
    )
    crowds, found = counted(crowds)
    if found["n"] <= FEW:  # else they meet by a shuffle
        crowds = F.broadcast(crowds)
    rows = rows.join(crowds, ["table", "bits"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)"))).select(
        *columns, F.xxhash64("table", "bits", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("tree"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def done(table: pa.Table) -> pa.RecordBatch:
            a, b = links(table)
            pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.record_batch([pa.array(pairs[:, i].copy()) for i in (0, 1)], schema=schema)

        rows_held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows_held += batch.num_rows
            if rows_held > 1 << 17:  # whole trees only: the last one may go on in the next batch
                table = pa.Table.from_batches(held)
                tree = table["tree"].to_numpy()
                cut = int(np.searchsorted(tree, tree[-1]))
                if cut:
                    yield done(table.slice(0, cut))
                    held, rows_held = table.slice(cut).to_batches(), len(tree) - cut
        if rows_held:
            yield done(pa.Table.from_batches(held))

    dealt = rows.repartition("tree").sortWithinPartitions("tree", "node")
    return dealt.mapInArrow(run, "a long, b long")


def named(marked: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """(key, fp, component): each row of ``marked`` (key, node, fp) with the least key (``least`` of ``distinct``) that its node reaches."""
    roots = components(links).withColumnRenamed("node", "linked")
    linked = pinned(distinct.join(roots, distinct["node"] == roots["linked"]).select("linked", "least", "root"))
    least, found = counted(linked.groupBy("root").agg(F.min("least").alias("component")))
    if found["n"] <= FEW_KEYS:  # else they meet by a shuffle
        least = F.broadcast(least)
    linked = linked.join(least, "root").select("linked", "component")
    every = distinct.join(linked, distinct["node"] == linked["linked"], "left").select(F.col("node").alias("of"), F.coalesce("component", "least").alias("component"))
    return marked.join(every, marked["node"] == every["of"]).select("key", "fp", "component")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component): one row for each row of ``docs``; component is the least key reachable over links.

    Fingerprints link at ``radius`` or fewer differing bits; no link is lost. Repeated keys share what their rows have; a null key is never the
    least one while another is reachable; an empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    marked = pinned(fingerprints(docs, words, text, key))
    distinct, many = counted(marked.groupBy("node").agg(F.min("key").alias("least")))
    members = distinct.select("node", F.col("node").alias("fp"))
    found = candidate_links(members, masks(radius, many["n"]), lambda members: forest_links(members, radius))
    return named(marked.withColumn("fp", F.col("node")), distinct, found)


def frequent_shingles(docs: DataFrame, words: int, text: str, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold (ascending), and how many do. For an order of shingles only."""
    one_in = max(1, min(SAMPLED, docs.count() // 4096))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                found = [np.unique(h) for h in shingle_hashes(part.column("t"), words)]
                yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], names=["shingle"])

    taken = docs.where(F.pmod(F.xxhash64(docs[key].cast("long")), F.lit(one_in)) == 0).select(docs[text].alias("t"))
    counted = taken.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("many")).where("many > 2")
    rows = counted.orderBy(F.desc("many"), "shingle").limit(FREQUENT).toPandas()
    known, many = rows["shingle"].to_numpy(np.int64).view(np.uint64), rows["many"].to_numpy(np.int64)
    order = np.argsort(known)
    return known[order], many[order]


def first_shingles(different: np.ndarray, share: float, known: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first: two sets that share ``share`` of their shingles have one of these in common.

    They share at least that part of each set, so not all of their common shingles can lie beyond the first of each.
    """
    times = np.zeros(len(different), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, different), len(known) - 1)
        times = np.where(known[at] == different, many[at], 0)
    order = np.lexsort((different, times))
    return different[order[: len(different) - math.ceil(share * len(different) - TINY) + 1]]


def shingled(docs: DataFrame, words: int, share: float, text: str, key: str) -> DataFrame:
    """(key, node, fp, second, n, firsts) of each row: a hash of the set of its shingles, two fingerprints to which each different shingle gives one vote
    (of its hash and of a mix of it), the number of different shingles, and the first ones of the prefix filter. All but the key are functions of node."""
    known, many = frequent_shingles(docs, words, text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                made, held = [], []
                for h in shingle_hashes(part.column("t"), words):
                    different = np.unique(h)
                    made.append((set_hash(different), fingerprint(different), fingerprint(mixed(different)), len(different)))
                    held.append(first_shingles(different, share, known, many).view(np.int64))
                made = np.array(made, np.int64)
                ends = np.r_[0, np.cumsum([len(x) for x in held])].astype(np.int32)
                firsts = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
                yield pa.record_batch([part.column("k"), *(pa.array(made[:, i].copy()) for i in range(4)), firsts], names=["key", "node", "fp", "second", "n", "firsts"])

    return docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t")).mapInArrow(run, "key long, node long, fp long, second long, n long, firsts array<long>")


def near_copies(docs: DataFrame, words: int = 5, share: float = 0.8, radius: int = 18, recall: float = 0.95, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component): one row for each row of ``docs``; component is the least key reachable over links between texts that have ``share`` of their different shingles in common.

    Two such texts differ in about arccos(2 share / (1 + share)) / pi of a fingerprint's bits; ``radius`` lies nearly three standard deviations above
    that, and the trees hold a pair at the mean distance together with probability ``recall``. Each member's nearest is verified, then all pairs of the prefix
    filter that aren't yet in one component; so up to equal hashes no link is missed, and none below ``share`` is made. Sets are those
    of a text of their least key: what only rows with a null key hold gets no links. Otherwise as ``near_duplicates``.
    """
    marked = pinned(shingled(docs, words, share, text, key))
    distinct, many = counted(marked.groupBy("node").agg(*(F.min(c).alias(x) for c, x in (("key", "least"), ("fp", "fp"), ("second", "second"), ("n", "n")))))
    apart = math.acos(2 * share / (1 + share)) / math.pi
    found = candidate_links(distinct.select("node", "fp", "second", "n"), sampled_masks(apart, many["n"], recall), lambda members: nearest_links(members, radius, share))
    found = pinned(same_shingles(docs, words, share, found.distinct(), distinct, text, key))
    roots = pinned(components(found))
    nodes = pinned(rooted(distinct, roots))
    rows = pinned(shared_firsts(marked, nodes, share, many["n"]))
    found = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(same_shingles(docs, words, share, all_pairs(rows, share), distinct, text, key))
    found = pinned(found.union(links_to_large(docs, words, share, rows, nodes, text, key)))
    return named(marked.select("key", "node", "fp"), distinct.select("node", "least"), found)


def rooted(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, least, n, root, size): each node with the root of its component and how many nodes that has."""
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    roots, many = counted(roots.join(sizes, "root").withColumnRenamed("node", "linked"))
    if many["n"] <= FEW_KEYS:  # else they meet by a shuffle
        roots = F.broadcast(roots)
    return distinct.join(roots, distinct["node"] == roots["linked"], "left").select("node", "least", "n", F.coalesce("root", "node").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))


def shared_firsts(marked: DataFrame, nodes: DataFrame, share: float, many: int | None = None) -> DataFrame:
    """(node, n, root, size, pos, shingle, early): the first shingles of each set, where nodes (``many`` in all, else they are counted) of different components have them among theirs.

    ``early`` ones are enough for the smaller set of a pair: a set at least as large holds 2 share / (1 + share) of it, so not all of that can lie beyond
    them. Shingles that are early in no set are left out. Rows that repeat a key and a text repeat theirs; so counts of common shingles are never too small.
    """
    if (nodes.count() if many is None else many) <= FEW_NODES:  # else they meet by a shuffle
        nodes = F.broadcast(nodes)
    firsts = marked.select(F.col("node").alias("of"), "key", "firsts").join(nodes, (F.col("of") == F.col("node")) & (F.col("key") == F.col("least")))
    rows = firsts.select("node", "n", "root", "size", F.posexplode("firsts").alias("pos", "shingle"))
    rows = rows.withColumn("early", F.col("pos") <= F.col("n") - F.ceil(2 * share / (1 + share) * F.col("n") - TINY))
    several, found = counted(rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("early").alias("early")).where("low <> high AND early").select("shingle"))
    if found["n"] <= SHARED:  # else they meet by a shuffle
        several = F.broadcast(several)
    return rows.join(several, "shingle", "left_semi")


def fitting(pairs: DataFrame, share: float) -> DataFrame:
    """(a, b, c, need): pairs of rows (x, the smaller set's early one, and y) whose numbers of shingles, and of those from the first common one on, allow ``share``.

    c is the number of rows that a pair has. ``need`` is what c must be at least: no more can be common beyond the early shingles
    of x and the first ones of y than the set still has whose last one comes earlier.
    """
    least = F.lit(share / (1 + share)) * (F.col("x.n") + F.col("y.n")) - TINY
    beyond = F.greatest(F.ceil(2 * share / (1 + share) * F.col("x.n") - TINY), F.ceil(share * F.col("y.n") - TINY)) - 1
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) - least
    met = pairs.groupBy(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.max(least - beyond).alias("need"), F.max(room).alias("room"))
    return met.where("room >= 0").drop("room")


def with_top(rows: DataFrame) -> DataFrame:
    """``rows`` with the root, and the number of nodes, of the component that has the most nodes at each shingle, and whether it is early in one of them."""
    top = rows.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("c"), F.max("size").alias("size"), F.max("early").alias("early")).groupBy("shingle")
    top = top.agg(F.max(F.struct("c", "root", "size", "early")).alias("e"))
    return rows.join(top.select("shingle", F.col("e.root").alias("top"), F.col("e.size").alias("top_size"), F.col("e.early").alias("top_early")), "shingle")


def meetings(rows: DataFrame, share: float) -> DataFrame:
    """Pairs of rows (structs x and y) with one shingle in common, of different components and fitting sizes: x is an early row of the smaller set (of equal ones the lesser node).

    For each shingle only nodes outside its largest component meet others. Where that component has over ``LARGE`` nodes they
    don't meet its nodes here but in ``links_to_large``; so no node meets more than ``LARGE`` of a component. Sets of one size that have less
    than ``share`` in common and differ in rare shingles have no early one in common, so a family just below ``share`` doesn't meet at all.
    """
    near = with_top(rows).select("shingle", (F.col("root") == F.col("top")).alias("at_top"), "top_size", F.struct("node", "n", "root", "pos", "early").alias("z"))
    free = near.where(f"NOT at_top OR top_size <= {LARGE}")

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        left, right = left.where("z.early").select("shingle", F.col("z").alias("x")), right.select(F.col("shingle").alias("same"), F.col("z").alias("y"))
        order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
        fit = (F.col("x.root") != F.col("y.root")) & (F.col("x.n") + TINY >= share * F.col("y.n"))
        return left.join(right, (F.col("shingle") == F.col("same")) & order & fit).select("x", "y")

    return joined(near.where("NOT at_top"), free).union(joined(free.where("at_top"), near.where("NOT at_top")))


def all_pairs(rows: DataFrame, share: float) -> DataFrame:
    """(a, b): pairs of nodes of different components that have enough first shingles in common to be links, but for those left to ``links_to_large``."""
    return fitting(meetings(rows, share), share).where("c >= need").select("a", "b")


def links_to_large(docs: DataFrame, words: int, share: float, rows: DataFrame, nodes: DataFrame, text: str, key: str) -> DataFrame:
    """(a, b): links between nodes and components of over ``LARGE`` nodes with which they have a first shingle in common.

    A component's nodes are dealt into blocks and those that ask for it into parts; each block counts the common shingles of
    all its pairs in one task, exactly, and gives one link for each node and block that has one.
    """
    asked, found = counted(with_top(rows).where(f"root <> top AND top_size > {LARGE} AND (early OR top_early)").select("node", "top").distinct())
    if not found["n"]:
        return asked.toDF("a", "b")
    sizes = asked.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / LARGE).cast("int").alias("parts"))
    members = nodes.join(sizes, nodes["root"] == sizes["top"]).select("node", "top", F.ceil(F.col("size") / LARGE).cast("int").alias("blocks"), "parts")
    members = pinned(members)
    sizes = members.groupBy("top").agg(F.max("blocks").alias("blocks"), F.max("parts").alias("parts"))
    chosen = nodes.join(asked.select("node").union(members.select("node")).distinct(), "node", "left_semi").select(F.col("least").alias("k"))
    held = pinned(shingle_sets(docs, words, chosen, text, key))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            sets = [np.frombuffer(x, np.uint64) for x in left["shingles"].to_pylist()]
            many = np.array(list(map(len, sets)))
            every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), many)
            order = np.argsort(every, kind="stable")
            every, owner, ids = every[order], owner[order], left["node"].to_pylist()
            for node, x in zip(right["node"].to_pylist(), right["shingles"].to_pylist()):
                x = np.frombuffer(x, np.uint64)
                low, high = np.searchsorted(every, x), np.searchsorted(every, x, "right")
                at, _ = gather(owner, low, high - low)
                both = np.bincount(at, minlength=len(sets))
                linked = np.flatnonzero(both + TINY >= share * (len(x) + many - both))
                if len(linked):
                    found.append((node, ids[linked[0]]))
        return pa.table([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    of = held.withColumnRenamed("node", "of")
    blocks = members.join(of, F.col("node") == F.col("of")).select("node", "shingles", "top", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    askers = asked.join(sizes, "top").join(of, F.col("node") == F.col("of")).select("node", "shingles", "top", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    where = ["top", "block", "part"]
    blocks, askers = (x.toDF("node", "shingles", *where) for x in (blocks, askers))
    return blocks.groupBy(*where).cogroup(askers.groupBy(*where)).applyInArrow(meet, "a long, b long")


def shingle_sets(docs: DataFrame, words: int, keys: DataFrame, text: str, key: str) -> DataFrame:
    """(node, shingles): the sets of the texts with the given keys ``k``, as sorted 64-bit hashes in one binary; one row for each set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                made, held = [], []
                for h in shingle_hashes(part.column("t"), words):
                    different = np.unique(h)
                    made.append(set_hash(different))
                    held.append(different.tobytes())
                yield pa.record_batch([pa.array(made, pa.int64()), pa.array(held, pa.binary())], names=["node", "shingles"])

    keys, many = counted(keys)
    if many["n"] <= FEW_KEYS:  # else they meet by a shuffle
        keys = F.broadcast(keys)
    chosen = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t")).join(keys, "k", "left_semi")
    return chosen.mapInArrow(sets, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def same_shingles(docs: DataFrame, words: int, share: float, links: DataFrame, distinct: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The links between texts whose sets of shingles have a Jaccard similarity of ``share`` or more.

    Each set is represented by a text of its least key; one that only rows with a null key have gets no links.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both + TINY >= share * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links, many = counted(links)
    if not many["n"]:
        return links.select("a", "b")
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    if many["n"] <= FEW:  # else they meet by a shuffle
        ends = F.broadcast(ends)
    held = shingle_sets(docs, words, distinct.join(ends, "node", "left_semi").select(F.col("least").alias("k")), text, key)
    met = links.join(held.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    met = met.join(held.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return met.mapInArrow(compare, "a long, b long")


def one_of_each_group(docs: DataFrame, words: int = 5, share: float = 0.8) -> DataFrame:
    """``docs`` without near copies (``near_copies``): of each group the rows with the least doc_id stay (all rows with a null one, too). All columns are kept as they are."""
    found = near_copies(docs, words, share)
    stay = found.where(F.col("key") == F.col("component")).select(F.col("key").alias("__stay")).distinct()
    kept = docs.join(stay, docs["doc_id"].cast("long") == stay["__stay"], "left_semi")
    return kept.unionByName(docs.where(docs["doc_id"].isNull()))
