"""SimHash near-duplicates by a self-join of binary tries under a Hamming error budget.

Copies share a fingerprint, so the join runs over distinct fingerprints.  Cut into ``budget + 1``
blocks, two fingerprints that differ in at most ``budget`` bits agree in some block.  For each
block there is a rotation of the fingerprint that puts the block first; the nodes at that depth
of the rotated tries are the units of work that Spark deals out (there the budget is untouched).
Below such a node ``trie_links`` walks pairs of nodes together, adds up differing bits and drops
a pair as soon as the sum exceeds the budget.  A node with more than ``node_rows`` fingerprints
is cut into parts by a hash, and each pair of parts is a unit of its own, so no unit is unbounded.

Links are contracted to stars within each task and then over the whole table by alternating
large-star and small-star steps; fingerprints, links and components never reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import batches_of, materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BITS = 64


def fingerprint(text: str | None, size: int = 4) -> int:
    """The unsigned SimHash of a whole text's word shingles; 0 without words."""
    joined = " ".join(WORD.findall((text or "").translate(LOWER))).encode("utf-8", "surrogatepass")
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts = [0, *[g + 1 for g in gaps]]
    ends = [*gaps, len(joined)]
    h = xxhash.xxh64_intdigest
    hashes = [h(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :])] or [h(joined, 42)]
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """doc_id and fp (long, the fingerprint's bits) for each row, repeated rows included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), size) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_signed(fps), pa.int64())], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return batches_of(docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInArrow(run, f"doc_id {kind}, fp long")


def blocks(budget: int) -> list[tuple[int, int]]:
    """(shift to the left that puts the block first, width) of budget + 1 blocks covering all bits."""
    edges = [BITS * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def trie_links(left: np.ndarray, right: np.ndarray | None, depth: int, budget: int, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places in left, places in right) of sorted uint64 keys that differ in at most ``budget`` bits.

    ``right`` None: left with itself, each pair once.  A trie node is a range of the sorted keys
    that share a prefix; the walk starts at the nodes of ``depth`` that occur on both sides and
    goes down in pairs.  Pairs of single keys are settled at once.  The frontier is processed in
    pieces of at most ``chunk`` pairs, deepest first, which bounds memory.
    """
    own = right is None
    right = left if own else right
    if not len(left) or not len(right):
        return
    top = (left >> np.uint64(BITS - depth)) if depth else np.zeros(len(left), np.uint64)
    rtop = (right >> np.uint64(BITS - depth)) if depth else np.zeros(len(right), np.uint64)
    keys = np.intersect1d(top, rtop)
    first = [np.searchsorted(top, keys), np.searchsorted(top, keys, "right"), np.searchsorted(rtop, keys), np.searchsorted(rtop, keys, "right")]
    stack = [(depth, np.stack([*first, np.zeros(len(keys), np.int64)]).astype(np.int64))]

    def middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
        """Where the bit turns to one within each range."""
        a, b = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return a
            m = (a[open_] + b[open_]) >> 1
            one = (keys[m] & bit) != 0
            b[open_[one]] = m[one]
            a[open_[~one]] = m[~one] + 1

    while stack:
        d, pairs = stack.pop()
        if pairs.shape[1] > chunk:
            stack.append((d, pairs[:, chunk:]))
            pairs = pairs[:, :chunk]
        alo, ahi, blo, bhi, diff = pairs
        small = (ahi - alo) * (bhi - blo) <= (16 if d < BITS else 1 << 62)
        if small.any():  # a few keys on either side: compare them
            x, y, nx, ny = alo[small], blo[small], (ahi - alo)[small], (bhi - blo)[small]
            total = nx * ny
            at = np.repeat(np.arange(len(total)), total)
            k = np.arange(len(at)) - np.repeat(np.cumsum(total) - total, total)
            i, j = x[at] + k // ny[at], y[at] + k % ny[at]
            ok = np.bitwise_count(left[i] ^ right[j]) <= budget
            if own:
                ok &= i < j
            if ok.any():
                yield i[ok], j[ok]
            alo, ahi, blo, bhi, diff = pairs[:, ~small]
        if not len(alo):
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - d)
        amid, bmid = middle(left, alo, ahi, bit), middle(right, blo, bhi, bit)
        parts = [(alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff), (alo, amid, bmid, bhi, diff + 1)]
        both = (amid, ahi, blo, bmid, diff + 1)
        if own:  # a node with itself has one mixed pair
            keep = alo != blo
            both = tuple(x[keep] for x in both)
        nxt = np.concatenate([np.stack(p) for p in (*parts, both)], axis=1)
        nxt = nxt[:, (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= budget)]
        if nxt.shape[1]:
            stack.append((d + 1, nxt))


class Forest:
    """Union-find over places; the root of a set is its smallest place."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            n = self.up[r]
            if (n == r).all():
                return r
            r = n

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots(i), self.roots(j)
            keep = a != b
            i, j, a, b = i[keep], j[keep], a[keep], b[keep]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
        self.up = self.roots(np.arange(len(self.up)))


def fingerprint_links(distinct: DataFrame, budget: int = 4, node_rows: int = 20_000) -> DataFrame:
    """Links (a, b), a < b as signed longs, that connect all fingerprints within ``budget`` bits.

    ``distinct``: one row for each fingerprint, in column fp.  The links of each task are
    contracted to stars, so a dense group yields at most as many links as fingerprints.
    """
    cuts = blocks(budget)
    rotations = F.explode(F.array(*[F.struct(F.lit(k).alias("turn"), (F.shiftrightunsigned("fp", BITS - s - w).bitwiseAND(F.lit((1 << w) - 1))).alias("node")) for k, (s, w) in enumerate(cuts)]))
    placed = distinct.select("fp", rotations.alias("x")).select("fp", "x.turn", "x.node")
    counted = placed.groupBy("turn", "node").agg(F.count("*").alias("n"))
    large = materialize(counted.where(F.col("n") > node_rows).withColumn("parts", F.ceil(F.col("n") / node_rows).cast("int")).drop("n"), "simhash-nodes")
    spread = placed.join(large, ["turn", "node"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    units = spread.withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = units.select("turn", "node", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), (F.col("part") > F.col("other")).alias("second"), "fp")
    dealt = units.repartition("turn", "node", "p", "q").sortWithinPartitions("turn", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units that differ in the node only are walked together: their nodes are the walk's first level."""
        held, key = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            turn, p, q = key
            fp = np.concatenate([h[0] for h in held]).view(np.uint64)
            second = np.concatenate([h[1] for h in held])
            shift, width = cuts[turn]
            keys = (fp << np.uint64(shift)) | (fp >> np.uint64(BITS - shift)) if shift else fp
            order = np.argsort(keys)
            keys, second = keys[order], second[order]
            forest = Forest(len(keys))
            if p == q:
                for i, j in trie_links(keys, None, width, budget):
                    forest.join(i, j)
            else:
                a, b = np.flatnonzero(~second), np.flatnonzero(second)
                for i, j in trie_links(keys[a], keys[b], width, budget):
                    forest.join(a[i], b[j])
            own = fp[order].view(np.int64)
            # stars around the smallest fingerprint of each set
            root = forest.roots(np.arange(len(keys)))
            low = own.copy()
            np.minimum.at(low, root, own)
            linked = low[root] != own
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(low[root][linked]), pa.array(own[linked])], names=["a", "b"])

        for b in batches:
            turn, p, q = (np.asarray(b.column(k)) for k in (0, 2, 3))
            second, fp = b.column(4).to_numpy(zero_copy_only=False), np.asarray(b.column(5))
            change = np.flatnonzero((np.diff(turn) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1
            for lo, hi in zip([0, *change], [*change, len(turn)]):
                now = (int(turn[lo]), int(p[lo]), int(q[lo])) if hi > lo else key
                if now != key:
                    yield from flush()
                    held, key = [], now
                if hi > lo:
                    held.append((fp[lo:hi].copy(), second[lo:hi].copy()))
        yield from flush()

    return dealt.mapInArrow(run, "a long, b long")


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """node and component (its smallest node) for every node of the undirected links (a, b).

    Alternating large-star and small-star steps (Kiveris et al., 2014): each round is two
    aggregations over the links; a written table cuts the lineage of each round.  Ends when a
    round changes nothing; not ending within ``limit`` rounds is an error, never a wrong answer.
    """
    links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    mark = None
    for _ in range(limit):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: each larger neighbour of u moves to the smallest of u and its neighbours
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lowest, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x < y")
        links = materialize(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return links.select(F.col("b").alias("node"), F.col("a").alias("component"))
        mark = now
    raise RuntimeError(f"components did not settle in {limit} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 4, budget: int = 4, node_rows: int = 20_000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most ``budget`` differing
    bits.  Null and empty texts have fingerprint zero and are linked like any other.  Null ids
    stay null and never name a component unless all ids there are null.  Only the columns named
    are used, so others may clash.  An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text, size), "simhash-prints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    member = components(fingerprint_links(distinct.select("fp"), budget, node_rows))
    linked = member.unionByName(member.select(F.col("component").alias("node"), "component").distinct())
    classes = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("class"))
    classes = materialize(classes, "simhash-classes")
    # written, so that a class of very many fingerprints is a join's skewed key, which Spark splits
    lows = materialize(classes.groupBy("class").agg(F.min("low").alias("component_id")), "simhash-lows")
    names = classes.join(lows, "class").select("fp", "component_id")
    return fps.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 4, budget: int = 4) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each near-duplicate group, columns unchanged.

    Of rows that repeat that id, one stays.  Rows with null ids stay only if their whole group
    has none, and then one of them.
    """
    keys = ["__row_1", "__row_2"]
    whole = [F.col(f"`{c}`") for c in docs.columns]
    # a row is known by 128 bits of its id and content
    rows = docs.withColumns({keys[0]: F.xxhash64(*whole), keys[1]: F.xxhash64(F.lit(1), *whole)})
    named = rows.select(F.struct(F.col(id_col).alias("i"), *keys).alias("id"), F.col(text).alias("text"))
    found = near_duplicates(named, "id", "text", size, budget)
    # a null id sorts first in a struct: only a group without other ids may be named by it
    order = F.struct(F.col("doc_id.i").isNull(), F.col("doc_id"))
    best = found.groupBy("component_id").agg(F.min_by("doc_id", order).alias("d")).select(*[F.col(f"d.{k}").alias(k) for k in keys])
    return rows.join(best, keys, "left_semi").dropDuplicates(keys).drop(*keys)
