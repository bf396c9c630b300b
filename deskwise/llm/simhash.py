"""SimHash near-duplicates: exact links by vantage-point trees, components by star contraction."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from deskwise.llm.blocks import blocks, hash_unit, join_counted, text_or_empty
from deskwise.session import broadcast_if_small, materialize

SEED = 42
LOWER = bytes(range(256)).lower()


# -- fingerprints ---------------------------------------------------------------------------------


def _hashes(text: str, shingle: int) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()  # splits at space and tab to carriage return
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in pairs]


def fingerprints_of(texts: list[str | None], shingle: int = 4) -> np.ndarray:
    """64-bit SimHash of every text: a bit is set if it is in over half of the shingles' hashes."""
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        found = _hashes(text or "", shingle)
        if not found:
            continue
        ones = np.zeros(64, np.int64)
        for at in range(0, len(found), 1 << 16):  # bounded memory for the longest texts
            part = np.array(found[at : at + (1 << 16)], "<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, digest, fp): the fingerprint of every row as a signed long; null and wordless texts have 0.

    ``digest`` is the 64-bit hash of the text, which tells rows of the same id apart.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(text_col), F.col(text_col).alias("text"))
    schema = StructType([rows.schema["doc_id"], StructField("digest", LongType()), StructField("fp", LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                fps = fingerprints_of(part.column("text").to_pylist(), shingle)
                out = [part.column("doc_id"), part.column("digest"), pa.array(fps.view(np.int64))]
                yield pa.RecordBatch.from_arrays(out, schema.names)

    return rows.mapInArrow(run, schema)


# -- vantage-point trees --------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """Fingerprints at most ``radius`` from the point (within the mask's bits) are inside, the others outside."""

    point: int
    radius: int
    inside: Node | int
    outside: Node | int


def bit_groups(count: int) -> list[int]:
    """Masks that split 64 bits into groups of nearly equal size."""
    edges = [64 * i // count for i in range(count + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _distance(fps: np.ndarray, point: int, mask: int) -> np.ndarray:
    return np.bitwise_count((fps ^ np.uint64(point)) & np.uint64(mask)).astype(np.int64)


def _vantage(fps: np.ndarray, mask: int, rng: np.random.Generator, tries: int = 8) -> tuple[int, int] | None:
    """Of a few points, the one whose median ball splits most evenly; None if none splits at all."""
    best, choice = 0, None
    for point in rng.choice(fps, min(tries, len(fps)), replace=False):
        d = _distance(fps[:4096], int(point), mask)
        radius = int(np.median(d))
        for r in (radius - 1, radius):
            small = min(int((d <= r).sum()), int((d > r).sum()))
            if small > best:
                best, choice = small, (int(point), r)
    return choice


def plant(sample: np.ndarray, mask: int, depth: int, seed: int) -> tuple[Node | int, int]:
    """A tree of at most ``2 ** depth`` leaves over the sample, its leaves numbered from 0, and their number."""
    rng, leaves = np.random.default_rng(seed), 0

    def grow(fps: np.ndarray, left: int) -> Node | int:
        nonlocal leaves
        split = _vantage(fps, mask, rng) if left and len(fps) > 1 else None
        if split is None:
            leaves += 1
            return leaves - 1
        near = _distance(fps, split[0], mask) <= split[1]
        return Node(*split, grow(fps[near], left - 1), grow(fps[~near], left - 1))

    return grow(sample, depth), leaves


def route(tree: Node | int, fps: np.ndarray, mask: int, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, places, home): the leaves a ball of ``reach`` around each fingerprint can touch, and its own leaf.

    By the triangle inequality a fingerprint at distance d from the point has neighbours inside only if
    d - reach <= radius, and outside only if d + reach > radius.
    """
    todo = [(tree, np.arange(len(fps)), np.ones(len(fps), bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield node, at, home
            continue
        d = _distance(fps[at], node.point, mask)
        inside = d <= node.radius
        for child, keep, own in ((node.inside, d - reach <= node.radius, inside), (node.outside, d + reach > node.radius, ~inside)):
            todo.append((child, at[keep], (home & own)[keep]))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of every pair (a, b); a class is named by its smallest place."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def shard_links(fps: np.ndarray, home: np.ndarray, mask: int, reach: int, bits: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint of its class) for all but the smallest of every class in one shard.

    All pairs of a home fingerprint and any other at ``bits`` or fewer bits are found by a local tree: below
    a node only the queries that can reach it meet its members. Where the group's bits no longer tell
    members apart, all 64 bits take over with the full reach. Pairs are merged block by block and not kept.
    """
    order = np.argsort(fps)
    fps, home = fps[order], home[order]
    label, rng = np.arange(len(fps)), np.random.default_rng(seed)

    def compare(members: np.ndarray, queries: np.ndarray) -> None:
        step = max(1, (1 << 20) // max(1, len(members)))
        for i in range(0, len(queries), step):
            part = queries[i : i + step]
            close = np.bitwise_count(fps[part][:, None] ^ fps[members][None, :]) <= bits
            q, m = np.nonzero(close)
            _merge(label, part[q], members[m])

    todo = [(np.flatnonzero(home), np.arange(len(fps)), mask, reach)]
    while todo:
        members, queries, bitmask, near = todo.pop()
        if not len(members) or not len(queries):
            continue
        split = _vantage(fps[members], bitmask, rng) if len(members) > 64 and len(queries) > 64 else None
        if split is None and len(members) > 1024 and near != bits:
            todo.append((members, queries, (1 << 64) - 1, bits))
            continue
        if split is None:
            compare(members, queries)
            continue
        dm, dq = _distance(fps[members], split[0], bitmask), _distance(fps[queries], split[0], bitmask)
        todo.append((members[dm <= split[1]], queries[dq - near <= split[1]], bitmask, near))
        todo.append((members[dm > split[1]], queries[dq + near > split[1]], bitmask, near))
    linked = label != np.arange(len(fps))
    return fps[linked], fps[label[linked]]


def links(distinct: DataFrame, bits: int = 4, groups: int = 3, shard_rows: int = 32_768, sample_rows: int = 4_096, max_depth: int = 10) -> DataFrame:
    """(a, b): links between distinct fingerprints whose transitive closure is that of all close pairs.

    Fingerprints that differ in at most ``bits`` of 64 bits differ in at most ``bits // groups`` bits of one of
    the groups. So one vantage-point tree per group, over the distance within its bits, needs only that
    small reach, which is what lets the triangle bounds prune. The upper levels of the trees are planted on
    a sample of at most about ``sample_rows`` fingerprints and shape only the shards, never the result;
    every fingerprint lives in one shard of each tree and visits the others its ball overlaps.
    """
    total = distinct.count()
    fraction = min(1.0, sample_rows / max(total, 1))
    sample = distinct.where(hash_unit(F.col("fp"), 11) < fraction).select("fp").collect()
    sample = np.array(sorted(r[0] for r in sample), np.int64).view(np.uint64)
    depth = min(max_depth, max(0, int(np.ceil(np.log2(max(1, total) / shard_rows)))))
    reach, masks = bits // groups, bit_groups(groups)
    trees, base = [], 0
    for k, mask in enumerate(masks):
        tree, leaves = plant(sample, mask, depth, k)
        trees.append((tree, mask, base))
        base += leaves
    shard_masks = {b + leaf: mask for (tree, mask, b), n in zip(trees, [*[t[2] for t in trees[1:]], base], strict=True) for leaf in range(n - b)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column("fp").to_numpy()
            for tree, mask, first in trees:
                for leaf, at, home in route(tree, signed.view(np.uint64), mask, reach):
                    shard = pa.array(np.full(len(at), first + leaf, np.int32))
                    yield pa.RecordBatch.from_arrays([shard, pa.array(signed[at]), pa.array(home)], ["shard", "fp", "home"])

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy().view(np.uint64)
        a, b = shard_links(fps, rows["home"].to_numpy(), shard_masks[int(key[0])], reach, bits, int(key[0]))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


# -- components -----------------------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node it is connected to.

    Alternating large and small stars: every node's larger, then its smaller neighbours are tied to its
    smallest neighbour, until each node hangs directly below its root. Rounds grow with the logarithm
    of the size; every round is a stored table.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        tied = both.join(least, "a")
        if large:
            return tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))

    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now, before = materialize(tidy(edges), "stars"), None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        now = materialize(tidy(star(tidy(star(now, True)), False)), "stars")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, digest, fp, root, component_id) of every row; ``root`` names the component by a fingerprint."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps")
    tied = components(links(distinct, bits))
    rooted = distinct.join(tied, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    named = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "named")
    return rows.join(join_counted(rooted.select("fp", "root"), named, "root"), "fp").select("doc_id", "digest", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Copies share a fingerprint and are compared once. Null, empty and wordless texts have fingerprint zero
    and link like any other. A null doc_id never names a component unless all its members are null.
    Repeated rows are repeated in the result; an empty table gives none; other columns are ignored.
    """
    rows = grouped(docs, id_col, text_col, shingle, bits)
    return rows.select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """``docs`` with one row of every component: that of the smallest doc_id (nulls last), of several the smallest text hash.

    Rows are taken out by an anti-join on (id, text hash), so a kept text moves only where the list of
    dropped rows is too large to be sent around. Of repeated rows one stays.
    """
    rows = materialize(grouped(docs, id_col, text_col, shingle, bits), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("best")
    best = materialize(rows.groupBy("root").agg(first, F.count("*").alias("n")), "best")
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    lost = join_counted(rows.select("root", "doc_id", "digest"), best, "root").where(~same).select("doc_id", "digest").distinct()
    twice = materialize(rows.groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest"), "repeated")

    def on(other: DataFrame, how: str, of: DataFrame) -> DataFrame:
        return of.alias("a").join(other.alias("b"), F.col(f"a.{id_col}").eqNullSafe(F.col("b.doc_id")) & (digest(F.col(f"a.{text_col}")) == F.col("b.digest")), how)

    kept = on(broadcast_if_small(lost), "left_anti", docs)
    if twice.isEmpty():
        return kept
    return on(twice, "left_anti", kept).unionByName(on(twice, "left_semi", kept).dropDuplicates([id_col, text_col]))


def digest(text: str | Column) -> Column:
    return F.xxhash64(text_or_empty(text)).alias("digest")


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
