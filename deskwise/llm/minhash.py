"""MinHash near-duplicates: tensored table keys, links confirmed on full shingle sets, components by star contraction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from deskwise.llm.blocks import blocks, join_counted, text_or_empty
from deskwise.llm.simhash import components
from deskwise.session import broadcast_if_small, materialize

LOWER = bytes(range(256)).lower()
BLOCK = 1 << 20  # bytes of text that a task works on at a time, or one longer text


# -- shingle sets ---------------------------------------------------------------------------------


class _WordHashes(dict):
    """XXH64 of every word, remembered while there are few of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """One hash of two, order mattering."""
    with np.errstate(over="ignore"):
        a = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        a = (a ^ (a >> np.uint64(29))) + np.asarray(b, np.uint64)
        a = (a ^ (a >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return a ^ (a >> np.uint64(31))


def shingle_set(text: str | None, shingle: int, known: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a text of fewer words has one, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # splits at space and tab to carriage return
    if not words:
        return np.zeros(0, np.uint64)
    known = _WordHashes() if known is None else known
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out, codes[k : k + len(out)])
    return np.unique(out)


# -- sketches -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tensor:
    """``collections`` small collections of ``width`` minhashes each; a table key is a pair of collections.

    ``collections * width`` minhashes thus serve ``collections * (collections - 1) / 2`` tables whose keys agree in
    ``2 * width`` minhashes, instead of as many minhashes for each table.
    """

    collections: int = 16
    width: int = 3
    seed: int = 11

    def miss(self, similarity: float) -> float:
        """Chance that two sets of this similarity share no table key: fewer than two collections agree."""
        p, m = similarity**self.width, self.collections
        return (1 - p) ** m + m * p * (1 - p) ** (m - 1)

    def sketch(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, collections) hashes of the collections' minhashes; no set may be empty."""
        rng = np.random.default_rng(self.seed)
        factors = rng.integers(0, 1 << 63, (self.collections, self.width), np.uint64) * np.uint64(2) + np.uint64(1)
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((len(sets), self.collections), np.uint64)
        scratch = np.empty_like(flat)
        for i in range(self.collections):
            key = np.full(len(sets), i, np.uint64)
            for j in range(self.width):
                np.multiply(flat, factors[i, j], out=scratch)
                key = mix(key, np.minimum.reduceat(scratch, starts))
            out[:, i] = key
        return out


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, tensor: Tensor) -> DataFrame:
    """(doc_id, text_hash, digest, n_shingles, sketch) of every row; digest and sketch are null for an empty set.

    ``digest`` is the md5 of the set, so rows with equal sets are compared once.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col), F.col(text_col).alias("text"))
    schema = StructType([rows.schema["doc_id"], StructField("text_hash", LongType())])
    schema = schema.add("digest", "binary").add("n_shingles", "long").add("sketch", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            for part in blocks(batch, "text", BLOCK):
                sets = [shingle_set(t, shingle, known) for t in part.column("text").to_pylist()]
                full = [s for s in sets if len(s)]
                found = iter(tensor.sketch(full).view(np.int64).tolist() if full else ())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    schema.names,
                )

    return rows.mapInArrow(run, schema)


def text_hash(text: str | Column) -> Column:
    return F.xxhash64(text_or_empty(text)).alias("text_hash")


# -- candidates -----------------------------------------------------------------------------------


def table_keys(nodes: DataFrame) -> DataFrame:
    """(node, size, key): every table key of the sets that share two collections or more with other sets.

    A collection that no other set shares can't be part of a shared key. Most sets have none that is shared, so
    they leave here, after one row a collection instead of one a table.
    """
    parts = nodes.select("node", F.col("n_shingles").alias("size"), F.posexplode("sketch").alias("i", "u"))
    shared = parts.groupBy("i", "u").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("i", "u")
    live = parts.join(shared, ["i", "u"], "left_semi")
    lists = live.groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("i", "u"))).alias("c")).where(F.size("c") > 1)
    pairs = F.flatten(
        F.transform("c", lambda x, at: F.transform(F.slice("c", at + 2, F.size("c")), lambda y: F.xxhash64(x["i"], x["u"], y["i"], y["u"])))
    )
    return lists.select("node", "size", F.explode(pairs).alias("key"))


def centre_pairs(keyed: DataFrame, percent: int) -> DataFrame:
    """(a, b): the sets of every table bucket with the bucket's centre, its smallest node, where their sizes allow a link.

    Sets that meet in many tables mostly meet the same centre, so a group of g sets gives about g pairs.
    """
    centres = keyed.groupBy("key").agg(F.min(F.struct("node", "size")).alias("c"), F.count("*").alias("n")).where("n > 1")
    met = join_counted(keyed, materialize(centres, "table-centres"), "key").where("node <> c.node")
    met = met.where(comparable(F.col("size"), F.col("c.size"), percent))
    return met.select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()


def unsettled(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, size, root) of the sets in buckets of three or more whose links to the centre left several components."""
    rooted = keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    buckets = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
    left = buckets.where("n > 2 AND lo < hi").select("key")
    return rooted.join(broadcast_if_small(left), "key", "left_semi").select("node", "size", "root").distinct()


def prefix_pairs(open_sets: DataFrame, percent: int, per_task: int = 2048) -> DataFrame:
    """(a, b) of all sets (node, size, root, shingles) that can be similar enough and lie in different components.

    Exact, without comparing all members of a bucket: shingles are ordered from rare to common, and two sets as
    similar as asked for share one among the first ``size - ceil(percent * size / 100) + 1`` of each. What may follow a
    shared shingle bounds the overlap, which drops most of the rest. A common shingle's sets are dealt to as many
    tasks as their number asks for.
    """
    shingles = open_sets.select("node", "size", "root", F.explode("shingles").alias("t"))
    counts = materialize(shingles.groupBy("t").agg(F.count("*").alias("n")).withColumn("df", F.col("n")), "shingle-counts")
    ranked = join_counted(shingles, counts, "t").groupBy("node", "size", "root").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("l"))
    least = F.expr(f"({percent} * size + 99) div 100")
    first = F.slice("l", 1, (F.col("size") - least + 1).cast("int"))
    heads = ranked.select("node", "size", "root", F.posexplode(first).alias("at", "e")).select("node", "size", "root", "at", "e.t", "e.df").where("df > 1")
    heads = heads.withColumn("salts", F.ceil(F.col("df") / per_task).cast("int"))
    a = heads.withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int")).alias("a")
    b = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("b")
    left = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))  # this shingle and what follows
    reach = (100 + percent) * left >= percent * (F.col("a.size") + F.col("b.size"))
    on = (F.col("a.t") == F.col("b.t")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.node") < F.col("b.node"))
    on = on & (F.col("a.root") != F.col("b.root")) & comparable(F.col("a.size"), F.col("b.size"), percent) & reach
    return a.join(b, on).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


# -- confirmation ---------------------------------------------------------------------------------


def comparable(a: Column, b: Column, percent: int) -> Column:
    """Sizes that allow the similarity at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, shingles) of the nodes in ``wanted`` (node, doc_id, text_hash), from the text of one of their rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col), F.col(text_col).alias("text"))
    same = F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.text_hash") == F.col("w.text_hash"))
    texts = rows.alias("r").join(broadcast_if_small(wanted).alias("w"), same).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            for part in blocks(batch, "text", BLOCK):
                sets = [shingle_set(t, shingle, known).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<bigint>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, per_task: int = 4096) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar enough.

    A set that occurs in more than ``per_task`` pairs as ``a`` is repeated for as many tasks as it needs.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / per_task).cast("int"))
    counts = materialize(counts, "pair-counts")
    dealt = join_counted(pairs, counts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts").cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    left = sets.join(counts, sets["node"] == counts["a"]).select("a", F.col("shingles").alias("sa"), copies)
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = dealt.select("a", "b", "salt").join(right, "b").join(left, ["a", "salt"])
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * inter >= percent * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


# -- the operator ---------------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 85, tensor: Tensor | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Rows link if their sets of distinct word shingles have ``100 * intersection >= percent * union``; ``component_id`` is the
    smallest doc_id that links reach, and ``kept`` says that it is the row's own. Candidates share a key of the
    tensored tables; with the default a pair just at 85 percent misses all 120 tables with a chance of 7 in a
    million (``Tensor.miss``), and no candidate is left out: a bucket's sets are confirmed against one of them, and what
    that leaves in several components is completed by an exact prefix join.

    Rows of equal sets are compared once. Texts without words, empty or null, have no shingles and link with
    nothing, not even each other. A null doc_id never names a component unless all its rows are null. Repeated rows
    are repeated in the result; an empty table gives none; other columns are ignored.
    """
    tensor = tensor or Tensor()
    rows = materialize(sketches(docs, id_col, text_col, shingle, tensor), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("rep")
    nodes = rows.where(F.col("digest").isNotNull()).groupBy("digest", "n_shingles", "sketch").agg(first, F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "sets")

    keyed = materialize(table_keys(nodes), "table-keys")
    pairs = materialize(centre_pairs(keyed, percent), "centre-pairs")
    seen = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    reps = nodes.join(seen, "node").select("node", "rep.doc_id", "rep.text_hash")
    sets = materialize(full_sets(docs, reps, id_col, text_col, shingle), "shingle-sets")
    links = materialize(confirmed(pairs, sets, percent), "links")
    roots = components(links)

    rest = materialize(unsettled(keyed, roots), "unsettled")
    if not rest.isEmpty():
        absent = nodes.join(rest, "node").join(sets, "node", "left_anti").select("node", "rep.doc_id", "rep.text_hash")
        more = sets.unionByName(full_sets(docs, absent, id_col, text_col, shingle))
        open_sets = materialize(rest.join(more, "node"), "open-sets")
        found = confirmed(materialize(prefix_pairs(open_sets, percent), "prefix-pairs"), open_sets.select("node", "shingles"), percent)
        roots = components(links.unionByName(found))

    tied = nodes.select("node", "digest", "copies", "rep").join(roots, "node", "left")
    tied = materialize(tied.withColumn("root", F.coalesce("root", "node")), "tied")
    least = F.min(F.struct("rep.no_id", "rep.doc_id")).alias("least")
    named = materialize(tied.groupBy("root").agg(least, F.count("*").alias("n")), "named")
    named = join_counted(tied.select("root", "digest", "copies"), named, "root").select("digest", F.col("least.doc_id").alias("component_id"), F.col("copies").alias("n"))
    worded = join_counted(rows.where(F.col("digest").isNotNull()), materialize(named, "components"), "digest")
    bare = rows.where(F.col("digest").isNull()).withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    both = worded.select(*columns).unionByName(bare.select(*columns))
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
