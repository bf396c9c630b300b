"""Benchmark decontamination over a positional inverted index of the training documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskwise.llm.blocks import ascii_lower, text_or_empty
from deskwise.operators.joins import lookup_join
from deskwise.session import broadcast_if_small, materialize

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
DOC = ["doc_id", "digest"]


def words_of(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """(terms, item_id): every window of n consecutive words; an item of fewer words is one window."""
    words = items.select(F.col(id_col).alias("item_id"), words_of(text_or_empty(text_col)).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(1)))
    windows = words.where(F.size("words") > 0).withColumn("at", F.explode(starts))
    return windows.select(F.slice("words", F.col("at"), n).alias("terms"), "item_id").distinct()


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (doc_id, digest, pos, term) of all occurrences of ``terms`` in all documents, stored as a table.

    ``digest`` tells documents apart that share an id. ``n_words`` is set on one row of every document (the
    one of its first word, or without a word), which also records documents that hold no term.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), words_of(text).alias("words"))
    rows = rows.select(*DOC, F.size("words").cast("long").alias("size"), F.posexplode_outer("words").alias("pos", "word"))
    rows = lookup_join(rows, "word", terms.select("term").distinct(), "term", "left")
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return materialize(
        rows.where(F.col("term").isNotNull() | first).select(*DOC, "pos", "term", F.when(first, F.col("size")).alias("n_words")),
        "postings",
    )


def _same_doc(a: str = "a", b: str = "b") -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, digest, start, terms): every place where the words of a window follow each other.

    Terms are ordered by their number of postings. The postings of a window's rarest term give its possible
    starts (position minus offset in the window); the lists of the other terms are intersected with them
    at their own offsets, the second rarest first, and a start stays if every term is there.
    """
    phrases = windows.select("terms").distinct().withColumn("phrase", F.xxhash64("terms"))
    postings = index.where(F.col("term").isNotNull()).select(*DOC, "pos", "term")
    frequency = materialize(postings.groupBy(F.col("term").alias("known")).agg(F.count("*").alias("n")), "frequencies")
    parts = phrases.select("terms", F.posexplode("terms").alias("offset", "term"))
    known = lookup_join(parts, "term", frequency, "known", "inner").groupBy("terms").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("by_n"))
    plans = materialize(
        known.where(F.size("by_n") == F.size("terms")).select("terms", "by_n"), "phrases"
    )
    first = broadcast_if_small(plans.select("terms", F.col("by_n")[0]["offset"].alias("offset"), F.col("by_n")[0]["term"].alias("term")))
    starts = postings.join(first, "term").select(*DOC, (F.col("pos") - F.col("offset")).alias("start"), "terms").where("start >= 0")
    starts = materialize(starts, "starts")

    def intersect(found: DataFrame, lists: DataFrame, begin: int, length: Column) -> DataFrame:
        """Starts with the number of their terms of rank ``begin`` and after (``length`` of them) that are in place."""
        wanted = found.join(plans, "terms").withColumn("part", F.explode(F.slice("by_n", begin, length)))
        wanted = wanted.select(*DOC, "start", "terms", (F.col("start") + F.col("part.offset")).alias("pos"), F.col("part.term").alias("term"))
        here = (F.col("a.pos") == F.col("b.pos")) & (F.col("a.term") == F.col("b.term"))
        hits = wanted.alias("a").join(lists.distinct().alias("b"), _same_doc() & here)
        hits = hits.select("a.doc_id", "a.digest", "a.start", "a.terms")
        return hits.groupBy(*DOC, "start", "terms").agg(F.count("*").alias("n"))

    starts = starts.distinct()
    one = starts.where(F.size("terms") == 1)
    # The lists of second rarest terms are short as well; those of common terms are read for the few documents left.
    second = broadcast_if_small(plans.where(F.size("by_n") > 1).select(F.col("by_n")[1]["term"].alias("term")).distinct())
    pairs = intersect(starts.where(F.size("terms") > 1), postings.join(second, "term", "left_semi"), 2, F.lit(1))
    pairs = materialize(pairs.drop("n"), "pairs")
    longer = pairs.where(F.size("terms") > 2)
    holders = broadcast_if_small(longer.select(*DOC).distinct())
    lists = postings.alias("a").join(holders.alias("b"), _same_doc(), "left_semi")
    rest = intersect(longer, lists, 3, F.size("terms"))
    whole = rest.where(F.col("n") == F.size("terms") - 2).drop("n")
    return one.unionByName(pairs.where(F.size("terms") == 2)).unionByName(whole)


def proximity_matches(index: DataFrame, left: str, right: str, within: int) -> DataFrame:
    """(doc_id, digest, left_pos, right_pos): occurrences of two terms at most ``within`` words apart.

    Positions are filed under stretches of ``within + 1`` words, so that only neighbouring stretches meet.
    """
    width = within + 1
    spots = index.select(*DOC, "pos", "term").distinct()
    a = spots.where(F.col("term") == left).withColumn("cell", F.explode(F.array(*(F.floor(F.col("pos") / width) + d for d in (-1, 0, 1)))))
    b = spots.where(F.col("term") == right).withColumn("cell", F.floor(F.col("pos") / width))
    both = a.alias("a").join(b.alias("b"), _same_doc() & (F.col("a.cell") == F.col("b.cell")))
    both = both.where((F.abs(F.col("a.pos") - F.col("b.pos")) <= within) & (F.col("a.pos") != F.col("b.pos")))
    return both.select("a.doc_id", "a.digest", F.col("a.pos").alias("left_pos"), F.col("b.pos").alias("right_pos"))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", n: int = 10,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words, so no hits; items without words are never found. Rows with the same id
    and text get equal rows, rows with the same id and other texts their own. Without documents there are no
    rows, without items no hits. Other columns are ignored.
    """
    windows = materialize(item_windows(items, item_id, item_text, n), "windows")
    index = build_index(docs, windows.select(F.explode("terms").alias("term")), id_col, text_col)
    matches = materialize(phrase_matches(index, windows), "matches")

    spans = matches.select(*DOC, "start", (F.col("start") + F.size("terms")).alias("end")).distinct()
    so_far = Window.partitionBy(*DOC).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(so_far), F.lit(0))
    spans = spans.withColumn("new", F.greatest(F.col("end") - F.greatest(F.col("start"), reached), F.lit(0)))
    hits = spans.groupBy(*DOC).agg(F.sum("new").alias("n_hit"))

    found = matches.select(*DOC, "terms").distinct().join(windows, "terms").select(*DOC, F.col("item_id").cast("string").alias("item")).distinct()
    found = found.groupBy(*DOC).agg(F.count("*").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("items"))
    hits = hits.alias("a").join(found.alias("b"), _same_doc()).select("a.doc_id", "a.digest", "n_hit", "n_items", "items")

    rows = index.where(F.col("n_words").isNotNull()).select(*DOC, "n_words")
    out = rows.alias("a").join(broadcast_if_small(hits).alias("b"), _same_doc(), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return out.select(
        "a.doc_id", "a.digest", "n_words", n_hit.alias("n_hit"), F.coalesce(F.col("n_items"), F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce(F.col("items"), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a hit, with their own columns; a text moves only where the list of hit rows is long."""
    found = contamination(docs, items, id_col, text_col, **options).where("contaminated").select(*DOC).distinct()
    same = F.col(f"a.{id_col}").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64(text_or_empty(F.col(f"a.{text_col}"))) == F.col("b.digest"))
    return docs.alias("a").join(broadcast_if_small(found).alias("b"), same, "left_anti")
