"""Decontamination, sharding and quality rules against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from deskwise.llm import decontaminate, shards, weak_rules


def words(text):
    return re.findall(decontaminate.WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_contamination(text, items, n=10):
    mine, hit, found = words(text), set(), set()
    for item, content in items:
        w = words(content)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            window = w[k : k + n]
            for i in range(len(mine) - len(window) + 1):
                if mine[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item))
    return len(mine), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination(spark, hostile, empty):
    rng = random.Random(1)
    draw = lambda n: " ".join(rng.choice(["a", "b", "C", "dé"]) for _ in range(n))
    items = [(k, draw(rng.choice([1, 2, 5, 9, 10, 11, 14]))) for k in range(12)] + [(100, None), (101, "..."), (None, "same text"), (7, "same text")]
    docs = [(k, draw(rng.randrange(60))) for k in range(60)] + [(r.doc_id, r.text) for r in hostile.collect()]
    table = hostile.unionByName(spark.createDataFrame(docs[:60], "doc_id long, text string"), allowMissingColumns=True)
    items_table = spark.createDataFrame(items, "item_id long, text string")
    named = [(i, t) for i, t in items if i is not None]
    got = decontaminate.contamination(table, items_table.where("item_id is not null")).drop("digest").collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_contamination(t, named)) for i, t in docs)
    assert decontaminate.contamination(empty, items_table).count() == 0
    assert decontaminate.contamination(hostile, items_table.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.keep_clean(table, items_table.where("item_id is not null"))
    assert kept.columns == table.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t in docs if not brute_contamination(t, named)[4])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x a b y a"), (2, "y b b x"), (3, None)], "doc_id long, text string")
    index = decontaminate.build_index(docs, spark.createDataFrame([("x",), ("y",)], "term string"))
    found = decontaminate.proximity_matches(index, "x", "y", 3).select("doc_id", "left_pos", "right_pos")
    assert sorted(map(tuple, found.collect())) == [(1, 0, 3), (2, 3, 0)]
    assert decontaminate.proximity_matches(index, "x", "y", 2).count() == 0


def test_shards(spark, hostile, empty):
    docs = hostile.unionByName(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), allowMissingColumns=True)
    docs = docs.unionByName(spark.range(200_000).select(F.lit(77).cast("long").alias("doc_id"), F.lit("hot").alias("text")), allowMissingColumns=True)
    rows = shards.shard_rows(docs).collect()
    assert len(rows) == docs.count()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    assert {r.shard for r in rows if r.doc_id == 77} == {next(r.shard for r in rows if r.doc_id == 77)}
    expect = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expect
    assert shards.shard_rows(empty).count() == 0


def test_weights(spark):
    rows = shards.assign_shards(spark.range(40_000), "id", {0: 1.0, 1: 3.0})
    share = rows.where("shard = 1").count() / 40_000
    assert abs(share - 0.75) < 0.02


def brute_rules(text):
    text = text or ""
    w = [x for x in re.split("[ \t-\r]+", text) if x]
    lines, grams, covered = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)], {}, set()
    for k in range(len(w) - 7):
        grams.setdefault(tuple(w[k : k + 8]), []).append(k)
    for places in grams.values():
        if len(places) > 1:
            covered.update(i for k in places for i in range(k, k + 8))
    symbols = sum(map(text.count, "#*$%&|<>"))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_rules(spark, hostile, empty, sf):
    docs = hostile.select("doc_id", "text").unionByName(sf("documents").select("doc_id", "text"))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = weak_rules.judge(docs)
    assert Counter(tuple(r[f] for f in ["doc_id", *fields]) for r in got.collect()) == Counter((r.doc_id, *brute_rules(r.text)) for r in docs.collect())
    assert got.where("base_failed and kept").count() == 0
    judged = weak_rules.judge(sf("documents")).join(sf("labels"), "doc_id")
    assert judged.where("quality = 0 and kept").count() <= 1
    assert judged.where("quality = 1 and not kept and not base_failed").count() <= 1
    assert weak_rules.judge(hostile).count() == hostile.count() and weak_rules.judge(empty).count() == 0


@pytest.mark.parametrize("good", [0.8, 0.5])
def test_accuracies_of_simulated_rules_are_recovered(spark, good):
    """Five rules of known accuracy vote or abstain at random; nothing but their votes is given."""
    rng = random.Random(3)
    names, right, speaks = list("abcde"), [0.9, 0.8, 0.75, 0.85, 0.7], [0.9, 0.6, 0.8, 0.5, 0.95]
    counts, truth, n = Counter(), Counter(), 40_000
    for _ in range(n):
        label = int(rng.random() < good)
        votes = tuple((label if rng.random() < r else 1 - label) if rng.random() < s else -1 for r, s in zip(right, speaks))
        counts[votes] += 1
        truth[votes, label] += 1
    rows = spark.createDataFrame([(*v, k) for v, k in counts.items()], [*names, "k"]).selectExpr(*names, "explode(sequence(1, int(k))) as one").drop("one")
    model = weak_rules.fit_votes(rows, names)
    assert abs(model.prior - good) < 0.05
    for name, r in zip(names, right):
        for label in (0, 1):
            rates = model.rates[name][label]
            assert abs(rates[label] / (rates[0] + rates[1]) - r) < 0.05
    hits = sum(k for (votes, label), k in truth.items() if (model.posterior(dict(zip(names, votes))) >= 0.5) == label)
    best = sum(max(truth[v, 0], truth[v, 1]) for v in counts)
    assert hits >= 0.98 * best
    column = rows.limit(200).select(*names, weak_rules.posterior(model).alias("p")).collect()
    assert all(abs(r.p - model.posterior({n: r[n] for n in names})) < 1e-9 for r in column)
