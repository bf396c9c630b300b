import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from deskwise.operators import similarity
from deskwise.operators.groups import components


def brute_set(text, size=5):
    words = re.findall(r"\w{2,}", (text or "").lower())
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, percent=80):
    sets = {k: brute_set(t) for k, t in rows}
    links = [
        (a, b) for a, b in combinations(sorted(sets), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    group = {k: k for k in sets}
    for _ in sets:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    near = {k: sum(k in link for link in links) for k in sets}
    return sorted((k, len(sets[k]), near[k], group[k]) for k in sets), links


def edited(words, n, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(0)
    page = [f"w{k}" for k in range(120)]
    rows = [" ".join(page)] * 4 + [edited(page, n, rng) for n in (1, 2, 3, 4, 5, 8) for _ in range(8)]
    rows += ["", None, "!!! ?", "one two", "One  TWO", "a b c", "hello there " * 300]
    chain = list(page)
    for k in range(0, 60, 2):
        chain[k] = f"c{k}"
        rows.append(" ".join(chain))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("per_task", [4096, 3])
def test_near_identical_is_brute_force(spark, cases, per_task):
    df = spark.createDataFrame(cases, "pos long, text string").repartition(5)
    found = similarity.near_identical(df, "pos", "text", rows_per_task=per_task)
    assert sorted(map(tuple, found.collect())) == brute(cases)[0]


@pytest.mark.parametrize("percent", [50, 80, 95, 100])
def test_links_at_any_threshold(spark, cases, percent):
    found = similarity.similarity_join(spark.createDataFrame(cases, "pos long, text string"), "pos", "text", percent)
    keys = {}
    for r in found.rows.where("node IS NOT NULL").collect():
        keys.setdefault(r.node, []).append(r.key)
    mine = {tuple(sorted(p)) for n in keys.values() for p in combinations(n, 2)}
    mine |= {tuple(sorted((x, y))) for r in found.links.collect() for x in keys[r.a] for y in keys[r.b]}
    assert mine == set(brute(cases, percent)[1])


def test_few_pairs_are_compared(spark):
    """Texts that share a long header and nothing else meet in no prefix, since its shingles are common."""
    rng = random.Random(1)
    header = [f"h{k}" for k in range(30)]
    rows = [(k, " ".join(header + [f"x{rng.randrange(10**9)}" for _ in range(60)])) for k in range(300)]
    found = similarity.similarity_join(spark.createDataFrame(rows, "pos long, text string"), "pos", "text")
    assert found.candidates.count() < 100 and found.links.count() == 0
    copies = spark.createDataFrame([(k, "the very same words in every single row") for k in range(500)], "pos long, text string")
    found = similarity.similarity_join(copies, "pos", "text")
    assert found.nodes.count() == 1 and found.candidates.count() == 0
    assert similarity.near_identical(copies, "pos", "text").agg(F.min("n_similar"), F.max("group_id")).first() == (499, 0)


def test_drop_near_identical_and_empty(spark, cases):
    df = spark.createDataFrame([(k, t, "kept") for k, t in cases], "pos long, text string, node string")
    left = similarity.drop_near_identical(df, "pos", "text")
    assert left.columns == df.columns
    assert sorted(r.pos for r in left.collect()) == sorted({g for *_, g in brute(cases)[0]})
    none = df.where("false")
    assert similarity.near_identical(none, "pos", "text").count() == similarity.drop_near_identical(none, "pos", "text").count() == 0


def test_components(spark):
    rng = random.Random(2)
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 200)]
    loose = [(2000 + rng.randrange(300), 2000 + rng.randrange(300)) for _ in range(150)]
    links = chain + star + loose + star[:5] + [(7, 3), (5000, 5000)]
    rng.shuffle(links)
    root = {n: n for link in links for n in link}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
