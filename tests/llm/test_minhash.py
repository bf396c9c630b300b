import random
import re
from itertools import combinations

import numpy as np
import pytest

from deskwise.llm import minhash
from deskwise.llm.queries import op11_minhash


def brute_set(text, n=3):
    w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(docs, percent=85):
    sets = [frozenset(brute_set(t)) for _, t in docs]
    root = {s: s for s in sets if s}

    def find(x):
        while root[x] is not x:
            x = root[x]
        return x

    for a, b in combinations(root, 2):
        if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                root[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(docs, sets, strict=True):
        if s and i is not None:
            least[find(s)] = min(least.get(find(s), i), i)
    tied = [least.get(find(s)) if s else i for (i, _), s in zip(docs, sets, strict=True)]
    return [(i, len(s), c, i == c) for (i, _), s, c in zip(docs, sets, tied, strict=True)]


def check(found, docs):
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, brute(docs)))


def edited(words, share, rng):
    """The words, about this share of their shingles broken by new words."""
    out = list(words)
    for k in rng.sample(range(len(out)), max(1, round(share * len(out) / 3))):
        out[k] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def test_near_duplicates(spark, hostile, empty, sf):
    for table in (hostile, sf("documents")):
        check(minhash.near_duplicates(table), [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])
    assert minhash.near_duplicates(empty).count() == 0


def test_op11_is_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    check(op11_minhash(spark, "/root/testdata/sf0.01"), docs)


def test_groups_around_the_threshold(spark):
    """Copies that are near the original but not each other, chains, and families that share most of a page."""
    rng = random.Random(4)
    page = [f"w{k}" for k in range(400)]
    docs = [" ".join(page)] + [edited(page, s, rng) for s in (0.07, 0.09, 0.12, 0.2) for _ in range(25)]
    for family in range(4):
        start = page[:250] + [f"f{family}-{k}" for k in range(150)]
        docs += [edited(start, 0.05, rng) for _ in range(12)]
    chain = list(page[:120])
    for k in range(40):
        chain[(3 * k) % 120] = f"c{k}"
        docs.append(" ".join(chain))
    rng.shuffle(docs)
    docs = list(enumerate(docs)) + [(1000, docs[0]), (1001, docs[0])]
    check(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)), docs)


def test_buckets_that_their_centre_does_not_settle(spark):
    """One table only in effect: every set meets every other, and the prefix join has to find all links."""
    rng = random.Random(5)
    families = [[f"{f}-{k}" for k in range(60)] for f in range(5)]
    docs = [(n, edited(families[n % 5], 0.04, rng)) for n in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = minhash.sketches(table, "doc_id", "text", 3, minhash.Tensor())
    nodes = rows.selectExpr("doc_id as node", "n_shingles as size", "doc_id as root")
    sets = spark.createDataFrame([(n, [int(x) for x in minhash.shingle_set(t, 3).view(np.int64)]) for n, t in docs], "node long, shingles array<bigint>")
    for per_task in (2048, 4):
        found = minhash.confirmed(minhash.prefix_pairs(nodes.join(sets, "node"), 85, per_task), sets, 85, per_task)
        truth = {(a, b) for (a, x), (b, y) in combinations(docs, 2) for p, q in [(brute_set(x), brute_set(y))] if 100 * len(p & q) >= 85 * len(p | q)}
        assert set(map(tuple, found.collect())) == truth


@pytest.mark.parametrize("similarity", [0.85, 0.9, 0.95])
def test_misses_are_as_rare_as_stated(similarity):
    rng, tensor = np.random.default_rng(6), minhash.Tensor(6, 3)
    n, missed = 3000, 0
    union = 200
    both = round(union * similarity)
    for _ in range(n // 100):
        sets = []
        for _ in range(100):
            h = rng.integers(0, 1 << 64, union, np.uint64)
            half = (union - both) // 2
            sets += [np.sort(h[: both + half]), np.sort(np.concatenate((h[:both], h[both + half :])))]
        s = tensor.sketch(sets)
        missed += int(((s[::2] == s[1::2]).sum(axis=1) < 2).sum())
    expect = tensor.miss(similarity)
    assert abs(missed / n - expect) < 4 * np.sqrt(expect / n) + 2 / n
    assert minhash.Tensor().miss(0.85) < 1e-5


def test_shingles_are_told_apart():
    for a, b in (("a b c", "a c b"), ("a b", "a b b"), ("a", "a a"), ("ab c d", "a bc d")):
        assert set(minhash.shingle_set(a, 3).tolist()).isdisjoint(minhash.shingle_set(b, 3).tolist())
    assert (minhash.shingle_set("A b\tC d", 3) == minhash.shingle_set("a B c D ", 3)).all()
    assert minhash.shingle_set("É x y", 3) != minhash.shingle_set("é x y", 3)
    assert len(minhash.shingle_set(" \n", 3)) == len(minhash.shingle_set(None, 3)) == 0
