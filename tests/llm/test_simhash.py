import re

import numpy as np
import xxhash

from deskwise.llm import simhash


def brute_fp(text, n=4):
    w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if x]
    grams = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, bits=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in root}


def check(rows, docs):
    fps = {(i, t): brute_fp(t) for i, t in docs}
    tied = classes(set(fps.values()))
    least = {}
    for (i, _), f in fps.items():
        if i is not None:
            least[tied[f]] = min(least.get(tied[f], i), i)
    expect = sorted(((i, f"{fps[i, t]:016x}", least.get(tied[fps[i, t]])) for i, t in docs), key=repr)
    assert sorted(map(tuple, rows), key=repr) == expect


def test_near_duplicates(spark, hostile, empty, sf):
    for table in (hostile, sf("documents")):
        check(simhash.near_duplicates(table).collect(), [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])
    assert simhash.near_duplicates(empty).count() == 0


def test_links_are_complete_over_many_shards(spark):
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for c in centres for _ in range(6)]
    fps = np.unique(np.concatenate((np.array(flips, np.uint64), rng.integers(0, 1 << 63, 3000, dtype=np.uint64))))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(table, shard_rows=200)).collect()}
    tied = classes([int(x) for x in fps])
    mine: dict = {}
    for f in fps.view(np.int64).tolist():
        mine.setdefault(found.get(f, f), set()).add(f % (1 << 64))
    theirs: dict = {}
    for f, r in tied.items():
        theirs.setdefault(r, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_dense_group_with_equal_group_bits():
    low = np.array([sum(1 << b for b in range(40, 52) if k >> (b - 40) & 1) for k in range(4096)], np.uint64)
    a, b = simhash.shard_links(low, np.ones(4096, bool), simhash.bit_groups(3)[0], 1, 4)
    assert len(a) == 4095 and set(b.tolist()) == {0}


def test_long_chains_become_one_component(spark):
    edges = spark.range(1, 400).selectExpr("id as a", "id - 1 as b")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_keep_one(spark, hostile):
    kept = simhash.keep_one(hostile)
    assert kept.columns == hostile.columns
    found = simhash.grouped(hostile)
    assert kept.count() == found.select("root").distinct().count()
    assert simhash.grouped(kept).select("root").distinct().count() == kept.count()
