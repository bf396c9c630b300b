import math
from collections import Counter

import pytest

from deskwise.operators import language

DOCS = [
    (1, "en", "the thing and the other thing"), (2, "en", "THE  end"), (3, "de", "der Hund und die Katze"), (4, "de", "und nun"),
    (5, "fr", "l'été et le thé"), (6, None, "the hound"), (7, "en", ""), (8, "fr", None), (9, "de", "ab"),
]


def grams(text):
    low = " ".join((text or "").lower().split())
    return Counter(low[k : k + 3] for k in range(len(low) - 2))


def brute(docs):
    known = [(lang, grams(t)) for _, lang, t in docs if lang]
    langs = sorted({lang for lang, _ in known})
    counts = {x: sum((g for lang, g in known if lang == x), Counter()) for x in langs}
    size = len(set().union(*counts.values()))
    out = {}
    for i, _, text in docs:
        logs = [
            math.log(sum(lang == x for lang, _ in known) / len(known))
            + sum(n * math.log((counts[x][g] + 1) / (counts[x].total() + size)) for g, n in grams(text).items())
            for x in langs
        ]
        total = sum(math.exp(v - max(logs)) for v in logs)
        out[i] = (langs[logs.index(max(logs))], [math.exp(v - max(logs)) / total for v in logs])
    return out


def test_naive_bayes_is_brute_force(spark):
    rows = language.counted_rows(spark.createDataFrame(DOCS, "id long, lang string, text string").repartition(3), "text", "id", "lang")
    tables = language.fit(rows, "lang")
    assert tables.langs == ["de", "en", "fr"]
    want = brute(DOCS)
    got = {r.id: r for r in language.detect(tables, rows, ["id"]).collect()}
    assert set(got) == set(want)
    for i, (lang, p) in want.items():
        assert got[i].detected_lang == lang and got[i].p == pytest.approx(p, abs=1e-6)


def test_unseen_trigrams_weigh_alike(spark):
    train = language.counted_rows(spark.createDataFrame(DOCS[:5], "id long, lang string, text string"), "text", "id", "lang")
    new = language.counted_rows(spark.createDataFrame([(1, "xyzzy"), (2, "der Katze")], "id long, text string"), "text", "id")
    got = {r.id: r for r in language.detect(language.fit(train, "lang"), new, ["id"]).collect()}
    assert got[2].detected_lang == "de" and sum(got[1].p) == pytest.approx(1, abs=3e-6)
    assert language.detect(language.fit(train, "lang"), new.where("false"), ["id"]).count() == 0
