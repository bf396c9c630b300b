"""Quality, toxicity and personal data: held-out accuracy, brute force and odd inputs."""

import random
import re
import zlib
from collections import Counter

import pytest

from deskwise.llm import pii, quality, toxicity

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(3)
    bits = ["a", "b.", "@", ".", "1", "25", "4111111111111111", "-", " ", "+", "(", ")", "é", "256", "+1 (499) 555-6503", "x@y.z"]
    for _ in range(30_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert sorted(pii.base_spans(text)) == brute_spans(text), text


def test_every_hidden_address_of_a_line():
    line = "ann [at] mail [dot] com, bob [at] mail [dot] com, cat(at)mail(dot)com; x [at] y, dan (@) a-b [.] co [dot] uk"
    pattern = r"[A-Za-z0-9._%+-]+ ?[\[(] ?(?:at|@) ?[\])] ?[A-Za-z0-9-]+(?: ?[\[(] ?(?:dot|\.) ?[\])] ?[A-Za-z0-9-]+)+"
    rng, bits = random.Random(3), ["ann", "b.c", " ", " ", "[at]", "(at)", "[ @ ]", "[dot]", "(dot)", "( . )", "-", ", ", "m" * 70]
    for text in [line, "a" * 100 + line, *("".join(rng.choices(bits, k=30)) for _ in range(3000))]:
        spans = [m.span() for m in re.finditer(pattern, text, re.I)]
        assert pii.hidden_emails(text) == spans, text
    found = [line[c.start : c.end] for c in pii.candidates(line) if c.kind == "email"]
    assert found == ["ann [at] mail [dot] com", "bob [at] mail [dot] com", "cat(at)mail(dot)com", "dan (@) a-b [.] co [dot] uk"]


def test_local_phones_with_any_separator():
    rng, bits = random.Random(4), ["555", "0123", "4567", " ", ".", "-", "(", ")", "+", "x", "\n"]
    for body in ("555.123.4567", "555 123 4567", "(555) 123 4567", "555-123-4567", "555 123-4567"):
        found = [(c.kind, c.start, c.end) for c in pii.candidates(f"call {body} today")]
        assert found == [("phone", 5, 5 + len(body))], body
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=12))
        taken = [(s, e) for _, s, e in pii.base_spans(text)]
        free = [m.span() for m in pii.LOCAL_PHONE.finditer(text) if all(e <= m.start() or m.end() <= s for s, e in taken)]
        assert [(c.start, c.end) for c in pii.candidates(text) if c.kind == "phone" and not c.base] == free, text


def test_personal_data(spark, hostile, empty, sf):
    model = pii.fit(sf("documents"))
    found = pii.find(sf("documents"), model).collect()
    texts = {r.doc_id: r.text for r in sf("documents").collect()}
    assert all(sorted((s.kind, s.start, s.end) for s in r.found if s.base) == brute_spans(texts[r.doc_id]) for r in found)
    assert sum(len(r.found) for r in found) > sum(s.base for r in found for s in r.found)
    digest = {r.doc_id: r for r in pii.digest(pii.find(hostile, model)).collect()}
    assert digest[8].n_email == digest[8].n_phone == 1 and digest[8].spans == "email:9:24,phone:28:45"
    masked = {r.doc_id: r.text for r in pii.redact(hostile, model).collect()}
    assert masked[8] == "write to <EMAIL> or <PHONE> !" and masked[2] is None and masked[3] == ""
    assert pii.redact(hostile, model).columns == hostile.columns
    assert pii.fit(empty) == pii.SpanClassifier({}, 0.0) and pii.find(empty, model).count() == 0


def test_classifier_learns_to_reject_failed_checksums():
    good, bad = "pay 4111 1111 1111 1111 now", "pay 4111 1111 1111 1112 now"
    assert pii.candidates(good)[0].base and not pii.candidates(bad)[0].base


@pytest.mark.parametrize(("module", "label", "mod", "left_out"), [(quality, "quality", 5, 0), (toxicity, "toxic", 3, 1)])
def test_held_out_accuracy(spark, module, label, mod, left_out):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    rows = module.classify(read("documents"), read("labels")).collect()
    truth = {r.doc_id: r[label] for r in read("labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == left_out) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right / len(held) >= 0.95
    assert len(rows) == read("documents").count()


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_odd_inputs(spark, hostile, empty, module, label):
    one_class = spark.createDataFrame([(i, 1) for i in range(5)], f"doc_id long, {label} int")
    none = one_class.limit(0)
    for docs, labels in ((hostile, one_class), (hostile, none), (empty, one_class), (empty, none)):
        rows = module.classify(docs, labels).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    mixed = spark.createDataFrame([(i, i % 2) for i in range(1, 11)] + [(None, 1), (1, None), (10, 0)], f"doc_id long, {label} int")
    assert len(module.classify(hostile, mixed).collect()) == hostile.count()


def test_rules_are_paths_of_trees():
    lines = [
        "  If (feature 0 <= 1.5)", "   If (feature 1 > 2.0)", "    Predict: 0.0", "   Else (feature 1 <= 2.0)", "    Predict: 1.0",
        "  Else (feature 0 > 1.5)", "   Predict: 1.0",
    ]
    debug = "\n".join(lines)
    assert quality.tree_paths(debug, ["a", "b"]) == {
        (("a", False, 1.5),), (("a", False, 1.5), ("b", True, 2.0)), (("a", False, 1.5), ("b", False, 2.0)), (("a", True, 1.5),),
    }


def test_statistics_and_stems():
    assert quality.describe(None) == quality.describe("") == quality.describe(" \n") == [0.0] * len(quality.STATISTICS)
    assert toxicity.stems("Idiots, no") == {"idi", "idio", "idiot", "idiots"}
    assert Counter(toxicity.Lexicon({"idi": 1.0}).of(["idiot", "id", "other"])) == Counter([("idi", 1.0)])


def test_disguised_insults_are_found():
    known, none = frozenset(toxicity.INSULTS), toxicity.Lexicon({})
    at = toxicity.FEATURES.index("hidden_rate")
    for token in ("idi*t", "$tupid", "1diot", "st*pid", "i.d.i.o.t", "1d10t", "(m0r0n)", "l-o-s-e-r!", "i d i o t", "u9ly", "'tr@sh'", "STUP!D,"):
        found = toxicity.describe(f"Well, you are a {token} indeed.", none, known)
        assert found[at] > 0, token
    for text in ("It costs 5$ or 10.50 at 9-11.", "e.g. a well-known 3-day trip", "2 * 3 = 6 ** 2", "a b c of it", "mail a.b@c.de", "", None, "*** --- ..."):
        assert toxicity.describe(text, none, known)[at] == 0, text
    learned = toxicity.Lexicon({"blor": 3.0})
    assert toxicity.describe("such bl0rking", learned, known)[at] > 0
