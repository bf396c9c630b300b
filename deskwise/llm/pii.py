"""Personal data by weak supervision: labelers vote on spans, their reliabilities train a span classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskwise.llm.blocks import blocks
from deskwise.llm.weak_rules import ABSTAIN, BAD, GOOD, maximise

KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("pattern", "valid", "gazetteer", "context", "border", "layout")

# The base patterns (an email's local part is looked for backwards from its @).
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# What the labelers may add to the base.
LOCAL_PHONE = re.compile(r"(?<![\w+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?!\w)")
LOCAL_PHONE_END = re.compile(r"[0-9]{3}[ .-][0-9]{4}(?!\w)")  # every local phone ends so, whatever its separators
HIDDEN_AT = re.compile(r"[\[(] ?(?:at|@) ?[\])]", re.I)  # the local part is looked for backwards from it
HIDDEN_DOMAIN = re.compile(r" ?[A-Za-z0-9-]+(?: ?[\[(] ?(?:dot|\.) ?[\])] ?[A-Za-z0-9-]+)+", re.I)
SECRET = re.compile(r"\b([A-Za-z_]{2,24}) ?[=:] ?\"([^\"\s]{12,})\"")

CONTEXT = {
    "email": {"mail", "email", "contact", "write", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "from"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon"},
    "secret": {"token", "key", "secret", "password", "passwd", "apikey", "api_key", "access_token"},
}
AGAINST = {"version", "release", "chapter", "isbn", "section", "page", "figure", "table"}
DOMAINS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info"}
COUNTRIES = ("1", "7", "33", "34", "39", "41", "43", "44", "49", "52", "54", "55", "61", "81", "86", "91")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


@dataclass(frozen=True)
class Span:
    """A candidate: votes of the labelers and the features (``shape``) the classifier sees."""

    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, ...]
    shape: tuple[str, ...]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches: leftmost and not overlapping within a kind, in code points."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            out.append(("email", begin, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    for m in NUMBERS.finditer(text):
        parts, place = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", place, place + length))
            place += length + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _vote(yes: bool, no: bool = False) -> int:
    return GOOD if yes else BAD if no else ABSTAIN


def label(text: str, kind: str, start: int, end: int, base: bool) -> Span:
    """Let every labeler vote on one candidate."""
    body, digits = text[start:end], re.sub("[^0-9]", "", text[start:end])
    words = re.findall(r"\w+", text[max(0, start - 40) : start].lower())[-4:]
    near = _vote(any(w in CONTEXT[kind] for w in words), any(w in AGAINST for w in words))
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    if kind == "email":
        valid = _vote(body.count("@") == 1 and not body.startswith("."), body.count("@") > 1)
        known = _vote(re.split(r"[.\])]\s*", body.lower())[-1].strip() in DOMAINS)
        layout = _vote("@" in body, "@" not in body)
    elif kind == "ip":
        valid, known = GOOD, _vote(not body.startswith(("0.", "127.", "255.")), body.startswith("0."))
        layout = _vote(len(body) >= 9, len(body) <= 7)
    elif kind == "card":
        valid = _vote(luhn(digits), True)
        known = _vote(digits[0] in "3456", digits[0] in "0789")
        layout = _vote(len(digits) in (15, 16), len(digits) > 17)
    elif kind == "phone":
        valid = _vote(10 <= len(digits) <= 15, True)
        known = _vote(body.startswith("+") and digits.startswith(COUNTRIES))
        layout = _vote("(" in body or "-" in body, body.isdigit())
    else:
        bits = -sum(n / len(body) * math.log2(n / len(body)) for n in Counter(body).values())
        mixed = any(c.isdigit() for c in body) and any(c.isalpha() for c in body)
        valid = _vote(bits >= 3 and mixed, bits < 2.5)
        known = _vote(bool(words) and words[-1] in CONTEXT["secret"])
        layout = _vote(len(body) >= 20, body.isalpha())
    votes = (_vote(base or kind == "secret", not base), valid, known, near, _vote(not glued, glued), layout)
    size = str(min(4, (end - start) // 8))
    sign = "+" if body.startswith("+") else "@" if "@" in body else "#" if body.isdigit() else "-"
    shape = (kind, f"{kind}:size{size}", f"{kind}:{sign}", f"{kind}:valid{valid}", f"{kind}:known{known}", f"{kind}:near{near}", f"glued{int(glued)}")
    return Span(kind, start, end, base, votes, shape)


def candidates(text: str | None) -> list[Span]:
    """Base matches, and what else looks like personal data, with their votes; null and empty texts have none."""
    text = text or ""
    base = base_spans(text)
    spans = [label(text, *span, True) for span in base]
    taken = sorted((s, e) for _, s, e in base)

    def add(kind: str, start: int, end: int) -> None:
        k = _first_ending_after(taken, start)
        if k < len(taken) and taken[k][0] < end:
            return
        spans.append(label(text, kind, start, end, False))

    for m in CARD.finditer(text):
        if 15 <= len(re.sub("[^0-9]", "", m[0])) <= 16 if m.end() - m.start() >= 15 else False:
            add("card", *m.span())
    if LOCAL_PHONE_END.search(text):
        for m in LOCAL_PHONE.finditer(text):
            add("phone", *m.span())
    if "(" in text or "[" in text:
        for start, end in hidden_emails(text):
            add("email", start, end)
    if '"' in text:
        for m in SECRET.finditer(text):
            add("secret", *m.span(2))
    return spans


def hidden_emails(text: str) -> list[tuple[int, int]]:
    """Addresses with a bracketed at and dots, leftmost and not overlapping; every mark is tried, at any distance."""
    out, free = [], 0
    for m in HIDDEN_AT.finditer(text):
        begin = last = m.start() - (m.start() > free and text[m.start() - 1] == " ")
        while begin > free and (text[begin - 1] in LOCAL_CHARS or text[begin - 1] in "\u0130\u0131\u017f\u212a"):  # these four fold to letters
            begin -= 1
        domain = HIDDEN_DOMAIN.match(text, m.end()) if begin < last else None
        if domain:
            out.append((begin, domain.end()))
            free = domain.end()
    return out


def _first_ending_after(taken: list[tuple[int, int]], start: int) -> int:
    """First taken span that ends after ``start``; base spans of different kinds may overlap, so look a little back."""
    low, high = 0, len(taken)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if taken[mid][1] <= start else (low, mid)
    return low


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic regression over the shape of a span."""

    weights: dict[str, float]
    bias: float

    def accepts(self, span: Span) -> bool:
        return span.base or self.bias + sum(self.weights.get(f, 0.0) for f in span.shape) > 0


def fit(docs: DataFrame, text_col: str = "text", prior: float = 0.7, penalty: float = 1.0) -> SpanClassifier:
    """Reliabilities of the labelers by expectation-maximisation, then the classifier on their posteriors.

    All candidates of all documents count. Votes and shapes take few values, so they are counted by pattern
    on Spark, and only the patterns, a number that the votes and shapes bound, reach the driver.
    """
    schema = "votes array<int>, shape array<string>, n long"

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part in blocks(batch, "text"):
                for text in part.column("text").to_pylist():
                    seen.update((c.votes, c.shape) for c in candidates(text))
        names, rows = ["votes", "shape", "n"], [(list(v), list(s), n) for (v, s), n in seen.items()]
        columns = [pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([r[2] for r in rows], pa.int64())], names)

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(tally, schema).groupBy("votes", "shape").agg(F.sum("n").alias("n"))
    patterns = sorted((tuple(r["votes"]), tuple(r["shape"]), r["n"]) for r in counted.collect())
    start = {GOOD: {GOOD: 0.7, BAD: 0.05, ABSTAIN: 0.25}, BAD: {GOOD: 0.3, BAD: 0.4, ABSTAIN: 0.3}}
    model = maximise([(v, n) for v, _, n in patterns], list(LABELERS), start, prior)
    if not patterns:
        return SpanClassifier({}, 0.0)
    features = sorted({f for _, s, _ in patterns for f in s})
    place = {f: k for k, f in enumerate(features)}
    x = np.zeros((len(patterns), len(features) + 1))
    x[:, -1] = 1
    for k, (_, shape, _) in enumerate(patterns):
        x[k, [place[f] for f in shape]] = 1
    y = np.array([model.posterior(dict(zip(LABELERS, v, strict=True))) for v, _, _ in patterns])
    n = np.array([c for _, _, c in patterns], float)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + penalty * w
        curve = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.linalg.solve(curve, gradient)
    return SpanClassifier(dict(zip(features, w[:-1].tolist(), strict=True)), float(w[-1]))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])


def spans_of(text: str | None, model: SpanClassifier) -> list[tuple[str, int, int, bool]]:
    """Accepted spans by start, then kind as listed."""
    kept = [(c.start, KINDS.index(c.kind), c.end, c.base) for c in candidates(text) if model.accepts(c)]
    return [(KINDS[k], s, e, b) for s, k, e, b in sorted(kept)]


def find(docs: DataFrame, model: SpanClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found) for every row of ``docs``: spans (kind, start, end, base) in code points, end exclusive.

    Null and empty texts have none. Repeated rows are repeated, other columns ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("found", T.ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                found = [
                    [{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in spans_of(t, model)] for t in part.column("text").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], schema.names)

    return rows.mapInArrow(run, schema)


def redact(docs: DataFrame, model: SpanClassifier, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_col):
                masked = pa.array([mask(t, model) for t in part.column(text_col).to_pylist()], pa.string())
                columns = [masked if name == text_col else part.column(name) for name in part.schema.names]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def mask(text: str | None, model: SpanClassifier) -> str | None:
    """Overlapping spans are masked as one, under the kind of the first."""
    if not text:
        return text
    out, done = [], 0
    for kind, start, end, _ in spans_of(text, model):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


def digest(found: DataFrame) -> DataFrame:
    """The base counts and digest, and all spans as one string, of :func:`find`'s rows."""
    base = F.filter("found", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
