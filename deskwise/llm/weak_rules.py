"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs their votes."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskwise.llm.blocks import SPACE, text_or_empty
from deskwise.session import materialize

GOOD, BAD, ABSTAIN = 1, 0, -1


@dataclass(frozen=True)
class VoteModel:
    """Prior of a good document and, by rule and class, the probability of each vote.

    With ``one_sided`` an abstention is no evidence and a vote never counts against what it says, which is for labelers
    that abstain nearly always; without, the posterior is that of the model.
    """

    prior: float
    rates: dict[str, dict[int, dict[int, float]]]
    one_sided: bool = False

    def log_odds(self, rule: str, vote: int) -> float:
        """Evidence of one vote for a good document."""
        odds = math.log(self.rates[rule][GOOD][vote] / self.rates[rule][BAD][vote])
        if not self.one_sided:
            return odds
        return max(odds, 0.0) if vote == GOOD else min(odds, 0.0) if vote == BAD else 0.0

    def posterior(self, votes: Mapping[str, int]) -> float:
        odds = math.log(self.prior / (1 - self.prior)) + sum(self.log_odds(r, v) for r, v in votes.items())
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))

    def log_likelihood(self, votes: Mapping[str, int]) -> float:
        good, bad = (math.log(p) + sum(math.log(self.rates[r][k][v]) for r, v in votes.items()) for k, p in ((GOOD, self.prior), (BAD, 1 - self.prior)))
        return max(good, bad) + math.log1p(math.exp(-abs(good - bad)))


def repeated_words(words: Column, n: int = 8) -> Column:
    """Words inside n-word windows that occur twice or more in the same text, each word once.

    Windows are compared by 64-bit hash. Most texts repeat none, which one hash set shows; only the
    others sort their windows, keep the places whose window has an equal neighbour and add up the
    stretches they cover. No quadratic step, whatever the text.
    """
    grams = _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda hashes: F.when(
            F.size(hashes) >= n,
            F.transform(F.sequence(F.lit(1), F.size(hashes) - (n - 1)), lambda i: F.xxhash64(F.slice(hashes, i, n))),
        ).otherwise(F.array().cast("array<bigint>")),
    )

    def covered(found: Column) -> Column:
        places = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spread(at: Column) -> Column:
            same = lambda i, j: F.get(at, i)["h"] == F.get(at, j)["h"]
            kept = F.filter(at, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            return F.array_sort(F.transform(kept, lambda x: x["i"]))

        def total(starts: Column) -> Column:
            gaps = F.transform(starts, lambda s, i: F.least(F.lit(n), F.coalesce(F.get(starts, i + 1) - s, F.lit(n))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

        return _let(_let(places, spread), total)

    return _let(
        grams,
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)),
    )


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one column per statistic; columns of the same names are replaced.

    Words are what white space (space, tab to carriage return) leaves; a null text has none.
    """
    text = text_or_empty(text_col)
    out = docs.withColumn("_text", text)
    out = out.withColumn("_words", F.filter(F.split("_text", f"{SPACE}+"), lambda w: w != ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    letters = F.regexp_replace("_text", "[^A-Za-z]+", "")
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.regexp_replace("_text", f"{SPACE}+", "")).cast("long"),
            "n_symbols": F.char_length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")),
            "n_distinct_words": F.size(F.array_distinct("_words")).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_letters": F.char_length(letters).cast("long"),
            "n_capitals": F.char_length(F.regexp_replace(letters, "[a-z]+", "")).cast("long"),
            "n_marks": F.regexp_count("_text", F.lit("[#*$%&|<>!]+")).cast("long"),
            "n_stops": F.char_length(F.regexp_replace("_text", "[^.,;:?]+", "")).cast("long"),
        }
    )
    return out.drop("_text", "_words")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN))


def rules() -> dict[str, Column]:
    """The rules over :func:`statistics`: a clear fault votes bad, a clearly usual value good, the rest abstains."""
    c, some = F.col, F.greatest(F.col("n_words"), F.lit(1))
    per_word = c("word_chars") / some
    symbols, repeats = c("n_symbols") / some, c("n_repeat_words") / some
    dup_lines = c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1))
    capitals = c("n_capitals") / F.greatest(c("n_letters"), F.lit(1))
    distinct, marks = c("n_distinct_words") / F.sqrt(some), c("n_marks") / some
    stops = c("n_stops") / some
    return {
        "symbols": _vote(symbols > 0.25, symbols < 0.1),
        "marks": _vote(marks > 0.3, marks < 0.1),
        "repeats": _vote(repeats > 0.3, repeats < 0.05),
        "lines": _vote(dup_lines > 0.5, (dup_lines < 0.1) & (c("n_lines") > 2)),
        "capitals": _vote((capitals > 0.5) & (c("n_letters") > 20), capitals < 0.2),
        "variety": _vote((c("n_distinct_words") < 0.3 * some) & (distinct < 4), c("n_distinct_words") > 0.5 * some),
        "length": _vote(c("n_words") < 20, c("n_words") >= 50),
        "words": _vote((per_word < 2) | (per_word > 15), per_word.between(3, 10)),
        "stops": _vote((stops > 1) | ((stops < 0.005) & (c("n_words") >= 50)), stops.between(0.03, 0.5)),
    }


def fit_votes(votes: DataFrame, names: list[str], rounds: int = 500, prior: float = 0.9) -> VoteModel:
    """Accuracies of the rules from their votes alone, by expectation-maximisation with two classes.

    The votes are counted by pattern on Spark, over all rows; at most ``3 ** rules`` pattern counts reach the
    driver, whatever the number of rows. The start says that rules are right rather than wrong; counts are
    smoothed by one, so that no vote is ever certain. An empty table leaves the start as it is.
    """
    counts = [(tuple(r[:-1]), r[-1]) for r in votes.groupBy(*names).count().collect()]
    start = {GOOD: {GOOD: 0.85, BAD: 0.005, ABSTAIN: 0.145}, BAD: {GOOD: 0.6, BAD: 0.3, ABSTAIN: 0.1}}
    return maximise(counts, names, start, prior, rounds, one_sided=False)


def maximise(
    counts: list[tuple[tuple, int]], names: list[str], start: dict[int, dict[int, float]], prior: float, rounds: int = 50,
    one_sided: bool = True, tolerance: float = 1e-9,
) -> VoteModel:
    """Expectation-maximisation over counted vote patterns; ``start`` has the first rates of every rule by class and vote.

    It ends when the log likelihood changes by less than a ``tolerance``-th part, or after ``rounds``. Likelihood says nothing of
    a ``one_sided`` model, whose posterior is another; that takes all rounds.
    """
    model, before = VoteModel(prior, {n: {k: dict(v) for k, v in start.items()} for n in names}, one_sided), None
    for _ in range(rounds if counts else 0):
        seen = {n: {GOOD: dict.fromkeys((GOOD, BAD, ABSTAIN), 1.0), BAD: dict.fromkeys((GOOD, BAD, ABSTAIN), 1.0)} for n in names}
        good = bad = 1.0
        likelihood = 0.0
        for pattern, rows in counts:
            votes = dict(zip(names, pattern, strict=True))
            p = model.posterior(votes)
            likelihood += rows * model.log_likelihood(votes)
            good, bad = good + p * rows, bad + (1 - p) * rows
            for n, v in votes.items():
                seen[n][GOOD][v] += p * rows
                seen[n][BAD][v] += (1 - p) * rows
        if not one_sided and before is not None and abs(likelihood - before) <= tolerance * abs(likelihood):
            break
        before = likelihood
        rates = {n: {k: {v: x / sum(by.values()) for v, x in by.items()} for k, by in seen[n].items()} for n in names}
        model = VoteModel(good / (good + bad), rates, one_sided)
    return model


def posterior(model: VoteModel) -> Column:
    """Probability that a document is good, as a column over the vote columns."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for rule in model.rates:
        vote = F.col(rule)
        score = F.when(vote == GOOD, model.log_odds(rule, GOOD)).when(vote == BAD, model.log_odds(rule, BAD))
        odds = odds + score.otherwise(model.log_odds(rule, ABSTAIN))
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: statistics, the base filter, the posterior of the votes and what is kept.

    A row is kept if the base filter does not fail it (under 20 words, or over 30 % of its words in repeated
    8-word windows) and its posterior reaches ``threshold``. Null and empty texts have no words and
    fail the base filter. Repeated rows are judged alike; an empty table gives no rows.
    """
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    votes = rules()
    table = statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    table = materialize(table.drop("text"), "votes").select("doc_id", *shown, base_failed.alias("base_failed"), *(v.alias(n) for n, v in votes.items()))
    model = fit_votes(table.select(*votes), list(votes))
    table = table.withColumn("probability", posterior(model))
    return table.select("doc_id", *shown, "base_failed", (~F.col("base_failed") & (F.col("probability") >= threshold)).alias("kept"), "probability", *votes)
