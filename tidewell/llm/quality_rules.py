"""Quality rules by weak supervision, with DataFrame functions alone.

Each rule votes for a document (1), against it (-1) or abstains (0).
Expectation-maximisation over the counts of vote patterns, of which there are at
most three to the power of the number of rules, estimates how often each rule is
right and how common good documents are. A document's posterior probability of
being good replaces the demand that it pass all rules: some rules are noisy on
purpose, and votes for a document can outweigh one against it.

Two base rules reject by themselves. The estimate is made on the documents that
they leave open, as those alone need a verdict.

Null texts have no words. A document with fewer words than the base rules ask
for fails, whatever its posterior. Repeated rows are judged each, and equal texts
alike. Texts of any length are judged whole. An empty table gives no rows. Other
columns of the input, whatever their names, play no part.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import BLANK_CLASS, BLANKS, let, materialise

#: Base rules: fewest words, and most repeated words in a hundred.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A document is kept from this posterior on.
KEEP = 0.5
#: Before any document is seen: the share of votes against among a rule's votes on good and on bad documents,
#: the share of good documents, and the number of documents that these beliefs weigh as much as, however many there are.
PRIOR_AGAINST_GOOD, PRIOR_AGAINST_BAD = 0.02, 0.4
PRIOR_GOOD, PRIOR_VOTES = 0.8, 50.0
#: The estimate ends when no share changes by more than this, or after so many rounds.
SETTLED, ROUNDS = 1e-7, 500


class Voter(NamedTuple):
    """On a ratio of features: for a document up to ``good``, against it from ``bad`` on, abstaining
    between. Where ``good`` is the larger, high ratios are the good ones."""

    name: str
    over: str
    below: str
    good: float
    bad: float


#: The last three are noisy: languages without these words, lists and long texts get votes against.
VOTERS = [
    Voter("symbols", "n_symbols", "n_words", 0.02, 0.1),
    Voter("repeats", "n_repeat_words", "n_words", 0.1, 0.3),
    Voter("lines", "n_dup_lines", "n_lines", 0.05, 0.3),
    Voter("capitals", "n_capitals", "word_chars", 0.15, 0.4),
    Voter("shouts", "n_shouts", "n_words", 0.01, 0.1),
    Voter("digits", "n_digits", "word_chars", 0.1, 0.3),
    Voter("lengths", "word_chars", "n_words", 8.0, 10.0),
    Voter("functions", "n_functions", "n_words", 0.1, 0.02),
    Voter("distinct", "n_distinct", "n_words", 0.5, 0.25),
    Voter("ends", "n_ends", "n_words", 0.04, 0.01),
]

#: Words that hold sentences together, of four languages.
FUNCTION_WORDS = (
    "the of and to in is it that was for as with are on by this from "
    "der die das und zu den von mit für im ein eine ist auf "
    "le la les de des du et que est dans pour par un une qui "
    "el los las y en con por una del se es"
).split()

#: Their hashes as Spark makes them, so that words are told by one look into a set.
FUNCTION_HASHES = [h - (1 << 64) if (h := xxhash.xxh64_intdigest(w, 42)) >> 63 else h for w in FUNCTION_WORDS]


def windows(hashes: Column) -> Column:
    """The hashes of the three-word windows, from those of the words, of which there are three at least."""
    return F.transform(
        F.sequence(F.lit(0), F.size(hashes) - 3),
        lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)),
    )


def places(found: Column) -> Column:
    """The words in windows that are there twice or more."""
    twice = let(
        F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        lambda s: F.filter(
            s,
            lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
        ),
    )
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def covered(hashes: Column) -> Column:
    """Words in three-word windows that the text has twice or more. Most texts have none, which their distinct windows tell."""
    some = let(windows(hashes), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(places(w)))
    return F.when(F.size(hashes) < 4, F.lit(0)).otherwise(some)


def features(text: Column) -> Column:
    """A struct of the counts that rules look at."""
    whole = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(whole, F.lit(pattern)).cast("long")
    words = F.filter(F.split(whole, f"[{BLANK_CLASS}]+", -1), lambda w: w != "")
    full = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    of_words = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.struct(
            F.size(h).alias("n"),
            covered(h).alias("r"),
            F.size(F.array_distinct(h)).alias("d"),
            F.size(F.filter(h, lambda x: x.isin(FUNCTION_HASHES))).alias("f"),
        ),
    )
    of_lines = let(full, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda x: F.struct(
            x["w"]["n"].cast("long").alias("n_words"),
            (F.char_length(whole) - count(f"[{BLANK_CLASS}]")).cast("long").alias("word_chars"),
            count(r"[#*$%&|<>]").alias("n_symbols"),
            (x["l"]["n"] - x["l"]["d"]).cast("long").alias("n_dup_lines"),
            x["w"]["r"].cast("long").alias("n_repeat_words"),
            x["l"]["n"].cast("long").alias("n_lines"),
            count(r"\p{Lu}").alias("n_capitals"),
            count(r"[!?]{2,}").alias("n_shouts"),
            count(r"[0-9]").alias("n_digits"),
            x["w"]["f"].cast("long").alias("n_functions"),
            x["w"]["d"].cast("long").alias("n_distinct"),
            count(f"[.!?](?![^{BLANK_CLASS}])").alias("n_ends"),
        ),
    )


def vote(voter: Voter, of: str) -> Column:
    over, below = F.col(f"{of}.{voter.over}"), F.col(f"{of}.{voter.below}")
    ratio = over / F.greatest(below, F.lit(1))
    sign = 1 if voter.good < voter.bad else -1
    return F.when(sign * ratio >= sign * voter.bad, -1).when(sign * ratio <= sign * voter.good, 1).otherwise(0).cast("int")


class Model(NamedTuple):
    """Log odds of a good document before any vote, and for each rule what a vote against and a vote for add."""

    prior: float
    weights: list[tuple[float, float]]

    def posterior(self, votes: list[Column]) -> Column:
        odds = F.lit(self.prior)
        for v, (against, by) in zip(votes, self.weights, strict=True):
            odds = odds + F.when(v < 0, against).when(v > 0, by).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


class Shares(NamedTuple):
    """What is estimated: the share of good documents, and of each rule's votes on good and on bad ones those against."""

    good: float
    against_good: list[float]
    against_bad: list[float]

    def model(self) -> Model:
        pairs = zip(self.against_good, self.against_bad, strict=True)
        weights = [(math.log(g / b), math.log((1 - g) / (1 - b))) for g, b in pairs]
        return Model(math.log(self.good / (1 - self.good)), weights)


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_voters: int) -> Shares:
    """Expectation-maximisation over (votes, number of documents).

    A rule's accuracy is how many of its votes on good documents, and how many on
    bad ones, are against. A rule that abstains says nothing. The prior says which of the two classes is
    the good one and counts as much as a few documents; it vanishes as documents grow.
    """
    now = Shares(PRIOR_GOOD, [PRIOR_AGAINST_GOOD] * n_voters, [PRIOR_AGAINST_BAD] * n_voters)
    cast = [([r for r, v in enumerate(votes) if v], [r for r, v in enumerate(votes) if v < 0], n) for votes, n in patterns]
    whole = sum(n for _, n in patterns) + PRIOR_VOTES
    for _ in range(ROUNDS):
        model = now.model()
        by = [w for _, w in model.weights]
        more = [a - b for a, b in model.weights]
        good = PRIOR_GOOD * PRIOR_VOTES
        votes_good, votes_bad = [PRIOR_VOTES] * n_voters, [PRIOR_VOTES] * n_voters
        hits_good, hits_bad = [PRIOR_AGAINST_GOOD * PRIOR_VOTES] * n_voters, [PRIOR_AGAINST_BAD * PRIOR_VOTES] * n_voters
        for voting, against, n in cast:
            odds = model.prior + sum(by[r] for r in voting) + sum(more[r] for r in against)
            mass = n / (1 + math.exp(-odds)) if odds > -700 else 0.0
            good += mass
            for r in voting:
                votes_good[r] += mass
                votes_bad[r] += n - mass
            for r in against:
                hits_good[r] += mass
                hits_bad[r] += n - mass
        share = lambda hits, votes: [h / v for h, v in zip(hits, votes, strict=True)]
        before, now = now, Shares(good / whole, share(hits_good, votes_good), share(hits_bad, votes_bad))
        pairs = zip((before.good, *before.against_good, *before.against_bad), (now.good, *now.against_good, *now.against_bad), strict=True)
        if max(abs(a - b) for a, b in pairs) < SETTLED:
            break
    return now


def fitted(featured: DataFrame, of: str) -> Model:
    """The model of the documents that the base rules leave open, from one row for each pattern of votes."""
    names = [v.name for v in VOTERS]
    votes = featured.where(~base_failed(of)).select(*(vote(v, of).alias(v.name) for v in VOTERS))
    found = votes.groupBy(*names).count().collect()
    return estimate(sorted((tuple(r[:-1]), r[-1]) for r in found), len(VOTERS)).model()


def base_failed(of: str) -> Column:
    words, repeated = F.col(f"{of}.n_words"), F.col(f"{of}.n_repeat_words")
    return (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)


def verdict(model: Model, of: str) -> tuple[Column, Column]:
    posterior = model.posterior([vote(v, of) for v in VOTERS])
    return posterior, ~base_failed(of) & (posterior >= KEEP)


def judge(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the base counts, base_failed, kept, posterior."""
    slim = docs.select(F.col("doc_id").cast("long"), features(F.col("text")).alias("f"))
    featured = materialise(slim, "features")
    posterior, kept = verdict(fitted(featured, "f"), "f")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return featured.select(
        "doc_id",
        *(F.col(f"f.{c}").alias(c) for c in counts),
        base_failed("f").alias("base_failed"),
        kept.alias("kept"),
        posterior.alias("posterior"),
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Features are computed once, and stored beside the rows."""
    of = "_f"
    while of in map(str.lower, docs.columns):
        of += "_"
    featured = materialise(docs.withColumn(of, features(F.col("text"))), "featured")
    _, kept = verdict(fitted(featured, of), of)
    return featured.where(kept).select(docs.columns)
