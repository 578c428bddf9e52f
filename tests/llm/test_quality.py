"""The quality classifier and the quality rules."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import BLANKS, documents, empty, texts
from tests.oracle import SF
from tidewell.llm import quality_classifier as classifier
from tidewell.llm import quality_rules as rules
from tidewell.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    folder = SF.replace("0.001", "0.01")
    labels = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect())
    rows = QUERIES["op3_quality_classifier"](spark, folder).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.95


def test_trees_follow_a_rule_and_walk_alike():
    r = np.random.default_rng(0)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = classifier.fit(x, y)
    assert np.mean((forest.score(x) > 0.5) == y) > 0.97
    one = x[7]
    raw = forest.base
    for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
        at = 0
        while at < len(f):
            at = 2 * at + 1 + int(one[f[at]] > t[at])
        raw += leaf[at - len(f)]
    assert abs(1 / (1 + np.exp(-raw)) - forest.score(x[7:8])[0]) < 1e-9


def test_classifier_edges(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = classifier.score(docs, none).collect()
    assert len(scores) == docs.count() and {r["score"] for r in scores} == {0.5}
    odd = spark.createDataFrame([(i, i % 3 if i != 4 else None, 0) for i in [*range(8), 3, 3]], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in classifier.score(docs, odd).collect())
    assert classifier.score(empty(spark), odd).collect() == []


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.strip(BLANKS)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(spark):
    rows = rules.judge(documents(spark)).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts()) + 2
    for i, t in enumerate(texts()):
        assert tuple(by_id[i])[1:7] == brute(t), i
        assert not (by_id[i]["base_failed"] and by_id[i]["kept"]) and 0 <= by_id[i]["posterior"] <= 1
    assert rules.judge(empty(spark)).collect() == []


def by_definition(votes, n_rules):
    """The estimate document by document and with products of probabilities: no patterns, no logarithms."""
    good, on_good, on_bad = rules.PRIOR_GOOD, [rules.PRIOR_AGAINST_GOOD] * n_rules, [rules.PRIOR_AGAINST_BAD] * n_rules
    k = rules.PRIOR_VOTES
    posterior = []
    for _ in range(rules.ROUNDS):
        posterior = []
        for row in votes:
            a, b = good, 1 - good
            for r, v in enumerate(row):
                if v == -1:
                    a, b = a * on_good[r], b * on_bad[r]
                elif v == 1:
                    a, b = a * (1 - on_good[r]), b * (1 - on_bad[r])
            posterior.append(a / (a + b))
        old = (good, *on_good, *on_bad)
        good = (sum(posterior) + rules.PRIOR_GOOD * k) / (len(votes) + k)
        for r in range(n_rules):
            for of, prior, share in ((on_good, rules.PRIOR_AGAINST_GOOD, posterior), (on_bad, rules.PRIOR_AGAINST_BAD, [1 - p for p in posterior])):
                cast = sum(p for p, row in zip(share, votes, strict=True) if row[r])
                against = sum(p for p, row in zip(share, votes, strict=True) if row[r] == -1)
                of[r] = (against + prior * k) / (cast + k)
        if max(abs(x - y) for x, y in zip(old, (good, *on_good, *on_bad), strict=True)) < rules.SETTLED:
            break
    return good, on_good, on_bad


def test_verdicts_are_those_of_a_pass_over_documents(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    featured = docs.select("doc_id", rules.features(docs["text"]).alias("f"))
    rows = featured.select("doc_id", rules.base_failed("f").alias("failed"), *(rules.vote(v, "f").alias(v.name) for v in rules.VOTERS)).collect()
    votes = {r[0]: tuple(r[2:]) for r in rows if not r["failed"]}
    good, on_good, on_bad = by_definition(list(votes.values()), len(rules.VOTERS))
    judged = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    kept_with_one_against = 0
    for r in rows:
        a, b = good, 1 - good
        for v, x, y in zip(r[2:], on_good, on_bad, strict=True):
            a, b = (a * x, b * y) if v < 0 else (a * (1 - x), b * (1 - y)) if v else (a, b)
        assert abs(judged[r["doc_id"]]["posterior"] - a / (a + b)) < 1e-4
        assert judged[r["doc_id"]]["kept"] == (not r["failed"] and a / (a + b) >= 0.5)
        kept_with_one_against += judged[r["doc_id"]]["kept"] and min(r[2:]) < 0
    # The verdict is not that all rules must pass.
    assert kept_with_one_against > 0


def test_known_accuracies_are_recovered():
    for seed, share in ((1, 0.9), (2, 0.8), (3, 0.6), (4, 0.8)):
        r = np.random.default_rng(seed)
        n, k = 20_000, 8
        on_good, on_bad = r.uniform(0.02, 0.1, k), r.uniform(0.5, 0.9, k)
        good = r.random(n) < share
        against = r.random((n, k)) < np.where(good[:, None], on_good, on_bad)
        votes = np.where(r.random((n, k)) < 0.2, 0, np.where(against, -1, 1))
        found = rules.estimate(sorted(Counter(map(tuple, votes.tolist())).items()), k)
        assert abs(found.good - good.mean()) < 0.02
        assert np.abs(np.array(found.against_good) - on_good).max() < 0.02
        assert np.abs(np.array(found.against_bad) - on_bad).max() < 0.04, (seed, found.against_bad, on_bad)
        # Votes for outweigh one against.
        weights = found.model().weights
        odds = found.model().prior + weights[0][0] + sum(by for _, by in weights[1:])
        assert odds > 0


def test_prior_vanishes_as_documents_grow():
    votes = [((1, 1, -1), 30), ((-1, -1, 1), 20), ((1, 1, 1), 50)]
    few, many = rules.estimate(votes, 3), rules.estimate([(v, 10_000 * n) for v, n in votes], 3)
    assert abs(many.against_bad[0] - 1) < 1e-3 and abs(many.good - 0.8) < 0.05
    assert abs(few.against_bad[0] - rules.PRIOR_AGAINST_BAD) < abs(many.against_bad[0] - rules.PRIOR_AGAINST_BAD)
    assert rules.estimate([], 3).good == rules.PRIOR_GOOD


def test_main_path_is_without_python_and_features_are_counted_once(spark):
    docs = documents(spark)
    for made in (rules.judge(docs), rules.keep(docs)):
        plan = made._jdf.queryExecution().toString()
        assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
        assert "xxhash64" not in plan and "FileScan parquet" in plan
    plan = docs.select(rules.features(docs["text"]).alias("f"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_hashes_of_function_words(spark):
    told = spark.createDataFrame([(w,) for w in rules.FUNCTION_WORDS], "w string").select(F.xxhash64("w")).collect()
    assert [r[0] for r in told] == rules.FUNCTION_HASHES


def test_very_long_texts_are_counted_whole(spark):
    long = ["one two three four five " * 100_000, "x" * 2_000_000, "a b\n" * 200_000, ("Ünïcode wörds! " * 60_000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "doc_id long, text string")
    found = {r["doc_id"]: tuple(r)[1:7] for r in rules.judge(docs).collect()}
    assert found == {i: brute(t) for i, t in enumerate(long)}


def test_junk_goes_and_clean_stays(spark):
    folder = SF.replace("0.001", "0.01")
    labels = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect())
    rows = [r for r in rules.judge(spark.read.parquet(f"{folder}/documents.parquet")).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good = [r["kept"] for r in rows if labels[r["doc_id"]] == 1]
    bad = [r["kept"] for r in rows if labels[r["doc_id"]] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def test_keep_has_the_columns_of_its_input(spark):
    docs = documents(spark)
    docs = docs.withColumns({"_f": F.lit(1), "_F_": F.lit(2), "f": F.lit(3), "votes": F.lit("x")})
    kept = rules.keep(docs)
    assert kept.columns == docs.columns
    assert rules.keep(empty(spark)).collect() == []
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rules.judge(docs).where("kept").collect()}
