"""The label model, the votes and the posterior against brute-force versions, and texts of several languages."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import toxicity
from marlstone.llm.toxicity import DENSITIES, LEVELS, Voter, Votes


def texts_of_two_languages(seed, n=900):
    """Words of one language are told apart by their beginning; each has bad beginnings of its own."""
    rng = random.Random(seed)
    ends = [f"{a}{b}" for a in "aeiou" for b in "klmnrst"]
    rows, labels = [], []
    for i in range(n):
        first = rng.choice(["b", "v"])
        words = [first + rng.choice(ends) + rng.choice(ends) for _ in range(rng.choice([20, 80, 200]))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice({"b": ["bzorki", "bxul"], "v": ["vqrumpo", "vgnarla"]}[first]) + rng.choice(ends))
        elif rng.random() < 0.1:
            words.append("bxul" + rng.choice(ends))  # a bad beginning stands in clean texts, too, but once
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def two(spark):
    rows, labels = texts_of_two_languages(1)
    return rows, labels, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_every_language_is_found(two):
    rows, labels, docs, known = two
    truth, text = dict(labels), dict(rows)
    model = toxicity.fit(docs, known)
    assert {v[:4] for v in model.voters if v.endswith("*")} >= {"bzor", "bxul", "vqru", "vgna"}
    for first in "bv":
        held = [(truth[r.doc_id], r.score >= 0.3) for r in toxicity.score(docs, model).where(toxicity.held_out("doc_id")).collect() if text[r.doc_id].startswith(first)]
        assert sum(y and p for y, p in held) >= 0.95 * sum(y for y, _ in held)
        assert sum(p and not y for y, p in held) <= 0.15 * sum(p for _, p in held)  # a bad word in a text of twenty


def test_voters_hold_no_names_inside_each_other(two):
    *_, docs, known = two
    names = [v.name for v in toxicity.choose_voters(docs, known).voters]
    for a in names:
        for b in names:
            assert a == b or not (b.endswith("*") and a.rstrip("*").startswith(b[:-1]))


def test_counts_of_voters_equal_brute_force(two):
    rows, labels, docs, known = two
    chosen = toxicity.choose_voters(docs, known)
    train = {r.doc_id for r in known.where(~toxicity.held_out("doc_id")).collect()}
    text, truth = dict(rows), dict(labels)
    assert (chosen.toxic, chosen.clean) == (sum(truth[i] for i in train), sum(1 - truth[i] for i in train))
    for v in chosen.voters[:6]:
        found = {i: sum(w.startswith(v.name[:-1]) and w != v.name[:-1] if v.name.endswith("*") else w == v.name for w in text[i].split()) for i in train}
        for kind, y in (("toxic", 1), ("clean", 0)):
            assert list(getattr(v, kind)) == [sum(found[i] > k for i in train if truth[i] == y) for k in range(LEVELS)]


def test_near_copies_of_a_toxic_text_count_once(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(40)] + [(100 + i, f"clean text number {i} of many") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = toxicity.choose_voters(docs, spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int"))
    assert chosen.toxic < 10 and chosen.clean > 100
    assert [v.name for v in chosen.voters] == list(toxicity.INSULTS)  # words of one text are no evidence


def test_votes_equal_brute_force():
    voters = ["idiot", "bom*", "x*", "réê*"]
    rows = [None, "", "Idiot! idiots bom bombo xx-xy", "réêa réê ré", "bombom " * 9]
    got = Votes(voters).levels(rows)
    for i, text in enumerate(rows):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        n = [sum(w.startswith(v[:-1]) if v.endswith("*") else w == v for w in words) for v in voters]
        assert got[i].tolist() == [*(min(x, LEVELS) for x in n), sum(n)]


def test_vote_moments_equal_brute_force(two):
    rows, _, docs, _ = two
    voters = ["bzorki*", "vqrumpo*", "bxul*"]
    n, both = toxicity.vote_moments(docs, voters)
    has = np.array([[any(w.startswith(v[:-1]) for w in t.split()) for v in voters] for _, t in rows], dtype=int)
    assert n == len(rows) and both.tolist() == (has.T @ has).tolist()


def test_label_model_recovers_rates():
    """From votes drawn by known rates, without any label, within the range that few labels leave open."""
    rng = np.random.default_rng(4)
    prior, on_toxic, on_clean = 0.2, np.array([0.6, 0.5, 0.4, 0.7, 0.3]), np.array([0.02, 0.05, 0.01, 0.03, 0.02])
    y = rng.random(200_000) < prior
    votes = rng.random((len(y), 5)) < np.where(y[:, None], on_toxic, on_clean)
    both = votes.T.astype(int) @ votes.astype(int)
    seen = np.stack([np.full(5, 3.0), np.full(5, 1.0)], axis=1)  # of a handful of labelled rows
    rates, pairs = toxicity.label_model(len(y), both, prior, seen, (6, 40))
    assert pairs == ()
    assert rates[:, 0] == pytest.approx(on_toxic, abs=0.02) and rates[:, 1] == pytest.approx(on_clean, abs=0.01)


def test_label_model_finds_the_correlated_pair_and_keeps_rates_of_lonely_voters():
    rng = np.random.default_rng(5)
    y = rng.random(100_000) < 0.2
    votes = rng.random((len(y), 6)) < np.where(y[:, None], 0.5, 0.05)
    votes[:, 5] = np.where(rng.random(len(y)) < 0.9, votes[:, 4], votes[:, 5])
    both = votes.T.astype(int) @ votes.astype(int)
    seen = np.stack([np.full(6, 50.0), np.full(6, 20.0)], axis=1)
    rates, pairs = toxicity.label_model(len(y), both, 0.2, seen, (100, 400))
    assert pairs == ((4, 5),) and rates == pytest.approx(np.array([[0.5, 0.05]] * 6), abs=0.03)
    alone = np.diag([500, 300])
    rates, _ = toxicity.label_model(10_000, alone, 0.2, np.array([[30.0, 1.0], [20.0, 2.0]]), (100, 400))
    assert rates == pytest.approx(np.array([[30.5 / 101, 1.5 / 401], [20.5 / 101, 2.5 / 401]]))


def test_weights_and_posterior_equal_brute_force():
    voters = [Voter("a*", (40, 40, 20, 5), (30, 2, 0, 0)), Voter("b", (10, 0, 0, 0), (0, 0, 0, 0)), Voter("c", (9, 4, 0, 0), (1, 0, 0, 0))]
    rates = np.array([[0.4, 0.03], [0.1, 0.001], [0.09, 0.002]])
    dense = np.array([[5.0, 1, 2, 8, 30, 4], [900.0, 40, 9, 3, 1, 0]])
    weights, by_density = toxicity.vote_weights(rates, voters), toxicity.density_weights(dense)
    levels, words = np.array([[0, 0, 0], [1, 0, 0], [3, 1, 0], [4, 0, 2], [0, 1, 1]]), np.array([50, 400, 90, 1000, 10])
    total = levels.sum(axis=1)
    odds = toxicity.log_odds(levels, weights, ((0, 1),)) + by_density[toxicity.density_level(total, words)]
    got = toxicity.posterior(odds, levels, 0.2, 0.05)
    for row, n, p in zip(levels, words, got, strict=True):
        if not row.any():
            assert p == pytest.approx(0.2 * 0.05 / (0.2 * 0.05 + 0.8))
            continue
        s = np.log(0.2 / 0.8)
        for i, k in enumerate(row):
            if k:
                just = [[(c[k - 1] - (c[k] if k < LEVELS else 0) + 1 / LEVELS) / (c[0] + 1)] for c in (voters[i].toxic, voters[i].clean)]
                w = np.log(rates[i, 0] / rates[i, 1] * just[0][0] / just[1][0])
                s += w / 1.5 if i < 2 and row[0] and row[1] else w
        at = sum(100 * row.sum() / n >= d for d in DENSITIES)
        s += np.log((dense[0, at] + 0.5) / (dense[0, 1:] + 0.5).sum()) - np.log((dense[1, at] + 0.5) / (dense[1, 1:] + 0.5).sum())
        assert p == pytest.approx(1 / (1 + np.exp(-s)))
    assert weights[0, 1] < 0 < weights[0, 3]  # once: as in clean texts


def test_nulls_repeated_ids_and_clashing_columns(spark, two):
    _, _, docs, known = two
    model = toxicity.fit(docs, known)
    rows = [(None, "bzorkiak bzorkial bzorkiam"), (None, None), (1, ""), (1, ""), (1, "bzorkiak bxulat bzorkiam"), (2, "word " * 100_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("kept") for c in ("toxic", "copy", "name", "x", "y", "votes", "dense", "Score2")}).withColumn("score", F.lit("gone"))
    got = toxicity.score(odd, model).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert all(r.copy == r.dense == "kept" and isinstance(r.score, float) for r in got)
    by = {(r.doc_id, r.text): r.score for r in got}
    assert by[None, None] == by[1, ""] < 0.3 <= min(by[rows[0]], by[rows[4]])
    kept = toxicity.without_toxic(odd, known).count()
    assert kept >= 4
    assert toxicity.fit(odd, known).voters  # training rows with null and repeated doc_ids
