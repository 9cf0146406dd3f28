"""Scores and verdicts: held-out accuracy, plain versions, odd rows."""

import random
import re
import zlib

import numpy as np
import pytest

from quadlab.llm import additive_model, labelled, quality_model, quality_rules, toxicity
from quadlab.llm.shingles import WordHashes
from quadlab.llm.text_stats import FEATURES, base_counts, features

SF = "/root/testdata/sf0.01"


def auc(score, y):
    score, y = np.asarray(score), np.asarray(y)
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1.0
    for v in np.unique(score):
        order[score == v] = order[score == v].mean()
    pos = y.sum()
    return (order[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "a b c a b c a", "é\x1c x y", "# * $\n# * $\n\n# * $ ", "x\r\nx\r\n", "🙂 🙂 🙂 🙂", "a " * 5000])
def test_base_counts(text):
    with np.errstate(over="ignore"):
        c = base_counts(text, WordHashes())
        assert len(features(text, WordHashes())) == len(FEATURES)
    assert tuple(c[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_counts(text)


def test_accuracies_find_good_and_useless_rules():
    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.7
    votes = np.stack([np.where(rng.random(20000) < 0.2, 0, np.where(rng.random(20000) < a, 2 * y - 1, 1 - 2 * y)) for a in (0.9, 0.85, 0.8, 0.95, 0.5)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, right = quality_rules.accuracies(patterns, counts.astype(float))
    assert abs(share - 0.7) < 0.1 and right[3].min() > right[2].max() - 0.02 and right[4].sum() < 1.2


def test_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        n = plain_counts(texts[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.kept and r.base_failed)
    long = [i for i in labels if not got[i].base_failed]
    assert np.mean([got[i].kept for i in long if labels[i]]) > 0.98 and np.mean([got[i].kept for i in long if not labels[i]]) < 0.1
    left = quality_rules.good_documents(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if r.kept}


def test_verdicts_of_odd_rows(spark):
    good = " ".join(f"word{i} the" for i in range(200)) + "."
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, good, 1), (3, good, 1), (3, good, 1)], "doc_id long, text string, votes int")
    got = sorted(((r.doc_id, r.n_words, r.base_failed) for r in quality_rules.judged(docs).collect()), key=str)
    assert got[-1] == (None, 400, False) and [g[:2] for g in got[:-1]] == [(1, 0), (2, 0), (3, 400), (3, 400)]
    assert quality_rules.judged(docs.limit(0)).count() == 0 and quality_rules.good_documents(docs).columns == docs.columns


def test_texts_are_not_shuffled_for_verdicts(spark):
    good = " ".join(f"word{i} the" for i in range(200)) + "."
    docs = spark.createDataFrame([(1, None, [1], 1), (None, good, None, 2), (3, good, [2, None], 3), (3, good, [2, None], 3), (3, "bad", [3], 4)],
                                 "doc_id long, text string, __r array<int>, votes int")
    left = quality_rules.good_documents(docs)
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(None, good, None, 2), (3, good, [2, None], 3), (3, good, [2, None], 3)], key=str)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_additive_model_learns_shapes_and_pairs():
    rng = np.random.default_rng(3)
    x = rng.random((6000, 5))
    z = 3 * np.sin(6 * x[:, 0]) + np.where((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5), 2.0, -2.0)
    y = (rng.random(6000) < 1 / (1 + np.exp(-z))).astype(int)
    m = additive_model.fit(x[:4000], y[:4000])
    assert (1, 2) in [(i, j) for i, j, _ in m.pairs]
    assert auc(m.score(x[4000:]), y[4000:]) > auc(z[4000:], y[4000:]) - 0.02
    assert (additive_model.fit(np.zeros((0, 3)), np.zeros(0)).score(x[:3, :3]) == 0.5).all()
    assert np.isfinite(m.score(np.full((2, 5), np.nan))).all()


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality_model.scored(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(got) == docs.count() and auc(*zip(*held)) > 0.97


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(got) == docs.count() and auc(*zip(*held)) > 0.8


def test_toxicity_locates_sentences():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    docs, y = [], []
    for i in range(800):
        s = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(6)]
        bad = i % 4 == 0
        if bad:
            s[rng.randrange(6)] += " " + rng.choice(["vile", "awful"])
        docs.append(". ".join(s) + ".")
        y.append(int(bad))
    features_ = toxicity.WordFeatures()
    model = toxicity.fit([toxicity.encoded(t, features_) for t in docs[:600]], np.array(y[:600]))
    scores = toxicity.WordScores(model.weights)
    for t, label in zip(docs[600:], y[600:]):
        p, worst = model.document(t, scores)
        assert (p >= 0.5) == bool(label)
        assert not label or any("vile" in t[a:b] or "awful" in t[a:b] for a, b, _ in worst)
    assert model.document("", scores) == (0.0, []) and model.document(None, scores)[0] == 0.0


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a fine text. vile"), (1, "a fine text. vile"), (2, None), (3, ""), (None, "x " * 50000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, None), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for f in (quality_model.scored, toxicity.scored):
        rows = f(docs, labels).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [False]
        assert len(f(docs, labels.limit(0)).collect()) == 5 and f(docs.limit(0), labels).count() == 0


def test_sample_is_bounded_and_usable(spark):
    rows = spark.range(500).selectExpr("id as doc_id")
    labels = spark.range(500).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    got = labelled.sample(rows, labels, "quality", labelled.remainder(3) != 1, 50).collect()
    assert len(got) == 50 and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.y == r.doc_id % 2 for r in got)
