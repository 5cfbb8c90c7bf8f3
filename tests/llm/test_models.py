"""Language, toxicity and quality: held-out accuracy, plain re-computations and edge cases."""

import zlib

import numpy as np
import pytest

from netsift.llm import language, queries, quality, toxicity
from netsift.llm.common import score

from .helpers import DATA, held

SF = DATA.replace("0.001", "0.01")
EDGE = [(-1, None), (-2, ""), (-3, "  \n 12 %% "), (-4, "The " * 30_000), (-5, "ж" * 50)]


@pytest.fixture(scope="module")
def truth(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return docs, labels


def edge_frame(spark, **extra):
    return spark.createDataFrame([(i, t, "clash", 0.25) for i, t in EDGE], "doc_id long, text string, lang_pred string, score double")


def plain_viterbi(scores, penalty):
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        top = best.argmax()
        switch = best < best[top] - penalty
        back.append(np.where(switch, top, np.arange(len(best))))
        best = np.where(switch, best[top] - penalty, best) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_language_paths_equal_plain_viterbi():
    rng = np.random.default_rng(1)
    model = language.Model(["a", "b", "c"], np.zeros((4, 8, 3), np.float32), np.ones((20, 3), bool), penalty=3.0)
    counts = np.array([5, 0, 1, 17, 4])
    word = rng.integers(0, 9, counts.sum())
    scores = rng.normal(0, 3, (9, 3)).astype(np.float32)
    got = model.paths(scores, word, counts)
    at = 0
    for n in counts:
        if n:
            assert got[at : at + n].tolist() == plain_viterbi(scores[word[at : at + n]], 3.0)
        at += n


def test_language_of_held_out_rows_and_mixed_texts(spark, truth):
    docs, _ = truth
    found = queries.QUERIES["op10_language"](spark, SF).collect()
    assert len(found) == len(docs) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in found)
    out = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in out]) > 0.97
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    by_lang = {d.lang: d.text for d in docs.values() if len(d.text) > 2000 and "|" not in d.text and "!!" not in d.text}
    mixed = " ".join(by_lang["en"].split()[:60]) + " " + " ".join(by_lang["de"].split()[:30])
    row = model.label([mixed]).iloc[0]
    assert row.lang_pred == "en" and list(row.span_langs) == ["en", "de"] and abs(row.span_words[0] - 60) <= 3


def test_language_edge_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    got = {r.doc_id: r for r in language.identify(edge_frame(spark), language.fit(docs)).collect()}
    assert [got[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and [got[i].score for i in (-1, -2, -3)] == [0.0] * 3
    assert got[-4].lang_pred == "en" and got[-5].lang_pred != "und"
    none = language.fit(docs.where("false"))
    assert {r.lang_pred for r in language.identify(edge_frame(spark), none).collect()} == {"und"}
    assert language.identify(edge_frame(spark).where("false"), none).count() == 0


@pytest.mark.parametrize(("query", "label", "cut", "accuracy"), [("op3_toxicity", "toxic", 0.5, 0.9), ("op9_quality", "quality", 0.3, 0.9)])
def test_scores_of_held_out_rows(spark, truth, query, label, cut, accuracy):
    docs, labels = truth
    found = queries.QUERIES[query](spark, SF).collect()
    assert len(found) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == held(r.doc_id) for r in found)
    out = [(r.predicted, labels[r.doc_id][label]) for r in found if r.held_out and r.doc_id in labels and labels[r.doc_id][label] is not None]
    assert np.mean([p == y for p, y in out]) >= accuracy


def fits(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int")
    yield toxicity.fit(frame)
    yield quality.fit(frame, frame)


def test_scores_of_edge_cases(spark):
    rows = [(i, "good words all over" if i % 2 else "scum words !!! HERE", (i + 1) % 2, i % 2) for i in range(40)] + [(99, None, None, None)]
    for model in fits(spark, rows):
        got = {r.doc_id: r.score for r in score(edge_frame(spark), model, columns=("doc_id",)).collect()}
        assert set(got) == {i for i, _ in EDGE} and all(0 <= s <= 1 for s in got.values())
        assert score(edge_frame(spark).where("false"), model).count() == 0
    for model in fits(spark, [(i, "x", 1, 1) for i in range(3)]):
        assert model.scores(["a", None])[0] > 0.99
    for model in fits(spark, []):
        assert model.scores(["a", None]).tolist() == [0.5, 0.5]


def test_filters_do_not_run_into_the_next_text():
    model = toxicity.train(["bad apple", "nice pear", "bad pear", "nice apple"] * 4, np.array([1, 0, 1, 0] * 4), steps=20)
    texts = ["one bad", "", "apple", None, "a b c d"]
    together = model.scores(texts)
    assert np.allclose(together, [model.scores([t])[0] for t in texts], atol=1e-6)


def test_context_sums_equal_a_plain_loop(spark):
    texts = ["A b, a B!", "b a", None, "", "c"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    want = np.zeros((quality.BUCKETS, quality.DIM))
    index = quality.index_vectors()
    for t in texts:
        own = [quality.bucket_of(w.lower()) for w in quality.TOKEN.findall(t or "")]
        for x, y in zip(own, own[1:], strict=False):
            want[x] += index[y]
            want[y] += index[x]
    assert np.allclose(quality.context_sums(frame), want)


def test_a_rare_language_keeps_its_rows(spark):
    rows = [(i, f"the and of with common words {i}", "en") for i in range(2000)] + [(5000, "żółć gęślą jaźń źdźbło", "pl")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=20)
    assert list(model.languages) == ["en", "pl"]


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """No class is cut to a number of rows, and shards together count what one table does."""
    rng = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary, 6)) + (" nasty" if i % 2 and i % 3 else " vile" if i % 2 else ""), i % 2) for i in range(4400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    seen = []
    plain = toxicity.count_buckets
    monkeypatch.setattr(toxicity, "count_buckets", lambda packed, apart: seen.append(plain(packed, apart)) or seen[-1])
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 400)
    model = toxicity.fit(frame)
    learnt = [r for r in rows if zlib.crc32(f"part{r[0]}".encode()) % 4]
    word, names, sizes = toxicity.lay_out([r[1] for r in learnt])
    want = toxicity.bucket_counts(word, toxicity.word_buckets(names), sizes, np.array([r[2] for r in learnt], dtype=float))
    assert len(learnt) > 3200 and np.array_equal(seen[0], np.stack(want))
    scores = model.scores(["word1 word2 nasty word3", "word4 vile", "word5 word6", "word299"])
    assert (scores[:2] > 0.5).all() and (scores[2:] < 0.5).all()
