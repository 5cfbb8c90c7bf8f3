"""The corpus pipeline against a brute-force version, and on empty and odd rows."""

import difflib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from netsift.llm import bpe, queries

from .helpers import DATA, DOCS, components, near_earlier, near_links, placed_words, repeated_runs
from .test_text_joins import contamination, passages


def test_pipeline_equals_brute_force(spark):
    """Every stage against a plain version on its own input, and the whole run against the chain of them."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(texts) == docs.count()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    seen = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(function(spark, docs, DATA).collect(), DOCS)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    told = {i: t for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    assert seen["language"] == told
    group = components(told, near_links(told, 5, 80, 100))
    apart = {i: t for i, t in told.items() if group[i] == i}
    assert seen["near_duplicates"] == apart
    cut = {}
    for i, t in apart.items():
        own, left = placed_words(t), [x[0] for x in placed_words(seen["passages"][i])]
        match = difflib.SequenceMatcher(None, [x[0] for x in own], left, autojunk=False)
        kept = {k for block in match.get_matching_blocks() for k in range(block.a, block.a + block.size)}
        assert len(kept) == len(left)
        cut[i] = set(range(len(own))) - kept
    assert seen["passages"].keys() == apart.keys()
    runs, lines = repeated_runs(apart), passages(apart, min_words=51)
    for i, t in apart.items():
        whole = {k for k, x in enumerate(placed_words(t)) if (i, x[3]) in lines}
        if not cut[i]:
            assert seen["passages"][i] == t and not whole and not runs[i]
        # equal words at an edge may be taken for one another in the comparison of before and after
        assert len((runs[i] | whole) - cut[i]) <= len(cut[i]) // 10
        unsure = sorted(cut[i] - runs[i] - whole)
        assert sum(near_earlier(apart, i, k) for k in unsure[::15]) >= 0.9 * len(unsure[::15])
    assert any(cut.values()) and not any(repeated_runs({**{j: apart[j] for j in apart if j < i}, i: seen["passages"][i]})[i] for i in cut if cut[i])
    dirty = {r[0] for r in contamination(seen["passages"].items(), items) if r[5]}
    assert seen["benchmark"] == {i: t for i, t in seen["passages"].items() if i not in dirty} and dirty
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: encoding.encode_ordinary(t) for i, t in seen["benchmark"].items()}
    got = {r.doc_id: (r.n_tokens, list(r.ids)) for r in queries.QUERIES["pipeline"](spark, DATA).collect()}
    assert got == {i: (len(x), x) for i, x in want.items()}
    assert len(want) < len(texts)


def test_stages_on_odd_rows(spark):
    names = DOCS.split(", ")
    rows = [(1, None, None, None, None), (1, "Words to keep here.", "en", "s", 19), (1, "Words to keep here.", "en", "s", 19), (2, "", None, "s", 0), (3, "12 !!", "en", None, 5), (4, "x " * 5000, "en", "s", 10000)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], DOCS + ", lang_pred string")
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, DATA)
        assert docs.columns == [x.split()[0] for x in names] + ["lang_pred"]
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(1, "Words to keep here."), (4, "x " * 5000)]


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, DATA).count() == 0
