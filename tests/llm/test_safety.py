"""Odd tables and clusters: clashing names, wide numbers, workers without the package."""

import os
import random
import subprocess
import sys

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from netsift.llm import bpe, chat, decontaminate, language, neardup, neighbours
from netsift.llm.common import free_name, labelled_sample, score

from .helpers import DATA, sentence
from .test_text_joins import rows_of

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_keep_columns_of_any_name(spark):
    rng = random.Random(50)
    item, text = sentence(rng, 12), sentence(rng, 40)
    names = "doc string, copy int, _row string, _twice int, _again long, own_text string, item int, words string"
    rest = ("mine", 7, "r", 1, 9, "o", 3, "w")
    rows = [(1, text, *rest), (2, text, *rest), (3, item + " more", *rest), (4, None, *rest), (None, item, *rest)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {names}")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert rows_of(decontaminate.drop_contaminated(docs, bench)) == sorted([rows[0], rows[1], rows[3]], key=str)
    assert rows_of(neardup.keep_one(docs)) == sorted([rows[0], *rows[2:]], key=str)
    again = docs.unionByName(spark.createDataFrame([(1, "another text of the same id", *rest)], docs.schema))
    assert rows_of(neardup.keep_one(again)) == sorted([rows[0], *rows[2:], (1, "another text of the same id", *rest)], key=str)


def test_scores_beside_clashing_names(spark):
    class Length:
        def scores(self, texts):
            return [float(len(t or "")) for t in texts]

    docs = spark.createDataFrame([(1, "ab", "own", 5.0)], "doc_id long, text string, _text string, score double")
    assert rows_of(score(docs, Length()).select("doc_id", "text", "_text", "score")) == [(1, "ab", "own", 2.0)]
    assert free_name(["_Text", "__text"], "_text") == "___text"


def test_turns_of_any_width(spark):
    rows = [(1, turn, role, f"text {turn}") for turn, role in ((2**31 - 2, "user"), (2**31 - 1, "assistant"), (-5, "system"))]
    digest = chat.digest_segments(chat.format_conversations(chat.turns_as_events(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))).first()
    assert digest.n_turns == 3 and digest.loss_chars == len(f"text {2**31 - 1}")


def test_numbers_are_no_letters(spark):
    docs = [(k, sentence(random.Random(k), 30), "en") for k in range(20)]
    model = language.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    texts = ["½ ²", "③ Ⅷ ௰ 12 _ \U00010107 \U0001F10B", "a½", "一", None]
    got = [r.lang_pred for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).sort("doc_id").collect()]
    assert got[0] == got[1] == got[4] == "und" and got[2] == "en" and got[3] != "und"


def test_pieces_are_forgotten_in_two_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 8)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoder, fresh = (bpe.Encoder(ranks, public_tokenizers.PATTERN) for _ in range(2))
    rng = random.Random(51)
    for _ in range(30):
        text = "often " * 2 + sentence(rng, 6)
        assert encoder.encode(text) == fresh.encode_all([text, text])[1] and len(encoder.pieces) + len(encoder.older) < 30
    assert "often" in encoder.pieces or "often" in encoder.older


def test_vocabularies_of_one_size_are_told_apart(spark, tmp_path):
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()[:260]
    paths = []
    for name, own in (("a", lines), ("b", [*lines[:258], lines[259].split()[0] + b" 258", lines[258].split()[0] + b" 259"])):
        paths.append(str(tmp_path / name))
        open(paths[-1], "wb").write(b"\n".join(own))
    docs = spark.createDataFrame([(1, "the other then there in thin")], "doc_id long, text string").coalesce(1)
    for path in paths:
        own = bpe.Encoder(bpe.load_ranks(path), public_tokenizers.PATTERN).encode("the other then there in thin")
        assert list(bpe.encode_documents(docs, path, public_tokenizers.PATTERN).first().ids) == own


def test_labelled_rows_are_chosen_without_their_texts(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(400)] + [(None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)] + [(None, 1), (999, 0), (5000, None)], "doc_id long, toxic int")
    everything = rows_of(labelled_sample(docs, labels, "toxic", 1000))
    assert everything == sorted([(k, f"text {k}", int(k % 4 == 0)) for k in range(300)], key=str)
    some = labelled_sample(docs, labels, "toxic", 40)
    counts = {r.toxic: r["count"] for r in some.groupBy("toxic").count().collect()}
    assert set(counts) == {0, 1} and all(15 <= n <= 70 for n in counts.values()) and set(rows_of(some)) <= set(everything)


def test_index_of_few_vectors(spark):
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(4)], "vec_id long, embedding array<double>")
    assert neighbours.search(rows, F.col("id") == 0, k=5).count() == 3


HIDDEN = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
def seen(frames):
    import importlib.util
    for f in frames:
        yield f.assign(id=int(importlib.util.find_spec("netsift") is not None))
assert spark.range(1).mapInPandas(seen, "id long").first().id == 0
for name in ("op10_language", "op3_toxicity", "op9_quality", "op8_nearest_neighbours", "op11_simhash"):
    assert entry.queries()[name](spark, {data!r}).count() > 0
print("all ran")
"""


def test_workers_without_the_package(tmp_path):
    script = HIDDEN.format(root=ROOT, folder=str(tmp_path / "shared"), data=DATA)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "all ran" in done.stdout, done.stderr[-3000:]


@pytest.mark.parametrize("name", ["netsift.llm", "netsift.llm.queries"])
def test_the_entry_module_needs_no_corpus_package(name):
    script = f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules[{name!r}] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=100)
    assert done.stdout.split()[-1] == "False" and int(done.stdout.split()[0]) > 130, done.stderr[-2000:]
