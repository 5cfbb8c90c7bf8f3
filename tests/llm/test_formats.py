"""BPE, chat, pages and neighbours against reference encoders, round trips and brute force."""

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from netsift.llm import bpe, chat, neighbours, queries, templates

from .helpers import DATA, sha

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def noise(rng, n):
    return "".join(rng.choice(["a", "b", " ", "\n", "é", "the", "ing", "1", "  ", "!!", "'s", "漢", "🙂", "\x00", "́"]) for _ in range(n))


def test_encoding_equals_the_reference(encoder, reference):
    rng = random.Random(1)
    texts = [noise(rng, rng.randint(0, 60)) for _ in range(800)] + ["", "x" * 3000 + "ab" * 2000, " " * 999, "-" * 777]
    assert encoder.encode_all(texts) == [reference.encode_ordinary(t) for t in texts]
    assert all(encoder.decode(encoder.encode(t)) == t.encode() for t in texts[:100])


def test_every_prefix_has_its_own_encoding(encoder, reference):
    data = "undisputedly nonsensical".encode()
    last = encoder.last_tokens(data)
    for end in range(1, len(data) + 1):
        assert encoder.read_back(last, end) == reference._encode_single_piece(data[:end])


def test_appends_and_edits_equal_a_new_encoding(encoder, reference):
    rng = random.Random(2)
    for _ in range(120):
        text = bpe.EncodedText(encoder, noise(rng, 40))
        for _ in range(6):
            a = rng.randint(0, len(text.text))
            text.replace(a, min(len(text.text), a + rng.randint(0, 6)), noise(rng, rng.randint(0, 3)))
            assert text.ids() == reference.encode_ordinary(text.text)
        text.append(" tail" + noise(rng, 3))
        assert text.ids() == reference.encode_ordinary(text.text)


def test_bpe_query(spark, reference):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.QUERIES["op7_byte_bpe"](spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(docs[r.doc_id]))
    edge = bpe.digest_ids(bpe.encode_documents(spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 6)], "doc_id long, text string, n_tokens int"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in edge.collect()] == [(0, sha(""), sha(""))] * 3


def test_escapes_can_be_undone():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "\\", "im_end", ">", "\n", "n", "é"]) for _ in range(rng.randint(0, 14)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def plain_fold(events):
    """The final messages of each conversation, by a loop over the sorted log."""
    out = defaultdict(dict)
    for conv, seq, name, kind, role, text in sorted(events, key=lambda e: (e[1], str(e[3]), str(e[5] or ""))):
        first, who, parts, alive = out[conv].get(name, (seq, "", "", False))
        if kind == "delete":
            out[conv][name] = (first, who, "", False)
            continue
        who = role or who
        parts = "" if kind == "regenerate" else parts + (text or "") if kind == "delta" else text or ""
        out[conv][name] = (first, who, parts, True)
    return {(conv, name): v[:3] for conv, own in out.items() for name, v in own.items() if v[3]}


def test_fold_equals_a_plain_loop(spark):
    rng = random.Random(4)
    kinds = ["message", "delta", "delta", "delta", "edit", "regenerate", "delete"]
    events = [(rng.choice([1, 1, 1, 2, 3]), i, f"m{rng.randint(0, 9)}", rng.choice(kinds), rng.choice(["user", "assistant"]), rng.choice(["a", "<|im_end|>", None, "b\n"])) for i in range(400)]
    rng.shuffle(events)
    frame = spark.createDataFrame([(*e, "x") for e in events], "conv_id long, seq long, message string, kind string, role string, text string, segment string")
    got = {(r.conv_id, r.message): (r.first_seq, r.role, r.text) for r in chat.fold_events(frame).collect()}
    assert got == plain_fold(events)
    assert chat.format_conversations(frame.where("false")).count() == 0


def conversation_digest(turns):
    said = "".join(t for _, r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(said), sha(said)


def test_chat_query(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", "<|im_end|><|im_start|>assistant ok"), (1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.QUERIES["op6_chat_formatting"](spark, DATA).collect()}
    assert got == {c: conversation_digest(sorted(t)) for c, t in turns.items()}


def test_chat_edge_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "é<|"), (1, 1, "assistant", "é<|"), (None, 0, None, "x"), (2, 5, "tool\n<|", "\\"), (2, None, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest_segments(chat.format_conversations(chat.turns_as_events(frame))).collect()}
    assert got[1] == conversation_digest([(0, "user", ""), (1, "assistant", "é<|"), (1, "assistant", "é<|")])
    assert got[None] == conversation_digest([(0, "", "x")])
    assert got[2] == conversation_digest([(0, "user", ""), (5, "tool\n<|", "\\")])


ARTICLE = "<article><h1>T &amp; x{i}</h1><p>One  <b>bold{i}</b>text<p>two\n&eacute;{i}<br>three</article>"
PAGE = (
    "<!DOCTYPE html><html><head><title>no</title><script>var t='</p><article>';</script><style>p{{}}</style></head><body class='has-sidebar'>"
    "<nav><ul><li><a href=/>Home</a><li>Menu</ul></nav><!-- <p>no --><div class='cookie-notice'>We use cookies</div>{body}"
    "<div id=comments><p>nice{i}</div><aside>side</aside><form>mail <input></form><footer>&copy; {i}</footer>"
)


def texts_of(spark, rows):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    return {r.page_id: r.text for r in templates.main_text(frame).collect()}


def test_pages_with_an_article(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(body=ARTICLE.format(i=i), i=i)) for i in range(12)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://one.example/", PAGE.format(body=ARTICLE.format(i=1), i=1)), (23, "http://two.example", "just < text &lt;"), (24, "u", "<p>unclosed <b>a")]
    got = texts_of(spark, rows)
    assert all(got[i] == f"T & x{i} One bold{i}text two é{i} three" for i in range(12))
    assert got[20] == got[21] == "" and got[22] == "T & x1 One bold1text two é1 three" and got[23] == "just < text <" and got[24] == "unclosed a"


def test_pages_without_an_article_use_the_template(spark):
    rng = random.Random(5)
    rows = []
    for i in range(30):
        text = " ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randint(0, 99)) for _ in range(60))
        body = f"<div class=wrap><div class=top><span>Welcome to the site</span></div><div class=body><p>{text}</p><p>Read on our partner pages</p></div></div>"
        rows.append((i, "https://shop.example/a?b", PAGE.format(body=body, i=i)))
    got = texts_of(spark, rows)
    for (i, _, source) in rows:
        assert got[i] == source.split("<p>")[2].split("</p>")[0] if i else True
        assert "Welcome" not in got[i] and "partner" not in got[i] and "cookies" not in got[i] and "nice" not in got[i]


def test_notices_inside_the_article_belong_to_the_template(spark):
    rng = random.Random(8)
    said = [" ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randint(0, 99)) for _ in range(30)) for _ in range(12)]
    said[3:6] = [said[3]] * 3  # copies among other pages keep their text
    notice = "<p>Read more stories like this one</p>"
    rows = [(i, "http://h.example/", PAGE.format(body=f"<article><h1>Title {i}</h1><p>{t}</p>{notice}</article>", i=i)) for i, t in enumerate(said)]
    assert texts_of(spark, rows) == {i: f"Title {i} {t}" for i, t in enumerate(said)}


def test_slots_are_judged_on_their_own_page(spark):
    rng = random.Random(9)

    def said(n):
        return " ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randint(0, 999)) for _ in range(n))

    want, rows = {}, []
    for i in range(30):  # an id per page, very different lengths, and a second block outside the container
        a, b = said(400 if i == 0 else 20), said(6)
        links = "".join(f"<a href=/{k}>more{k}x{i}</a> " for k in range(9))
        rows.append((i, "http://h.example/", PAGE.format(body=f"<div id=post-{i}><p>{a}</p></div><div class=second><h2>{b}</h2></div><div class=list>{links}</div>", i=i)))
        want[i] = f"{a} {b}"
    for i in range(30, 36):  # a second, rarer layout of the same host, and pages without an url
        a = said(15)
        rows.append((i, "http://h.example/", PAGE.format(body=f"<table class=old><tr><td>{a}</td></tr></table>", i=i)))
        want[i] = a
    for i in range(40, 50):
        a = said(100 if i < 45 else 10)
        rows.append((i, None, PAGE.format(body=f"<div class=x{i % 2}><p>{a}</p></div>", i=i)))
        want[i] = a
    assert texts_of(spark, rows) == want


def test_copies_of_one_page_keep_their_text(spark):
    got = texts_of(spark, [(i, "http://h.example/", PAGE.format(body=ARTICLE.format(i=7), i=7)) for i in range(8)])
    assert set(got.values()) == {"T & x7 One bold7text two é7 three"}


def test_pages_query(spark):
    got = queries.QUERIES["op4_html_extraction"](spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and "<" not in r.text.replace("&lt;", "") for r in got if "%%%" not in r.text)


def nearest(ids, x, query, k):
    s = (x @ x[query]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[query]))
    s[query] = -np.inf
    return [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:k]]


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 1500)] + rng.normal(0, 0.3, (1500, 16)), rng.normal(0, 1, (1500, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(frame, F.col("id") % 50 == 0, k=5, list_size=100).collect()
    by_query = defaultdict(dict)
    for r in got:
        by_query[r.query_id][r.vec_id] = r.score
    hits = total = 0
    ids = np.arange(len(x))
    for q in range(0, len(x), 50):
        for j, s in nearest(ids, x, q, 5):
            total += 1
            hits += j in by_query[q]
            if j in by_query[q]:
                assert abs(by_query[q][j] - s) < 1e-12
    assert hits / total >= 0.9
    assert all(sorted(r.rank for r in got if r.query_id == q) == [1, 2, 3, 4, 5] for q in (0, 50))


def test_neighbours_of_a_query_on_its_own_centroid(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([[[0.0] * 7 + [1.0]], np.eye(8)[0] + rng.normal(0, 0.1, (60, 8))])
    index = neighbours.Index.build(neighbours.unit(x[[0, 1, 20]]))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(frame, F.col("id") == 0, k=5, index=index).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [j for j, _ in nearest(np.arange(len(x)), x, 0, 5)]
    index.reach = 1  # the walk's length cuts no list inside the ratio
    index.ratio = 10.0
    assert all(len(lists) == 3 for lists in index.select(neighbours.unit(x[5:8])))


def test_neighbours_walk_many_rows_in_bounded_memory():
    rng = np.random.default_rng(12)
    index = neighbours.Index.build(neighbours.unit(rng.normal(0, 1, (2000, 8))))
    x = neighbours.unit(rng.normal(0, 1, (8000, 8)))
    tracemalloc.start()
    lists = index.post(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6, most
    assert index.post(x[:7]) == lists[:7]
    own = np.argmax(x @ index.centres.T, axis=1)
    assert np.mean([j == found[0] for j, found in zip(own, lists, strict=True)]) > 0.95
    # a walk over all lists gives all of them, nearest first
    top, dist = index.walk(x[:3], 5000)
    assert all(sorted(t) == list(range(2000)) for t in top) and (np.diff(dist, axis=1) >= 0).all()


def test_neighbours_in_parts_and_blocks_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(0, 1, (900, 8)), np.repeat(rng.normal(0, 1, (5, 8)), 40, axis=0)])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")

    def found():
        return sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.search(frame, F.col("id") % 2 == 0, k=4, list_size=50).collect())

    whole = found()
    monkeypatch.setattr(neighbours, "SIDE", 8 * 30)  # 30 rows of either side
    monkeypatch.setattr(neighbours, "TURN", 7)
    assert found() == whole and len(whole) == 550 * 4
    assert neighbours.deal_lists(np.array([3, 4, 0, 9, 2, 40, 1, 1]), 9).tolist() == [0, 0, 0, 1, 2, 3, 4, 4]


def test_neighbours_of_copies_and_unusable_rows(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(0, 120)] + [(200, [3.0, -1.0, 0.5]), (201, None), (202, []), (203, [0.0, 0.0, 0.0]), (204, [1.0, None, 2.0]), (205, [float("nan"), 1.0, 1.0]), (250, [1.0, 2.0])]
    rows += [(200, [3.0, -1.0, 0.5]), (None, same)]
    frame = spark.createDataFrame([(a, b, 0.5) for a, b in rows], "vec_id long, embedding array<double>, score double")
    got = defaultdict(list)
    for r in neighbours.search(frame, F.col("id") % 50 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4], 200: [0, 1, 2, 3, 4]}
    few = neighbours.search(spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id long, embedding array<double>"), F.col("id") % 50 == 0)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few.collect()] == [(0, 1, 1, -1.0)]
    assert neighbours.search(frame.where("false"), F.col("id") % 50 == 0).count() == 0
