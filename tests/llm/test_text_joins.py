"""Decontamination, near-duplicates, passages and components against brute force."""

import itertools
import os
import random
import re

import pytest
from netsift.llm import decontaminate, minhash, neardup, paragraphs, queries
from netsift.llm.common import shared_folder
from netsift.llm.components import connected_components
from netsift.llm.minhash import Bands

from .helpers import DATA, DOCS, FOLD, components, docs_frame, near_earlier, near_links, placed_words, repeated_runs, sentence, sha, shingles


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def contamination(texts, items, window=10):
    spans = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            spans.setdefault(tuple(w[k : k + window]), set()).add(item)
    out = []
    for doc, text in texts:
        w = words(text)
        hit, found = set(), set()
        for length in {len(s) for s in spans}:
            for k in range(len(w) - length + 1):
                own = spans.get(tuple(w[k : k + length]))
                if own:
                    hit.update(range(k, k + length))
                    found |= own
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), sha(",".join(names)), len(hit) > 0))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(1)
    items = [(i, sentence(rng, rng.choice([1, 2, 3, 9, 10, 14, 30]), "abc")) for i in range(25)] + [(90, None), (91, "..."), (3, "again Same ID")]
    items += items[:2]
    texts = []
    for i in range(60):
        t = sentence(rng, rng.randint(0, 40), "abcdef")
        if i % 3 == 0:
            w = words(items[rng.randrange(25)][1])
            k = rng.randrange(len(w))
            t += " " + "; ".join(x.upper() for x in w[max(0, k - 6) : k + 14]) + "\n" + t
        texts.append((i, t))
    texts += [(100, None), (101, ""), (102, "!?"), (5, texts[0][1]), (7, "other text of seven")] + texts[:1]
    docs = spark.createDataFrame([(a, b, 1) for a, b in texts], "doc_id long, text string, start int")
    bench = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    got = decontaminate.contamination(docs, bench)
    assert rows_of(got) == contamination(texts, items)
    clean = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    dirty = {r[0] for r in contamination(texts, items) if r[5]}
    assert clean == {a for a, _ in texts} - (dirty - {r[0] for r in contamination(texts, items) if not r[5]})


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, bench).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert rows_of(decontaminate.contamination(some, bench)) == [(1, 2, 0, 0, sha(""), False)]


def test_contamination_plan_stays_native(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = decontaminate.contamination(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == components(nodes, [(a, b) for a, b in links if a != b])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def copies(rng, n_bases=12, length=60):
    texts = []
    for _ in range(n_bases):
        base = sentence(rng, length).split()
        for _ in range(rng.randint(1, 7)):
            own = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
                own[rng.randrange(len(own))] = "new"
            texts.append(" ".join(own).upper() if rng.random() < 0.2 else "  ".join(own))
    return texts


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    texts = copies(rng) + [None, "", "  \n", "one", "One", "one two", "one two"]
    got = {r.doc_id: r for r in neardup.near_duplicates(docs_frame(spark, texts)).collect()}
    by_id = dict(enumerate(texts))
    want = components(by_id, near_links(by_id, 3, 85, 100))
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) and r.n_shingles == len(shingles(by_id[i], 3)) for i, r in got.items())


def test_near_duplicates_with_rows_that_share_an_id(spark):
    text = "a b c d e f g h"
    rows = [(1, text), (1, text), (2, "x y z w"), (2, text), (3, "x y z w"), (None, text)]
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (None, 1, True)} or got == {(1, 1, True), (2, 1, False), (3, 1, False), (None, None, True)}
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_different_texts_of_one_id_both_stay(spark):
    rng = random.Random(12)
    a, b, c = (sentence(rng, 30) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "y"), (2, c, "x"), (3, c, "x"), (None, a, "z")]
    got = rows_of(neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "text"))
    assert got == sorted([(1, a), (1, b), (2, c), (None, a)], key=str)


def test_residual_blocks_find_links_between_small_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "LEFT_BLOCK", 4)
    rng = random.Random(4)
    base = sentence(rng, 40).split()
    texts = []
    for k in range(24):  # a chain: neighbours are similar, the ends are not
        own = base[:]
        own[: 2 * k] = [f"n{j}" for j in range(2 * k)][: len(own)]
        texts.append(" ".join(own[:40]))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_frame(spark, texts), bands=Bands(40, 1)).collect()}
    by_id = dict(enumerate(texts))
    assert got == components(by_id, near_links(by_id, 3, 85, 100))


def test_bands_are_tuned_to_the_miss_rate():
    bands = Bands.tuned(0.85, 5, 1e-8)
    assert (1 - 0.85**5) ** bands.bands <= 1e-8 < (1 - 0.85**5) ** (bands.bands - 1)


def passages(texts, min_words=30, shingle=5):
    """(doc, pos) of the paragraphs to remove, by the rule of the module."""
    lines = {}
    for doc, text in texts.items():
        idx = 0
        for pos, line in enumerate((text or "").split("\n")):
            n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
            if n >= 5:
                lines[doc, pos] = (idx, n, line)
                idx += 1
    group = components(lines, near_links({k: v[2] for k, v in lines.items()}, shingle, 80, 100))
    first = {}
    for place, root in group.items():
        first[root] = min(first.get(root, place), place)
    gone = set()
    for doc in texts:
        run = []
        own = sorted((v[0], k) for k, v in lines.items() if k[0] == doc)
        for _, place in [*own, (None, None)]:
            if place and first[group[place]][0] != doc:
                run.append(place)
                continue
            if sum(lines[p][1] for p in run) >= min_words:
                gone.update(run)
            run = []
    return gone


def test_passages_equal_brute_force(spark):
    rng = random.Random(5)
    shared = [sentence(rng, rng.choice([8, 20, 35, 55])) for _ in range(8)]
    texts = {}
    for i in range(40):
        lines = [sentence(rng, rng.choice([2, 6, 15, 40])) for _ in range(rng.randint(1, 5))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared).split()
            if rng.random() < 0.4 and len(passage) > 30:
                passage[0] = "changed"
            lines.insert(rng.randint(0, len(lines)), " ".join(passage))
        texts[i] = "\n".join(lines)
    texts |= {50: None, 51: "", 52: "\n\n", 53: shared[2] + "\n" + shared[2], 54: texts[0]}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], DOCS)
    want = passages(texts)
    found = paragraphs.repeated_paragraphs(docs)
    assert {(r.doc, r.pos) for r in found.collect()} == want and want
    left = {r.doc_id: r for r in paragraphs.remove_repeats(docs).collect()}
    for i, t in texts.items():
        kept = None if t is None else "\n".join(line for pos, line in enumerate(t.split("\n")) if (i, pos) not in want)
        assert left[i].text == kept and left[i].n_chars == len(kept or "")
    assert paragraphs.repeated_paragraphs(spark.createDataFrame([], DOCS)).count() == 0


def test_passages_without_line_breaks_of_their_own(spark):
    rng = random.Random(7)
    first = sentence(rng, 70).split()
    edited = first[:]
    for k in (15, 33, 52):
        edited[k] = "changed"
    own = [sentence(rng, 40, "klmnopqrst") for _ in range(7)]
    texts = [
        " ".join([own[0], *first, own[1]]),  # mid-line in a document of one line: stays
        " ".join([own[2], *first, own[3]]),
        own[4] + "\n" + "\n".join(" ".join(first[k : k + 13]) for k in range(0, 70, 13)) + "\n" + own[5],  # other line breaks
        own[6] + "\n" + "\n".join(" ".join(first[k : k + 3]) for k in range(0, 70, 3)),  # lines under five words
        " ".join([own[0][::-1], *edited]) + "\nend",  # one word changed in twenty
        " ".join([own[1][::-1], *first[:45]]),  # not over 50 words: stays
    ]
    left = {r.doc_id: r for r in paragraphs.remove_repeats(docs_frame(spark, texts)).collect()}
    want = [texts[0], f"{own[2]} {own[3]}", f"{own[4]}\n{own[5]}", own[6], f"{own[0][::-1]} \nend", texts[5]]
    assert [left[i].text for i in range(6)] == want
    assert all(r.n_chars == len(r.text) for r in left.values())


def test_a_passage_that_only_a_third_document_holds(spark):
    """Other documents hold every short run of the passage, before and between the two that hold all of it."""
    rng = random.Random(11)
    first = sentence(rng, 64).split()

    def torn(k):
        """The passage in two pieces of at most 50 words, far apart."""
        return " ".join([*sentence(rng, 60, "klmnop").split(), *first[:k], *sentence(rng, 60, "qrstuv").split(), *first[64 - k :], *sentence(rng, 60, "wxyz").split()])

    own = [sentence(rng, 40, "klmnopqrst") for _ in range(4)]
    texts = [torn(k) for k in (49, 48, 47, 50)]
    texts += [f"{own[0]} {' '.join(first)} {own[1]}"] + [torn(k) for k in (50, 49, 47, 48)]
    texts += [f"{own[2]} {' '.join(first)} {own[3]}"]
    left = {r.doc_id: r.text for r in paragraphs.remove_repeats(docs_frame(spark, texts), min_words=51).collect()}
    assert [left[i] for i in range(9)] == texts[:9]
    assert left[9] == f"{own[2]} {own[3]}"


def check_cut(texts, lines, left, cut):
    """Hold the places cut from each text against the rule: what must go, what may go, what stays."""
    runs, unsure = repeated_runs(texts), 0
    for i, text in texts.items():
        own = placed_words(text)
        whole = {k for k, x in enumerate(own) if (i, x[3]) in lines}
        must = {k for k in runs[i] | whole if k in whole or own[k][4] >= 5}
        assert must <= cut[i], (i, sorted(must - cut[i])[:5])
        for k in sorted(cut[i] - must - runs[i])[::12]:
            unsure += 1
            assert near_earlier(texts, i, k), (i, k)
        assert [x[0] for k, x in enumerate(own) if k not in cut[i]] == [x[0] for x in placed_words(left[i])]
    return unsure


def test_passages_of_the_small_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    lines = passages(texts, min_words=51)
    found = queries.QUERIES["op2_substring_dedup"](spark, DATA).collect()
    assert {(r.doc_id, r.pos) for r in found if r.char_from is None} == lines
    parts = [r for r in found if r.char_from is not None]
    assert parts and all(r.kept_doc_id < r.doc_id and r.run_words > 50 for r in parts)
    cut = {i: set() for i in texts}
    for r in found:
        own = placed_words(texts[r.doc_id])
        cut[r.doc_id].update(k for k, x in enumerate(own) if x[3] == r.pos and (r.char_from is None or r.char_from <= x[1] and x[2] <= r.char_to))
    left = {r.doc_id: r.text for r in paragraphs.remove_repeats(docs, min_words=51).collect()}
    check_cut(texts, lines, left, cut)


def test_clashing_names_and_repeated_ids_stay(spark):
    rng = random.Random(8)
    shared = sentence(rng, 60)
    rows = [(1, shared, "mine", 1, "a"), (2, "own words\n" + shared, "yours", 2, "b"), (2, "other text of two", "yours", 3, "c"), (None, shared, "none", 4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _copy string, _gone int, doc string")
    got = rows_of(paragraphs.remove_repeats(docs, min_words=51))
    assert got == sorted([rows[0], (2, "own words", "yours", 2, "b"), rows[2], rows[3]], key=str)


def test_queries_on_the_small_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert rows_of(queries.QUERIES["op1_decontamination"](spark, DATA)) == contamination(docs.items(), items)
    got = {r.doc_id: r.component_id for r in queries.QUERIES["op5_near_duplicates"](spark, DATA).collect()}
    assert got == components(docs, near_links(docs, 3, 85, 100))


def test_repeated_keys_equal_a_plain_count(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_KEYS", 64)
    rng = random.Random(9)
    rows = [(i, 3, [rng.randrange(-900, 900) for _ in range(4)] + [7], b"x") for i in range(400)]
    items = spark.createDataFrame(rows + rows[:50], "id long, n int, keys array<long>, sig binary").repartition(5)
    want = {}
    for i, _, keys, _ in rows:
        for k in keys:
            want.setdefault(k, set()).add(i)
    want = {(k, i) for k, ids in want.items() if len(ids) > 1 for i in ids}
    assert {(r.key, r.id) for r in minhash.bucket_members(items, 5).collect()} == want


@pytest.mark.parametrize("query", ["op1_decontamination", "op2_substring_dedup", "op5_near_duplicates"])
def test_no_join_without_a_key(spark, query):
    plan = queries.QUERIES[query](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_passages_leave_no_tables_of_their_steps(spark):
    """Five documents share a passage: pairs, places and whole runs are all looked at, and their tables go."""
    passage = " ".join(f"shared{k}" for k in range(60))
    rows = [(n, f"{' '.join(f'own{n}x{k}' for k in range(20 + n))} {passage} {' '.join(f'end{n}x{k}' for k in range(30))}") for n in range(5)]
    before = set(os.listdir(shared_folder(spark)))
    found = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc for r in found.collect()} == {1, 2, 3, 4}
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(shared_folder(spark))) - before}
    assert not left & {"met-places", "seeds", "whole-runs", "whole-windows", "paragraph-places", "paragraph-firsts", "repeated-paragraphs"}


@pytest.mark.parametrize("step", [1, -1])
def test_equal_words_are_counted_to_the_first_difference_or_an_end(step):
    for n, changed in itertools.product((0, 1, 7, 8, 9, 40), (None, 0, 7, 8, 23, 39)):
        a = [b"%d" % k for k in range(n)]
        b = [b"x" if k == changed else w for k, w in enumerate(a)]
        i = 0 if step > 0 else n - 1
        places = range(n) if step > 0 else range(n - 1, -1, -1)
        want = next((at for at, k in enumerate(places) if k == changed), n)
        assert paragraphs._equal_words(a, b, i, i, step) == want
