"""Fingerprints, collocations and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from netsift.llm import collocations, queries, simhash, spelling

from .helpers import DATA, DOCS, FOLD, components, sentence


def plain_fingerprint(text, shingle=4, seed=42):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    runs = [" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] if len(w) >= shingle else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r.encode(), seed) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_groups(found, radius=4):
    """Smallest id of each id's group, from ``{id: fingerprint}``."""
    ids = sorted(found)
    return components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (found[a] ^ found[b]).bit_count() <= radius])


def simhash_rows(docs):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_fingerprints(docs).collect()}


def test_simhash_of_the_small_table_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    marks = {i: plain_fingerprint(t) for i, t in texts.items()}
    group = near_groups(marks)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op11_simhash"](spark, DATA).collect()}
    assert got == {i: (f"{marks[i]:016x}", group[i]) for i in texts}


def test_simhash_of_odd_rows(spark):
    rng = random.Random(21)
    long = sentence(rng, 30_000)
    texts = [None, "", " \n\t", "one", "One", "one two three", "a b c d", "A  b\nc d", "a b c d e", long, long + " more", sentence(rng, 50)]
    rows = [(k + 1, t, "x", 7) for k, t in enumerate(texts)] + [(4, "one", "again", 7), (None, "one", "x", 7), (None, None, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component long")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_fingerprints(docs).collect()), key=str)
    marks = {k + 1: plain_fingerprint(t) for k, t in enumerate(texts)}
    group = near_groups(marks)
    want = [(k, f"{plain_fingerprint(t):016x}", group.get(k)) for k, t, _, _ in rows]
    assert got == sorted(want, key=str) and group[2] == group[3] == 1
    assert simhash.near_fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_simhash_takes_text_ids(spark):
    docs = spark.createDataFrame([("b", "same words here now"), ("a", "same words here now"), ("c", "others")], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_fingerprints(docs).collect()} == {"a": "a", "b": "a", "c": "c"}


@pytest.mark.parametrize("radius", [2, 4])
def test_ball_links_join_chains_and_dense_groups(spark, radius):
    rng = random.Random(22)
    marks = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        mark = rng.choice(marks)
        for b in rng.sample(range(64), rng.randint(1, radius + 1)):
            mark ^= 1 << b
        marks.append(mark)
    signed = np.array(sorted(set(marks)), dtype=np.uint64).view(np.int64).tolist()
    links = [(r.a, r.b) for r in simhash.ball_links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius).collect()]
    near = [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]
    assert components(signed, links) == components(signed, near)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= radius for a, b in links)


def test_ball_links_refuse_what_they_cannot_do(spark):
    with pytest.raises(ValueError, match="even"):
        simhash.ball_links(spark.createDataFrame([(1,)], "fp long"), radius=3)


def plain_collocations(rows, top=2000, least=10, share=50):
    """The best phrases of each language, from ``(lang, text)``, by counting everything."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(w)
            own.update(w[s : s + k] for k in (1, 2, 3) for s in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        good = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        dropped = {p[k : k + 2] for p, a in good.items() if len(p) == 3 for k in (0, 1) if 100 * a >= share * good[p[k : k + 2]]}
        scored = []
        for p, a in good.items():
            if p not in dropped:
                score, _, left, right = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def collocation_rows(found):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect())


@pytest.mark.parametrize(("top", "least", "rounds"), [(2000, 10, collocations.ROUNDS), (5, 3, (900_000, 500_000, 100_000, 1000, 0)), (40, 2, (300_000, 0)), (3, 1, (0,))])
def test_collocations_equal_brute_force(spark, top, least, rounds):
    rng = random.Random(31)
    vocabulary = [sentence(rng, 1) for _ in range(60)]
    phrases = [" ".join(rng.sample(vocabulary, rng.randint(2, 4))) for _ in range(12)]
    rows = []
    for k in range(150):
        parts = [rng.choice(phrases) if rng.random() < 0.5 else rng.choice(vocabulary[: 5 + k % 55]) for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice(["en", "de", None, "und", "x y"]), "".join(p + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " \x00 "]) for p in parts).title(), 1))
    rows += [("en", None, 1), ("en", "", 1), ("fr", " .\n", 1), ("en", "\u00c9t\u00e9 \u00c9t\u00e9 \u00e9t\u00e9 " * 30, 1), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "lang string, text string, phrase int")
    want = plain_collocations([(lang, text) for lang, text, _ in rows], top, least)
    assert collocation_rows(collocations.collocations(docs, top, least, rounds=rounds)) == want
    assert want


def test_collocations_with_few_slots_and_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLOTS", 4)
    monkeypatch.setattr(collocations, "HELD", 20)
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert collocation_rows(collocations.collocations(docs, 100)) == plain_collocations(rows, 100)
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0


def plain_spelling(rows, min_letters=6, min_count=5, ratio=5):
    counts = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = w.translate(FOLD)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if doc is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_letters and n >= min_count}
    shorter = {}
    for w in words:
        for k in range(len(w)):
            shorter.setdefault((w[:k] + "*" + w[k + 1 :], "same"), set()).add(w)
            shorter.setdefault((w[:k] + w[k + 1 :], "less"), set()).add(w)
    near = {w: set() for w in words}
    for (_, kind), group in shorter.items():
        if kind == "same":
            for w in group:
                near[w] |= group - {w}
    for w in words:
        for longer in shorter.get((w, "less"), ()):
            near[w].add(longer)
            near[longer].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda u: (-words[u], u), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def spelling_rows(found):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect())


def test_spelling_of_the_small_table_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = plain_spelling(rows)
    assert spelling_rows(queries.QUERIES["op13_spelling"](spark, DATA)) == want
    assert any(r[1] for r in want)


@pytest.mark.parametrize("levels", [2, 24])
def test_spelling_of_odd_rows(spark, monkeypatch, levels):
    monkeypatch.setattr(spelling, "LEVELS", levels)
    monkeypatch.setattr(spelling, "HELD", 10)
    monkeypatch.setattr(spelling.near_words, "__defaults__", (levels,))
    rng = random.Random(41)
    base = [sentence(rng, 1, "ab\u00e9\u00fc") * 2 for _ in range(12)]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 30, 200])
        for _ in range(6):
            k = rng.randrange(len(w) + 1)
            words += [rng.choice([w[:k] + rng.choice("ab\u00e9") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abz\u00fc") + w[k + 1 :]])] * rng.choice([5, 6, 40])
    words += ["x" * 300] * 9 + ["x" * 299] * 60 + ["x" * 299 + "y"] * 5 + ["\u00c9COLES"] * 5 + ["\u00e9coles"] * 5
    rng.shuffle(words)
    rows = [(k, rng.choice([" ", "-", "1", "\n"]).join(words[k::40]), 1) for k in range(40)] + [(None, "nulled nulled nulled", 1)] * 2 + [(3, None, 1), (4, "", 1), (0, words[0] + " again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int")
    assert spelling_rows(spelling.spelling_groups(docs)) == plain_spelling([r[:2] for r in rows])
    assert spelling.spelling_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_spelling_broadcasts_no_table_at_any_size(spark, monkeypatch):
    plans = []
    staged = spelling.stage
    monkeypatch.setattr(spelling, "stage", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or staged(df, name))
    rows = [(k, "planet garden " * 6 + "plannet garten gardan") for k in range(5)]  # small tables, which Spark would broadcast
    found = spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert spelling_rows(found) == plain_spelling(rows) and found.where("form IS NOT NULL").count() == 3
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
