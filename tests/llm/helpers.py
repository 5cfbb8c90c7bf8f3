"""Small tables and plain re-computations for the corpus operators."""

import hashlib
import random
import re
import string
import zlib

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def held(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def sentence(rng: random.Random, n: int, letters: str = "abcdefghij") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def docs_frame(spark, texts, start=0):
    rows = [(start + i, t, "en", "src0", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_links(texts, n, num, den):
    sets = {i: shingles(t, n) for i, t in texts.items()}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                yield a, b


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def placed_words(text):
    """``(word, from, to, line, words in the line)`` of a text."""
    out, offset = [], 0
    for pos, line in enumerate((text or "").split("\n")):
        found = list(WORD.finditer(line))
        out += [(m.group().translate(FOLD), offset + m.start(), offset + m.end(), pos, len(found)) for m in found]
        offset += len(line) + 1
    return out


def repeated_runs(texts, more_than=50):
    """Word places of each text inside runs of over ``more_than`` words that a text of a smaller id holds too, word for word."""
    first, runs = {}, {}
    for i in sorted(texts):
        w = [x[0] for x in placed_words(texts[i])]
        runs[i] = set()
        own = [tuple(w[k : k + more_than + 1]) for k in range(len(w) - more_than)]
        for k, run in enumerate(own):
            if run in first:
                runs[i].update(range(k, k + more_than + 1))
        for run in own:
            first.setdefault(run, i)
    return runs


def aligned(a, b):
    """Most words of ``a`` that ``b`` holds in the same order (longest common subsequence)."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def near_earlier(texts, doc, at, more_than=50, share=0.75):
    """Whether word ``at`` of a text lies in a stretch of over ``more_than`` words that an earlier text holds but for few edits."""
    w = [x[0] for x in placed_words(texts[doc])]
    for e in sorted(i for i in texts if i < doc):
        v = [x[0] for x in placed_words(texts[e])]
        near = set(w[max(0, at - 8) : at + 9])
        if len(near & set(v)) < 5:
            continue
        for start in range(max(0, at - more_than), min(at, len(w) - more_than - 1) + 1, 10):
            own = w[start : start + more_than + 1]
            for j in range(0, max(1, len(v) - more_than // 2), 20):
                if len(set(own) & set(v[j : j + more_than + 30])) > len(set(own)) // 2 and aligned(own, v[j : j + more_than + 30]) >= share * len(own):
                    return True
    return False
