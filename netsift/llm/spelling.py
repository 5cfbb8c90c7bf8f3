"""Spelling variants: words one edit apart, found by walking a relational trie.

The trie is a table of edges ``(side, node, ch, lengths, tails, word)``: a node is a prefix
of some word, an edge leads on by one letter, and each edge carries two 64-bit masks of the
words below it (their lengths, and their last two letters). Two tries are kept: of the words
(side ``F``) and of the reversed words (side ``B``).

The frontier holds states (word, node, rest, edits): the node that has been reached and the
letters of the word still to be matched. An edit lies in the second half of the word or, seen
from its end, in the second half of the reversed word; so states without an edit start at a
word's own prefixes from its middle on, where few edges lead on, and not at the root. The
first join spends the edit (another letter, or one letter more), each further level joins the
states with the edge of their next letter. A state that has used up its word at the end of a
word is a neighbour. Masks drop states below which no word of the right length and ending
lies. One letter less is one letter more seen from the other word, so links are given both
ways. After ``LEVELS`` levels what is left of the states (very long words that are alike) is
joined with the words as a whole.

Every join is a sort-merge join at any size: Spark takes the size of a table from its packed
files and does not count the rows that an explode makes, so it would broadcast states and
edges of many times the size that it allows.

Edge cases: null texts have no words; a null id leaves its runs as they are; repeated rows
count each time; an empty table gives no rows; ties go to the smaller word in code-point
order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import bound_batches, free_shuffles, release, slices, stage

#: levels of the trie that are walked one by one after the edit
LEVELS = 24
#: distinct words that a task counts at once
HELD = 100_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_STATE = "side", "word", "node", "rest"


def garbled(doc_id, run: str, every: int) -> str:
    """The run, without one code point where ``every`` divides the checksum of id and run."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def run_counts(docs: DataFrame, min_letters: int, every: int) -> DataFrame:
    """``(word, n)`` of all runs of letters of ``(id, text)``, A-Z lower-cased, garbled runs as they are then."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for frame in slices(frames, "text"):
            for doc_id, text in zip(frame["id"], frame["text"], strict=True):
                # lower() of bytes changes A-Z only
                own = Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))) if text else {}
                for w, n in own.items():
                    if len(w) >= min_letters:
                        word = w if doc_id is None else garbled(doc_id, w, every)
                        if len(word) >= min_letters:
                            counts[word] += n
            if len(counts) > HELD:
                yield pd.DataFrame(list(counts.items()), columns=["word", "n"])
                counts.clear()
        yield pd.DataFrame(list(counts.items()), columns=["word", "n"])

    ids = docs.select(F.col("id").cast("string").alias("id"), "text")
    return bound_batches(ids).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _masks(letters: str) -> tuple[Column, Column]:
    """Bits for a length and for the last two letters of a column of letters."""
    size = F.expr(f"shiftleft(1L, CAST(pmod(char_length({letters}), 63) AS INT))")
    tail = F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(substring({letters}, -2, 2)), 63) AS INT))")
    return size, tail


def trie_edges(spelt: DataFrame) -> DataFrame:
    """Edges below the nodes that states can reach, from ``(side, spelt)``."""
    at = F.explode(F.sequence(F.expr("(char_length(spelt) - 1) DIV 2").cast("int"), F.char_length("spelt") - 1))
    places = spelt.select("side", "spelt", at.alias("at"))
    size, tail = _masks("spelt")
    return (
        places.select("side", F.expr("substring(spelt, 1, at)").alias("node"), F.expr("substring(spelt, at + 1, 1)").alias("ch"), size.alias("size"), tail.alias("tail"), (F.col("at") == F.char_length("spelt") - 1).alias("word"))
        .groupBy("side", "node", "ch")
        .agg(F.bit_or("size").alias("sizes"), F.bit_or("tail").alias("tails"), F.max("word").alias("ends"))
    )


def _possible(states: DataFrame) -> DataFrame:
    """States below whose edge a word of the right length and last two letters may lie."""
    size = F.expr("shiftleft(1L, CAST(pmod(char_length(node) + char_length(rest), 63) AS INT))")
    tail = F.expr("shiftleft(1L, CAST(pmod(xxhash64(substring(concat(node, rest), -2, 2)), 63) AS INT))")
    return states.where((F.col("sizes").bitwiseAND(size) != 0) & (F.col("tails").bitwiseAND(tail) != 0))


def _spend_edit(spelt: DataFrame, edges: DataFrame) -> DataFrame:
    """States after the one edit: another letter, or one more, from the middle of the word on."""
    at = F.explode(F.sequence(F.expr("char_length(spelt) DIV 2").cast("int"), F.char_length("spelt")))
    own = spelt.select("side", "word", "spelt", at.alias("at")).select("side", "word", F.expr("substring(spelt, 1, at)").alias("node"), F.expr("substring(spelt, at + 1)").alias("left"))
    met = own.join(edges.hint("merge"), ["side", "node"])
    # another letter: the pair is also seen from its other word, so one order of the two letters will do
    rests = F.array(F.when((F.col("left") != "") & (F.col("ch") > F.substring("left", 1, 1)), F.expr("substring(left, 2)")), F.col("left"))
    states = met.select("side", "word", F.concat("node", "ch").alias("node"), F.explode(F.array_compact(rests)).alias("rest"), "sizes", "tails", "ends")
    return _possible(states).select(*_STATE, "ends")


def near_words(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``(word, near)``, both ways: the words that differ by exactly one letter inserted, deleted or replaced."""
    sides = F.explode(F.array(F.struct(F.lit("F").alias("side"), F.col("word").alias("spelt")), F.struct(F.lit("B").alias("side"), F.reverse("word").alias("spelt"))))
    spelt = words.select("word", sides.alias("x")).select("word", "x.*")
    edges = stage(trie_edges(spelt), "trie-edges")
    found, states = [], None
    for level in range(levels + 1):
        if level == 0:
            states = stage(_spend_edit(spelt, edges), "trie-states")
        else:
            on = (F.col("s.side") == F.col("e.side")) & (F.col("s.node") == F.col("e.node")) & (F.expr("substring(s.rest, 1, 1)") == F.col("e.ch"))
            met = going.alias("s").join(edges.alias("e").hint("merge"), on)
            step = met.select("s.side", "word", F.concat("s.node", "ch").alias("node"), F.expr("substring(rest, 2)").alias("rest"), "sizes", "tails", "ends")
            before, states = states, stage(_possible(step).select(*_STATE, "ends"), "trie-states")
            release(before)
        found.append(stage(states.where("rest = '' AND ends").select("side", "word", "node"), "near-words"))
        going = states.where("rest <> ''").drop("ends")
        if going.isEmpty():
            break
    else:
        # the exact way for the rest: the whole remainder at once
        rest = going.select("side", "word", F.concat("node", "rest").alias("spelt")).join(spelt.select("side", "spelt").hint("merge"), ["side", "spelt"])
        found.append(stage(rest.select("side", "word", F.col("spelt").alias("node")), "near-words"))
    near = found[0]
    for part in found[1:]:
        near = near.union(part)
    near = near.select("word", F.when(F.col("side") == "F", F.col("node")).otherwise(F.reverse("node")).alias("near")).where("word <> near")
    out = stage(near.union(near.select("near", "word")).distinct(), "near-pairs")
    release(edges, states, *found)
    free_shuffles(words.sparkSession)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: the last word of each chain of forms. Steps double, so rounds are few."""
    ahead = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next")).hint("merge")
        step = stage(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(ahead)
        ahead = step
        if ahead.where("moved").isEmpty():
            return ahead.select("word", "root")


def spelling_groups(docs: DataFrame, min_letters: int = 6, min_count: int = 5, ratio: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``min_letters`` letters and ``min_count`` occurrences.

    A word's form is the near word of the largest count, if that is ``ratio`` times its own.
    """
    runs = run_counts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), min_letters, every)
    words = stage(runs.where(F.col("n") >= min_count), "spelt-words")
    free_shuffles(docs.sparkSession)
    near = near_words(words)
    counted = near.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(best.hint("merge"), "word", "left").withColumn("form_n", -F.col("best.less"))
    is_form = F.col("form_n") >= ratio * F.col("n")
    known = stage(known.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n")), "spelling-forms")
    out = known.join(roots(known.where("form IS NOT NULL")).hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
