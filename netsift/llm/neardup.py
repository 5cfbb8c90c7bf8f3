"""Near-duplicate documents by MinHash.

A document's set is its distinct word shingles. Documents of equal sets are one
node from the start, so groups of exact copies cost one signature; the rest is
linked by ``minhash.similar_groups`` and components by alternating large-star and
small-star.

Edge cases: null, empty and blank texts have no set and are linked with nothing;
rows that share an id are one document with the links of all its rows; rows
without an id are kept and linked with nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import release, slices, stage
from netsift.llm.components import connected_components
from netsift.llm.minhash import Bands, shingle_hashes, similar_groups, words


def signatures(docs: DataFrame, shingle: int, bands: Bands) -> DataFrame:
    """``(id, n, set_a, set_b, keys, sig)`` of each ``(id, text)``: set size, 128 bits that name the set, band keys, minima."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text"):
            hashes, places = shingle_hashes([words(t) for t in frame["text"]], shingle)
            owner = np.repeat(np.arange(len(frame)), places)
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            fresh = np.ones(len(hashes), dtype=bool)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            hashes, owner = hashes[fresh], owner[fresh]
            n = np.bincount(owner, minlength=len(frame))
            has = n > 0
            out = pd.DataFrame({"id": frame["id"], "n": n, "set_a": np.int64(0), "set_b": np.int64(0)})
            out["keys"], out["sig"] = None, None
            if has.any():
                keys, sig = bands.sign(hashes, n[has])
                first = (np.cumsum(n) - n)[has]
                mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                out.loc[has, "set_a"] = np.add.reduceat(mixed, first).view(np.int64)
                out.loc[has, "set_b"] = np.bitwise_xor.reduceat((mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB), first).view(np.int64)
                at = np.flatnonzero(has)
                out.loc[has, "keys"] = pd.Series(list(keys), index=at, dtype=object)
                out.loc[has, "sig"] = pd.Series([x.tobytes() for x in sig], index=at, dtype=object)
            yield out

    return docs.select("id", "text").mapInPandas(run, "id long, n int, set_a long, set_b long, keys array<long>, sig binary")


def near_duplicates(docs: DataFrame, shingle: int = 3, num: int = 85, den: int = 100, bands: Bands | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` of every row; similarity at least ``num / den`` links."""
    bands = bands or Bands.tuned(num / den, rows=5, miss=1e-8)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stage(signatures(named, shingle, bands), "signatures")
    sets = signed.where("n > 0 AND id IS NOT NULL").groupBy("n", "set_a", "set_b").agg(F.min("id").alias("rep"))
    owned = stage(signed.select("id", "n", "set_a", "set_b").join(sets, ["n", "set_a", "set_b"], "left").select("id", "n", "rep"), "set-owners")
    reps = owned.where("id = rep").select("id").distinct()
    items = signed.where("n > 0").select("id", "n", "keys", "sig").join(reps, "id", "left_semi")
    labels, _ = similar_groups(items, lambda ids: named.join(ids, "id", "left_semi"), bands, shingle, num, den)
    release(signed)
    labels = _join_split_documents(labels, owned)
    out = owned.withColumnRenamed("id", "doc").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "doc")
    return out.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def _join_split_documents(labels: DataFrame, owned: DataFrame) -> DataFrame:
    """Where rows share an id but not a set, the id joins their components; without such rows nothing is done."""
    twice = owned.where("id IS NOT NULL AND rep IS NOT NULL").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("id")
    if twice.isEmpty():
        return labels
    split = owned.join(twice, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    return connected_components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(split))


def keep_one(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns, whatever their names. Ids are whole numbers.

    Rows that share an id and a text are one document, of which a fixed row stays; where only the id is shared, each text is
    a document of its own.
    """
    twice = stage(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("_again")), "repeated-ids")
    aside = docs.select(*[F.col(f"`{c}`").alias(f"own_{c}") for c in docs.columns])
    key, text = F.col(f"`own_{id_col}`"), F.col(f"`own_{text_col}`")
    own = [F.col(f"`own_{c}`").alias(c) for c in docs.columns]
    if twice.isEmpty():
        found = near_duplicates(docs, shingle, num, den, id_col=id_col, text_col=text_col)
        gone = found.where(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct()
        return aside.join(gone, key == F.col("_gone"), "left_anti").select(*own)
    row = F.when(F.col("_again").isNotNull(), F.xxhash64(key, text)).otherwise(key.cast("long"))
    keyed = aside.join(twice, key == F.col("_again"), "left").withColumn("_row", row)
    found = near_duplicates(keyed.select("_row", text.alias("_text")), shingle, num, den, id_col="_row", text_col="_text")
    gone = found.where(~F.col("kept")).select(F.col("_row").alias("_gone")).distinct()
    kept = keyed.join(gone, F.col("_row") == F.col("_gone"), "left_anti")
    whole = F.struct(*own)
    alike = kept.where("_again IS NOT NULL").groupBy("_row").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("_x")).select("_x.*")
    return kept.where("_again IS NULL").select(*own).unionByName(alike)
