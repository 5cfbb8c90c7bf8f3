"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last one of the
prefix's encoding. ``Encoder.last_tokens`` stores it for each prefix: the token
``t`` ending at byte ``i`` is the right one if the last token of the prefix
before it and ``t`` stay apart, that is, if the pair encodes to itself. Reading
the table backwards gives the encoding of any prefix, so text can be appended
without starting anew, and after an edit only the part from the edit until the
splits fall together again is computed.

Edge cases: a null text is the empty text and has no tokens; repeated rows are
encoded each by itself; texts of any length are linear in work, for a prefix
looks back at most one longest token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import bound_batches, slices

CACHE_PIECES = 250_000
CACHE_PAIRS = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: one line per token, base64 bytes and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Encoder:
    """Encodes pieces of text; a worker keeps one for all its batches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split = regex.compile(pattern)
        self.pairs: dict[int, bool] = {}
        self.joined: dict[int, tuple[int, int]] = {}
        # pieces met lately, and those met before them: what does not come again is forgotten
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes, whole: bool = True) -> list[bytes]:
        """The defining rule, for single tokens: join the pair of lowest rank, leftmost first. Without
        ``whole`` it stops before the join that would leave one part."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            best = min(((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 62, 0))
            if best[0] == 1 << 62 or not whole and len(parts) == 2:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens that the rule joins last to get this one; the token twice if it is a single byte."""
        known = self.joined.get(token)
        if known is None:
            data = self.bytes_of[token]
            known = (token, token)
            if len(data) > 1:
                left = self.merge(data, whole=False)
                known = (self.ranks[left[0]], self.ranks[left[1]]) if len(left) == 2 else (-1, -1)
            self.joined[token] = known
        return known

    def stays(self, before: int, token: int) -> bool:
        """Whether the two tokens, side by side, encode to themselves; ``before`` -1 stands for the start.

        Takes back the latest join on either side of the border, again and again. If the pieces at the
        border could have been joined before that join was made, the tokens do not stay apart. Of equal
        ranks the left one is joined first.
        """
        if before < 0:
            return self.halves(token)[0] >= 0
        key = before << 32 | token
        known = self.pairs.get(key)
        if known is not None:
            return known
        ranks, bytes_of, left, right = self.ranks, self.bytes_of, before, token
        known, limit = True, 1 << 62
        while True:
            across = ranks.get(bytes_of[left] + bytes_of[right])
            if across is not None and across < limit:
                known = False
                break
            inner, outer = self.halves(left)[1], self.halves(right)[0]
            if inner < 0 or outer < 0:
                known = False
                break
            if inner != left and (left > right or outer == right):
                limit, left = left, inner
            elif outer != right:
                limit, right = right + 1, outer
            else:
                break
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[key] = known
        return known

    def last_tokens(self, data: bytes, known: list[int] | None = None, start: int = 0) -> list[int]:
        """The last token of each prefix of 1, 2, ... bytes; ``known`` has those of the first ``start`` bytes."""
        last = [] if known is None else known[:start]
        get, pairs, stays, longest = self.ranks.get, self.pairs, self.stays, self.longest
        for end in range(len(last) + 1, len(data) + 1):
            for begin in range(end - 1, max(-1, end - longest - 1), -1):
                token = get(data[begin:end])
                if token is None:
                    continue
                before = last[begin - 1] if begin else -1
                apart = pairs.get(before << 32 | token)
                if stays(before, token) if apart is None else apart:
                    last.append(token)
                    break
        return last

    def read_back(self, last: list[int], end: int | None = None) -> list[int]:
        """Tokens of a prefix, from the table of last tokens."""
        out, at = [], len(last) if end is None else end
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def learn_pieces(self, pieces) -> None:
        """Encode pieces in byte order: each starts from the table of the prefix it shares with the one before."""
        ranks, known = self.ranks, self.pieces
        previous, last = b"", []
        for data, piece in sorted((p.encode("utf-8", "replace"), p) for p in pieces):
            whole = ranks.get(data)
            if whole is not None:
                known[piece] = (whole,)
                continue
            common = 0
            for a, b in zip(previous, data, strict=False):
                if a != b:
                    break
                common += 1
            last = self.last_tokens(data, last, common)
            previous = data
            known[piece] = tuple(self.read_back(last))

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        split = [self.split.findall(t) for t in texts]
        needed = set()
        for pieces in split:
            needed.update(pieces)
        fresh = needed.difference(self.pieces)
        again = fresh.intersection(self.older)
        self.pieces.update((p, self.older[p]) for p in again)
        self.learn_pieces(fresh - again)
        known = self.pieces.__getitem__
        out = [list(chain.from_iterable(map(known, pieces))) for pieces in split]
        if len(self.pieces) > CACHE_PIECES // 2:
            self.pieces, self.older = {}, self.pieces
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EncodedText:
    """A text with its encoding kept up to date under appends and edits."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text, self.pieces = encoder, "", []
        self.replace(0, 0, text)

    def ids(self) -> list[int]:
        return [t for _, _, last in self.pieces for t in self.encoder.read_back(last)]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, begin: int, end: int, new: str) -> None:
        """Replace characters ``begin`` to ``end``. Pieces well before the edit stay, and so do those after
        it from the first old piece on at which the new splits fall together with the old ones; a piece
        that only grows keeps its table up to the change."""
        shift = len(new) - (end - begin)
        text = self.text[:begin] + new + self.text[end:]
        # a split looks one piece ahead at most, so the two pieces before the edit are split again
        keep = max(0, next((i for i, (at, piece, _) in enumerate(self.pieces) if at + len(piece) >= begin), len(self.pieces)) - 2)
        old = {at + shift: i for i, (at, _, _) in enumerate(self.pieces) if at >= end}
        head = self.pieces[:keep]
        at = head[-1][0] + len(head[-1][1]) if head else 0
        before = {a: (p, last) for a, p, last in self.pieces[keep:]}
        out, tail = head[:], []
        for match in self.encoder.split.finditer(text, at):
            same = old.get(match.start())
            if same is not None and match.start() >= begin + len(new) and self.pieces[same][1] == match.group() and self._tail_is_same(text, match, same, shift):
                tail = [(a + shift, p, last) for a, p, last in self.pieces[same:]]
                break
            data = match.group().encode("utf-8", "replace")
            piece, last = before.get(match.start(), ("", []))
            common = 0
            for a, b in zip(piece.encode("utf-8", "replace"), data, strict=False):
                if a != b:
                    break
                common += 1
            out.append((match.start(), match.group(), self.encoder.last_tokens(data, last, common)))
        self.text, self.pieces = text, out + tail

    def _tail_is_same(self, text: str, match, same: int, shift: int) -> bool:
        """A split depends on the text from its own start on only, so equal text after it splits alike."""
        return text[match.start() :] == self.text[match.start() - shift :]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_for(ranks: dict[bytes, int], pattern: str, name: str) -> Encoder:
    """The worker's encoder of a vocabulary, which its digest names."""
    key = (name, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """Token ids of every text: ``(id, n_tokens, ids, decoded)``, decoded being the bytes that the ids give.

    ``packed`` ids are little-endian unsigned 32-bit numbers end to end, else an array. The vocabulary is
    read once on the driver and broadcast; its size is that of the file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    with open(path, "rb") as file:
        name = hashlib.file_digest(file, "sha256").hexdigest()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(shared.value, pattern, name)
        for frame in slices(frames, "text", 1 << 22):
            ids = encoder.encode_all([t or "" for t in frame["text"]])
            yield pd.DataFrame(
                {
                    "id": frame["id"],
                    "n_tokens": [len(x) for x in ids],
                    "ids": [np.asarray(x, dtype="<u4").tobytes() if packed else np.asarray(x, dtype=np.int32) for x in ids],
                    "decoded": [encoder.decode(x) for x in ids],
                }
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    out = bound_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"id {id_type}, n_tokens long, ids {'binary' if packed else 'array<int>'}, decoded binary"
    )
    return out.withColumnRenamed("id", id_col)


def digest_ids(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: number of tokens and digests of the ids (little-endian unsigned 32 bit) and of the decoded bytes."""
    if ids.schema["ids"].dataType.typeName() == "binary":
        return ids.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(
                {
                    "id": frame["id"],
                    "n_tokens": frame["n_tokens"],
                    "ids_sha256": [hashlib.sha256(np.asarray(x, dtype="<u4").tobytes()).hexdigest() for x in frame["ids"]],
                    "decoded_sha256": [hashlib.sha256(bytes(x)).hexdigest() for x in frame["decoded"]],
                }
            )

    id_type = ids.schema[id_col].dataType.simpleString()
    out = ids.withColumnRenamed(id_col, "id").mapInPandas(run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
