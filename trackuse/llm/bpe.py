"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash cuts a text into chunks, so that passages shared by documents give
equal chunks. A chunk is encoded by itself, and kept in the worker for all documents that hold
it. A cut may fall inside a word, so every join of two chunks is repaired: the text around the
cut is encoded anew, with more words on either side until the outer ones come out as
they did in the chunks.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from tokenizers import Tokenizer

from trackuse.llm.fingerprints import rolling_hashes

CHUNK_BITS = 10
CHUNKS = 4_000  # a generation in a worker, about 8 kB each
WORDS = 150_000  # a generation in a worker
WORD_LENGTH = 40
AROUND = 2  # words on either side of a cut that are encoded anew at first
SLICE = 500_000  # characters that are encoded before rows go back to Spark
_LEAD = re.compile(r"(?<=\S)(?= \S)")


def cuts(text: str, bits: int = CHUNK_BITS) -> list[int]:
    """Where the chunks of a text end, in code points: after bytes whose rolling hash has ``bits`` low bits set."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return []
    low = np.uint64((1 << bits) - 1)
    ends = np.flatnonzero(rolling_hashes(data)[1] & low == low)
    # a cut after the first byte of a letter moves behind the whole letter
    places = ends + 1 if len(data) == len(text) else np.cumsum((data & 0xC0) != 0x80)[ends]
    return sorted({*places.tolist(), len(text)})


@F.pandas_udf(LongType())
def content_key(texts: pd.Series) -> pd.Series:
    """The smallest rolling hash of each text: texts that share most of their content mostly share it."""
    keys = []
    for text in texts:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        keys.append(int(rolling_hashes(data)[1].min()) if len(data) else 0)
    return pd.Series(keys, dtype="int64")


class Generations:
    """A table that forgets what was not asked for while ``size`` other entries came in."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: Iterable) -> set:
        """Those of the keys that are not known; the others are found in ``young`` afterwards."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        new = {k for k in keys if k not in self.young}
        again = new & self.old.keys()
        self.young.update((k, self.old[k]) for k in again)
        return new - again


class _Chunk(NamedTuple):
    """A chunk that was encoded by itself: its ids, all ids as bytes of int32, and what lies near both ends.

    ``head`` characters and ``head_ids`` bytes are the first few words, ``tail`` and ``tail_ids`` are where
    the last few begin; ``first`` and ``last`` are the ids of the innermost of these words.
    """

    ids: bytes
    head: int
    head_ids: int
    first: bytes
    tail: int
    tail_ids: int
    last: bytes


class _Join(NamedTuple):
    """Text around one or more cuts, and the ids it must begin and end with."""

    text: str
    left: bytes
    right: bytes

    def agrees(self, ids: bytes) -> bool:
        return len(ids) >= len(self.left) + len(self.right) and ids.startswith(self.left) and ids.endswith(self.right)


class Codec:
    """Encodes and decodes as the library does.

    Chunks are used with a vocabulary whose words stand for themselves, either without
    the white space between them or each with the space before it; with any other one
    whole texts go to the library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        a, b, lead = self.whole("a"), self.whole("b"), self.whole(" b")
        self.drops = all(self.whole(p) == a + b for p in ("a b", "a\nb", " a  b ", "a \n b"))
        self.leads = not self.drops and self.whole("a b") == a + lead and self.whole(" b b") == lead + lead
        plain = self.library.decoder is None
        self.pieces = pa.array([self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]) if plain else None
        self.known = Generations(WORDS)
        self.chunks = Generations(CHUNKS)
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        fits = [(s, i) for s, i in special.items() if self.whole(f"a{s}b{s}{s} b") == a + [i] + b + [i, i] + self.whole(" b")]
        self.mark, self.mark_id = fits[0] if fits else ("", -1)

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of texts; short ones go to the library as one text with a special token between them, which is cheaper."""
        joint = self.mark.join(texts)
        if not self.mark or joint.count(self.mark) != len(texts) - 1:
            return [array("i", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.array(self.library.encode_batch_fast([joint], add_special_tokens=False)[0].ids, np.int32)
        data, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark_id)).tolist()
        return [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(data)], strict=True)]

    def words(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ") if self.drops else _LEAD.split(text)

    def coded(self, texts: list[str], around: int) -> list[_Chunk | None]:
        """Chunks encoded by themselves; none for one with too few words to be left in one piece between two cuts."""
        split = [w if len(w) > 2 * around else None for w in map(self.words, texts)]
        new = list(self.known.missing({w for words in split if words for w in words}))
        known, long = self.known.young, {}
        for word, ids in zip(new, self.batch(new), strict=True):
            (known if len(word) <= WORD_LENGTH else long)[word] = ids
        look = (lambda w: known[w] if w in known else long[w]) if long else known.__getitem__
        gap = int(self.drops)
        out: list[_Chunk | None] = []
        for text, words in zip(texts, split, strict=True):
            if words is None:
                out.append(None)
                continue
            ids = list(map(look, words))
            joined = b"".join(ids)
            head = sum(map(len, words[:around])) + gap * (around - 1)
            tail = len(text) - sum(map(len, words[-around:])) - gap * (around - 1)
            tail_ids = len(joined) - sum(map(len, ids[-around:]))
            out.append(_Chunk(joined, head, sum(map(len, ids[:around])), ids[around - 1], tail, tail_ids, ids[-around]))
        return out

    def parts(self, chunks: list[str], found: dict[str, _Chunk | None]) -> list[bytes | _Join]:
        """The ids inside the chunks of a text, and the joins between them."""
        out: list[bytes | _Join] = []
        loose, left, last = "", b"", None  # text since the last chunk's inside, the ids it begins with, that chunk
        for text in chunks:
            chunk = found[text]
            if chunk is None:
                loose, last = loose + text, None
                continue
            begin = 0
            if loose:
                out.append(_Join(loose + text[: chunk.head], left, chunk.first))
                begin = chunk.head_ids
            out.append(chunk.ids[begin : chunk.tail_ids])
            loose, left, last = text[chunk.tail :], chunk.last, chunk
        if last:
            out.append(last.ids[last.tail_ids :])
        elif loose:
            out.append(_Join(loose, left, b""))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, as bytes of int32."""
        if not (self.drops or self.leads):
            return self.batch(texts)
        chunks = []
        for text in texts:
            ends = cuts(text)
            chunks.append([text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=False)])
        new = list(self.chunks.missing({c for own in chunks for c in own}))
        found = self.chunks.young
        found.update(zip(new, self.coded(new, AROUND), strict=True))
        out: list[bytes] = [b""] * len(texts)
        rest, around = list(range(len(texts))), AROUND
        while rest:
            parts = [self.parts(chunks[i], found) for i in rest]
            joins = [p for own in parts for p in own if isinstance(p, _Join)]
            repaired = dict(zip(joins, self.batch([j.text for j in joins]), strict=True))
            wider = []
            for i, own in zip(rest, parts, strict=True):
                if all(p.agrees(repaired[p]) for p in own if isinstance(p, _Join)):
                    out[i] = b"".join([repaired[p] if isinstance(p, _Join) else p for p in own])
                else:
                    wider.append(i)
            # more words around every cut; in the end no chunk is left and the text is one piece
            rest, around = wider, 2 * around
            if rest:
                again = list({c for i in rest for c in chunks[i]})
                found = dict(zip(again, self.coded(again, around), strict=True))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        if self.pieces is None:
            return pa.array(self.library.decode_batch(ids.to_pylist(), skip_special_tokens=False), pa.string())
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.pieces.take(ids.values)), " ")

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def _encoder(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            start = size = 0
            for i, text in enumerate(texts, 1):
                size += len(text)
                if size > SLICE or i == len(texts):
                    ids = coder.encode_all(texts[start:i])
                    offsets = np.cumsum([0, *(len(b) // 4 for b in ids)], dtype=np.int32)
                    lists = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(ids), np.int32))
                    columns = [batch.column("doc_id").slice(start, i - start), lists, coder.decode_all(lists)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])
                    start, size = i, 0

    return rows


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` of every row: token ids of the whole text without special tokens, and their text.

    ``path`` is the tokenizer file, at the same place on every machine. A null text counts
    as empty and gives no ids. Documents that share content are dealt to the same tasks,
    so that their chunks are encoded once there, as long as they stay among the worker's
    ``CHUNKS`` latest; large groups are split by adaptive
    execution, and then once in each part. Equal rows stay equal rows.
    """
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = dealt.withColumn("key", content_key("text")).hint("rebalance", "key")
    return dealt.select("doc_id", "text").mapInArrow(_encoder(path), "doc_id long, ids array<int>, decoded string")
