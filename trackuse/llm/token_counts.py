"""Token counts of texts by byte-pair merging, without making any token identifiers.

The symbols of a piece of text form a linked list, and a heap holds the adjacent pairs
that can merge, lowest rank first. A piece of n symbols after m merges has n - m tokens.
"""

from __future__ import annotations

import json
import re
from functools import cache, lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from tokenizers import Tokenizer

LIMIT = 2_048
KEPT = 200_000  # counts of words, and of pieces, that a worker keeps; the longest unused one goes first
KEPT_LENGTH = 40


PLACE_BITS = 40  # of a heap entry: the rank lies above the place, so that equal ranks go from left to right


def merged_count(symbols: list[int], ranks: dict[tuple[int, int], int], made: list[int]) -> int:
    """Number of symbols left once no adjacent pair has a rank; of equal ranks the leftmost pair merges first.

    ``made`` has the symbol that the pair of each rank becomes. A list links every
    symbol to the next one and the one before; merged symbols are -1.
    """
    n = len(symbols)
    heap = [ranks[p] << PLACE_BITS | i for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
    if not heap:
        return n
    heapify(heap)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    get, merges, mask = ranks.get, 0, (1 << PLACE_BITS) - 1
    while heap:
        entry = heappop(heap)
        rank, left = entry >> PLACE_BITS, entry & mask
        right = after[left]
        # a pair that changed since it was pushed has another rank, or none
        if right < 0 or get((symbols[left], symbols[right])) != rank:
            continue
        symbols[left] = symbol = made[rank]
        symbols[right] = -1
        merges += 1
        after[left] = following = after[right]
        if following >= 0:
            before[following] = left
            if (new := get((symbol, symbols[following]))) is not None:
                heappush(heap, new << PLACE_BITS | left)
        previous = before[left]
        if previous >= 0 and (new := get((symbols[previous], symbol))) is not None:
            heappush(heap, new << PLACE_BITS | previous)
    return n - merges


class Counter:
    """Counts the tokens of whole texts as the library does for a BPE vocabulary file.

    Only normalising and cutting a text into pieces is left to the library. If the file
    drops white space, words between blanks and line ends are cut apart first, and the
    count of a word is kept. A vocabulary with unknown symbols, dropout or marks at
    the front of pieces is refused.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, special = spec["model"], spec["added_tokens"]
        odd = ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in odd):
            raise ValueError(f"not a plain BPE vocabulary: {path}")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError(f"special tokens that depend on what is around them: {path}")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        numbers = self.numbers = model["vocab"]
        self.ranks = {(numbers[a], numbers[b]): rank for rank, (a, b) in reversed([*enumerate(pairs)])}
        self.made = [numbers[a + b] for a, b in pairs]
        self.end = model.get("end_of_word_suffix") or ""
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        names = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.ascii_pieces = self._ascii_pattern(spec)
        self.apart = self._drops_white_space(spec.get("pre_tokenizer"))
        self.of_piece = lru_cache(KEPT)(self._piece)
        self.of_word = lru_cache(KEPT)(self._segment)

    def _drops_white_space(self, pre_tokenizer: dict | None) -> bool:
        """True if the first step keeps nothing but matches of a pattern, and no match holds a blank or a line end."""
        steps = (pre_tokenizer or {}).get("pretokenizers") or [pre_tokenizer or {}]
        keeps_matches = steps[0].get("type") == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        probes = [a + b + a for a in ("a", "1", "'", "é", "") for b in (" ", "\n", " \n ")]
        return bool(keeps_matches) and all(self._pieces(p) == self._pieces(p[:1].strip()) * 2 for p in probes)

    @staticmethod
    def _ascii_pattern(spec: dict) -> re.Pattern | None:
        """What cuts a lower-cased text of visible ASCII letters as the library would, if the file has only steps known here."""
        normalizer, pre_tokenizer = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        if [n["type"] for n in normalizer.get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
            return None
        cut, *rest = pre_tokenizer.get("pretokenizers") or [{}]
        if [p["type"] for p in rest] != ["ByteLevel"] or rest[0]["use_regex"] or rest[0]["add_prefix_space"]:
            return None
        if cut["type"] != "Split" or cut["behavior"] != "Removed" or not cut["invert"] or "Regex" not in cut["pattern"]:
            return None
        pattern = cut["pattern"]["Regex"].replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
        return None if r"\p" in pattern or "(" in pattern else re.compile(pattern)

    def _pieces(self, text: str) -> list[str]:
        if self.ascii_pieces and text.isascii() and text.isprintable() and " " not in text:
            return self.ascii_pieces.findall(text.lower())
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        return [p for p, _ in self.pre_tokenizer.pre_tokenize_str(text)] if self.pre_tokenizer else [text]

    def _piece(self, piece: str) -> int:
        symbols = [*piece]
        if symbols:
            symbols[-1] += self.end
        # a symbol outside the vocabulary gives no token: the file has no unknown token
        return merged_count([self.numbers[s] for s in symbols if s in self.numbers], self.ranks, self.made)

    def _segment(self, text: str) -> int:
        return sum(self.of_piece(p) if len(p) <= KEPT_LENGTH else self._piece(p) for p in self._pieces(text))

    def _plain(self, text: str) -> int:
        if not self.apart:
            return self._segment(text)
        of_word, of_long = self.of_word, self._segment
        return sum(of_word(w) if len(w) <= KEPT_LENGTH else of_long(w) for w in text.replace("\n", " ").split(" "))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.special or "<" not in text and not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_count(path: str):
    """A column function: the number of tokens of each text; a null text counts as empty and has none."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        own = counter(path)
        return pd.Series([own.count(t) for t in texts], dtype="int64")

    return count


def counted(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; the whole text is counted, without special tokens added.

    ``path`` is the vocabulary file, at the same place on every machine. Special strings
    inside a text are one token each, as they are for the library. A null or empty text
    has no bytes and no tokens. Equal rows stay equal rows, a null id stays null, and
    other columns play no part. Nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        token_count(path)(text).alias("n_tokens"),
    )
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
