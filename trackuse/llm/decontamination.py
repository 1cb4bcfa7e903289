"""Benchmark passages in documents, found by templates, so that changed numbers and names don't hide them.

Numbers, names and units become typed slots. Windows of words are joined by two hashes, word
for word in any case and as a template;
windows whose words changed must agree with their run on what every slot value became.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackuse.sources.staging import stage

WINDOW = 8
LITERALS = 4
SHARE = 0.5
FILTER_BITS = 20
KNOWN = 200_000  # words kept at a time in a worker
# numbers, runs of letters, single letters of scripts without spaces, ends of sentences
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_\u3040-\u30ff\u3400-\u9fff]+|[\u3040-\u30ff\u3400-\u9fff]|[.!?\n]")
# Words that are units after a number.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams ton tons ounce ounces pound pounds ml l "
    "liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months "
    "year years cent cents dollar dollars euro euros percent degree degrees watt watts volt volts byte bytes".split()
)
LITERAL, NUMBER, UNIT, CAPITAL, END = range(5)
_SLOTS = {NUMBER: "number", UNIT: "unit", CAPITAL: "name"}
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class _Words(dict):
    """Word to its index in ``hashes`` and ``kinds``, which grow by doubling; new words are added when asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.kinds = np.zeros(1_024, np.uint64), np.zeros(1_024, np.int8)

    def __missing__(self, word: str) -> int:
        if word in ".!?\n":
            kind = END
        elif word[0].isdigit():
            kind = NUMBER
        elif word in UNITS:
            kind = UNIT
        else:
            kind = CAPITAL if word[0].isupper() else LITERAL
        at = self[word] = len(self)
        if at == len(self.hashes):
            self.hashes, self.kinds = (np.concatenate((a, np.zeros_like(a))) for a in (self.hashes, self.kinds))
        self.hashes[at], self.kinds[at] = _hash(word.lower()), kind
        return at


_SLOT_HASH = np.array([0, *(_hash(f"<{_SLOTS[k]}>") for k in (NUMBER, UNIT, CAPITAL)), 0], np.uint64)


class Templates:
    """Turns texts into hashed windows of their templates."""

    def __init__(self) -> None:
        self.words = _Words()

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Hash and slot type (``LITERAL``: none) of every word, and the words if there is a slot.

        A capitalised word is a name unless it starts a sentence; a unit must follow a number.
        """
        if len(self.words) > KNOWN:
            self.words = _Words()
        tokens = TOKEN.findall(text or "")
        at = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        kinds, hashes = self.words.kinds[at], self.words.hashes[at]
        before = np.concatenate(([END], kinds[:-1]))
        slots = np.where((kinds == CAPITAL) & (before == END), LITERAL, kinds)
        slots[(kinds == UNIT) & (before != NUMBER)] = LITERAL
        inside = np.flatnonzero(kinds != END)
        slots, hashes = slots[inside], hashes[inside]
        words = [tokens[i] for i in inside.tolist()] if slots.any() else []
        return hashes, slots, words


def window_hashes(hashes: np.ndarray, slots: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words; one with fewer than ``LITERALS`` plain words is hashed as it is."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    if not slots.any():
        return _rolled(hashes, width)
    plain = np.concatenate(([0], np.cumsum(slots == LITERAL)))
    enough = plain[width:] - plain[:-width] >= LITERALS
    return np.where(enough, _rolled(np.where(slots == LITERAL, hashes, _SLOT_HASH[slots]), width), _rolled(hashes, width))


def _rolled(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out = out * _BASE + values[k : k + n]
    return (out ^ out >> np.uint64(31)) * _MIX


_WINDOW_TYPE = "pos int, hash long, slots array<string>"


def _values(slots: np.ndarray, words: list[str], start: int, width: int) -> list[str]:
    """The slot values of a window; none if it is hashed as it is."""
    kinds = slots[start : start + width].tolist()
    if kinds.count(LITERAL) < LITERALS:
        return []
    return [f"{_SLOTS[k]}:{words[start + i].lower()}" for i, k in enumerate(kinds) if k]


def _hashed(hashes: np.ndarray, slots: np.ndarray, width: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Whether they are templates, places and hashes of all windows word for word, and of those whose template is another one."""
    if len(hashes) < width:
        return
    literal = _rolled(hashes, width)
    yield False, np.arange(len(literal)), literal
    if slots.any():
        template = window_hashes(hashes, slots, width)
        other = np.flatnonzero(template != literal)
        yield True, other, template[other]


def _item_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All windows of the items; an item that is shorter than a window is one window.

    A capitalised first word may be a name or not, so it is read alone and as it is after a word.
    """
    templates = Templates()
    for batch in batches:
        out = []
        for item, text in zip(batch["id"], batch["text"], strict=True):
            inside = [x[1:] for x in templates.read(f"a {text or ''}")]
            for hashes, slots, words in (templates.read(text), inside):
                width = min(WINDOW, len(hashes))
                if not width:
                    continue
                total = len(hashes) - width + 1
                for template, at, found in _hashed(hashes, slots, width):
                    for i, h in zip(at.tolist(), found.view(np.int64).tolist(), strict=True):
                        out.append((item, i, h, _values(slots, words, i, width) if template else [], width, total))
        yield pd.DataFrame(out, columns=["item_id", "pos", "hash", "slots", "width", "total"])


def _document_rows(passing: np.ndarray, widths: list[int]):
    """The windows of the documents whose hash passes a bit table of fixed size."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates()
        for batch in batches:
            out = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                hashes, slots, words = templates.read(text)
                for width in widths:
                    for template, at, found in _hashed(hashes, slots, width):
                        met = passing[found >> np.uint64(64 - FILTER_BITS)]
                        if width < WINDOW and not template:  # items of one window: any place will do
                            at, found = at[met], found[met]
                            met = np.unique(found, return_index=True)[1]
                        for i, h in zip(at[met].tolist(), found[met].view(np.int64).tolist(), strict=True):
                            out.append((doc, i, h, _values(slots, words, i, width) if template else []))
            yield pd.DataFrame(out, columns=["doc_id", "pos", "hash", "slots"])

    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """``doc_id, item_id, matched_windows, item_windows, changed_slots`` of every document that holds an item.

    A document holds an item if at least ``share`` of the item's windows occur in it. A
    window with the item's own words always counts. One with changed slots counts if they
    agree with its run, the windows at the same distance: there every slot value of the item
    stands for the value that most windows give it. Different values may become equal, also equal
    to one that stays. Texts without words hold nothing and match
    nothing, null texts and rows with a null id neither; rows with the same id count as
    one document, so do equal item ids. An item of fewer than eight words is one window,
    and one of fewer than four is looked for word for word only. In Chinese and Japanese
    every letter is a word. Windows of the documents first pass a bit table
    of fixed size; with a very large benchmark it lets all pass, and the join decides.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _holding(rows, benchmark, share, "long")


def _holding(docs: DataFrame, benchmark: DataFrame, share: float, id_type: str) -> DataFrame:
    """The same for documents ``id, text`` whose ids have the given type."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("id"), "text")
    items = stage(items.mapInPandas(_item_rows, f"item_id long, {_WINDOW_TYPE}, width int, total int").distinct(), "benchmark-windows")
    top = F.shiftrightunsigned("hash", 64 - FILTER_BITS).cast("int")
    passing = np.zeros(1 << FILTER_BITS, bool)
    passing[items.select(top.alias("bit")).distinct().toArrow()["bit"].to_numpy()] = True  # at most 2**FILTER_BITS rows
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    found = docs.mapInPandas(_document_rows(passing, widths), f"doc_id {id_type}, {_WINDOW_TYPE}")
    own = items.select("item_id", "hash", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), F.col("total").alias("item_windows"))
    met = found.join(own, "hash").where(F.size("slots") == F.size("item_slots"))
    met = met.select(
        "doc_id", "item_id", "item_pos", "item_windows", (F.col("pos") - F.col("item_pos")).alias("shift"),
        F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")).alias("slots"),
    ).distinct()
    met = stage(met, "benchmark-meets")
    run = ["doc_id", "item_id", "item_windows", "shift"]
    votes = met.select(*run, F.explode(F.array_distinct("slots")).alias("slot")).groupBy(*run, "slot.a", "slot.b").count()
    # most windows, then the value itself
    best = votes.groupBy(*run, "a").agg(F.max(F.struct("count", F.expr("a = b").alias("same"), "b"))["b"].alias("b"))
    chosen = best.groupBy(*run).agg(F.collect_list(F.struct("a", "b")).alias("chosen"))
    same = F.forall("slots", lambda s: s["a"] == s["b"])
    agrees = F.size(F.array_except("slots", F.coalesce("chosen", F.array().cast(chosen.schema["chosen"].dataType)))) == 0
    runs = met.join(chosen, run, "left").where(same | agrees).groupBy(*run).agg(
        F.collect_set("item_pos").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")
    )
    changed = F.size(F.filter("slots", lambda s: s["a"] != s["b"]))
    held = runs.groupBy("doc_id", "item_id", "item_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("matched_windows"),
        F.max(changed).alias("changed_slots"),
    )
    return held.where(F.col("matched_windows") >= share * F.col("item_windows")).select(
        "doc_id", "item_id", "matched_windows", "item_windows", "changed_slots"
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are.

    Every row is judged by its own text, also without an id or with the id of another row.
    """
    key = F.concat_ws(":", F.col(id_col).cast("string"), F.hex(F.xxhash64(text_col)), F.hex(F.hash(text_col)))
    rows = docs.select(key.alias("id"), F.col(text_col).alias("text")).where("text is not null")
    held = stage(_holding(rows, benchmark, SHARE, "string").select(F.col("doc_id").alias("held_id")).distinct(), "contaminated")
    return docs.join(held, key == held["held_id"], "left_anti")
