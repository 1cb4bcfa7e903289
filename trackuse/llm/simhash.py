"""SimHash fingerprints of documents, linked within a small Hamming radius.

Candidates meet on keys by the pigeonhole principle; inside a key group the
fingerprints lie as 64 vertical bit planes and one fingerprint is compared with all
of them at once, by carry-save counters over the planes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trackuse.operators.components import connected_components
from trackuse.sources.staging import stage

BITS = 64
SEED = 42
WORDS = 3
RADIUS = 2
BLOCK = 4_096


def simhash(text: str | None) -> int:
    """The unsigned 64-bit fingerprint: a bit is set if over half the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - WORDS + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[WORDS - 1 :] - 1).tolist()
    counts = np.zeros(BITS, np.int64)
    for first in range(0, n, 65_536):
        spans = zip(starts[first : first + 65_536], stops[first : first + 65_536], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > n))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


@F.pandas_udf(LongType())
def simhash_of(texts: pd.Series) -> pd.Series:
    return pd.Series([_signed(simhash(t)) for t in texts], dtype="int64")


def _pieces(bits: list[int], parts: int) -> list[list[int]]:
    return [[int(i) for i in p] for p in np.array_split(bits, parts)]


def _masks(radius: int) -> list[int]:
    """Bit masks; two fingerprints within the radius agree on at least one of them.

    The bits are dealt to ``radius + 1`` pieces of which one must agree, and the
    other bits again, so that a key has more than half of the bits.
    """
    masks = []
    for piece in _pieces(list(range(BITS)), radius + 1):
        rest = [i for i in range(BITS) if i not in piece]
        masks += [sum(1 << i for i in piece + sub) for sub in _pieces(rest, radius + 1)]
    return masks


def bit_planes(members: np.ndarray) -> tuple[list[int], int]:
    """Plane i has bit i of every member; the other value has a bit for every member."""
    bits = np.unpackbits(members.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = [int.from_bytes(np.packbits(bits[:, i], bitorder="little").tobytes(), "little") for i in range(BITS)]
    return planes, (1 << len(members)) - 1


def within_radius(query: int, planes: list[int], full: int, radius: int) -> int:
    """The members, as bits, at most ``radius`` bits from ``query``; ``planes[i]`` has bit i of all members.

    Distances are counted in carry-save form: ``counters[k]`` holds bit k of every
    member's distance. A member whose distance overflows the counters is out for
    good, and the block is abandoned once no member is in.
    """
    width = (radius + 1).bit_length()
    counters = [((1 << width) - 1 - radius >> k & 1) * full for k in range(width)]
    alive = full
    for i, plane in enumerate(planes):
        carry = (plane ^ full if query >> i & 1 else plane) & alive
        for k in range(width):
            if not carry:
                break
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        alive &= ~carry
        if not alive:
            break
    return alive


def group_links(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected inside one key group: a spanning forest, not all pairs."""
    values = [int(v) for v in members]
    blocks = [(at, *bit_planes(members[at : at + BLOCK])) for at in range(0, len(values), BLOCK)]
    links, parts = [], []
    for i, value in enumerate(values[:-1]):
        near = 0
        for at, planes, full in blocks[i // BLOCK :]:
            near |= within_radius(value, planes, full, radius) << at
        near &= -(2 << i)
        own, others = 1 << i, []
        for part in parts:
            if part & own:
                own |= part
            else:
                others.append(part)
        near &= ~own
        parts = []
        for part in others:
            common = part & near
            if common:
                links.append((value, values[common.bit_length() - 1]))
                own |= part
            else:
                parts.append(part)
        near &= ~own
        while near:
            last = near.bit_length() - 1
            links.append((value, values[last]))
            near ^= 1 << last
            own |= 1 << last
        parts.append(own)
    return links


_LINK = StructType([StructField("src", LongType()), StructField("dst", LongType())])


def _linker(radius: int):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Key groups in a row; the last group of a batch waits for the next batch."""
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            key, value = batch["key"].to_numpy(), batch["fp"].to_numpy()
            edges = np.flatnonzero(key[1:] != key[:-1]) + 1
            if waiting and waiting[-1][0][0] != key[0]:
                yield _links_of(waiting, radius)
                waiting = []
            if len(edges):
                done = [(key[: edges[-1]], value[: edges[-1]])]
                yield _links_of(waiting + done, radius)
                waiting = []
            last = edges[-1] if len(edges) else 0
            waiting.append((key[last:], value[last:]))
        if waiting:
            yield _links_of(waiting, radius)

    return link


def _links_of(parts: list[tuple[np.ndarray, np.ndarray]], radius: int) -> pd.DataFrame:
    key = np.concatenate([k for k, _ in parts])
    value = np.concatenate([v for _, v in parts])
    bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    links: list[tuple[int, int]] = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            links += group_links(value[a:b].view(np.uint64), radius)
    return pd.DataFrame([(_signed(x), _signed(y)) for x, y in links], columns=["src", "dst"], dtype="int64")


def _split(keyed: DataFrame, largest: int) -> DataFrame:
    """``key, fp`` with groups of more than ``largest`` rows dealt to blocks, each block with every other one as a group."""
    blocks = F.ceil(F.col("count") / largest).cast("int")
    large = stage(keyed.groupBy("key").count().where(F.col("count") > largest).select("key", blocks.alias("blocks")), "simhash-large")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != own)
    group = lambda b: F.xxhash64("key", F.least(own, b), F.greatest(own, b))
    groups = F.when(F.col("blocks").isNull(), F.array("key")).otherwise(F.transform(others, group))
    return keyed.join(large, "key", "left").select(F.explode(groups).alias("key"), "fp")


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, largest: int = BLOCK) -> DataFrame:
    """``src, dst``: links that connect all of the distinct ``fp`` within the radius of each other.

    Every fingerprint is sent once per mask. A key holds more than half of its bits,
    so a group has only fingerprints that are near anyway; a dense one is compared in
    bit-sliced form and gives fewer links than it has members. A group of more than
    ``largest`` members is split, and its blocks meet two at a time in tasks of their own.
    """
    masks = F.array([F.struct(F.lit(i).alias("m"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(_masks(radius))])
    keyed = distinct.select("fp", F.explode(masks).alias("k")).select(
        F.xxhash64("k.m", F.col("fp").bitwiseAND(F.col("k.mask"))).alias("key"), "fp"
    )
    return _split(keyed, largest).repartition("key").sortWithinPartitions("key").mapInPandas(_linker(radius), _LINK)


def near_duplicate_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: documents joined by chains of near fingerprints.

    A null text counts as empty; texts without words have fingerprint zero and are
    linked with each other. ``component_id`` is the smallest id of the component, its
    own included, null if all its ids are null. Equal rows stay equal rows. Equal
    fingerprints are combined before they are compared, so copies cost nothing.
    """
    rows = stage(docs.select(F.col(id_col).alias("doc_id"), simhash_of(text_col).alias("fp")), "simhash")
    labelled = _labelled(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), radius)
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = stage(labelled.join(least, "label").select("fp", "component_id"), "simhash-components")
    return rows.join(ids, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _labelled(classes: DataFrame, radius: int) -> DataFrame:
    """``fp, least`` of all distinct fingerprints, with the ``label`` of their component, staged."""
    classes = stage(classes, "simhash-classes")
    labels = connected_components(fingerprint_links(classes.select("fp"), radius))
    labelled = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )
    return stage(labelled, "simhash-labels")


def keep_one_per_component(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """The rows of ``docs``, one for each component: the one with the smallest id.

    A row without an id stays only if its component has no row with one. Of several rows
    with that id, or without any, the one whose text has the smallest hash stays, and of rows
    equal in id and text the one whose other columns come first.
    """
    key = [F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h1"), F.hash(text_col).alias("h2")]
    rows = stage(docs.select(F.struct(*key).alias("place"), simhash_of(text_col).alias("fp")), "simhash")
    labelled = _labelled(rows.groupBy("fp").agg(F.min("place").alias("least")), radius)
    first = labelled.groupBy("label").agg(F.min("least").alias("kept_place"))
    kept = stage(first.select("kept_place"), "simhash-kept")
    # a place is never null, and structs with null fields are equal to themselves
    found = docs.join(kept, F.struct(*key) == kept["kept_place"], "left_semi")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    whole = found.groupBy(*key, F.col(id_col).alias("_id")).agg(
        F.first(text_col).alias("_text"), F.min(F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0)).alias("_rest")
    )
    columns = {id_col: F.col("_id"), text_col: F.col("_text")} | {c: F.col("_rest")[c] for c in others}
    return whole.select(*[columns[c].alias(c) for c in docs.columns])
