"""Removal of lines that are like an earlier line, by an exact set-similarity join.

Lines are sets of lower-case words. Their words are put in one order, rare ones first,
so that two similar sets share a word among the first few of both. Only built-in
functions are used.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackuse.sources.staging import discard
from trackuse.sources.staging import stage as staged_table

SIMILARITY = Fraction(4, 5)
SKETCH_BITS = 18
HASH_BITS = 56
NEAREST = 4  # earlier rows of a word's group that a line is compared with at once
WIDER = (64, 128)  # words from which a line has 128 and 256 parity bits instead of 64
BLANKS = " \t\r\x0b\x0c"  # what stands between the words of a line


def stage(df: DataFrame, name: str) -> DataFrame:
    """A staged table; the shuffle files behind it go at once, as they are many times the input."""
    return staged_table(df, name, free_shuffles=True)


def _split(line: Column) -> Column:
    """Lower-case words; there may be empty ones."""
    text = F.lower(line)
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.split(text, " ")


def _blank(line: Column) -> Column:
    """Whether a line has no words, without splitting it."""
    return F.trim(line, F.lit(BLANKS)) == ""


def _hashes(line: Column) -> Column:
    """Hashes of the words, each once."""
    hashes = F.array_distinct(F.transform(_split(line), lambda w: F.xxhash64(w)))
    return F.array_remove(hashes, F.xxhash64(F.lit("")))


def _bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND((1 << SKETCH_BITS) - 1).cast("int")


def rarity_sketch(docs: DataFrame, text_col: str) -> bytes:
    """One byte for each hash bucket of words: four times the binary logarithm of its count.

    All words of all texts are counted, before the shuffle already. The size is fixed, so
    it can go to every task whatever the data; words that share a bucket count as equally
    rare, and any order of words gives the same result.
    """
    line = F.replace(text_col, F.lit("\n"), F.lit(" "))
    words = docs.select(F.explode(_split(line)).alias("word")).where("word <> ''")
    counts = words.groupBy(_bucket(F.xxhash64("word")).alias("bucket")).count()
    rank = F.least(F.lit(127), F.floor(4 * F.log2("count"))).cast("int")
    found = counts.select("bucket", rank.alias("rank")).toArrow()  # at most 2**SKETCH_BITS rows
    sketch = np.zeros(1 << SKETCH_BITS, np.uint8)
    sketch[found["bucket"].to_numpy()] = found["rank"].to_numpy()
    return sketch.tobytes()


def _ordered(hashes: Column, sketch: bytes) -> Column:
    """Word hashes with their rank in the leading bits, sorted: rare words first."""
    table = F.lit(sketch)
    rank = lambda h: F.ascii(F.substring(table, _bucket(h) + 1, F.lit(1)).cast("string")).cast("long")
    low = (1 << HASH_BITS) - 1
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(rank(h), HASH_BITS).bitwiseOR(h.bitwiseAND(low))))


def _ceil(share: Fraction, n: Column) -> Column:
    """The least whole number that is not below ``share * n``, without rounding errors."""
    return F.floor((n * share.numerator + (share.denominator - 1)) / share.denominator).cast("int")


def _key(id_col: str, text_col: str) -> Column:
    """The id and two hashes of the text: rows that differ in either are told apart. The key is never null."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h1"), F.hash(text_col).alias("h2"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(_key(id_col, text_col).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line", "text"))


def line_classes(docs: DataFrame, id_col: str, text_col: str, sketch: bytes, similarity: Fraction) -> DataFrame:
    """``number, doc, line, n, parity, p1, p2, p3, prefix`` of every distinct set of words.

    These are its first place, its size, parity bits and rarest words, and a number that
    is unique but means nothing; it holds once the table is staged. ``parity`` has 64 bits.
    Long lines fill them, so they have more: of the quarters q0 to q3 of 256 bits, ``parity`` is the exclusive or of
    all, ``p1`` that of q1 and q3, ``p2`` and ``p3`` are q2 and q3; null in shorter lines.
    """
    # a filter by the hashes would be moved below them and compute them once more
    lines = _lines(docs, id_col, text_col).where(~_blank(F.col("text")))
    sets = lines.select("doc", "line", _ordered(_hashes(F.col("text")), sketch).alias("s"))
    n = F.size("s")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    parity = lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(bit(x)))
    quarters = lambda mask, value: parity(F.filter("s", lambda x: x.bitwiseAND(mask << 6) == value << 6))
    more = [F.when(n >= WIDER[0], quarters(1, 1)), *[F.when(n >= WIDER[1], quarters(3, k)) for k in (2, 3)]]
    prefix = F.slice("s", 1, n - _ceil(similarity, n) + 1)
    measured = sets.select(
        F.xxhash64("s").alias("h1"),
        F.xxhash64(F.lit(1), "s").alias("h2"),
        F.struct(
            "doc", "line", n.alias("n"), parity("s").alias("parity"), *[m.alias(p) for m, p in zip(more, PARITY[1:])], prefix.alias("prefix")
        ).alias("set"),
    )
    return measured.groupBy("h1", "h2").agg(F.min("set").alias("set")).select(F.monotonically_increasing_id().alias("number"), "set.*")


def _may_match(x: dict[str, Column], y: dict[str, Column], similarity: Fraction) -> Column:
    """Length, position and parity filters; none of them drops a pair that is similar."""
    overlap = _ceil(similarity / (1 + similarity), x["n"] + y["n"])
    length = (x["n"] * similarity.denominator >= y["n"] * similarity.numerator) & (
        y["n"] * similarity.denominator >= x["n"] * similarity.numerator
    )
    position = F.least(x["n"] - x["i"], y["n"] - y["i"]) >= overlap
    most = x["n"] + y["n"] - 2 * overlap
    a, b, c, d = (x[p].bitwiseXOR(y[p]) for p in PARITY)
    ones = lambda *halves: sum(map(F.bit_count, halves[1:]), F.bit_count(halves[0])) <= most
    wider = b.isNull() | ones(b, a.bitwiseXOR(b))
    widest = c.isNull() | ones(d, c, b.bitwiseXOR(d), a.bitwiseXOR(b).bitwiseXOR(c))
    return length & position & ones(a) & wider & widest


PARITY = ("parity", "p1", "p2", "p3")
FIELDS = ("number", "n", "i", *PARITY)


def _fields(name: str) -> dict[str, Column]:
    return {f: F.col(f"{name}.{f}") for f in FIELDS}


def _prefix_rows(classes: DataFrame, *more: str) -> DataFrame:
    return classes.select("number", "n", *PARITY, *more, F.posexplode("prefix").alias("i", "word"))


def _with_partner(classes: DataFrame, similarity: Fraction) -> DataFrame:
    """``number`` of the classes that share a prefix word with another one that may match, staged.

    A semi join stops at the first partner, so a large group of copies gives no more
    rows than it has, and only what it leaves is looked at in pairs. Its rows are all
    prefix words of all classes, so they carry numbers and not places.
    """
    rows = _prefix_rows(classes)
    x, y = _fields("x"), _fields("y")
    meets = (F.col("x.word") == F.col("y.word")) & (x["number"] != y["number"]) & _may_match(x, y, similarity)
    found = rows.alias("y").join(rows.alias("x"), meets, "left_semi").select("y.number").distinct()
    return stage(found, "line-partners")


def _grouped(classes: DataFrame, similarity: Fraction) -> DataFrame:
    """Prefix words that several sets share, each with the numbers of nearby earlier sets of its group that may match."""
    group = "PARTITION BY word ORDER BY doc, line"
    packed = f"named_struct({', '.join(f"'{f}', {f}" for f in FIELDS)})"
    looked = [f"lag({packed}, {k}) OVER ({group})" for k in range(1, NEAREST + 1)]
    rows = _prefix_rows(classes, "doc", "line").select(
        "word",
        F.struct("doc", "line").alias("at"),
        *FIELDS,
        F.expr("count(1) OVER (PARTITION BY word)").alias("members"),
        F.expr(f"array({', '.join(looked)}, first_value({packed}) OVER ({group}))").alias("earlier"),
    )
    own = {f: F.col(f) for f in FIELDS}

    def fits(e: Column) -> Column:
        other = {f: e[f] for f in FIELDS}
        return e.isNotNull() & (other["number"] != own["number"]) & _may_match(other, own, similarity)

    found = F.transform(F.filter("earlier", fits), lambda e: e["number"])
    return rows.where("members > 1").withColumn("earlier", found)


def _word_sets(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``number, hashes``: the hashes of all words of every class, staged."""
    needed = stage(classes.groupBy("doc").agg(F.collect_list(F.struct("line", "number")).alias("wanted")), "line-ends")
    texts = docs.select(_key(id_col, text_col).alias("doc"), F.col(text_col).alias("text")).join(needed, "doc")
    lines = texts.select(F.split("text", "\n").alias("all"), F.inline("wanted")).where(F.col("line") < F.size("all"))
    sets = lines.select("number", _hashes(F.expr("all[line]")).alias("hashes"))
    found = stage(sets.dropDuplicates(["number"]), "line-sets")  # repeated rows have the same lines
    discard(needed)
    return found


def _verified(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The later number of every pair ``y, x`` whose sets have the wanted Jaccard similarity, staged."""
    both = (
        pairs.distinct()
        .join(sets.select(F.col("number").alias("y"), F.col("hashes").alias("wy")), "y")
        .join(sets.select(F.col("number").alias("x"), F.col("hashes").alias("wx")), "x")
    )
    common = F.size(F.array_intersect("wx", "wy"))
    union = F.size("wx") + F.size("wy") - common
    like = both.where(common * similarity.denominator >= union * similarity.numerator)
    return stage(like.select(F.col("y").alias("number")).distinct(), "line-matches")


def first_lines(docs: DataFrame, id_col: str, text_col: str, similarity: Fraction) -> DataFrame:
    """``at``: the first places of the sets that are not similar to a set that comes earlier."""
    sketch = rarity_sketch(docs, text_col)
    classes = stage(line_classes(docs, id_col, text_col, sketch, similarity), "line-classes")
    partners = _with_partner(classes, similarity)
    partnered = stage(classes.join(partners, "number", "left_semi"), "line-partnered")
    discard(partners)
    sets = _word_sets(partnered, docs, id_col, text_col)
    groups = stage(_grouped(partnered, similarity), "line-groups")
    discard(partnered)
    near = groups.select(F.col("number").alias("y"), F.explode("earlier").alias("x"))
    matched = _verified(near, sets, similarity)

    # what the nearby rows did not settle meets all earlier rows of its larger groups
    large = groups.where(F.col("members") > NEAREST + 2).drop("members", "earlier")
    open_ = large.join(matched, "number", "left_anti")
    x, y = _fields("x"), _fields("y")
    meets = (F.col("x.word") == F.col("y.word")) & (F.col("x.at") < F.col("y.at")) & _may_match(x, y, similarity)
    far = open_.alias("y").join(large.alias("x"), meets).select(F.col("y.number").alias("y"), F.col("x.number").alias("x"))
    matched = matched.unionByName(_verified(far, sets, similarity))
    discard(groups)
    discard(sets)
    return classes.join(matched, "number", "left_anti").select(F.struct("doc", "line").alias("at"))


def without_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Fraction = SIMILARITY
) -> DataFrame:
    """``docs`` with the text of every row without the lines that are like an earlier line.

    Lines are compared over all documents, in the order of id (null first), hash of the text, and place. A
    line goes if the words of some earlier line, kept or not, have at least the given
    Jaccard similarity with its own, each word counted once. Lines without words stay; so
    does a null text. No row goes: a text whose lines all go becomes empty. Rows equal in id
    and text share their decisions, so that repeated rows stay repeated; rows that
    share an id but not the text are compared like any others. Words count as equal if
    their 64-bit hashes are.
    """
    kept = first_lines(docs, id_col, text_col, similarity)
    kept = stage(kept.groupBy(F.col("at.doc").alias("kept_doc")).agg(F.collect_list("at.line").alias("kept_lines")), "line-kept")
    joined = docs.join(kept, _key(id_col, text_col) == kept["kept_doc"], "left")
    stays = lambda line, i: F.array_contains(F.coalesce(kept["kept_lines"], F.array().cast("array<int>")), i) | _blank(line)
    text = F.array_join(F.filter(F.split(docs[text_col], "\n"), stays), "\n")
    breaks = F.length(docs[text_col]) - F.length(F.replace(docs[text_col], F.lit("\n"), F.lit("")))
    text = F.when(F.size(kept["kept_lines"]) == breaks + 1, docs[text_col]).otherwise(text)  # all lines stay: nothing to split
    return joined.select(*[(text.alias(c) if c == text_col else docs[c]) for c in docs.columns])


# The same in SQL, if no two texts share an id: there the order of texts within an id is another one.
SQL = r"""
WITH texts AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS row, doc_id, text
               FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
split AS (SELECT row, string_split(text, chr(10)) AS p FROM texts),
numbered AS (SELECT row, unnest(p) AS line, generate_subscripts(p, 1) AS k FROM split),
lines AS (SELECT row, k, line, row_number() OVER (ORDER BY row, k) AS place,
  list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[ \t\r\v\f]+'), lambda w: w <> ''))) AS words FROM numbered),
classes AS (SELECT words, len(words) AS n, min(place) AS place FROM lines WHERE len(words) > 0 GROUP BY words),
tokens AS (SELECT place, n, unnest(words) AS word FROM classes),
counts AS (SELECT word, count(*) AS times FROM tokens GROUP BY word),
ordered AS (SELECT place, n, word, row_number() OVER (PARTITION BY place ORDER BY times, word) AS i FROM tokens JOIN counts USING (word)),
prefixes AS (SELECT place, n, word FROM ordered WHERE i <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT x.place AS x, y.place AS y FROM prefixes x JOIN prefixes y ON x.word = y.word AND x.place < y.place
          AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n),
common AS (SELECT y, a.n + b.n AS total, len(list_intersect(a.words, b.words)) AS shared
           FROM pairs JOIN classes a ON a.place = x JOIN classes b ON b.place = y),
matched AS (SELECT DISTINCT y AS place FROM common WHERE 5 * shared >= 4 * (total - shared)),
firsts AS (SELECT place FROM classes WHERE place NOT IN (SELECT place FROM matched)),
kept AS (SELECT row, string_agg(line, chr(10) ORDER BY k) AS text FROM lines
         WHERE len(words) = 0 OR place IN (SELECT place FROM firsts) GROUP BY row)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN texts t ON d.doc_id IS NOT DISTINCT FROM t.doc_id AND d.text = t.text LEFT JOIN kept USING (row)"""
