"""What the tests of the text operators share."""

from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside
CLASHING = ["key", "fp", "label", "at", "line", "lines", "word", "words", "hash", "bucket", "score", "kept_doc", "kept_lines", "kept_id", "held_id", "ids", "trusted", "threshold", "seed"]



def words(rng, n, vocabulary=4_000):
    """Made-up words of letters."""
    return " ".join("w" + "".join(chr(ord("a") + int(d)) for d in str(rng.randrange(vocabulary))) for _ in range(n))


def clash(df):
    return df.select("*", *[F.lit("own").alias(c) for c in CLASHING])


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
