"""Small documents with the odd cases every operator must take: nulls, empty and long texts, repeats, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    long_text = prose(random.Random(5), 20_000)
    return [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "   \n ", "en", "s", 5), (903, "one", "en", "s", 3),
            (904, long_text, "en", "s", len(long_text)), (905, "twice the same", "en", "s", 14), (905, "twice the same", "en", "s", 14),
            (906, "é漢😀 \x00 ñ", "xx", "s", 7)]


def frame(spark, rows, extra: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    if not extra:
        return df
    # columns that clash with names the operators use inside
    return df.withColumns({c: F.lit("clash") for c in ("t", "x", "score", "predicted", "node", "key", "n", "label", "features", "kind", "pos", "start", "n_words", "_drop", "_t", "_d", "_h", "row", "node")})
