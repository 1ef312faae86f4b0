"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
SYLLABLES = "an be ci do er fu ga he in jo ka le mi no or pa re si tu ve".split()


def sentence(rng, n=9):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def doc_rows(n=120, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "\n".join(sentence(rng) for _ in range(rng.randint(3, 14)))
        if i % 11 == 0:
            text = " ".join(w + rng.choice(["%%%", "###", "&&&"]) for w in text.split())
        rows.append([i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "É", None]), len(text)])
    for k in range(1, 13):            # exact copies, near copies, shared lines
        rows[5 * k + 50][1] = rows[k][1]
        words = rows[k + 20][1].split(" ")
        words[len(words) // 2] = "edited"
        rows[5 * k + 51][1] = " ".join(words)
        rows[5 * k + 52][1] += "\n  A Shared Line Of Text \nshort"
    rows += [[n, None, "en", "a", None], [n + 1, "", "en", None, 0], [n + 2, " \n\t ", None, "b", 4], [None, rows[3][1], "de", "a", 1],
             [None, "one two", None, None, None], [7, rows[7][1], "en", "a", 3], [n + 3, sentence(rng, 30_000), "en", "b", 1],
             [n + 4, "é ü 中文 it's <|endoftext|> ½ \\[x] <s>\nA B\n\n", "fr", "b", 1]]
    return [tuple(r) for r in rows]


def documents(spark, rows=None):
    return spark.createDataFrame(doc_rows() if rows is None else rows, DOCS)


def clashing(df):
    """Extra columns with names that the operators use themselves."""
    for name in ("row", "doc", "words", "h", "own_text", "of", "m", "stratum", "class", "size", "d", "bucket", "target", "copies"):
        df = df.withColumn(name, F.lit(1))
    return df


def labels(spark, rows=None):
    rows = [(r[0], 0 if r[0] % 11 == 0 else 1, 0) for r in doc_rows() if r[0] is not None] + [(None, 1, 0), (4, None, 0), (5, 0, 0)] if rows is None else rows
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
