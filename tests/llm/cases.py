"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} tail{i % 13}," for i in range(6_000))
SHARED = " ".join(f"shared{i}" for i in range(60))
ODD_TEXTS = [
    (1, "Hello world, it's  two   blanks \n\n and\ttabs ", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n ", "fr", None), (5, LONG, "en", "a"),
    (6, SHARED, "en", "b"), (7, SHARED.upper(), "en", "b"), (8, SHARED + " more", "en", None), (9, "über straße naïve 12345 ½² ４２ ǅ ɐ̀", "de", "b"),
    (10, "a<|endoftext|>b <|endoftext|> c", "en", "a"), (11, "日本語のテキスト 😀 👩‍👩‍👧  x y", None, "c"), (12, "###", "en", "c"), (13, "one two three", "en", "c"), (14, "ONE two three", "en", "c"),
    (15, "'s 'll don't  \x1c\x1d odd\x85line", "en", ""), (None, "no id at all", "en", "a"), (16, " lead", "en", "a"), (17, "trail ", "en", "a"), (18, "x" * 5_000, "en", "a"),
]


def odd_rows():
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in ODD_TEXTS]
    return rows + [rows[5], rows[5]]


def odd(spark):
    """The awkward rows with columns whose names clash with those that operators make."""
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    for name in ("n_tokens", "size", "score", "vertex", "node", "n", "row", "_k", "_h", "t", "id", "found", "held_out", "copies"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((1, 1, 0), (5, 0, 1), (6, None, 1), (7, 1, None), (None, 1, 1), (9, 1, 0), (9, 1, 0), (999, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def rows_of(df):
    return [r.asDict() for r in df.collect()]
