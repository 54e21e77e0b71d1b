"""Odd tables that every operator must take."""

ODD = [
    (1, "", "en"), (2, None, None), (3, "   \n\t ", "en"), (4, "one", ""), (5, "a b c d e f g h i j k l", "fr"), (5, "a b c d e f g h i j k l", "fr"), (None, "a b c d e f g h i j k l", "fr"),
    (6, "é日本 <|endoftext|> x's  ▁y \x00 İ", "en"), (7, "word " * 30_000, "en"), (8, "x" * 100_000, None),
]


def odd(spark):
    """Odd documents, with further columns that clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    for c in ("n_words", "row", "lo", "ids", "part", "score", "kept", "value", "number", "id", "known", "stratum"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return odd(spark).limit(0)
