"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, size long, score double, _row long, h long"

LONG = " ".join(f"w{i % 977} the of" for i in range(30_000))


def documents(spark, sf=None, more=()):
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", "en", "a"),
        (4, "one two\nthree four  ", "en", "b"), (5, "one two\nthree four  ", "en", "b"),
        (6, LONG, "en", "a"), (7, "All Rights Reserved. all-rights reserved; CC-BY 4.0 cc\nby", None, None),
        (8, "a b c d e f g h i " * 6, "en", "a"), (9, "ÉKİ CC-BY-SA-4.0 x", "fr", "c"),
        (4, "one two\nthree four  ", "en", "b"), (None, "a null id, with some words of its own", "en", "a"),
        *more,
    ]
    full = [(i, t, la, so, None if t is None else len(t), -1, -2, -0.5, 0, 7) for i, t, la, so in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if sf is None:
        return df
    given = spark.read.parquet(f"{sf}/documents.parquet")
    return df.unionByName(given.withColumn("doc_id", given.doc_id + 1000), allowMissingColumns=True)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)
