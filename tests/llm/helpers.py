"""Small documents tables with the cases that every operator must bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, partitions=3):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions)


def edge_rows():
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    return [
        (1, "the quick brown fox jumps over the lazy dog"), (2, "the quick brown fox jumps over the lazy dog"), (3, None), (4, ""), (5, " \t\n "),
        (6, long), (7, long), (8, "one"), (9, "Ünïcödé  ß 漢字 \U0001F600 <|endoftext|> it's 12 it'll"), (10, "\x00\x1f\x85  a\r\nb"),
        (None, "no id"), (11, "same row"), (11, "same row"), (12, "a" * 5000), (13, "!" * 3000 + " " * 2000),
    ]


def clashing(df):
    """The same table with columns that are named as operators name theirs."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("kept", "size", "score", "digest", "key", "slice", "ids", "file", "row", "label", "kind", "start", "component_id")})
