"""Small tables with the awkward rows every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))


def documents(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash with
    names used inside the operators."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name in ("words", "key", "size", "fp", "component", "doc", "line", "_gone", "id", "y", "s", "_source", "a.b"):
        df = df.withColumn(name, df["lang"])
    return df


AWKWARD = [
    (None, "a text without an id but with quite a few words in it"), (None, None), (1, None), (2, ""), (3, "   \n\t "),
    (4, "same words here in this text that is repeated below and again"), (5, "same words here in this text that is repeated below and again"),
    (5, "same words here in this text that is repeated below and again"), (6, LONG), (7, "x"),
]
