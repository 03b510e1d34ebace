"""Documents that operators must bear: nulls, empty and long texts, repeated rows, clashing columns."""

LONG = "long " * 3000 + "x" * 20_000
ROWS = [
    (1, None), (2, ""), (3, "one two"), (4, "same text here\nsecond line\nthird line"), (5, "same text here\nsecond line\nthird line"), (5, "same text here\nsecond line\nthird line"),
    (None, "no id but a text of six words"), (7, LONG), (8, "été　Ω \U0001f600\n\n\t"), (9, " \n "), (10, "<|endoftext|> and more"),
]
SCHEMA = "doc_id long, text string, digest string, found string, score string, shard string, bucket string, n string, sid string, start string, run string, lang string"


def odd_docs(spark):
    return spark.createDataFrame([(i, t, *["x"] * 9, "en") for i, t in ROWS], SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
