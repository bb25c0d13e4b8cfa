"""Small awkward tables: nulls, empty and long texts, repeated rows and clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, key string, rep string, n string, length string, hash string"
LONG = "wörd " * 3000 + "end"


def awkward(spark, texts=None):
    texts = ODD if texts is None else texts
    return spark.createDataFrame([(i, t, None, "s", None, "x", "x", "x", "x", "x", "x") for i, t in texts], SCHEMA)


ODD = [
    (5, "same text here\nand a second line"), (7, "same text here\nand a second line"), (9, None), (11, ""), (12, " \n\t "), (13, "a"), (14, LONG), (15, LONG + " tail"),
    (16, "tabs\tand   spaces   wide <|endoftext|> x  y \n z"), (16, "tabs\tand   spaces   wide <|endoftext|> x  y \n z"), (None, "a"), (18, "😀 emoji\r\n" * 40), (-3, "negative id"),
]


def rows(df):
    return [r.asDict() for r in df.collect()]
