"""The pipeline hides what the method takes for live."""

from pyspark.sql import functions as F
from texts import awkward, rows

import corpus_pipeline


def test_bare_live_tokens_are_masked(spark):
    live, copied = "sk-live_4fG7hJ2kL9mN3pQ8rT", "example_K3yW1thManyOwners99"
    docs = [(1, f"see {live} here 😀"), (2, f"{live} and {live}"), (3, f"x {copied}"), (4, f"y {copied}"), (5, f"z {copied}"), (6, "a-long-but-plain-word-of-no-digits")]
    df = awkward(spark, docs).withColumn("source", F.when(F.col("doc_id") < 3, "a").otherwise(F.concat(F.lit("s"), F.col("doc_id"))))
    df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows(corpus_pipeline.mask_secrets(spark, df, ""))}
    want = {1: "see [SECRET] here 😀", 2: "[SECRET] and [SECRET]", 3: f"x {copied}", 4: f"y {copied}", 5: f"z {copied}", 6: docs[5][1]}
    assert got == {i: (t, len(t)) for i, t in want.items()}
