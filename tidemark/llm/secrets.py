"""Secret scans weighed by corpus-wide ownership; DataFrame functions only.

Candidates come from four patterns. The places of a pattern's matches follow from the lengths of the text's pieces
between them. A value's hash is then counted over the whole corpus by distinct owners and repositories: what many owners, or
several owners in many repositories, carry is a copied example; what one owner alone has, in few repositories, and looks
random, is taken for a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm import common

#: In the order of the kinds: pattern, group of the value, least length of the value. "token" is the method's own kind.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "token": (r"[A-Za-z0-9_-]{20,}", 0, 20),
}
BASE = ("assign", "access", "hex")
#: An owner is a source; a repository is an owner's part in one language. A value with WIDE owners, or with two owners and SPREAD repositories,
#: is a copied example; so a value of one owner in SPREAD repositories of its own is no live credential either, but boilerplate of that owner.
WIDE, SPREAD = 3, 4
#: What looks random: distinct characters of a value.
DISTINCT = 8
MASK = "[SECRET]"


def _random(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Of each match, the length of the text since the last one, the length of the match, and its value; all without a Python worker."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), F.transform(whole, F.char_length).alias("size"), value.alias("value"))
    return F.when(text.rlike(pattern), zipped)


def candidates(df: DataFrame) -> DataFrame:
    """(row, owner, repo, kind number, start, end, value start, value hash, random) of every match that is long enough. df: row, owner, repo and the kinds' matches."""
    parts = []
    for number, (kind, (_, group, least)) in enumerate(KINDS.items()):
        m = df.select("row", "owner", "repo", F.posexplode(kind).alias("i", "m")).select("row", "owner", "repo", "i", "m.gap", "m.size", "m.value")
        end = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("row").orderBy("i"))
        m = m.withColumn("end", end.cast("long")).where(F.char_length("value") >= least)
        start = F.col("end") - F.col("size")
        m = m.select("row", "owner", "repo", F.lit(number).alias("kind"), start.alias("start"), "end", (F.col("end") - F.char_length("value")).alias("at"), F.sha2("value", 256).alias("hash"), _random(F.col("value")).alias("random"))
        parts.append(m)
    out = parts[0]
    for m in parts[1:]:
        out = out.unionByName(m)
    return out


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos, n_uses) over the corpus; counted in steps, so a value that all carry is summed up where it stands."""
    return (
        found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("uses")).groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("uses").alias("uses"))
        .groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("uses").alias("n_uses"))
    )


def judge(found: DataFrame, wide: int = WIDE, spread: int = SPREAD) -> DataFrame:
    """Adds live and example to a written table of candidates. The owners' table has a row for each value, so a value that all documents carry can be split in the join."""
    owners = common.save(ownership(found), "owners")
    joined = found.join(owners, "hash")
    live = F.col("random") & (F.col("n_owners") == 1) & (F.col("n_repos") < spread)
    return joined.withColumn("live", live).withColumn("example", (F.col("n_owners") >= wide) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= spread)))


def _prepared(df: DataFrame, id_col: str, text_col: str, owner: Column, repo: Column) -> DataFrame:
    """row names a text of an id: equal rows share it."""
    texts = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"))
    return texts.select("doc_id", "owner", "repo", *(_matches(F.col("text"), p, g).alias(k) for k, (p, g, _) in KINDS.items())).withColumn("row", F.monotonically_increasing_id())


def _spans(found: DataFrame) -> DataFrame:
    """Of each row with candidates, the counts and the joined spans."""
    names = F.array(*(F.lit(k) for k in KINDS))
    base = F.col("kind") < len(BASE)
    listed = found.where(base | F.col("live")).select("row", F.struct("start", "kind", "end").alias("span"), "kind", (base & F.col("live")).alias("live"), (base & F.col("example")).alias("example"))
    said = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    counts = [F.count_if(F.col("kind") == n).alias(f"n_{k}") for n, k in enumerate(BASE)]
    grouped = listed.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("all"), *counts, F.count_if("live").alias("n_live"), F.count_if("example").alias("n_example"))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, said))
    return grouped.select("row", *(f"n_{k}" for k in BASE), joined(F.filter("all", lambda x: x["kind"] < len(BASE))).alias("base"), joined(F.col("all")).alias("spans"), "n_live", "n_example")


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, wide: int = WIDE) -> DataFrame:
    """One row for each row of df: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    owner and repo default to the source and to the source's part in a language; null ones count as one owner with an empty name.
    Null texts count as empty, and rows without spans have the digest of an empty string. Repeated rows are each reported.
    An empty table gives no rows. Other columns of df are left out.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.col("lang") if repo is None else repo
    scanned = common.save(_prepared(df, id_col, text_col, owner, repo), "scanned")
    found = common.save(candidates(scanned), "candidates")
    spans = common.save(_spans(judge(found, wide)), "spans")
    out = scanned.select("row", "doc_id").join(spans, "row", "left")
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    return out.select("doc_id", *(count(f"n_{k}") for k in BASE), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), count("n_live"), count("n_example"))


def mask(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, wide: int = WIDE) -> DataFrame:
    """df with MASK in place of every base candidate's value unless many owners carry it, and of every live token; n_chars, where df has it, follows the text.

    Overlapping values are masked as one. Texts without such values stay as they are, null ones too. All rows and columns are kept.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.col("lang") if repo is None else repo
    key = [F.col(id_col).cast("long").alias("key_id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("key_sha")]
    texts = df.select(*key, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"))
    texts = texts.select("key_id", "key_sha", "owner", "repo", *(_matches(F.col("text"), p, g).alias(k) for k, (p, g, _) in KINDS.items()))
    some = F.lit(False)
    for k in KINDS:
        some = some | F.col(k).isNotNull()
    scanned = common.save(texts.where(some).withColumn("row", F.monotonically_increasing_id()), "scanned")
    found = common.save(candidates(scanned), "candidates")
    base = F.col("kind") < len(BASE)
    hidden = judge(found, wide).where((base & ~F.col("example")) | (~base & F.col("live")))
    cuts = hidden.groupBy("row").agg(F.sort_array(F.collect_set(F.struct(F.col("at").cast("int").alias("at"), F.col("end").cast("int").alias("end")))).alias("cuts"))
    cuts = cuts.join(scanned.select("row", "key_id", "key_sha"), "row").dropDuplicates(["key_id", "key_sha"]).drop("row")
    text = F.col(text_col)
    # Pieces between the cuts, each from the furthest end so far; a cut inside an earlier one adds nothing.
    start = F.struct(F.lit(0).alias("done"), F.lit("").alias("out"))

    def step(acc: Column, cut: Column) -> Column:
        fresh = cut["at"] >= acc["done"]
        return F.struct(F.greatest(acc["done"], cut["end"]).alias("done"), F.when(fresh, F.concat(acc["out"], F.substring(text, acc["done"] + 1, cut["at"] - acc["done"]), F.lit(MASK))).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate("cuts", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["done"] + 1, F.char_length(text))))
    marked = df.select("*", *key)
    cuts = common.save(cuts.select(F.coalesce("key_id", F.lit(-(2**63))).alias("cut_id"), F.col("key_sha").alias("cut_sha"), "cuts"), "cuts")
    joined = marked.join(cuts, (F.coalesce("key_id", F.lit(-(2**63))) == F.col("cut_id")) & (F.col("key_sha") == F.col("cut_sha")), "left")
    out = joined.withColumn(text_col, F.when(F.col("cuts").isNotNull(), masked).otherwise(text))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(F.col("cuts").isNotNull(), F.char_length(text_col).cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*df.columns)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
