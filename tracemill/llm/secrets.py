"""Secret scans in DataFrame operations only: candidates by pattern, judged by a random forest.

A candidate is a run of 16 or more key characters. The forest sees its length, its changes between kinds of characters,
how much of it corpus words cover, the path it stands in and the words beside it. It learns from labelled findings, and
what it scores low is a false positive.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

SHAPE = "[A-Za-z0-9+/_\\\\-]{16,}"
#: Labelled findings to learn from, at most, of each label.
SAMPLE = 10_000
#: Times the corpus must have a word for it to count as one.
COMMON_WORD = 5
TREES, TREE_DEPTH, KEEP = 30, 7, 0.5
FEATURES = ["n", "digits", "uppers", "lowers", "marks", "distinct", "changes", "vowels", "longest_letters", "covered", "slashes", "dots", "path_test", "key_before", "sign_before", "word_before", "quoted", "example_near"]


#: Characters of context: of the words beside a candidate's, and in its own word before it.
NEAR = 64


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, path, word, part, c, lead, before, before2, after, slashes, dots, quoted): every candidate with its neighbours.

    ``word`` numbers the whole text's white-space words, ``part`` the candidates in a word, ``lead`` is what stands before
    ``c`` in its word. Context is cut to NEAR characters, so a text that is one very long word is not copied a candidate.
    ``path`` is the document's source.
    """
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), path.alias("path"), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+").alias("ws"))
    spot = f"filter(transform(ws, (w_, i_) -> if(length(w_) >= 16 and w_ rlike '{SHAPE}', i_, -1)), i_ -> i_ >= 0)"
    lead = f"(?s)(.{{0,{NEAR}}}?)({SHAPE})"
    parts = f"arrays_zip(regexp_extract_all(ws[i_], '{SHAPE}', 0), regexp_extract_all(ws[i_], '{lead}', 1))"
    near = (
        f"transform({spot}, i_ -> named_struct('word', i_, 'parts', {parts}, 'before', if(i_ > 0, right(ws[i_ - 1], {NEAR}), ''), 'before2', if(i_ > 1, right(ws[i_ - 2], {NEAR}), ''), "
        f"'after', if(i_ + 1 < size(ws), left(ws[i_ + 1], {NEAR}), ''), 'own', left(ws[i_], {NEAR}), 'slashes', regexp_count(ws[i_], '/'), 'dots', regexp_count(ws[i_], '[.]'), 'quoted', ws[i_] rlike '[\"\\'].*[\"\\']'))"
    )
    each = base.select("doc_id", "path", F.explode(F.expr(near)).alias("s")).select("doc_id", "path", "s.*")
    return each.select("*", F.posexplode("parts").alias("part", "p")).select("*", F.col("p.0").alias("c"), F.col("p.1").alias("lead")).drop("parts", "p")


def features(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The candidates with the columns of FEATURES."""
    key = F.sha2("c", 256)
    runs = found.select(key.alias("key"), F.explode(F.expr("regexp_extract_all(c, '[A-Za-z]{4,}', 0)")).alias("run")).select("key", F.lower("run").alias("run")).distinct()
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), "[^a-z]+")).alias("run")).where("length(run) >= 4").groupBy("run").agg(F.count("*").alias("times")).where(F.col("times") >= COMMON_WORD)
    covered = runs.join(words, "run").groupBy("key").agg(F.sum(F.length("run")).alias("in_words"))
    out = found.withColumn("key", key).join(covered, "key", "left")
    many = lambda p: F.regexp_count("c", F.lit(p)).cast("double")
    before = F.lower(F.concat_ws(" ", "before2", "before", "lead"))
    flag = lambda x: x.cast("double")
    size = F.length("c").cast("double")
    return out.select("doc_id", "word", "part", "c", "lead", "before", "before2",
        size.alias("n"), (many("[0-9]") / size).alias("digits"), (many("[A-Z]") / size).alias("uppers"), (many("[a-z]") / size).alias("lowers"), many("[+/_-]").alias("marks"),
        F.size(F.array_distinct(F.split("c", ""))).cast("double").alias("distinct"),
        (many("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])") / size).alias("changes"), (many("[aeiouAEIOU]") / size).alias("vowels"),
        F.coalesce(F.expr("array_max(transform(regexp_extract_all(c, '[A-Za-z]+', 0), x_ -> length(x_)))"), F.lit(0)).cast("double").alias("longest_letters"),
        (F.coalesce("in_words", F.lit(0)) / size).alias("covered"), F.col("slashes").cast("double").alias("slashes"), F.col("dots").cast("double").alias("dots"),
        flag(F.coalesce(F.lower("path").rlike("test|example|sample|mock|fixture"), F.lit(False))).alias("path_test"),
        flag(before.rlike("token|secret|passw|pwd|api.?key|auth|credential|private|bearer")).alias("key_before"), flag(before.rlike("[=:]\\s*[\"']?$")).alias("sign_before"),
        F.length(F.regexp_replace("before", "[^A-Za-z]", "")).cast("double").alias("word_before"), flag(F.col("quoted")).alias("quoted"),
        flag(F.lower(F.concat_ws(" ", "before2", "before", "own", "after")).rlike("example|dummy|placeholder|changeme|xxxx")).alias("example_near"))


def format_label(c: Column, before: Column) -> Column:
    """1 for formats that only issued keys have, 0 for those that keys never have, null where the format says nothing.

    The tables have no labelled findings, so these stand in: provider prefixes and assigned long hexadecimal are
    findings; plain numbers, words of letters and dates are false positives.
    """
    issued = c.rlike("^AKIA[A-Z0-9]{16}$") | c.rlike("^gh[pousr]_[A-Za-z0-9]{36}$") | (c.rlike("^([0-9a-f]{18}|[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$") & F.lower(before).rlike("(token|secret|password|key)\\s*=?\\s*[\"']?$") & c.rlike("[0-9]") & c.rlike("[A-Fa-f]"))
    never = c.rlike("^[0-9]+$") | c.rlike("^[a-z]+$") | c.rlike("^[A-Z]+$") | c.rlike("^[A-Z][a-z]+$") | c.rlike("^[0-9-]+$") | c.rlike("^[-_/+]+$")
    return F.when(issued, F.lit(1.0)).when(never, F.lit(0.0))


def train(known: DataFrame, sample: int = SAMPLE) -> RandomForestClassificationModel | None:
    """A forest from findings with a ``label`` of 0 or 1, at most ``sample`` of each by the order of a hash; None unless both occur."""
    order = (F.xxhash64("doc_id", "word", "part"), "doc_id", "word", "part", "c")
    some = [known.where(F.col("label") == x).orderBy(*order).limit(sample) for x in (1.0, 0.0)]
    rows = saved(some[0].unionByName(some[1]).select("label", *FEATURES))
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=11, labelCol="label", featuresCol="x", minInstancesPerNode=2)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows))


def judge(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, word, part, c, score, secret): every candidate and whether the forest keeps it.

    ``labelled`` (doc_id, word, part, label) are findings; without it formats label two thirds of the documents'
    candidates. Null and empty texts have no candidates; repeated rows are scanned each; without labels of both kinds,
    the score is null and every candidate is kept.
    """
    found = saved(features(candidates(docs), docs))
    if labelled is None:
        before = F.concat_ws(" ", "before2", "before", "lead")
        known = found.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 1).withColumn("label", format_label(F.col("c"), before)).where("label is not null")
    else:
        known = found.join(labelled.select("doc_id", "word", "part", F.col("label").cast("double").alias("label")), ["doc_id", "word", "part"])
    model = train(known)
    if model is None:
        return found.select("doc_id", "word", "part", "c", F.lit(None).cast("double").alias("score"), F.lit(True).alias("secret"))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(found))
    score = F.round(vector_to_array("probability")[1], 9)
    return scored.select("doc_id", "word", "part", "c", score.alias("score")).withColumn("secret", F.col("score") >= KEEP)


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word", "part", F.length("c").cast("bigint").alias("length"), F.sha2("c", 256).alias("candidate_sha256"), "score", "secret")
