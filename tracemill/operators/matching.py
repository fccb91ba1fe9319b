"""Which catalog entry the name of a model means: by id, display name, part of the name, similar words or nearest version.

Every way gives candidates (model, rank, id) by a join on a key, and the candidate of least rank is taken, so names are
matched all at once whatever way each of them takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import match_key, strip_date

# Words that tell a model's size or kind and are never dropped, the families of one vendor that puts its version behind them, and words that only say how hard such a model thought.
TIERS = ("mini", "nano", "micro", "lite", "flash", "pro", "max", "plus", "turbo", "ultra", "small", "medium", "large", "xl", "haiku", "sonnet", "opus", "air", "fast", "instant", "coder", "codex", "vision", "omni", "audio", "image", "embed", "embedding", "reasoner", "chat", "base")
FAMILIES, FIRST, EFFORTS = ("opus", "sonnet", "haiku"), "claude", ("max", "medium")


def _listed(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(repr, words)) + ")"


def plain_name(model: Column) -> Column:
    """A model's name without the path of its provider and what stands behind it in brackets."""
    last = F.trim(F.substring_index(F.trim(model), "/", -1))
    return F.trim(F.regexp_replace(last, r"(\s*(\[[^\[]*\]|\([^(]*\)))+$", ""))


def display_key(name: Column) -> Column:
    """Letters and digits of a display name, without a number of four to eight digits at its end."""
    flat = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    return F.regexp_replace(flat, "^(.*[^0-9])[0-9]{4,8}$", "$1")


def similarity_words(name: Column) -> Column:
    """Runs of letters and runs of digits, without numbers of six digits or more."""
    return F.filter(F.regexp_extract_all(F.lower(strip_date(name)), F.lit("[a-z]+|[0-9]+"), F.lit(0)), lambda w: ~w.rlike("^[0-9]{6,}$"))


def version_runs(words: Column) -> Column:
    """The numbers that follow each other in a list of words, sorted."""
    return F.sort_array(F.regexp_extract_all(F.array_join(words, " "), F.lit("[0-9]+(?: [0-9]+)*"), F.lit(0)))


def spellings(names: DataFrame) -> DataFrame:
    """(model, base, n, name): each name as written (n 0), and with a version in front of its family put behind it or the vendor's word added."""
    rows = names.withColumn("ws", F.filter(F.split(match_key(F.col("base")), "[-:]"), lambda w: w != "")).withColumn("f", F.expr(f"coalesce(array_position(transform(ws, w -> w in {_listed(FAMILIES)}), true), 0L)"))
    number = "rlike '^[0-9]+$'"
    turned = F.expr(f"if(get(ws, 0) = '{FIRST}' and f > 2 and forall(slice(ws, 2, cast(f - 2 as int)), w -> w {number}), array_join(concat(array('{FIRST}', ws[f - 1]), slice(ws, 2, cast(f - 2 as int)), slice(ws, cast(f + 1 as int), size(ws))), '-'), null)")
    added = F.expr(f"if(get(ws, 0) in {_listed(FAMILIES)} and get(ws, 1) {number}, concat('{FIRST}-', array_join(ws, '-')), null)")
    each = rows.select("model", "base", F.posexplode(F.array(F.col("base"), turned, added)).alias("n", "name"))
    return each.where("name is not null")


def windows(spelt: DataFrame) -> DataFrame:
    """(model, n, w, win): parts of names of whole words, w 1 the longest and of these the last; none that drops a tier's word from the end.

    A part starts with a letter and has a digit or two words.
    """
    parts = spelt.withColumn("ps", F.regexp_extract_all("name", F.lit("[-:]*[^-:]+"), F.lit(0))).withColumn("ws", F.transform("ps", lambda p: F.lower(F.regexp_replace(p, "^[-:]+", "")))).where("size(ps) > 1")
    cut = "flatten(transform(sequence(1, size(ps) - 1), k -> transform(sequence(1, size(ps) - k + 1), s -> named_struct('k', k, 's', s, 'win', regexp_replace(array_join(slice(ps, s, k), ''), '^[-:]+', ''), 'kept', not exists(slice(ws, s + k, size(ws)), w -> w in " + _listed(TIERS) + ")))))"
    each = parts.select("model", "n", F.explode(F.expr(cut)).alias("c")).where("c.kept and c.win rlike '^[A-Za-z]' and (c.k > 1 or c.win rlike '[0-9]')")
    order = Window.partitionBy("model", "n").orderBy(F.desc("c.k"), F.desc("c.s"))
    return each.select("model", "n", F.row_number().over(order).alias("w"), F.col("c.win").alias("win"))


def indexes(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, id, consensus) of ids, with and without their dates, the newest date for a name without; (key, id) of display names.

    A display name that several vendors use is the one's whose name it begins with, else anyone's if all ask the same.
    """
    ids = entries.select("id", "consensus", match_key(F.col("id")).alias("key"), match_key(strip_date(F.col("id"))).alias("bare"))
    full = ids.groupBy("key").agg(F.min_by(F.struct("id", "consensus"), "id").alias("e"))
    bare = ids.where("bare <> key").groupBy(F.col("bare").alias("key")).agg(F.max_by(F.struct("id", "consensus"), "id").alias("e")).join(full.select("key"), "key", "left_anti")
    exact = full.unionByName(bare).select("key", "e.*")
    named = entries.where("not consensus and name is not null").withColumn("key", display_key(F.col("name"))).withColumn("owner", F.expr("startswith(key, provider)"))
    shown = named.groupBy("key").agg(F.count("*").alias("n"), F.count_if("owner").alias("owners"), F.min("id").alias("any"), F.min(F.when(F.col("owner"), F.col("id"))).alias("own"), (F.count_distinct(F.struct("rates.input", "rates.output", F.coalesce("rates.cache_read", F.lit(-1.0)))) == 1).alias("agree"))
    return exact, shown.select("key", F.expr("case when n = 1 then any when owners = 1 then own when agree then any end").alias("id")).where("id is not null")


def found(names: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    """``names`` with ``id``, ``consensus`` and ``by_id`` of what the name in ``column`` is listed as: a vendor's id, its display name, then any id."""
    exact, shown = indexes(entries)
    rows = names.withColumn("k1", match_key(F.col(column))).withColumn("k2", match_key(strip_date(F.col(column)))).withColumn("k3", display_key(F.col(column)))
    one = lambda k: exact.select(F.col("key").alias(k), F.struct("id", "consensus").alias(f"e{k}"))
    rows = rows.join(one("k1"), "k1", "left").join(one("k2"), "k2", "left").join(shown.select(F.col("key").alias("k3"), F.col("id").alias("shown")), "k3", "left").withColumn("e", F.coalesce("ek1", "ek2"))
    by_id = F.coalesce(~F.col("e.consensus"), F.lit(False)) | F.col("shown").isNull()
    return rows.select(*names.columns, F.when(by_id, F.col("e.id")).otherwise(F.col("shown")).alias("id"), F.when(by_id, F.col("e.consensus")).otherwise(F.lit(False)).alias("consensus"), by_id.alias("by_id")).where("id is not null")


def similar(names: DataFrame, entries: DataFrame) -> DataFrame:
    """(model, id, consensus): entries all of whose words are the name's and at least half of them, with the same version numbers and no tier's word left out.

    The one with most words is taken, a vendor's first, then the first by id.
    """
    own = names.select("model", similarity_words(F.col("base")).alias("ws")).where("size(ws) > 1").withColumn("runs", version_runs(F.col("ws")))
    listed = entries.select("id", "consensus", similarity_words(F.col("id")).alias("cs")).where("size(cs) > 1").withColumn("cruns", version_runs(F.col("cs"))).withColumn("word", F.get("cs", F.lit(0)))
    near = own.withColumn("word", F.explode(F.array_distinct("ws"))).join(listed, "word").where("size(cs) * 2 >= size(ws) and runs = cruns")
    inside = "forall(array_distinct(cs), c -> size(filter(cs, x -> x = c)) <= size(filter(ws, x -> x = c)))"
    kept = f"forall(filter(ws, w -> w in {_listed(TIERS)}), w -> array_contains(cs, w) or (exists(cs, c -> c in {_listed(FAMILIES)}) and w in {_listed(EFFORTS)}))"
    best = near.where(inside).where(kept).groupBy("model").agg(F.min_by(F.struct("id", "consensus"), F.struct(-F.size("cs"), "consensus", "id")).alias("e"))
    return best.select("model", "e.*")


def nearest(names: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    """``names`` with ``id``: of the entries that differ in numbers only the one whose numbers are nearest, then the first by id."""
    bare = lambda c: match_key(strip_date(F.col(c)))
    form = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: F.expr("double(0)") + x.cast("double"))
    rows = names.withColumn("key", bare(column)).where("key rlike '^[a-z].*[0-9]'")
    listed = entries.select("id", bare("id").alias("k")).select("id", form("k").alias("form"), numbers("k").alias("got"))
    met = rows.select(*names.columns, form("key").alias("form"), numbers("key").alias("want")).join(listed, "form")
    far = F.aggregate(F.zip_with("want", "got", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: a + b)
    return met.groupBy(*names.columns).agg(F.min_by("id", F.struct(far, "id")).alias("id"))


def resolved(models: DataFrame, entries: DataFrame) -> DataFrame:
    """(model, match_kind, id) of each distinct name; 'none' and a null id where nothing is like it.

    ``entries``: id, provider, name, consensus, rates. The first of: the name as written or another spelling, a vendor's
    listing before a median of resellers; a part of it that is a vendor's; a vendor's similar listing; a part that is a
    median; a similar median; the nearest version of the name, then of its parts. Only the id of the name as written is exact.
    """
    names = models.select("model").distinct().withColumn("base", plain_name(F.col("model"))).where("base <> ''")
    spelt = spellings(names).select("model", "n", "name", "base")
    parts = windows(spelt)
    rank = lambda *cs: F.array(*[F.lit(c).cast("int") if isinstance(c, int) else c.cast("int") for c in cs]).alias("rank")
    whole = found(spelt, "name", entries).select("model", rank(0, F.col("consensus"), F.col("n")), "id", (F.col("by_id") & (F.col("n") == 0)).alias("exact"))
    first = found(parts, "win", entries).groupBy("model", "n").agg(F.min_by(F.struct("id", "consensus"), "w").alias("e"))
    part = first.groupBy("model").agg(F.min_by("e", F.struct("e.consensus", "n")).alias("e")).select("model", rank(F.when(F.col("e.consensus"), 3).otherwise(1), 0, 0), "e.id", F.lit(False).alias("exact"))
    like = similar(names, entries).select("model", rank(F.when(F.col("consensus"), 4).otherwise(2), 0, 0), "id", F.lit(False).alias("exact"))
    near = nearest(spelt.select("model", "n", "name"), "name", entries).select("model", rank(5, F.col("n"), 0), "id", F.lit(False).alias("exact"))
    inner = nearest(parts, "win", entries).select("model", rank(6, F.col("n"), F.col("w")), "id", F.lit(False).alias("exact"))
    best = whole.unionByName(part).unionByName(like).unionByName(near).unionByName(inner).groupBy("model").agg(F.min_by(F.struct("id", "exact"), F.struct("rank", "id")).alias("b"))
    return models.select("model").distinct().where("model is not null").join(best, "model", "left").select("model", F.expr("case when b.id is null then 'none' when b.exact then 'exact' else 'approx' end").alias("match_kind"), "b.id")
