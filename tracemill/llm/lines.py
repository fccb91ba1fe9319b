"""Fuzzy line dedup in DataFrame operations only.

Lines are normalised (lower case, runs of anything but letters and digits to one space) and told apart by a 64-bit hash,
so a line that stands in a third of all documents is one class. A class's fingerprint has blocks: its distinct words are
dealt to ``BLOCKS`` blocks by hash, and each block is the 64-bit SimHash of its words, or of the ``CAP`` of least hash in
a block that has more. A changed word touches two blocks at most, the one it leaves and the one it joins, so by the
pigeonhole principle lines with a few different words agree on others. Classes that agree on one block of weight ``ONE``,
or on two lighter ones of weight ``TWO`` together, meet in a bucket (a word weighs its letters less one, fourteen at most;
a bucket that rests on a few common short words would bring unrelated lines together). Lines of up to ``SHORT`` words
have a block a word as well and meet when they agree on all but one; lines of more than ``LONG`` words have short runs of
words in place of words, as long texts of a small vocabulary would agree on words alone.

A link needs edit similarity of ``SIMILARITY`` of the whole normalised lines: edits of letters, or of words where one has
more than ``LONG`` words (and the two together fewer than 50,000 different ones). A bucket is not expanded into its pairs:
its members are compared with its first, then with the first outside the bucket's largest group. Only what is then still
in different groups is compared in full, block by block, so no link within a bucket is lost. Of every connected group the
first occurrence stays.

Of lines of four words or more with one word replaced or one letter mistyped, nine in ten at least are found;
tests/llm/test_lines.py measures it. More changes in short lines are found less often (README).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, dropped, fresh, packed, saved, small, table

BLOCKS, CAP, ONE, TWO, SHORT, REST, SIMILARITY = 8, 5, 24, 16, 12, 6, 0.8
#: Of a line of more than LONG words, runs of RUN words are its features, and a block the SimHash of CAP_LONG of them.
LONG, RUN, CAP_LONG = 128, 3, 4
#: Members of a mixed bucket in a block, and pairs a task, where what is left of it is compared in full.
BLOCK, PAIRS = 256, 20_000
#: Letters that stand for words by hash, a power of two; a million are above U+FFFF.
CODES = 1 << 20
#: What parts words, but for spaces: all but letters, digits and line ends. Characters up to U+00FF stand one by one, as Java looks those up in a table.
APART = "[^ \n" + "".join(c for c in map(chr, range(256)) if c.isalnum() and c == c.lower()) + "\\p{L}\\p{N}]+"


def spaced(text: Column) -> Column:
    """A text in lower case with its line ends and its words, which are parted by one space or several."""
    return F.regexp_replace(F.lower(text), APART, " ")


def added(a: str, b: str, c: str) -> tuple[str, str]:
    """Three rows of 64 bits added place by place: the sums' lower and upper bits."""
    return f"({a} ^ {b} ^ {c})", f"(({a} & {b}) | ({c} & ({a} ^ {b})))"


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def keyed(lines: DataFrame) -> DataFrame:
    """``lines`` without their words ``ws``, with ``keys``, the buckets of each normalised line as an array of hashes, among them maybe a null.

    A feature's hash has its block in the upper three bits and its letters in the lowest four. Sorted with a mark
    before each block, the hashes of a block stand together. A step's values are columns of the next, so that each is
    computed once. A lambda function in each step keeps Spark from making one method of all, which Java would interpret.
    """
    own = [c for c in lines.columns if c != "ws"]
    each = lambda *of: [F.expr(e.format(k=k)).alias(f"{c}{k}") for k in range(BLOCKS) for c, e in of]
    kept = lambda *of: [f"{c}{k}" for k in range(BLOCKS) for c in of]
    weight = "(least(length(w_), 15) - 1)"
    word = "(xxhash64(w_) & -16L) | least(length(w_), 15)"
    run = ", ".join(f"get(hw_, i_ + {k})" for k in range(RUN))
    runs = let("hw_", "transform(ws, w_ -> xxhash64(w_))", f"transform(sequence(0, size(hw_) - {RUN}), i_ -> xxhash64({run}) | 15L)")
    whole = f"if(size(ws) <= {SHORT}, aggregate(ws, 0, (s_, w_) -> s_ + {weight}), 0)"
    rest = f"transform(ws, (w_, i_) -> if(sum - {weight} >= {REST}, xxhash64(array_join(filter(ws, (x_, j_) -> j_ <> i_), ' ')), null))"
    short = f"if(size(ws) between 2 and {SHORT}, array_append({rest}, h), array())"
    summed = lines.select("*", F.expr(whole).alias("sum"))
    hashed = summed.select(*own, F.expr(short).alias("short"), F.expr(f"if(size(ws) > {LONG}, {runs}, transform(ws, w_ -> {word}))").alias("hs"), F.expr(f"if(size(ws) > {LONG}, {CAP_LONG}, {CAP})").alias("cap"))
    marks = [-(1 << 63) + (k << 61) for k in range(1, BLOCKS)]
    own += [F.expr("filter(short, h_ -> true)").alias("short")]
    ordered = hashed.select(*own, "cap", F.sort_array(F.concat(F.array_distinct("hs"), F.array(*map(F.lit, marks)))).alias("s"))
    # A block's hashes are between p<k> and p<k + 1>, counted from one; n<k> of them count, x<k>_<i> in the end.
    placed = ordered.select(*own, "cap", "s", F.lit(0).alias("p0"), *[F.expr(f"cast(array_position(s, {m}L) as int)").alias(f"p{k}") for k, m in enumerate(marks, 1)], F.expr("size(s) + 1").alias(f"p{BLOCKS}"))
    counted = placed.select(*own, "s", *kept("p"), *[F.expr(f"least(cap, p{k + 1} - 1 - p{k})").alias(f"n{k}") for k in range(BLOCKS)])
    dealt = counted.select(*own, *kept("n"), *each(*[(f"x{i}_", f"if(n{{k}} > {i}, coalesce(get(s, p{{k}} + {i}), 0L), 0L)") for i in range(CAP)]))
    # SimHash: a bit is set if over half of up to five hashes have it; none: zero. All 64 counters are added at once, as planes of bits.
    x = [f"x{i}_{{k}}" for i in range(CAP)]
    a, b = added(*x[:3])
    weigh = " + ".join(f"cast({e} & 15 as int)" for e in x) + " - n{k}"
    first = dealt.select(*own, *kept("n", "x3_", "x4_"), *each(("w", weigh), ("a", a), ("b", b)))
    a, b = added("a{k}", *x[3:])
    second = first.select(*own, *kept("n", "w", "b"), *each(("one", a), ("c", b)))
    # A count over half of n carries out of three planes when 7 less half of n is added to it; the upper plane of that is all ones.
    bit = [f"(-cast(shiftright(7 - shiftright(n{{k}}, 1), {p}) & 1 as bigint))" for p in range(2)]
    third = second.select(*own, *kept("n", "w"), *each(("two", "b{k} ^ c{k}"), ("four", "b{k} & c{k}"), ("carry", f"one{{k}} & {bit[0]}"), ("bit", bit[1])))
    prints = third.select(*own, *kept("n", "w"), *each(("v", "four{k} | (two{k} & bit{k}) | (carry{k} & (two{k} | bit{k}))")))
    one = [f"if(w{k} >= {ONE}, xxhash64({k}, n{k}, v{k}), null)" for k in range(BLOCKS)]
    two = [f"if(w{j} > 0 and w{k} > 0 and w{j} < {ONE} and w{k} < {ONE} and w{j} + w{k} >= {TWO}, xxhash64({j}, n{j}, v{j}, {k}, n{k}, v{k}), null)" for j, k in combinations(range(BLOCKS), 2)]
    return prints.select(*own[:-1], F.expr(f"array_distinct(concat(array({', '.join(one + two)}), short))").alias("keys"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, t, line, h, norm, ws) of every line that has a letter or digit; t is a hash of the document's text, h one of the line, ws its words."""
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    each = whole.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split(spaced(F.col("text")), "\n", -1)).alias("line", "raw"))
    words = each.where("trim(raw) <> ''").select("doc_id", "t", "line", F.array_remove(F.split("raw", " "), "").alias("ws"))
    return words.select("doc_id", "t", "line", F.array_join("ws", " ").alias("norm"), "ws").withColumn("h", F.xxhash64("norm"))


def similar() -> str:
    """SQL for whether the whole normalised lines ``na`` and ``nb`` have the edit similarity asked for."""
    of = lambda n: f"cast(floor({1 - SIMILARITY:.6f} * {n} + 1e-9) as int)"
    # Words that both begin or both end with change no distance; with a space after each word that holds for letters too.
    alike = lambda a, b: f"cast(array_position(zip_with({a}, {b}, (x_, y_) -> x_ <=> y_), false) as int) - 1"
    inner = lambda w, body: let(f"m{w}_", f"slice(w{w}_, p_ + 1, size(w{w}_) - p_ - q_)", body)
    cut = lambda body: let("p_", alike("wa_", "wb_"), let("q_", f"least({alike('reverse(wa_)', 'reverse(wb_)')}, least(size(wa_), size(wb_)) - p_)", inner("a", inner("b", body))))
    # Letters of words told one by one, or so many edits of words at a word's greatest length and a space, are never less
    # than the edit distance; these settle most pairs at a fraction of its cost, a narrow band most others.
    letters = "decode(unhex(array_join(transform({0}, w_ -> lpad(hex({1}), 8, '0')), '')), 'UTF-32')"
    hashed, placed = f"65536 + (xxhash64(w_) & {CODES - 1})", "array_position(ds_, w_) + 65535"
    runs = lambda e, most: f"levenshtein({letters.format('ma_', e)}, {letters.format('mb_', e)}, {most}) >= 0"
    by_word = "size(ma_) = size(mb_) and aggregate(zip_with(ma_, mb_, (x_, y_) -> if(x_ = y_, 0, greatest(length(x_), length(y_)))), 0, (s_, d_) -> s_ + d_) <= most_"
    by_edits = let("ds_", "array_distinct(concat(ma_, mb_))", runs(placed, "cast(most_ div (1 + array_max(transform(ds_, d_ -> length(d_)))) as int)"))
    near = f"greatest(length(sa_), length(sb_)) <= most_ or ({by_word}) or {by_edits} or levenshtein(sa_, sb_, least(most_, cast(most_ div 12 + 8 as int))) >= 0 or levenshtein(sa_, sb_, most_) >= 0"
    spelt = let("sa_", "array_join(array_append(ma_, ''), ' ')", let("sb_", "array_join(array_append(mb_, ''), ' ')", near))
    by_letter = let("most_", of("greatest(length(na), length(nb))"), f"abs(length(na) - length(nb)) <= most_ and {cut(spelt)}")
    # Word by word, with a letter for each word. One by hash may stand for several words, which makes lines no less alike; only then it is told by place.
    coded = let("ds_", "array_distinct(concat(ma_, mb_))", f"{runs(hashed, 'most_')} and (size(array_distinct(transform(ds_, w_ -> {hashed}))) = size(ds_) or {runs(placed, 'most_')})")
    run = cut(f"greatest(size(ma_), size(mb_)) <= most_ or (greatest(size(array_except(ma_, mb_)), size(array_except(mb_, ma_))) <= most_ and {coded})")
    by_run = let("most_", of("greatest(size(wa_), size(wb_))"), f"abs(size(wa_) - size(wb_)) <= most_ and {run}")
    few = "size(wa_) + size(wb_) < 50000 or size(array_distinct(concat(wa_, wb_))) < 50000"
    long = f"if({few}, {by_run}, levenshtein(na, nb, {of('greatest(length(na), length(nb))')}) >= 0)"
    whole = f"na = nb or if(greatest(size(wa_), size(wb_)) > {LONG}, {long}, {by_letter})"
    return let("wa_", "split(na, ' ')", let("wb_", "split(nb, ' ')", whole))


def texts_of(wanted: DataFrame, rows: int, lines: DataFrame) -> DataFrame:
    """(h, norm) of the classes in the written and counted table ``wanted`` (h)."""
    return saved(lines.select("h", "norm").join(small(wanted, rows), "h").groupBy("h").agg(F.first("norm").alias("norm")))


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole normalised lines have the edit similarity asked for."""
    wanted, rows = saved(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), rows=True)
    texts = texts_of(wanted, rows, lines)
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("norm").alias("na")), "a").join(texts.select(F.col("h").alias("b"), F.col("norm").alias("nb")), "b")
    return both.where(F.expr(similar())).select("a", "b")


def across(loose: DataFrame, lines: DataFrame) -> DataFrame:
    """All links (a, b) between members of one bucket of ``loose`` (bucket, b, root) that are in different groups.

    Every such pair is compared, once, in the least bucket that both are in. Members of a bucket are dealt to blocks of
    about ``BLOCK`` by hash and two blocks meet under a key of their own, so no task holds more than two blocks of a
    bucket at once and a large bucket is spread over tasks; pairs are compared inside the join and only links leave it.
    """
    asked, many = saved(loose.select(F.col("b").alias("h")).distinct(), rows=True)
    texts = texts_of(asked, many, lines)
    sizes = loose.groupBy("bucket").agg(F.count("*").alias("m"))
    told, rows = saved(sizes.select("bucket", F.expr(f"cast(1 + m div {BLOCK} as int)").alias("of"), "m"), rows=True)
    pairs = told.agg(F.sum(F.col("m").cast("double") * F.col("m") / 2)).first()[0] or 0
    own = loose.groupBy(F.col("b").alias("h")).agg(F.collect_list("bucket").alias("ks"))
    placed = loose.join(small(told.drop("m"), rows), "bucket").withColumn("c", F.expr("pmod(xxhash64(b), of)"))
    members = saved(placed.join(own.join(texts, "h"), F.col("b") == F.col("h")).select("bucket", "h", "root", "ks", "norm", "c", "of"))
    # The larger of two blocks asks, the other one, or itself, is asked.
    parts = int(min(5000, 1 + pairs // PAIRS))
    on = ["bucket", "i", "j"]
    left = members.select("bucket", F.col("h").alias("a"), F.col("root").alias("ra"), F.col("ks").alias("ka"), F.col("norm").alias("na"), F.explode(F.expr("sequence(0L, c)")).alias("i"), F.col("c").alias("j"))
    right = members.select("bucket", F.col("h").alias("b"), F.col("root").alias("rb"), F.col("ks").alias("kb"), F.col("norm").alias("nb"), F.col("c").alias("i"), F.explode(F.expr("sequence(c, of - 1L)")).alias("j"))
    left, right = left.repartition(parts, *on), right.repartition(parts, *on)
    met = F.expr("ra <> rb and (i < j or a < b) and bucket = array_min(array_intersect(ka, kb))")
    found = left.join(right.hint("merge"), on).where(met).where(F.expr(similar()))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def linked(lines: DataFrame) -> tuple[DataFrame, int]:
    """(node, root) of every class that is linked to another one, and how many there are."""
    members = lines.select("h", F.explode("keys").alias("bucket")).where("bucket is not null")
    # Copies of a line are combined before the shuffle; a bucket that only they are in has one h.
    shared, rows = saved(members.groupBy("bucket").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z").select("bucket", "a"), rows=True)
    active, n_active = saved(members.join(small(shared, rows), "bucket").select("bucket", "a", F.col("h").alias("b")).distinct(), rows=True)
    dropped(shared)
    active = packed(active, n_active)
    links = saved(verified(active.where("a <> b").select("a", "b").distinct(), lines))
    roots, n = components(links)

    def mixed() -> tuple[DataFrame, int]:
        """(bucket, b, root, top) of the buckets whose members are still in several groups, ``top`` the group with most of them."""
        grouped = active.select("bucket", "b").join(small(roots.select(F.col("node").alias("b"), "root"), n), "b", "left").select("bucket", "b", F.coalesce("root", "b").alias("root"))
        sizes = grouped.groupBy("bucket", "root").agg(F.count("*").alias("n"))
        most = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count("*").alias("roots"), F.sum("n").alias("all")).where("roots > 1 and all > 2").select("bucket", "top")
        return saved(packed(grouped.join(most, "bucket"), n_active), rows=True)

    # Where every member is linked to the first, a bucket is done. Others are compared once more with a member outside the
    # largest group, which settles most; what is then still in different groups is compared in full.
    for k in range(2):
        loose, left = mixed()
        if not left:
            break
        if k == 0:
            leader = loose.where("root <> top").groupBy("bucket").agg(F.min_by(F.struct("b", "root"), "b").alias("x")).select("bucket", F.col("x.b").alias("x"), F.col("x.root").alias("rx"))
            met = loose.join(leader, "bucket").where("rx <> root").select(F.least("x", "b").alias("a"), F.greatest("x", "b").alias("b")).distinct()
            more, found = saved(verified(met, lines), rows=True)
        else:
            more, found = saved(across(loose, lines), rows=True)
        dropped(loose)
        if found:
            links = saved(links.unionByName(more))
            dropped(more)
            dropped(roots)
            roots, n = components(links)
    dropped(active)
    return roots, n


def drops(docs: DataFrame) -> DataFrame:
    """(doc_id, t, gone): the line numbers that a document loses."""
    lines = saved(keyed(lines_of(docs)))
    roots, n = linked(lines)
    place = F.struct("doc_id", "t", "line")
    # Places are looked up only for lines that stand twice or are linked.
    twice = lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.lit(None).cast("bigint").alias("root"))
    met = twice.unionByName(roots.select(F.col("node").alias("h"), "root")).groupBy("h").agg(F.max("root").alias("root"))
    wanted, asked = saved(met, rows=True)
    reps = lines.select("h", "doc_id", "t", "line").join(small(wanted, asked), "h").groupBy("h").agg(F.min(place).alias("place"), F.first("root").alias("root"))
    classes = saved(reps.select("h", "place", F.col("root").isNotNull().alias("linked"), F.coalesce("root", "h").alias("root")))
    firsts, some = saved(classes.where("linked").groupBy("root").agg(F.min("place").alias("kept")), rows=True)
    kept, many = saved(classes.join(small(firsts, some), "root", "left").select("h", F.coalesce("kept", "place").alias("kept")), rows=True)
    gone = lines.select("doc_id", "t", "line", "h").join(small(kept, many), "h").where(place != F.col("kept"))
    return gone.groupBy("doc_id", "t").agg(F.collect_set("line").alias("gone"))


def dedup(docs: DataFrame, gone: str = "gone_lines") -> DataFrame:
    """The documents as they came, ``text`` without the repeated lines, and last the array column ``gone`` of their numbers.

    The first occurrence is the one with the smallest (doc_id, hash of text, line number); a null doc_id comes before all
    others. Lines without a letter or digit always stay; a null text stays null and an empty one empty; rows with equal
    id and text count as one document and all keep its lines; a document all of whose lines go stays with an empty text;
    an empty table gives no rows. Other columns pass through whatever their names are; ``gone`` gets underscores until
    its name is free.
    """
    i, t, g, k = fresh(docs, "i", "t", gone, "k")
    lost = drops(docs).select(F.col("doc_id").alias(i), F.col("t").alias(t), F.col("gone").alias(g))
    on = F.col("doc_id").cast("bigint").eqNullSafe(F.col(i)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t))
    joined = docs.join(lost, on, "left")
    left = F.expr(f"array_join(filter(split(cast(text as string), '\\n', -1), (x_, {k}) -> not array_contains({g}, {k})), '\\n')")
    text = F.when(F.col(g).isNull(), F.col("text").cast("string")).otherwise(left)
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.col(g))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("bigint").alias("n_lines"))
    found = dedup(n)
    return found.select("doc_id", "n_lines", F.coalesce(F.size("gone_lines"), F.lit(0)).cast("bigint").alias("n_removed"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The pipeline's form: the columns of ``docs``, n_chars following the text."""
    found = dedup(docs)
    found = found.drop(found.columns[-1])
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found
