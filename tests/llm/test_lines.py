"""Line dedup against a plain version of its rules, and its recall against edit similarity alone."""

import random
import re
from itertools import combinations

import duckdb
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_operators import parts
from tracemill.llm import lines

DATA = "/root/testdata/sf0.001"


def plain_norm(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def plain_hash(text):
    return xxhash.xxh64_intdigest(text.encode(), 42)


def chained(hashes):
    """Spark's hash of several numbers: each is hashed with the one before as its seed."""
    seed = 42
    for h in hashes:
        seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
    return seed


def plain_keys(norm):
    ws = norm.split(" ")
    if len(ws) > lines.LONG:
        hw = [plain_hash(w) for w in ws]
        features, cap = {chained(hw[i : i + lines.RUN]) | 15 for i in range(len(hw) - lines.RUN + 1)}, lines.CAP_LONG
    else:
        features, cap = {plain_hash(w) & ~15 | min(len(w), 15) for w in ws}, lines.CAP
    # Blocks are numbered by signed order.
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in features)
    blocks = [[f for f in signed if (f >> 61) + 4 == k][:cap] for k in range(lines.BLOCKS)]
    prints = [(k, len(b), sum(1 << i for i in range(64) if 2 * sum(f >> i & 1 for f in b) > len(b))) for k, b in enumerate(blocks)]
    weights = [sum((f & 15) - 1 for f in b) for b in blocks]
    keys = {(p,) for p, w in zip(prints, weights) if w >= lines.ONE}
    light = [(p, w) for p, w in zip(prints, weights) if 0 < w < lines.ONE]
    keys |= {(p, q) for (p, v), (q, w) in combinations(light, 2) if v + w >= lines.TWO}
    if 2 <= len(ws) <= lines.SHORT:
        weigh = [min(len(w), 15) - 1 for w in ws]
        keys |= {" ".join(ws[:i] + ws[i + 1 :]) for i in range(len(ws)) if sum(weigh) - weigh[i] >= lines.REST} | {norm}
    return keys


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b):
    if max(len(a.split()), len(b.split())) > lines.LONG:
        a, b = a.split(), b.split()
    most = int(0.2 * max(len(a), len(b)) + 1e-9)
    return abs(len(a) - len(b)) <= most and edits(a, b) <= most


def corpus():
    rng = random.Random(9)
    words = ["".join(rng.choice("aeiourstnlé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [line(n) for n in (2, 3, 5, 8, 12, 13, 20, 30, 60, 128, 129, 200)]
    texts = [base[0] + "\n" + base[1] + "\n\n" + base[2], base[1].upper() + "!\n" + base[3] + "\r\n" + base[0], None, "", "...\n...", line(3000), base[4] + "\n" + base[4] + "\n" + base[4][:-1], "\n".join(base)]
    for k in range(6):
        some = []
        for b in base:
            ws = b.split()
            for _ in range(1 + k % 3):
                i = rng.randrange(len(ws))
                ws[i : i + 1] = [[rng.choice(words)], [], [ws[i], rng.choice(words)]][(k + i) % 3]
            some.append(" ".join(ws))
        texts.append("\n".join(some))
    return [*texts, " ".join([base[5]] * 30), " ".join([base[5]] * 30) + " tail", texts[0]]


def test_dedup_is_the_plain_rule(spark):
    texts = corpus()
    made = spark.createDataFrame([(n, t, "x", 1, "y", None) for n, t in enumerate(texts)], "doc_id bigint, text string, h string, _i int, `gone_lines` string, `a.b` string")
    got = {r["doc_id"]: r for r in lines.dedup(made).collect()}
    norm = {(n, k): plain_norm(x) for n, t in enumerate(texts) if t for k, x in enumerate(t.split("\n")) if plain_norm(x)}
    keys = {x: plain_keys(x) for x in set(norm.values())}
    root = parts(sorted(norm), lambda a, b: norm[a] == norm[b] or bool(keys[norm[a]] & keys[norm[b]]) and similar(norm[a], norm[b]))
    assert len(set(root.values())) < len(set(norm.values()))
    for n, t in enumerate(texts):
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if root.get((n, k), (n, k)) == (n, k))
        assert got[n]["text"] == want
        assert (got[n]["h"], got[n]["_i"], got[n]["gone_lines"], got[n]["a.b"]) == ("x", 1, "y", None)
    assert lines.dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_null_and_repeated_ids(spark):
    same = "a line that stands in several places"
    made = spark.createDataFrame([(None, same), (None, "x\n" + same), (7, same), (7, same), (7, "y\n" + same), (8, same)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in lines.without_repeats(made).collect()), key=repr)
    assert sum(same in t for _, t in got) == 1 and len(got) == 6
    assert next(i for i, t in got if same in t) is None


def test_recall_of_planted_edits():
    rng = random.Random(2)
    with duckdb.connect() as con:
        found = con.execute(f"SELECT text FROM '{DATA}/documents.parquet'").fetchall()
    words = [w for (t,) in found for w in plain_norm(t or "").split()]
    for n in (4, 6, 8, 12, 16, 20, 40, 100, 150, 300):
        word = letter = 0
        for _ in range(100):
            ws = [rng.choice(words) for _ in range(n)]
            keys, i, line = plain_keys(" ".join(ws)), rng.randrange(n), list(" ".join(ws))
            word += bool(keys & plain_keys(" ".join([*ws[:i], rng.choice(words), *ws[i + 1 :]])))
            j = rng.randrange(len(line))
            line[j] = "q" if line[j] != " " else " "
            letter += bool(keys & plain_keys("".join(line)))
        assert word >= 90 and letter >= 88, (n, word, letter)


def test_recall_of_similar_lines():
    with duckdb.connect() as con:
        found = con.execute(f"SELECT text FROM '{DATA}/documents.parquet'").fetchall()
        norm = sorted({k for (t,) in found for x in (t or "").split("\n") if (k := plain_norm(x)) and len(k) < 400}, key=len)
        con.execute("CREATE TABLE n (s VARCHAR)")
        con.executemany("INSERT INTO n VALUES (?)", [(x,) for x in norm])
        near = con.execute("SELECT a.s, b.s FROM n a JOIN n b ON a.s < b.s AND abs(length(a.s) - length(b.s)) <= 0.2 * greatest(length(a.s), length(b.s)) WHERE levenshtein(a.s, b.s) <= 0.2 * greatest(length(a.s), length(b.s)) + 1e-9").fetchall()
    hit = sum(bool(plain_keys(a) & plain_keys(b)) for a, b in near)
    assert len(near) >= 20 and hit >= 0.9 * len(near), (hit, len(near))


def links_in_buckets(norms):
    """Pairs of lines that share a bucket and are similar by letters, by brute force."""
    buckets = {}
    for k, norm in enumerate(norms):
        for key in plain_keys(norm):
            buckets.setdefault(key, []).append(k)
    met = sorted({pair for ks in buckets.values() for pair in combinations(ks, 2)})
    with duckdb.connect() as con:
        met = pa.table({"a": [a for a, _ in met], "b": [b for _, b in met]})
        own = pa.table({"k": range(len(norms)), "s": norms})
        con.register("met", met)
        con.register("own", own)
        return con.execute("SELECT a, b FROM met JOIN own x ON x.k = a JOIN own y ON y.k = b WHERE levenshtein(x.s, y.s) <= floor(0.2 * greatest(length(x.s), length(y.s)) + 1e-9) ORDER BY a, b").fetchall()


def test_pairs_of_form_letters_grow_with_their_number(spark, monkeypatch):
    """Lines of ten fixed and ten random words: they share buckets and hardly any are similar. Pairs that are written down grow with the lines; what is compared in full leaves only links."""
    rng, asked = random.Random(6), []
    inner = lines.verified

    def counted(pairs, of):
        asked.append(pairs.count())
        return inner(pairs, of)

    monkeypatch.setattr(lines, "verified", counted)
    fixed = [f"fixed{k}words" for k in range(10)]
    seen = []
    for n in (500, 1000, 2000):
        asked.clear()
        rows = [(k, " ".join(w for pair in zip(fixed, (f"r{rng.randrange(10**6)}" for _ in range(10))) for w in pair)) for k in range(n)]
        gone = {r["doc_id"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).where("size(gone_lines) > 0").collect()}
        links = links_in_buckets([x for _, x in rows])
        # With so few links, a line goes exactly if it is similar to one before it.
        assert gone == {b for _, b in links} and len(links) < 20
        seen.append(sum(asked))
    assert seen[2] <= 2.2 * seen[1] and seen[2] <= 4.84 * seen[0]


def test_no_link_of_a_mixed_bucket_is_lost(spark, monkeypatch):
    """Lines of one bucket in many groups: couples that differ in some letters, each far from all others."""
    rng, letters = random.Random(3), "abcdefghijklmnopqrstuvwxyz"
    monkeypatch.setattr(lines, "BLOCK", 5)
    couples = []
    for k in range(30):
        first = "".join(rng.choice(letters) for _ in range(60))
        second = list(first)
        for place in range(0, 40, 5):
            second[place] = "0"
        couples += [first, "".join(second)]
    made = spark.createDataFrame([(i, x, k) for i, x in enumerate(couples) for k in ([7, 9] if i % 3 else [7])], "doc_id bigint, norm string, key bigint")
    hashed = made.selectExpr("xxhash64(norm) as h", "norm", "array(key) as keys").groupBy("h", "norm").agg(F.flatten(F.collect_list("keys")).alias("keys"))
    roots, n = lines.linked(hashed)
    want = {x: k // 2 for k, x in enumerate(couples)}
    got = {r["norm"]: r["root"] for r in hashed.join(roots, F.col("h") == F.col("node")).collect()}
    assert n == 60 and len({(want[x], r) for x, r in got.items()}) == 30 == len(set(got.values()))


def test_values_of_a_fingerprint_are_computed_once(spark):
    """Each of five hashes of eight blocks is fetched by one expression, besides those of runs of words."""
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        keys = lines.keyed(lines.lines_of(spark.createDataFrame([(1, "one line")], "doc_id bigint, text string")))
        plan = keys._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert 0 < len(re.findall(r"#\d+\[", plan)) <= lines.BLOCKS * lines.CAP + lines.RUN


def test_separators_of_all_kinds(spark):
    text = "  A--b\u00a0\u00c9t\u00e9   \u0663x\t\u4e2d \n _ \n\u00b2 \u00bd\U0001f600q\u01c5 \r"
    got = {r["line"]: r["norm"] for r in lines.lines_of(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()}
    assert got == {k: plain_norm(x) for k, x in enumerate(text.split("\n")) if plain_norm(x)}


def test_similar_lines_by_brute_force(spark, monkeypatch):
    """Edits at the ends, in the middle and all over, short and long lines; and with so few letters that most stand for several words."""
    rng, pairs = random.Random(4), []
    words = ["".join(rng.choice("aeioustn\u00e9") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for n in (1, 2, 5, 12, 30, 128, 129, 150):
        for share in (0, 0.05, 0.15, 0.2, 0.25, 0.5, 1):
            a = [rng.choice(words) for _ in range(n)]
            for at in (0, n // 2, n):
                b = a[:at] + [rng.choice(words) for _ in range(int(n * share))] + a[at + int(n * share) * rng.randrange(2) :]
                pairs.append((" ".join(a), " ".join(b)))
            b = [rng.choice(words) if rng.random() < share else w for w in a]
            pairs.append((" ".join(a), " ".join(b)))
    pairs = [(a, b) for a, b in pairs if a and b]
    want = [similar(a, b) for a, b in pairs]
    assert 20 < sum(want) < len(want) - 20
    made = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, na string, nb string")
    for codes in (1 << 20, 4):
        monkeypatch.setattr(lines, "CODES", codes)
        assert [r["s"] for r in made.select("i", F.expr(lines.similar()).alias("s")).orderBy("i").collect()] == want
