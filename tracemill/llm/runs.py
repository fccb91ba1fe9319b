"""Periodic runs of words: all maximal repetitions of a text, from its longest-previous-factor array.

A run is a stretch whose words repeat with its smallest period q, that is at least 2q words and at least so many words
long as is asked for, and that no neighbouring word extends. For each text, many at once as numpy columns:

- prefix doubling sorts the suffixes; the classes of every doubling stay, and tell how far any two places agree, forwards
  or backwards, in a lookup a doubling;
- neighbours in suffix order with a smaller place give the longest previous factor (LPF), whose greedy steps are the
  blocks of the Lempel-Ziv parse;
- a run that touches a block boundary is found from there: for each period that is possible at the boundary, the words
  around it are extended both ways;
- a run strictly inside a block stands in the block's previous occurrence as well and is copied from there, from buckets
  of runs by their start.

A text in which no stretch of half the least length stands twice has no run; such texts are told by hashes first. Texts
never meet: a task works on the texts it reads, however they are dealt out.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, table

#: Words in the least run that counts.
LEAST = 12
#: Words that are worked on at once, unless one text has more: while texts are told apart, and while suffixes are sorted.
READ_WORDS, BLOCK_WORDS = 2_000_000, 300_000
WORD = "[^ \\\\x09-\\\\x0D]+"
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
SCHEMA = f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string"


def classes(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and for each k the classes of the 2^k symbols from each place: equal numbers for equal stretches, in their order.

    The last symbol is the only one of its kind, so no two suffixes are alike.
    """
    order = np.argsort(symbols, kind="stable").astype(np.int32)
    begins = np.append(True, symbols[order][1:] != symbols[order][:-1])
    rank = np.empty(len(symbols), np.int32)
    rank[order] = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    levels, width = [rank], 1
    slots = np.flatnonzero(~begins | ~np.append(begins[1:], True))
    while len(slots):
        at = order[slots]
        key = (rank[at].astype(np.int64) << 32) | rank[at + width]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        begins = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        rank[at] = slots[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
        levels.append(rank)
        slots = slots[~begins | ~np.append(begins[1:], True)]
        width *= 2
    return order, levels[:-1] or levels


def ahead(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from places i and j on are alike."""
    i, j, n = i.copy(), j.copy(), np.zeros(len(i), np.int32)
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][i] == levels[k][j]).astype(np.int32) << k
        i += step
        j += step
        n += step
    return n


def behind(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols before places i and j are alike."""
    i, j, n = i.copy(), j.copy(), np.zeros(len(i), np.int32)
    for k in range(len(levels) - 1, -1, -1):
        w = 1 << k
        fits = (i >= w) & (j >= w)
        step = (fits & (levels[k][np.maximum(i - w, 0)] == levels[k][np.maximum(j - w, 0)])).astype(np.int32) << k
        i -= step
        j -= step
        n += step
    return n


def longest_previous(order: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(length, place) of the longest stretch from each place on that also starts at a smaller place; length 0 where there is none."""
    m = len(order)
    first = levels[0][order]
    # Suffixes with one first symbol stand together, from ``low`` to before ``high``.
    begin = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    size = np.diff(np.append(begin, m))
    low = np.repeat(begin, size).astype(np.int32)
    size = np.repeat(size, size)
    high = (low + size).astype(np.int32)
    least, tables = order, []
    while 1 << len(tables) < size.max(initial=1):
        tables.append(least)
        w = 1 << (len(tables) - 1)
        least = np.append(np.minimum(least[:-w], least[w:]), least[m - w :]) if m > w else least
    up, down = np.arange(m, dtype=np.int32), np.arange(1, m + 1, dtype=np.int32)
    for k in range(len(tables) - 1, -1, -1):
        w = 1 << k
        at = np.flatnonzero(size > w)
        before = up[at] - w
        skip = (before >= low[at]) & (tables[k][np.maximum(before, 0)] > order[at])
        up[at[skip]] -= w
        skip = (down[at] + w <= high[at]) & (tables[k][np.minimum(down[at], m - 1)] > order[at])
        down[at[skip]] += w
    length, place = np.zeros(m, np.int32), np.zeros(m, np.int32)
    for other, there in ((up - 1, up > low), (down, down < high)):
        r = np.flatnonzero(there)
        here, prior = order[r], order[other[r]]
        n = ahead(levels, here, prior)
        longer = n > length[here]
        length[here[longer]], place[here[longer]] = n[longer], prior[longer]
    return length, place


def blocks_of(length: list[int], start: int, end: int) -> list[int]:
    """Where the blocks of the parse of [start, end) begin, and its end."""
    out = []
    while start < end:
        out.append(start)
        start += length[start] or 1
    out.append(end)
    return out


def _counted(counts: np.ndarray) -> np.ndarray:
    """1..c for each count c, one after the other."""
    return np.arange(1, counts.sum() + 1) - np.repeat(np.cumsum(counts) - counts, counts)


def at_boundaries(levels: list[np.ndarray], at: np.ndarray, left: np.ndarray, right: np.ndarray, room: np.ndarray, least: int) -> np.ndarray:
    """Runs (start, end, period) of ``least`` words that touch a boundary; ``left`` and ``right`` are its blocks' lengths, ``room`` the words before it.

    A run that reaches into the right block by its period or more has a period of at most that block; one that does not
    has, as the left block could not be longer, a period of less than both blocks together.
    """
    found = []
    # Words that agree over all of a period's reach are half of the least length or more, and half of those on one side.
    k = min(len(levels) - 1, max(0, (-(-(-(-least // 2)) // 2)).bit_length() - 1))
    same, w = levels[k], 1 << k
    for sign, most in ((1, right), (-1, np.minimum(room, left + np.maximum(right - 1, 0)))):
        q = _counted(most)
        b = np.repeat(at, most)
        c = b + sign * q
        near = same[b] == same[np.minimum(c, len(same) - 1)]
        far = (b >= w) & (c >= w)
        near |= far & (same[np.maximum(b - w, 0)] == same[np.maximum(c - w, 0)])
        b, c, q = b[near], c[near], q[near]
        f, g = ahead(levels, b, c), behind(levels, b, c)
        start, end = np.minimum(b, c) - g, np.maximum(b, c) + f
        good = (f + g >= q) & (end - start >= least)
        found.append(np.stack([start[good], end[good], q[good]], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # Of equal stretches the smallest period counts; others are its multiples.
    return rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))] if len(rows) else rows


def copied(runs: list[tuple[int, int, int]], blocks: list[int], place: list[int], least: int) -> list[tuple[int, int, int]]:
    """``runs`` of one text and those strictly inside its blocks, which are copies of runs inside a block's previous occurrence."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for s, e, q in runs:
        buckets.setdefault(s, []).append((e, q))
    starts = sorted(buckets)
    for b, e in zip(blocks, blocks[1:]):
        if e - b < least + 2:
            continue
        back = b - place[b]
        k = bisect_right(starts, b - back)
        while k < len(starts) and starts[k] < e - back - least:
            inside = [(end + back, q) for end, q in buckets[starts[k]] if end < e - back]
            if inside:
                to = starts[k] + back
                if to not in buckets:
                    buckets[to] = []
                    insort(starts, to)
                buckets[to] += [x for x in inside if x not in buckets[to]]
            k += 1
    return sorted((s, q, end) for s in starts for end, q in buckets[s])


def runs_of(codes: np.ndarray, ends: np.ndarray, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, period, end) in order; ``codes`` are the texts' words as numbers, one text after the other."""
    n_docs, sizes = len(ends), np.diff(np.append(0, ends))
    doc = np.repeat(np.arange(n_docs), sizes)
    _, symbols = np.unique(doc * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
    # Behind each text stands a symbol of its own, so that nothing agrees across texts.
    text = np.empty(len(codes) + n_docs, np.int64)
    text[np.arange(len(codes)) + doc] = symbols
    close = ends + np.arange(n_docs)
    text[close] = len(codes) + np.arange(n_docs)
    order, levels = classes(text)
    length, place = longest_previous(order, levels)
    steps, back = length.tolist(), place.tolist()
    parses = [blocks_of(steps, int(e - s), int(e)) for s, e in zip(sizes, close)]
    at, left, right, room = [], [], [], []
    for parse in parses:
        b = np.array(parse)
        wide = np.diff(np.append(b, b[-1]))
        at.append(b[1:])
        left.append(wide[:-1])
        right.append(wide[1:])
        room.append(b[1:] - b[0])
    found = at_boundaries(levels, *(np.concatenate(x).astype(np.int32) for x in (at, left, right, room)), least)
    cut = np.searchsorted(found[:, 0], close)
    out = []
    for k, (parse, own) in enumerate(zip(parses, np.split(found, cut[:-1]))):
        base = parse[0]
        own = copied([tuple(r) for r in own.tolist()], parse, back, least) if len(own) else []
        out.append([(s - base, q, e - base) for s, q, e in own])
    return out


def repetitive(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the texts in which some ``width`` words in a row stand twice; equal hashes may add others."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = doc[:n].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for k in range(width):
        h = h * np.uint64(0x94D049BB133111EB) + mixed[k : k + n]
    h ^= h >> np.uint64(31)
    inside = np.arange(width, n + width) <= ends[doc[:n]]
    h, doc = h[inside], doc[:n][inside]
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    return np.unique(doc[np.isin(h, twice)]) if len(twice) else np.empty(0, np.int64)


def _cuts(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of texts with ``most`` words together, or one text with more."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def detected(texts: pa.Array, least: int = LEAST) -> list[pa.Array]:
    """n_words, runs and collapsed text of each text; a null has no words."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    words, sizes = split.flatten(), pc.list_value_length(split).to_numpy().astype(np.int64)
    filled = pc.not_equal(words, "")
    full = filled.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), sizes)[full]
    sizes = np.bincount(doc, minlength=len(texts))
    words, ends = words.filter(filled), np.cumsum(sizes)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in _cuts(ends, READ_WORDS):
        low = int(ends[a - 1]) if a else 0
        some = repetitive(codes[low : ends[b - 1]], doc[low : ends[b - 1]] - a, ends[a:b] - low, -(-least // 2)) + a
        for x, y in _cuts(np.cumsum(sizes[some]), BLOCK_WORDS):
            chosen = some[x:y]
            each = [codes[ends[d] - sizes[d] : ends[d]] for d in chosen]
            found |= {int(d): r for d, r in zip(chosen, runs_of(np.concatenate(each), np.cumsum(sizes[chosen]), least)) if r}
    keep = np.ones(len(codes), bool)
    for d, runs in found.items():
        base = int(ends[d] - sizes[d])
        for s, q, e in runs:
            keep[base + s + q : base + e] = False
    left = np.bincount(doc[keep], minlength=len(texts))
    kept = words.filter(pa.array(keep))
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(left)), pa.int32()), kept), " ")
    flat = np.array([(s, e - s, q) for d in sorted(found) for s, q, e in found[d]], np.int64).reshape(-1, 3)
    counts = np.zeros(len(texts) + 1, np.int64)
    for d, runs in found.items():
        counts[d + 1] = len(runs)
    structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
    return [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), structs), collapsed]


def collapsed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: the runs of at least ``least`` words by start and period, and the words joined by one space, each run cut to its first period.

    Words are what ASCII white space parts. A null text has no words, no runs and an empty collapsed text, as an empty one
    has; null and repeated ids are rows like others; an empty table gives no rows; columns other than doc_id and text are
    not read. Texts may be of any length: the memory of a task follows the longest one (some 100 bytes a word).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *detected(batch.column("text"), least)], names=["doc_id", "n_words", "runs", "collapsed"])

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, by the checksum h of their ids, repeat p words from word g mod n on to their end."""
    words = F.expr(f"regexp_extract_all(text, '{WORD}', 0)")
    rows = only(docs, doc_id="bigint", text="string").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    split = rows.withColumn("ws", F.when(F.col("h") % 10 == 0, words)).withColumn("g", F.floor(F.col("h") / 10))
    placed = split.withColumn("n", F.size("ws")).withColumn("a", F.expr("if(n > 0, g % n, null)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0, n - 1), i -> get(ws, cast(if(i < a, i, a + (i - a) % p) as int))), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapsed(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", (-F.col("b.back")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.short")).alias("period"), F.expr("1000 * b.length div -b.short").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
