"""Session filters and full-text search: substring terms, bm25 over trigram lengths, recency, best hits of a session."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import fold, occurrences

K1, B, HITS = 1.2, 0.75, 3


def session_filter(harness: list[str] | None = None, inside: str | None = None, since: int | None = None, until: int | None = None, has_parent: bool | None = None, starts: str | None = None, parent: str | None = None, negate: bool = False) -> Column:
    """One predicate over sessions from all that is given; it is never null, so that its negation keeps what it should."""
    parts = []
    if harness is not None:
        parts.append(F.col("harness").isin(*[h.lower() for h in harness]))
    if inside is not None:
        parts.append(F.contains(F.lower(F.translate("cwd", "\\", "/")), F.lit(inside.lower().replace("\\", "/"))))
    if since is not None:
        parts.append(F.col("updated_at") >= since)
    if until is not None:
        parts.append(F.col("updated_at") < until)
    if has_parent is not None:
        parts.append(F.col("parent").isNotNull() if has_parent else F.col("parent").isNull())
    if starts is not None:
        parts.append(F.col("session").startswith(starts) | F.substring_index("session", ":", -1).startswith(starts))
    if parent is not None:
        parts.append(F.col("parent") == parent)
    both = F.lit(True)
    for p in parts:
        both = both & F.coalesce(p, F.lit(False))
    return ~both if negate else both


def search(docs: DataFrame, terms: list[str], without: list[str], sessions: DataFrame, now: int, kinds: list[str] | None = None) -> DataFrame:
    """Up to three best hits of each session: all ``terms`` (three characters or more) in a document's folded text, none of ``without``.

    ``docs``: session, event, ts_ms, text, and kind where ``kinds`` are asked for; ``sessions``: session, updated_at, those
    that are searched. The corpus statistics are one row, of all documents whatever their kind or session.
    """
    if not terms:
        raise ValueError("a search needs a term that must stand in the text")
    if min(map(len, terms)) < 3:
        raise ValueError("terms of under three characters are searched by scan()")
    folded = docs.withColumn("f", fold(F.coalesce("text", F.lit("")))).withColumn("dl", F.greatest(F.length("text") - 2, F.lit(0)))
    lower = [t.lower() for t in terms]
    stats = folded.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.contains("f", F.lit(t))).alias(f"df{i}") for i, t in enumerate(lower)]).first()
    hit = F.lit(True)
    for t in lower:
        hit = hit & F.contains("f", F.lit(t))
    for t in without:
        hit = hit & ~F.contains("f", F.lit(t.lower()))
    if kinds is not None:
        hit = hit & F.col("kind").isin(*kinds)
    rows, n, mean = folded.where(hit), stats["n"], stats["avgdl"] or 1.0
    score = F.lit(0.0)
    for i, t in enumerate(lower):
        df, f = stats[f"df{i}"], occurrences(F.col("f"), t)
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        score = score + F.lit(idf) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("dl") / mean))
    rows = rows.select("session", "event", "ts_ms", score.alias("bm25")).join(sessions.select("session", "updated_at"), "session")
    age = F.greatest((F.lit(now) - F.col("updated_at")) / 86_400_000.0, F.lit(0.0))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("bm25"), F.desc("event")))).where(F.col("rn") <= HITS)
    return ranked.select("session", "event", F.col("rn").cast("bigint").alias("rank"), F.round("bm25", 6).alias("bm25"), F.round(F.col("bm25") * (1 + 1 / (1 + age / 30)), 6).alias("score"))


def sessions_page(hits: DataFrame, sessions: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """(place, session, score, hits) of a page of sessions: by the score of a session's best hit, then latest, then by name.

    ``hits`` are those of ``search``; the order is total, so pages never overlap. A page has at most 200 sessions.
    """
    limit = min(limit, 200)
    best = hits.groupBy("session").agg(F.max("score").alias("score"), F.count("*").alias("hits")).join(sessions.select("session", "updated_at"), "session")
    order = [F.desc("score"), F.desc("updated_at"), "session"]
    page = best.orderBy(*order).limit(offset + limit)
    return page.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint")).where(F.col("place") > offset).select("place", "session", "score", "hits")


def scan(docs: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """The newest ``limit`` documents that hold all of the short ``terms``, A-Z in either case; scores are zero."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.lit(True)
    for t in terms:
        hit = hit & F.contains(low, F.lit("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)))
    return docs.where(hit).select("session", "event", "ts_ms").orderBy(F.desc("ts_ms"), F.desc("event")).limit(limit)


def snippet(text: Column, term: str, before: int = 40, after: int = 80) -> Column:
    """What stands around the first occurrence, new lines as spaces, cuts marked; use it after a search has been cut to its page."""
    at = F.locate(term.lower(), fold(text))
    start = F.greatest(at - before, F.lit(1))
    size = F.lit(len(term) + before + after)
    body = F.translate(F.substring(text, start, size), "\n\r", "  ")
    return F.when(at > 0, F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), body, F.when(start + size - 1 < F.length(text), F.lit("…")).otherwise(F.lit("")))).otherwise(F.substring(text, 1, 120))
