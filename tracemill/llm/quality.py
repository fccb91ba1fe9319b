"""Quality rules: counts over words and lines, then bands of zstandard compression ratios.

Each whole text is compressed as one piece, and again in fixed chunks of ``CHUNK`` bytes and what is left of the last one.
Text that shrinks far more than prose of its length does is repetitive; text that shrinks less is noise (keys, encoded
bytes). What is normal depends on length, so each length class has its own band, for whole texts and for chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import only, table

#: Text up to so many bytes, and the least and greatest share of its bytes that may be left after compression.
BANDS = [(200, 0.3, 1.5), (1_000, 0.25, 0.95), (4_000, 0.2, 0.8), (20_000, 0.18, 0.72), (1 << 62, 0.12, 0.68)]
CHUNK = 4_096
#: The same for chunks. The upper bounds lie over what chunks of sf0.1's texts of quality 1 leave at most (0.482 of a full
#: chunk, 0.494 from 3,001 bytes, 0.521, 0.543, 0.580, 0.629, 0.682, 0.725, 0.824 down the classes), and under base64 from
#: 201 bytes and hexadecimal (0.523 to 0.536) from 2,001; in shorter chunks these leave no more than prose does.
CHUNK_BANDS = [(200, 0.08, 1.5), (300, 0.08, 0.88), (500, 0.08, 0.79), (700, 0.08, 0.75), (1_000, 0.08, 0.7), (1_500, 0.08, 0.65), (2_000, 0.08, 0.6), (3_000, 0.08, 0.53), (CHUNK - 1, 0.08, 0.51), (CHUNK, 0.08, 0.505)]
#: Share of bytes in chunks outside their band that rejects a text.
BAD_CHUNKS = 0.5
LEVEL, WINDOW = 3, 8


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    # Equal hashes are candidates; the words decide.
    seen: dict[tuple[bytes, ...], int] = {}
    covered = np.zeros(len(words) + 1, np.int64)
    for i in np.flatnonzero(hit).tolist():
        first = seen.setdefault(tuple(words[i : i + window]), i)
        if first != i:
            for at in (first, i):
                covered[at] += 1
                covered[at + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


#: Every byte but the symbols that are counted.
NOT_SYMBOL = bytes(set(range(256)) - set(b"#*$%&|<>"))


def ratios(raw: bytes, press: zstandard.ZstdCompressor) -> tuple[float, float]:
    """What is left of the whole text, and the share of its bytes that stand in chunks outside the chunk band."""
    if not raw:
        return 1.0, 0.0
    whole, bad = len(press.compress(raw)) / len(raw), 0
    for k in range(0, len(raw), CHUNK):
        chunk = raw[k : k + CHUNK]
        low, high = next((a, b) for most, a, b in CHUNK_BANDS if len(chunk) <= most)
        bad += 0 if low <= len(press.compress(chunk)) / len(chunk) <= high else len(chunk)
    return whole, bad / len(raw)


def judged(text: str | None, press: zstandard.ZstdCompressor) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, bad_chunks of one text; null is empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(raw.translate(None, NOT_SYMBOL))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    failed = n < 20 or 100 * repeat > 30 * n
    whole, bad = ratios(raw, press)
    low, high = next((a, b) for most, a, b in BANDS if len(raw) <= most)
    return n, chars, symbols, dup, repeat, failed, not failed and low <= whole <= high and bad < BAD_CHUNKS, whole, bad


SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, bad_chunks double"
KINDS = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2


def judge(docs: DataFrame) -> DataFrame:
    """A row of counts and verdicts for every row; null and empty texts have no words and fail the base rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            texts = batch.column("text")
            rows = [judged(texts[i].as_py(), press) for i in range(batch.num_rows)]
            columns = list(zip(*rows)) or [()] * len(KINDS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, KINDS))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, SCHEMA)


def op8_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
