"""Suffix-array dedup: column-wise construction over many short strings.

``common_prefixes`` sorts all suffixes of a collection by inserting one symbol of every string a round, from the last
column to the first. Three columns describe the sorted suffixes so far: the symbol before each (the collection's
Burrows-Wheeler transform), the prefix each shares with the one above it, and its string. They live in files that each
round reads and writes once from front to back. Documents are cut into strings by content-chosen anchors, so that rounds
are few however long a document is and equal 50-byte strings always meet; Spark deals the strings out by anchor. What of
a string no other document can share by the hashes of its windows is cut off before, and equal stretches go on once.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Matches have WINDOW bytes; of the SPAN strings of K bytes in a window the one with the least hash is its anchor.
WINDOW, K = 50, 20
SPAN = WINDOW - K + 1
#: Shuffled parts that anchors are dealt to at least; there are as many as tasks that read the input if those are more. A
#: batch of documents has a row for each, so several for each task would make the rows grow with the square of the input.
BUCKETS = 1024
#: Strings in one column-wise construction, unless one anchor has more.
BATCH = 5_000
#: Compressed bytes of whole buckets that are settled together, and ranges that a task keeps before it hands them on.
HELD, RANGES = 3_000_000, 1_000_000
#: Bytes of strings that are taken apart at once, and whose windows are hashed at once; more only if one anchor has more.
BLOCK, PIECE = 10_000_000, 500_000
_MULT, _ALL64 = 0x9E3779B97F4A7C15, (1 << 64) - 1
_POWER = {n: np.uint64(pow(_MULT, n, 1 << 64)) for n in (1, 2, 4, 8, 16)}


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each K-byte string of ``data``, by doubling: 1, 2, 4, 8, 16 bytes, then 16 + 4."""
    if len(data) < K:
        return np.empty(0, np.uint64)
    part, four = data.astype(np.uint64) + np.uint64(1), None
    for width in (1, 2, 4, 8):
        if width == 4:
            four = part
        part = part[:-width] * _POWER[width] + part[width:]
    n = len(data) - K + 1
    out = part[:n] * _POWER[4] + four[16 : 16 + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor): runs of consecutive windows of one text with one anchor.

    Every window is in exactly one run, and its anchor follows from its own bytes, so equal windows of different texts
    have equal anchors. A run longer than SPAN windows (text that repeats itself) is cut.
    """
    h, n = gram_hashes(data), len(data) - WINDOW + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    least, width = h, 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[SPAN - width : SPAN - width + n])
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    size = np.diff(np.append(first, n))
    if size.max() > SPAN:
        pieces = -(-size // SPAN)
        first = np.repeat(first, pieces) + SPAN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.diff(np.append(first, n))
    return first, first + size - 1, least[first]


def common_prefixes(strings: list[bytes], folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, length, prefix) of every suffix of the collection in sorted order; prefix: bytes shared with the one above.

    Equal suffixes stand in order of their strings' numbers. Symbols are the bytes plus one; zero ends a string.
    """
    m, lengths = len(strings), np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.cumsum(lengths)
    text = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
    names = {c: Path(folder) / c for c in ("symbol", "prefix", "string", "length")}
    # Round 0: the empty suffixes, in the strings' order; each one's symbol is not known yet.
    np.zeros(m, np.int16).tofile(names["symbol"])
    np.zeros(m, np.uint16).tofile(names["prefix"])
    np.arange(m, dtype=np.int32).tofile(names["string"])
    np.zeros(m, np.uint16).tofile(names["length"])

    def rewrite(name: str, values: np.ndarray) -> None:
        """Columns only grow and are written over: ext4 sends a file that is emptied first to the disk when it is closed."""
        with open(names[name], "r+b") as file:
            values.tofile(file)

    live, place = np.arange(m), np.arange(m)  # strings that still grow, and where their longest suffix stands
    for column in range(int(lengths.max(initial=0))):
        go = lengths[live] > column
        live, place = live[go], place[go]
        symbol = np.fromfile(names["symbol"], np.int16)
        prefix = np.fromfile(names["prefix"], np.uint16)
        symbol[place] = text[ends[live] - 1 - column]
        # The suffixes of the next order are the empty ones, then those here with their symbols put in front.
        order = np.argsort(symbol, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        zeros = int(np.searchsorted(symbol[order], 1))
        at = rank[place]
        by = np.argsort(at)
        live, place, at = live[by], place[by], at[by]
        here = symbol[place]
        above, below = order[at - 1], order[np.minimum(at + 1, len(order) - 1)]
        has_above = (at > zeros) & (symbol[above] == here)
        has_below = (at + 1 < len(order)) & (symbol[below] == here)

        def shared(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            """One more than the least prefix in (low, high]."""
            if not len(low):
                return np.empty(0, np.uint16)
            marks = np.empty(2 * len(low), np.int64)
            marks[0::2], marks[1::2] = low + 1, high + 1
            padded = np.append(prefix, np.uint16(0))
            sort = np.argsort(low, kind="stable")
            marks = np.stack([low[sort] + 1, high[sort] + 1], axis=1).ravel()
            out = np.empty(len(low), np.uint16)
            out[sort] = np.minimum.reduceat(padded, marks)[0::2] + 1
            return out

        up, down = np.zeros(len(place), np.uint16), np.zeros(len(place), np.uint16)
        up[has_above] = shared(above[has_above], place[has_above])
        down[has_below] = shared(place[has_below], below[has_below])
        spot = m + at - zeros
        total = len(symbol) + len(place)
        old = np.ones(total, bool)
        old[spot] = False

        def put(name: str, kind: type, values: np.ndarray | int, fresh: np.ndarray | None = None) -> np.ndarray:
            out = np.empty(total, kind)
            out[old] = np.fromfile(names[name], kind) if fresh is None else fresh
            out[spot] = values
            return out

        longer = put("prefix", np.uint16, up, prefix)
        fix = spot[has_below] + 1
        longer[fix] = np.where(old[fix], down[has_below], longer[fix])
        rewrite("symbol", put("symbol", np.int16, 0, symbol))
        rewrite("prefix", longer)
        rewrite("string", put("string", np.int32, live.astype(np.int32)))
        rewrite("length", put("length", np.uint16, column + 1))
        place = spot
    return np.fromfile(names["string"], np.int32), np.fromfile(names["length"], np.uint16), np.fromfile(names["prefix"], np.uint16)


def earlier_elsewhere(strings: list[bytes], owners: np.ndarray, folder: str) -> list[np.ndarray]:
    """For each string the starts of its windows that a string with a smaller owner has too."""
    string, length, prefix = common_prefixes(strings, folder)
    full = length >= WINDOW
    keep = np.flatnonzero(full)
    if not len(keep):
        return [np.empty(0, np.int64)] * len(strings)
    # Between two full suffixes there may be shorter ones; then their common prefix is the least of those between.
    least = np.minimum.reduceat(prefix, np.append(0, keep[:-1] + 1)) if len(keep) > 1 else prefix[keep[:1]]
    least[1:] = np.minimum.reduceat(np.append(prefix, 0), np.stack([keep[:-1] + 1, keep[1:] + 1], axis=1).ravel())[0::2] if len(keep) > 1 else least[1:]
    group = np.cumsum(np.append(True, least[1:] < WINDOW)) - 1
    first = np.minimum.reduceat(owners[string[keep]], np.flatnonzero(np.append(True, least[1:] < WINDOW)))
    late = owners[string[keep]] > first[group]
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    who, start = string[keep][late], sizes[string[keep][late]] - length[keep][late]
    sort = np.argsort(who, kind="stable")
    return np.split(start[sort], np.searchsorted(who[sort], np.arange(1, len(strings))))


# --- Spark: anchors that several documents have, the strings around them, and what each document loses ----------------

NO_ID = (1 << 63) - 1
PACKED = "kind int, bucket int, d bigint, body binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, each as planes of bytes (differences first where it is sorted numbers), compressed."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(planes) // sum(widths), [], 0
    for kind, width in zip(kinds, widths):
        out.append(np.ascontiguousarray(planes[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _keys(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Forty bits of the anchor's hash and its bucket."""
    return ((anchor >> np.uint64(24)) << np.uint64(24)) | ((anchor & np.uint64(0xFFFFFF)) % np.uint64(buckets))


def _unique(values: np.ndarray) -> np.ndarray:
    """The different values in order; for the few that a document has, np.unique takes several times as long."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def _slices(sorted_values: np.ndarray) -> Iterator[tuple[int, slice]]:
    cut = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(sorted_values)).tolist()):
        if b > a:
            yield int(sorted_values[a]), slice(a, b)


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


_PACKED = (["kind", "bucket", "d", "body"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()])


def _offer(buckets: int):
    """Each document's anchors, packed by bucket. An anchor that several documents of a batch have is known to repeat: they note it themselves (kind 1) and the batch offers it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("d").to_numpy(), batch.column("text")
            each = [_unique(_keys(runs(np.frombuffer(_raw(texts[i].as_py()), np.uint8))[2], buckets)) for i in range(batch.num_rows)]
            if not sum(map(len, each)):
                continue
            key, doc = np.concatenate(each), np.repeat(ids, list(map(len, each)))
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            same = key[1:] == key[:-1]
            known, lead = np.append(same, False) | np.append(False, same), np.append(True, ~same)
            out = []
            if known.any():
                by = np.lexsort((key[known], doc[known]))
                noted, owners = key[known][by], doc[known][by]
                out += [(1, d % buckets, d, noted[s].tobytes()) for d, s in _slices(owners)]
            bucket = (key[lead] & np.uint64(0xFFFFFF)).astype(np.int64)
            by = np.lexsort((doc[lead], bucket))
            k, d, f = key[lead][by], doc[lead][by], known[lead][by]
            for b, s in _slices(bucket[by]):
                five = np.ascontiguousarray((k[s] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
                out.append((0, b, 0, _pack(np.diff(d[s], prepend=0), five.view("V5").ravel(), f[s])))
            yield _rows(out, *_PACKED)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, body): a document's anchors that another has too. Rows come sorted by bucket."""

    def settle(bucket: int, bodies: list[bytes]) -> list[tuple]:
        parts = [_unpack(b, "<i8", "V5", "?") for b in bodies]
        key = np.concatenate([np.pad(p[1].view(np.uint8).reshape(-1, 5), ((0, 0), (0, 3))).view("<u8").ravel() for p in parts])
        doc, known = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[2] for p in parts])
        order = np.argsort(key, kind="stable")
        key, doc, known = key[order], doc[order], known[order]
        same = key[1:] == key[:-1]
        tell = (np.append(same, False) | np.append(False, same)) & ~known
        by = np.argsort(doc[tell], kind="stable")
        full = ((key[tell] << np.uint64(24)) | np.uint64(bucket))[by]
        return [(d, full[s].tobytes()) for d, s in _slices(doc[tell][by])]

    names, kinds = ["d", "body"], [pa.int64(), pa.binary()]
    at, held = -1, []
    for batch in batches:
        out = []
        for kind, bucket, d, body in zip(*(c.to_pylist() for c in batch.columns)):
            if kind:
                out.append((d, body))
                continue
            if bucket != at and held:
                out += settle(at, held)
                held = []
            at = bucket
            held.append(body)
        yield _rows(out, names, kinds)
    if held:
        yield _rows(settle(at, held), names, kinds)


def _joined(d: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Byte ranges (document, hash of its text, start, stop) in order, those that touch joined."""
    by = np.lexsort((a, t, d))
    d, t, a, b = d[by], t[by], a[by], b[by]
    if not len(d):
        return d, t, a, b
    other = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]))
    # Ends so far, within a document: a document's own ends are lifted above all those before it.
    lift = (np.cumsum(other) - 1) * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + lift) - lift
    lead = np.flatnonzero(other | np.append(True, a[1:] > reach[:-1]))
    return d[lead], t[lead], a[lead], reach[np.append(lead[1:] - 1, len(reach) - 1)]


def _spans(docs: np.ndarray, ts: np.ndarray, starts: np.ndarray, stops: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of kind 1: byte ranges that documents lose, packed by the documents' buckets."""
    d, t, a, b = _joined(docs, ts, starts, stops)
    g = d % buckets
    by = np.argsort(g, kind="stable")
    d, t, a, b, g = d[by], t[by], a[by], b[by], g[by]
    return [(1, k, 0, _pack(d[s], t[s], a[s].astype("<i8"), b[s].astype("<i8"))) for k, s in _slices(g)]


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, body): the ranges of each document of a bucket, from what all tasks found."""
    for batch in batches:
        out = []
        for bodies in batch.column("bodies"):
            d, t, a, b = _joined(*(np.concatenate(c) for c in zip(*(_unpack(x, "<i8", "<i8", "<i8", "<i8") for x in bodies.as_py()))))
            out += [(i, _pack(t[s], a[s], b[s])) for i, s in _slices(d)]
        yield _rows(out, ["d", "body"], [pa.int64(), pa.binary()])


def _strings(buckets: int):
    """The segments around repeated anchors, packed by bucket. Of equal segments in a batch only the smallest document's go on; the others are lost to their documents (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, noted = batch.column("d").to_numpy(), batch.column("text"), batch.column("bodies")
            content, docs, ts, starts, keys = [], [], [], [], []
            for i in range(batch.num_rows):
                raw = _raw(texts[i].as_py())
                first, last, anchor = runs(np.frombuffer(raw, np.uint8))
                key = _keys(anchor, buckets)
                own = np.sort(np.frombuffer(b"".join(noted[i].as_py()), np.uint64))
                use = np.append(own, 0)[np.searchsorted(own, key)] == key if len(own) else np.zeros(len(key), bool)
                first, last = first[use].tolist(), last[use].tolist()
                content += [raw[a : b + WINDOW] for a, b in zip(first, last)]
                starts += first
                keys.append(key[use])
                docs.append(np.full(len(first), ids[i]))
                ts.append(np.full(len(first), hash_of(raw)))
            if not content:
                continue
            doc, t, start, key = np.concatenate(docs), np.concatenate(ts), np.array(starts, np.int64), np.concatenate(keys)
            number: dict[bytes, int] = {}
            cls = np.fromiter((number.setdefault(c, len(number)) for c in content), np.int64, len(content))
            least = np.full(len(number), NO_ID)
            np.minimum.at(least, cls, doc)
            late = doc > least[cls]
            size = np.fromiter(map(len, content), np.int64, len(content))
            out = _spans(doc[late], t[late], start[late], (start + size)[late], buckets)
            bucket = (key & np.uint64(0xFFFFFF)).astype(np.int64)
            go = np.flatnonzero(~late)
            go = go[np.lexsort((key[go], bucket[go]))]
            for b, s in _slices(bucket[go]):
                x = go[s]
                head = _pack(doc[x], t[x], start[x], key[x], size[x].astype("<i2"))
                body = zstandard.ZstdCompressor(level=1).compress(b"".join(content[j] for j in x.tolist()))
                out.append((0, b, len(head), head + body))
            yield _rows(out, *_PACKED)

    return run


def hash_of(raw: bytes) -> int:
    """Tells rows apart that share a doc_id."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def window_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window of ``data``, by doubling: 1, 2, 4, 8, 16, 32 bytes, then 32 + 16 + 2."""
    part, pieces = data.astype(np.uint64) + np.uint64(1), {}
    for width in (1, 2, 4, 8, 16):
        pieces[width] = part
        part = part[:-width] * _POWER[width] + part[width:]
    n = len(data) - WINDOW + 1
    return (part[:n] * _POWER[16] + pieces[16][32 : 32 + n]) * _POWER[2] + pieces[2][48 : 48 + n]


def _groups(key: np.ndarray, weight: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows with whole runs of equal keys, ``most`` of weight together unless one key has more."""
    if not len(key):
        return
    edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    so_far = np.append(0, np.cumsum(weight))[edge]
    i = 0
    while i < len(edge) - 1:
        j = max(i + 1, int(np.searchsorted(so_far, so_far[i] + most, "right")) - 1)
        yield int(edge[i]), int(edge[j])
        i = j


def shared_stretches(content: list[bytes], owners: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, stop): the bytes under consecutive windows whose hash a string of another owner has too.

    Strings are of WINDOW bytes at least and come in order of their anchors' keys; only those of one anchor can meet.
    """
    sizes, out = np.fromiter(map(len, content), np.int64, len(content)), []
    for a, b in _groups(key, sizes, PIECE):
        hashes, strings, places = [], [], []
        for i, j in _groups(np.arange(a, b), sizes[a:b], PIECE):
            data = np.frombuffer(b"".join(content[a + i : a + j]), np.uint8)
            own = sizes[a + i : a + j] - WINDOW + 1
            who = np.repeat(np.arange(j - i), own)
            place = np.arange(len(who)) - np.repeat(np.cumsum(own) - own, own)
            hashes.append(window_hashes(data)[place + (np.cumsum(sizes[a + i : a + j]) - sizes[a + i : a + j])[who]])
            strings.append((who + (a + i)).astype(np.int32))
            places.append(place.astype(np.int32))
        h, who, place = np.concatenate(hashes), np.concatenate(strings), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        h = h[order]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        owner = owners[who[order]]
        told = np.minimum.reduceat(owner, start) < np.maximum.reduceat(owner, start)
        use = np.empty(len(h), bool)
        use[order] = np.repeat(told, np.diff(np.append(start, len(h))))
        if not use.any():
            continue
        who, place = who[use], place[use]
        lead = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (place[1:] != place[:-1] + 1)))
        out.append((who[lead], place[lead], place[np.append(lead[1:], len(who)) - 1] + WINDOW))
    none = np.empty(0, np.int64)
    return tuple(np.concatenate([none, *c]) for c in zip(*out)) if out else (none, none, none)


def _classes(strings: Iterator[bytes], owners: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different strings, each string's number among them, the least owner of each)."""
    number: dict[bytes, int] = {}
    cls = np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(owners))
    least = np.full(len(number), NO_ID)
    np.minimum.at(least, cls, owners)
    return list(number), cls, least


def lost_ranges(content: list[bytes], owners: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, stop): bytes of different strings, in order of their keys, that one of a smaller owner has too.

    Their shared stretches are taken for themselves. Equal ones are the least owner's; of the different ones that share a
    window's hash with one of another owner the construction finds the windows.
    """
    who, a, b = shared_stretches(content, owners, key)
    parts, cls, least = _classes((content[i][x:y] for i, x, y in zip(who.tolist(), a.tolist(), b.tolist())), owners[who])
    late = owners[who] > least[cls]
    lost = [(who[late], a[late], b[late])]
    of = np.empty(len(parts), np.uint64)
    of[cls] = key[who]
    sus = np.unique(shared_stretches(parts, least, of)[0])
    string, start = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in _groups(of[sus], np.ones(len(sus), np.int64), BATCH):
        with tempfile.TemporaryDirectory() as folder:
            found = earlier_elsewhere([parts[x] for x in sus[i:j]], least[sus[i:j]], folder)
        string.append(np.repeat(sus[i:j], list(map(len, found))))
        start += found
    string, start = np.concatenate(string), np.concatenate(start)
    own = np.flatnonzero(~late)
    row, at = _matches(cls[own], string)
    lost.append((who[own][row], a[own][row] + start[at], a[own][row] + start[at] + WINDOW))
    return tuple(np.concatenate(c) for c in zip(*lost))


def _matches(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of equal numbers."""
    order = np.argsort(right, kind="stable")
    low, high = (np.searchsorted(right[order], left, side) for side in ("left", "right"))
    n = high - low
    return np.repeat(np.arange(len(left)), n), order[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)]


def _compared(buckets: int):
    """(g, body): byte ranges that documents lose, packed by the documents' buckets, from all strings of a bucket."""

    def settle(heads: list[bytes], bodies: list[bytes]) -> tuple[np.ndarray, ...]:
        doc, t, start, key, size = (np.concatenate(c) for c in zip(*(_unpack(h, "<i8", "<i8", "<i8", "<u8", "<i2") for h in heads)))
        size = size.astype(np.int64)
        blob = b"".join(zstandard.ZstdDecompressor().decompress(b) for b in bodies)
        stop, order, lost = np.cumsum(size), np.argsort(key, kind="stable"), []
        for i, j in _groups(key[order], size[order], BLOCK):
            x = order[i:j]
            content, cls, least = _classes((blob[b - n : b] for b, n in zip(stop[x].tolist(), size[x].tolist())), doc[x])
            # Classes are numbered as they come, so in order of their keys.
            who, a, b = lost_ranges(content, least, key[x][np.unique(cls, return_index=True)[1]])
            late = doc[x] > least[cls]
            own = np.flatnonzero(~late)
            row, at = _matches(cls[own], who)
            late, own = x[late], x[own][row]
            lost += [(doc[late], t[late], start[late], (start + size)[late]), (doc[own], t[own], start[own] + a[at], start[own] + b[at])]
        return tuple(np.concatenate(c) for c in zip(*lost))

    def told(lost: list[tuple[np.ndarray, ...]]) -> list[tuple]:
        return [(g, body) for _, g, _, body in _spans(*(np.concatenate(c) for c in zip(*lost)), buckets)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["g", "body"], [pa.int64(), pa.binary()]
        at, heads, bodies, size, lost = -1, [], [], 0, []
        for batch in batches:
            out = []
            for kind, bucket, d, body in zip(*(c.to_pylist() for c in batch.columns)):
                if kind:
                    out.append((bucket, body))
                    continue
                if bucket != at and size > HELD:
                    lost.append(settle(heads, bodies))
                    heads, bodies, size = [], [], 0
                    if sum(len(x[0]) for x in lost) > RANGES:
                        out += told(lost)
                        lost = []
                at = bucket
                heads.append(body[:d])
                bodies.append(body[d:])
                size += len(body) - d
            yield _rows(out, names, kinds)
        if heads:
            lost.append(settle(heads, bodies))
        if lost:
            yield _rows(told(lost), names, kinds)

    return run


def kept_bytes(raw: bytes, bodies: list[bytes]) -> tuple[int, int, bytes]:
    """(removed, spans, what is left) of a text, given its packed ranges."""
    if not bodies:
        return 0, 0, raw
    t, a, b = (np.concatenate(c) for c in zip(*(_unpack(x, "<i8", "<i8", "<i8") for x in bodies)))
    own = t == hash_of(raw)
    step = np.zeros(len(raw) + 1, np.int64)
    np.add.at(step, a[own], 1)
    np.add.at(step, b[own], -1)
    gone = np.cumsum(step)[:-1] > 0
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text without the bytes that a smaller doc_id's text has too.

    A null text is empty; a null doc_id counts as larger than all others; rows that share a doc_id never remove from
    each other. An empty table gives no rows.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("d"), F.col("text").cast("string").alias("text"))
    buckets = min(1 << 24, max(BUCKETS, own.rdd.getNumPartitions()))
    dealt = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    repeated = dealt(own.mapInArrow(_offer(buckets), PACKED)).mapInArrow(_repeated, "d bigint, body binary")
    noted = repeated.groupBy("d").agg(F.collect_list("body").alias("bodies"))
    strings = own.join(noted, "d").mapInArrow(_strings(buckets), PACKED)
    lost = dealt(strings).mapInArrow(_compared(buckets), "g bigint, body binary")
    # A bucket holds as many documents however large the input is; each comes out once.
    gone = lost.groupBy("g").agg(F.collect_list("body").alias("bodies")).mapInArrow(_by_document, "d bigint, body binary")
    gone = gone.select("d", F.array("body").alias("gone"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, text, gone in zip(*(batch.column(c) for c in ("d", "text", "gone"))):
                raw = _raw(text.as_py())
                removed, spans, left = kept_bytes(raw, gone.as_py() or [])
                out.append((None if d.as_py() == NO_ID else d.as_py(), len(raw), removed, spans, left))
            yield _rows(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], [pa.int64()] * 4 + [pa.binary()])

    return own.join(gone, "d", "left").mapInArrow(finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
