"""Toxicity scores from a factorization machine over hashed terms.

A text's features are its distinct lower-cased words, hashed to ``BUCKETS`` numbers. The machine adds a weight a term and,
for each pair of terms, the product of two short learned vectors, so that two terms can mean together what neither means
alone; the pair sum is taken in linear time. Terms are built by Spark functions; numpy learns from a bounded sample and
scores Arrow batches inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, only, table

BUCKETS, FACTORS = 1 << 18, 8
#: Labelled rows to learn from, at most, by the order of a hash of doc_id.
SAMPLE = 20_000
#: A term counts if at least so many sampled documents have it, whatever their labels.
LEAST_DOCS = 5
#: What a step takes off each weight and off the length of each term's vector (regularisation decides which stay), and the vectors' share of the rate.
SHRINK, SHRINK_FACTOR, FACTOR_RATE = 1e-3, 5e-4, 0.5
#: Parts of the sample that are scored by machines fitted to the others, to place the threshold.
FOLDS = 2
THRESHOLD = 0.7
#: What a task of ``train`` gives back.
LEARNED = pa.schema([("part", pa.int32()), ("bias", pa.float64()), ("term", pa.list_(pa.int32())), ("weight", pa.list_(pa.float32())), ("factor", pa.list_(pa.float32())), ("raw", pa.list_(pa.float64())), ("toxic", pa.list_(pa.float64()))])


def terms(text: Column) -> Column:
    """The distinct hashed words of a text; null: none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def held_out(doc_id: Column) -> Column:
    """True for the third of rows that labels are never learned from; a null id is read as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


class Machine:
    """A fitted factorization machine: ``bias``, ``weight`` (buckets), ``factor`` (buckets x factors), all float32."""

    def __init__(self, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.bias, self.weight, self.factor = bias, weight, factor
        self.active = (weight != 0) | (factor != 0).any(axis=1)

    def raw(self, flat: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Log odds of ``rows`` texts; ``flat`` has their terms, ``row`` each term's text."""
        use = self.active[flat]
        flat, row = flat[use], row[use]
        out = self.bias + np.bincount(row, self.weight[flat], rows)
        for f in range(self.factor.shape[1]):
            v = self.factor[flat, f]
            out += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
        return out

    def score(self, lists: pa.ListArray) -> np.ndarray:
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        return 1 / (1 + np.exp(-np.clip(self.raw(flat, np.repeat(np.arange(len(lists)), sizes), len(lists)), -30, 30)))


def supported(lists: list[np.ndarray]) -> np.ndarray:
    """The terms that enough documents have."""
    docs = np.zeros(BUCKETS, np.int64)
    for k in range(0, len(lists), 1000):
        docs += np.bincount(np.concatenate(lists[k : k + 1000]), minlength=BUCKETS)
    return np.flatnonzero(docs >= min(LEAST_DOCS, max(1, len(lists) // 50)))


def descend(lists: list[np.ndarray], labels: np.ndarray, epochs: int = 12, rate: float = 0.15, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss; both labels occur.

    All supported terms have a weight and a vector. The first ``epochs`` fit the weights alone, as many more fit the vectors
    with them, so that vectors explain what weights leave over.
    """
    n, active = len(lists), supported(lists)
    place = np.full(BUCKETS, -1, np.int32)
    place[active] = np.arange(len(active))
    kept = [p[p >= 0] for p in (place[x] for x in lists)]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(active)), rng.normal(0, 0.02, (len(active), FACTORS))
    bias = float(np.log(labels.mean() / (1 - labels.mean())))
    gw, gv, gb = np.full(len(active), 1e-2), np.full((len(active), FACTORS), 1e-2), 1e-2
    # Batches are dealt once and come in another order each epoch, so that their terms are sorted once.
    batches = []
    for batch in np.array_split(rng.permutation(n), max(1, n // 128)):
        flat = np.concatenate([kept[i] for i in batch]).astype(np.int32)
        if len(flat):
            row = np.repeat(np.arange(len(batch), dtype=np.int32), [len(kept[i]) for i in batch])
            order = np.argsort(flat, kind="stable")
            at, first = np.unique(flat[order], return_index=True)
            # Terms in order, so that a term's rows stand together.
            batches.append((batch, flat[order], row[order], at, first.astype(np.int32)))
    del kept
    for epoch in range(2 * epochs):
        for b in rng.permutation(len(batches)):
            batch, flat, row, at, first = batches[b]
            z = bias + np.bincount(row, w[flat], len(batch))
            if epoch >= epochs:
                vf = v[flat]
                total = np.stack([np.bincount(row, vf[:, f], len(batch)) for f in range(FACTORS)], axis=1)
                z += 0.5 * ((total**2).sum(axis=1) - np.bincount(row, (vf * vf).sum(axis=1), len(batch)))
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]
            each = error[row]
            dw = np.add.reduceat(each, first) / len(batch) + decay * w[at]
            gw[at] += dw * dw
            step = rate / np.sqrt(gw[at])
            moved = w[at] - step * dw
            w[at] = np.sign(moved) * np.maximum(np.abs(moved) - step * SHRINK, 0)
            if epoch >= epochs:
                dv = np.add.reduceat(each[:, None] * (total[row] - vf), first) / len(batch) + decay * v[at]
                gv[at] += dv * dv
                steps = FACTOR_RATE * rate / np.sqrt(gv[at])
                turned = v[at] - steps * dv
                size = np.sqrt((turned**2).sum(axis=1))
                v[at] = turned * np.maximum(1 - steps.mean(axis=1) * SHRINK_FACTOR / np.maximum(size, 1e-12), 0)[:, None]
            gb += (db := error.mean()) ** 2
            bias -= rate * db / np.sqrt(gb)
    weight, factor = np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32)
    weight[active], factor[active] = w, v
    return Machine(bias, weight, factor)


def cut(raw: np.ndarray, labels: np.ndarray) -> float:
    """The log odds from which calling a text toxic has the best F1, midway between the two scores that it parts."""
    order = np.argsort(-raw, kind="stable")
    z, hit = raw[order], np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + labels.sum())
    f1[:-1][z[:-1] == z[1:]] = 0
    best = int(np.argmax(f1))
    return float(z[best] + (z[best + 1] if best + 1 < len(z) else z[best] - 1)) / 2


def constant(label: float) -> Machine:
    """A machine that gives every text the same score."""
    return Machine(4.0 if label else -4.0, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32))


def judged(lists: list[np.ndarray], labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds and labels of fold ``k`` by a machine fitted to the other rows; none where those have one label only."""
    fold = np.random.default_rng(11).permutation(len(lists)) % FOLDS
    rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
    if not len(own) or not len(rest) or labels[rest].min() == labels[rest].max():
        return np.zeros(0), np.zeros(0)
    part = descend([lists[i] for i in rest], labels[rest])
    return part.raw(np.concatenate([lists[i] for i in own]), np.repeat(np.arange(len(own)), [len(lists[i]) for i in own]), len(own)), labels[own]


def settled(machine: Machine, raw: np.ndarray, labels: np.ndarray) -> Machine:
    """The machine whose score reaches THRESHOLD where the judged rows part best."""
    if 0 < labels.sum() < len(labels):
        machine.bias += float(np.log(THRESHOLD / (1 - THRESHOLD))) - cut(raw, labels)
    return machine


def fit(lists: list[np.ndarray], labels: np.ndarray) -> Machine:
    """A machine for a bounded sample whose score reaches THRESHOLD where held-out folds of the sample part best.

    No rows, or one label only: a machine that gives every text the same score.
    """
    if not len(lists) or labels.min() == labels.max():
        return constant(labels[0] if len(lists) else 0)
    machine = descend(lists, labels)
    raw, own = map(np.concatenate, zip(*(judged(lists, labels, k) for k in range(FOLDS))))
    return settled(machine, raw, own)


def learned(rows: pa.Table) -> pa.Table:
    """A part of what ``fit`` does, on the whole sample (doc_id, terms, toxic, part): a fold is judged, or, as part FOLDS, the machine fitted."""
    k, rows = rows.column("part")[0].as_py(), rows.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    lists, labels = [np.sort(x.values.to_numpy(zero_copy_only=False)) for x in rows.column("terms")], rows.column("toxic").to_numpy().astype(float)
    machine, raw, own = constant(labels[0]), np.zeros(0), np.zeros(0)
    if k < FOLDS:
        raw, own = judged(lists, labels, k)
    elif labels.min() != labels.max():
        machine = descend(lists, labels)
    term = np.flatnonzero(machine.active).astype(np.int32)
    values = [k, machine.bias, term, machine.weight[term], machine.factor[term].ravel(), raw, own]
    return pa.table([pa.array([v], f.type) for v, f in zip(values, LEARNED)], schema=LEARNED)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Learns from at most ``sample`` labelled rows outside the held-out third; rows with a null id, label or twice-used id are fine (null: unused).

    The sample is dealt to a task for the machine and one a fold; the driver gets the machine's terms and the folds' log odds.
    """
    known = only(labels, doc_id="bigint", toxic="int").where("doc_id is not null and toxic in (0, 1)")
    chosen = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The sample has at most ``sample`` rows of two numbers, so it can be broadcast.
    rows = only(docs, doc_id="bigint", text="string").join(F.broadcast(chosen), "doc_id").select("doc_id", terms(F.col("text")).alias("terms"), "toxic")
    dealt = rows.select("*", F.explode(F.array(*map(F.lit, range(FOLDS + 1)))).alias("part"))
    found = sorted(dealt.groupBy("part").applyInArrow(learned, "part int, bias double, term array<int>, weight array<float>, factor array<float>, raw array<double>, toxic array<double>").toArrow().to_pylist(), key=lambda r: r["part"])
    machine = constant(0)
    if not found:
        return machine
    term, weight, factor = np.array(found[-1]["term"], np.int64), machine.weight, machine.factor
    weight[term], factor[term] = found[-1]["weight"], np.array(found[-1]["factor"], np.float32).reshape(-1, FACTORS)
    raw, own = (np.concatenate([np.array(r[c], float) for r in found[:FOLDS]]) for c in ("raw", "toxic"))
    return settled(Machine(found[-1]["bias"], weight, factor), raw, own)


def scored(docs: DataFrame, machine: Machine, id_kind: str = "bigint") -> DataFrame:
    """(doc_id, score) of every row, null and empty texts included (their score is the bias alone)."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weight, machine.factor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.score(batch.column("terms")), pa.float64())], names=["doc_id", "score"])

    return only(docs, doc_id=id_kind, text="string").select("doc_id", terms(F.col("text")).alias("terms")).mapInArrow(run, f"doc_id {id_kind}, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows that score below the threshold, with the columns they came with. Rows that share an id are judged each by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weight, machine.factor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*shared.value)
        for batch in batches:
            kept = batch.filter(pa.array(own.score(batch.column(batch.num_columns - 1)) < THRESHOLD))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=names)

    names = docs.columns
    (own_terms,) = fresh(docs, "terms")
    return docs.select("*", terms(F.col("text").cast("string")).alias(own_terms)).mapInArrow(run, docs.schema)
