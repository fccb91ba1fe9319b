"""Whitening of embeddings by MLlib's SVD of centred rows.

Entries become whole numbers, so the sums of each dimension, and with them every row's distance from the mean, are exact.
``computeSVD`` takes the rows centred on those means. Its singular values s belong to the rows' sum of products; a
covariance divides by n, so a component's variance is s^2 / n. The total variance does not come from the SVD: it is the
exact sum of squared deviations. Sums, deviations and projections are columns of one row each and nothing but matrices of
the dimension's size reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

#: An entry c becomes floor(SCALE * c) + SHIFT; entries so large that this is over LARGEST become LARGEST.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 40
#: Components that are told, and the least singular value against the greatest that counts as one: below, doubles do not tell it from zero.
MOST, LEAST = 32, 1e-7


@dataclass(frozen=True)
class Whitening:
    """Rows, the sum of each dimension, components (a unit vector each, by falling variance), their variances, the total variance, and whether deviations fit in longs."""

    n: int
    sums: list[int]
    components: list[list[float]]
    variances: list[float]
    total: float
    narrow: bool


def whole(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """(vec_id, x): every vector without nulls, NaN or infinity as whole numbers.

    Where lengths differ, vectors of the most frequent one stay (of the longer one among equally frequent); empty vectors
    and null ones go. Rows that share an id, or have none, all stay.
    """
    c = F.col(f"`{name}`").cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id"), c.alias("c")).where(F.coalesce(fine, F.lit(False)) & (F.size("c") > 0))
    least, most = F.lit(float(-LARGEST)), F.lit(float(LARGEST))
    whole_ = lambda v: F.floor(F.greatest(least, F.least(most, v * SCALE))).cast("bigint") + SHIFT
    lengths = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("c") == (lengths["d"] if lengths else 0)).select("vec_id", F.transform("c", whole_).alias("x"))


def apart(n: int, sums: list[int], narrow: bool) -> Column:
    """n * x - S of each dimension, exact: longs where they fit, else decimals."""
    kind = "bigint" if narrow else "decimal(38,0)"
    s = F.array(*[F.lit(str(v)).cast(kind) for v in sums])
    return F.zip_with("x", s, lambda x, v: F.lit(str(n)).cast(kind) * x - v)


def squared(away: Column, narrow: bool) -> Column:
    kind = "bigint" if narrow else "decimal(38,0)"
    return F.aggregate(away, F.lit(0).cast(kind), lambda a, v: (a + v * v).cast(kind))


def fit(rows: DataFrame, most: int = MOST) -> Whitening | None:
    """The whitening of (vec_id, x) rows, null for a table without rows; vectors that are all alike have no component."""
    each = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.min("v").alias("low"), F.max("v").alias("high"))
    told = sorted(each.collect())
    if not told:
        return None
    n, sums = told[0]["n"], [int(r["s"]) for r in told]
    widest = [max(n * r["high"] - int(r["s"]), int(r["s"]) - n * r["low"]) for r in told]
    narrow = max(sum(w * w for w in widest), *(n * max(abs(r["low"]), abs(r["high"])) for r in told)) < 1 << 63
    away = apart(n, sums, narrow)
    deviation = rows.select(F.sum(squared(away, narrow).cast("decimal(38,0)")).alias("d")).first()["d"]
    if not deviation:
        return Whitening(n, sums, [], [], 0.0, narrow)
    centred = rows.select(array_to_vector(F.transform(away, lambda v: v.cast("double") / n)).alias("v"))
    # With every component asked for, MLlib decomposes the summed products by LAPACK and not to a tolerance.
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v")).computeSVD(len(sums), False, LEAST)
    vectors = found.V.toArray().T
    variances = [float(s) ** 2 / n for s in found.s.toArray()]
    return Whitening(n, sums, [[float(v) for v in c] for c in vectors[:most]], variances[:most], float(Fraction(int(deviation), n**3)), narrow)


def whitened(rows: DataFrame, w: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened): each row's exact sum of (n * x - S)^2, and its coordinate on each component over the component's deviation."""
    away = apart(w.n, w.sums, w.narrow)
    axes = [F.array(*[F.lit(v / e**0.5) for v in c]) for c, e in zip(w.components, w.variances)]
    on = lambda axis: F.aggregate(F.zip_with("y", axis, lambda y, v: y * v), F.lit(0.0), lambda a, v: a + v)
    placed = rows.select("vec_id", squared(away, w.narrow).alias("deviation"), F.transform(away, lambda v: v.cast("double") / w.n).alias("y"))
    return placed.select("vec_id", "deviation", F.array(*map(on, axes)).alias("whitened"))


def identity_error(written: DataFrame, n: int) -> float:
    """The largest absolute entry of the whitened rows' covariance (divisor n) less the identity; one row has covariance zero."""
    if n == 1:
        return 1.0
    vectors = written.select(array_to_vector("whitened").alias("v"))
    cov = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeCovariance().toArray() * ((n - 1) / n)
    for k in range(len(cov)):
        cov[k][k] -= 1
    return float(abs(cov).max())


def whiten(vectors: DataFrame, name: str = "embedding", most: int = MOST) -> DataFrame | None:
    """(vec_id, n, deviation, whitened, explained, identity_error), a row a vector; arrays have an entry a component, up to ``most``.

    Which vectors take part, and what becomes of repeated and null ids, is told at ``whole``. A table without vectors, or
    with vectors that are all alike, has no component and gives null. Columns other than ``vec_id`` and ``name`` are not
    read, so their names do not matter. A component whose variance doubles do not tell from zero is left out. Where a
    deviation is over a long it is exact as a decimal. The dimension, not the table, bounds what the driver holds.
    """
    rows = whole(vectors, name)
    w = fit(rows, most)
    if w is None or not w.components:
        return None
    written = saved(whitened(rows, w))
    explained = F.array(*[F.lit(e / w.total) for e in w.variances])
    return written.select("vec_id", F.lit(w.n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(identity_error(written, w.n)).alias("identity_error"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a vector and component. A deviation that is over a long is null."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    if found is None:
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    each = found.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "c.whitened", "c.explained", "identity_error")
