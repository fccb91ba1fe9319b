"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper and lower case, for folding A-Z and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a few numbers up to which a written and counted table is broadcast (some 40 MB); beyond it Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; in local mode a local one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame, rows: bool = False) -> DataFrame | tuple[DataFrame, int]:
    """The same rows, written once as a Parquet table in the shared folder: cuts the lineage, survives lost executors.

    With ``rows`` also their number, which the files tell without being read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracemill-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    return (found, found.count()) if rows else found


def dropped(written: DataFrame) -> None:
    """Deletes the files of a table that ``saved`` wrote, once nothing reads it any more."""
    spark = written.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(written: DataFrame, rows: int) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if its counted rows are few."""
    return F.broadcast(written) if rows <= BROADCAST_ROWS else written


def packed(df: DataFrame, rows: int) -> DataFrame:
    """A table of a few numbers a row in no more tasks than its counted rows need."""
    return df.coalesce(1 + rows // 250_000)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where the table has a column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def only(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns alone, cast; other columns of the input can't clash with an operator's own names."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()])


def components(links: DataFrame, rounds: int = 60) -> tuple[DataFrame, int]:
    """Connected components of undirected ``links`` (a, b): a row (node, root) for each node, root the smallest node reachable; and their number.

    Each round every node takes the smallest label among itself and its neighbours, then the label of its label (pointer
    jumping), so long chains need few rounds. Labels are written once a round and the round's before is deleted; nothing
    goes to the driver but a count a round. ``min`` is combined before its shuffle. Labels are joined by broadcast where they
    are few; otherwise a hub, or a root that very many nodes have, is a hot key of one side only, the other has a row a
    key, which is what Spark splits skewed joins on.
    """
    both, m = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), rows=True)
    both = packed(both, m)
    label, n = saved(packed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), m), rows=True)
    for _ in range(rounds if n else 0):
        seen = both.join(small(label.select(F.col("node").alias("b"), F.col("root").alias("near")), n), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = label.join(small(seen, n), label.node == seen.a, "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = label.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        new = step.join(small(jump, n), "mid", "left").select("node", "old", F.least("mid", "far").alias("root"))
        written = saved(packed(new, n))
        dropped(label)
        label = written.select("node", "root")
        if not written.where("root <> old").limit(1).count():
            dropped(both)
            return label, n
    if n:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return label, n
