"""What the operators of this package share: tables, intermediate results, edited schemas, components."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeflow.session import new_folder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package; on a cluster it is installed or sent with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


#: Rows that Python workers get at a time in :func:`small_batches`: texts of 2 KB make some 2 MB, in the JVM and in Python.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Python workers get ``BATCH_ROWS`` rows at a time, or fewer if that is what it says.

    Each running task holds a batch several times (Arrow's buffers double while they fill, on both sides), beside the heap.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_written: list[str] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` under the shared folder and reads it again, so that a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Intermediates:
    """Notes the tables that :func:`saved` writes, to remove them once what was made of them is stored itself."""

    def __init__(self) -> None:
        self._paths: list[str] = []

    def __enter__(self) -> Intermediates:
        self._from = len(_written)
        return self

    def __exit__(self, *_) -> None:
        self._paths += _written[self._from :]
        del _written[self._from :]

    def remove(self, spark: SparkSession) -> None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while self._paths:
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop())
            path.getFileSystem(conf).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """The connected component of every node that has an edge: ``node``, ``component`` (its smallest node).

    ``edges`` has two columns ``a`` and ``b`` of one ordered type; loops are allowed. Every round hooks each root to its
    least neighbouring root, if that is less than itself, and contracts the edges. Rounds take turns in what is less:
    by the nodes themselves a star of any size vanishes in two rounds, but a sorted chain only halves; by a hash that
    each round draws anew a chain of any order shrinks to less than half, as no order of nodes can make long ways down.
    So rounds grow with the logarithm of the nodes. They are written to the shared folder.
    """
    labels = saved(
        edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")),
        "components",
    )
    ways = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left, number = saved(edges.filter("a != b").select(*ways).distinct(), "edges"), 0
    while not left.isEmpty():

        def rank(node: str):
            return F.struct(F.xxhash64(node, F.lit(number)), node) if number % 2 else F.struct(node)

        down = F.when(rank("a") < rank("b"), F.struct(F.col("b").alias("root"), F.col("a").alias("to")))
        hooks = left.select(down.otherwise(F.struct(F.col("a").alias("root"), F.col("b").alias("to"))).alias("way"))
        parents = saved(hooks.select("way.*").groupBy("root").agg(F.min_by("to", rank("to")).alias("parent")), "parents")
        # One jump shortens chains of parents before they are used.
        upper = parents.select(F.col("root").alias("parent"), F.col("parent").alias("grandparent"))
        parents = saved(
            parents.join(upper, "parent", "left").select("root", F.coalesce("grandparent", "parent").alias("parent")),
            "parents",
        )

        def lifted(df: DataFrame, column: str) -> DataFrame:
            up = parents.select(F.col("root").alias(column), F.col("parent").alias("_up"))
            return df.join(up, column, "left").withColumn(column, F.coalesce("_up", column)).drop("_up")

        labels = saved(lifted(labels, "component").select("node", "component"), "components")
        left = saved(lifted(lifted(left, "a"), "b").filter("a != b").select(*ways).distinct(), "edges")
        number += 1
    smallest = labels.groupBy("component").agg(F.min("node").alias("smallest"))
    return labels.join(smallest, "component").select("node", F.col("smallest").alias("component"))
