"""What the operators share: the shared folder, checkpoints, skew-free sizes and connected components."""

from __future__ import annotations

import ctypes
import inspect
import sys
import tempfile

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where it is unset and the driver is the only
    machine (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="groundwork-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store, whatever store that is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back_driver(spark: SparkSession) -> None:
    """What the driver's JVM has freed outside its heap goes back to the system, where its JVM has a command for that.

    Hundreds of threads plan, broadcast and listen; the C library keeps what each of them has freed. Live memory and
    the heap are not touched.
    """
    lang, array = spark._jvm.java.lang, spark.sparkContext._gateway.new_array
    call = array(lang.Object, 4)
    call[0] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    call[1], call[2], call[3] = "systemTrimNativeHeap", array(lang.Object, 0), array(lang.String, 0)
    try:  # by the public interface: the server's own class is closed to reflection
        methods = lang.Class.forName("javax.management.MBeanServer").getMethods()
        invoke = next(m for m in methods if m.getName() == "invoke")
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JJavaError:  # other kinds of JVM, and systems with another C library, keep it
        pass


def materialised(df: DataFrame) -> DataFrame:
    """df written once to the shared folder; its lineage is cut, so a lost executor costs nothing that was done."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    give_back_driver(df.sparkSession)
    return out


def worker_cache(name: str, make):
    """A value that lives as long as the Python worker, over many tasks. It only saves time."""
    store = sys.__dict__.setdefault("_groundwork_cache", {})
    if name not in store:
        store[name] = make()
    return store[name]


class BoundedCache:
    """A dictionary of at most about `limit` bytes; it is emptied when full, and only saves time."""

    def __init__(self, limit: int):
        self.limit, self.held, self.known = limit, 0, {}
        self.get = self.known.get

    def put(self, key, value, size: int):
        """Keeps value; size is an estimate of its bytes and its key's, without what a dictionary takes for an entry."""
        self.held += size + 100
        if self.held > self.limit:
            self.clear()
        self.known[key] = value

    def clear(self):
        self.known.clear()
        self.held = 0


def give_back():
    """What this process has freed goes back to the system: workers that wait share the executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """run, a function of batches or of one group's table, that gives memory back when it is done."""

    def stream(batches):
        yield from run(batches)
        give_back()

    def once(table):
        out = run(table)
        give_back()
        return out

    return stream if inspect.isgeneratorfunction(run) else once


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, from one narrow scan."""
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def salts_for(rows: int, salt_rows: int = 65536) -> int:
    """How many salts the rows of one key are dealt to, if all rows had that key: 64, or one for each `salt_rows`."""
    return max(64, rows // salt_rows + 1)


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], by: str, salts: int) -> DataFrame:
    """rows joined with groups, which has one row for each value of keys.

    A key's rows are dealt to salts by a hash of column `by`, and its group goes to those salts that hold some, so a
    key of a third of all rows is as many tasks as there are salts. Rows whose key is null or has no group go.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    held = salted.select(*keys, "_salt").distinct().join(groups, keys)
    return salted.join(held, [*keys, "_salt"]).drop("_salt")


def _starred(e: DataFrame, salt) -> DataFrame:
    """The edges of e(u, v), u > v, after a round of large star and small star."""
    # large star: every larger neighbour of a node is linked to the smallest of its neighbourhood
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("salt", salt)
    salts = both.groupBy("u", "salt").agg(F.min("v").alias("m"))
    low = salts.groupBy("u").agg(F.min("m").alias("m")).select("u", F.least("u", "m").alias("m"))
    low = salts.select("u", "salt").join(low, "u")
    large = both.where("v > u").join(low, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u <> v").distinct()
    # small star: every smaller neighbour, and the node, is linked to the smallest of them
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return materialised(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def _settled(e: DataFrame) -> bool:
    """Whether the edges are stars, each node under its component: none has two smaller neighbours, or one of each kind."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.max(F.expr("up > 1 or up > 0 and down > 0")).alias("open")).first()["open"]


def connected_components(edges: DataFrame, max_rounds: int = 40, salt_rows: int = 65536) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Small-star and large-star rounds alternate until nothing changes. The neighbours of a node are dealt to salts, 64 or
    one for each `salt_rows` edges, and a salt takes the node's minimum from the salts' minima, so a hub is a row a salt
    wherever rows meet by node. Each round's edges are checkpointed. No edge or label ever reaches the driver.
    """
    e = materialised(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    salt = F.pmod(F.xxhash64("v"), F.lit(salts_for(e.count(), salt_rows)))
    for _ in range(max_rounds):
        e = _starred(e, salt)
        if _settled(e):
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
