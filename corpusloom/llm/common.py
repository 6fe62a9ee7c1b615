"""What the operators of this folder share: inputs, shared storage and small helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: White space of the contracts: blank and the controls from tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"

_made: list[tuple[SparkSession, str]] = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def docs_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Two columns, doc_id and text, whatever else the table has."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that names none gets one, a cluster has to name it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    own = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def stash(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_forget_all)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path
    return out


def forget_path(spark: SparkSession, path: str) -> None:
    _made[:] = [x for x in _made if x[1] != path]
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget_all() -> None:
    """At exit: what is still there goes; a session that has ended leaves it to the cluster."""
    for spark, path in list(_made):
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Py4JError, OSError):
                forget_path(spark, path)


def forget(*tables: DataFrame) -> None:
    """Delete stashed tables that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_stash", None):
            forget_path(t.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_held: dict = {}


def held_by_worker(key, make):
    """What a Python worker keeps between batches and stages, made once; another key's takes its place.

    Workers outlive stages, so the caches of one operator would else lie beside those of the next."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Give back what the operator before kept in this worker."""
    _held.clear()
    trim()


def trim() -> None:
    """Free memory goes back to the system, so that idle workers stay small."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: A worker turns so many rows, and so many bytes of text, into Python values at once; a longer text comes alone.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20
#: An Arrow batch on its way to a worker: Spark's own bound on its bytes, and the one that takes its place.
SPARK_BATCH, OWN_BATCH = "67108864b", "8m"


def slices(batches, column: int = 1):
    """Record batches in slices of bounded rows and bytes of one text or binary column."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = int(np.searchsorted(ends, before + SLICE_BYTES, "right"))
            n = max(1, min(SLICE_ROWS, upto - at))
            yield b.slice(at, n)
            at += n


def record_batch(columns, schema: pa.Schema) -> pa.RecordBatch:
    """Columns (lists or arrays, None for null) as a batch; nothing passes through floats, so ids stay exact."""

    def column(c, kind: pa.DataType) -> pa.Array:
        if not isinstance(c, pa.Array):
            return pa.array(c, kind)
        return c if c.type == kind else c.cast(kind)  # names of zones and of nested fields may differ

    return pa.RecordBatch.from_arrays([column(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches hold few bytes, so that long texts don't pile up; a session with a bound of its own keeps it."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", SPARK_BATCH) == SPARK_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", OWN_BATCH)


def map_arrow(df: DataFrame, run, fields: str | T.StructType) -> DataFrame:
    """mapInArrow with a worker that uses the system's memory pool and gives memory back after each task.

    run gets the record batches and the Arrow schema of fields, and yields record batches."""
    bound_batches(df.sparkSession)
    kind = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields
    schema = to_arrow_schema(kind)

    def task(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches, schema)
        finally:
            trim()

    return df.mapInArrow(task, kind)


def map_texts(docs: DataFrame, of, fields: str) -> DataFrame:
    """Rows made from (doc_id, text): of gets an iterator of (ids, texts) lists and yields lists of rows or, as a
    tuple, of columns."""

    def run(batches, schema):
        for out in of((b.column(0).to_pylist(), b.column(1).to_pylist()) for b in slices(batches)):
            columns = out if isinstance(out, tuple) else list(zip(*out))
            if len(columns) and len(columns[0]):
                yield record_batch(columns, schema)

    return map_arrow(docs_of(docs), run, fields)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, however it is cased."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_field(kind: T.StructType, name: str, ddl: str) -> T.StructType:
    """The schema with one more field at its end."""
    return T.StructType([*kind.fields, *T.StructType.fromDDL(f"`{name}` {ddl}").fields])


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, where=None) -> DataFrame:
    """At most per_class rows for either label of a column, chosen by a hash of doc_id; doc_id, text, y.

    Labels decide first, so the side that is broadcast has 2 * per_class rows at most."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
    rows = rows.where("doc_id is not null")
    if where is not None:
        rows = rows.where(where)
    rows = rows.dropDuplicates(["doc_id"])
    picked = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    return docs_of(docs).join(F.broadcast(picked), "doc_id")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a long, b long) edges to (node, component), component being the smallest node that can be reached;
    that smallest node has no row of its own.

    Alternates large-star and small-star steps; each is one aggregation on the node and each result is stashed.
    An error is raised where the state still changes after the last round.
    A node with very many neighbours is never gathered: the minimum is aggregated map-side, then joined."""
    spark = edges.sparkSession
    cur = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    last = None
    for _ in range(rounds):
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small_min = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        joined = large.join(small_min, large.hi == small_min.u)
        small = joined.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).distinct()
        new = stash(small)
        sums = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        forget(cur)
        cur = new
        if last == (sums["n"], sums["h"]):
            break
        last = (sums["n"], sums["h"])
    else:
        raise RuntimeError(f"connected components did not settle in {rounds} rounds")
    return cur.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")), cur


def id_bits(rows: DataFrame, column: str, bits: int = 1 << 25) -> bytes:
    """A bit map of fixed size (4 MB) with a bit for the low bits of each hash in a column: what is broadcast has one
    size at every scale.  A wrong hit only costs a row that a later exact join drops."""
    found = rows.selectExpr(f"`{column}` & {bits - 1}L as b").selectExpr("shiftright(b, 6) as w", "shiftleft(1L, cast(b & 63 as int)) as m").groupBy("w").agg(F.bit_or("m").alias("m"))
    words = found.toArrow()  # bits / 64 rows at most, in one job
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words["w"].to_numpy()] = words["m"].to_numpy()
    return out.tobytes()


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows with a count n so high that no more than a given number of rows have it; ties at the bound stay out.

    The bound is read off the histogram of the counts, whose rows are the distinct counts: a driver that collects the
    result gets no more than that, whatever the number of partitions."""
    histogram = counts.groupBy("n").agg(F.count("*").alias("rows")).toArrow()
    n, rows = histogram["n"].to_numpy(), histogram["rows"].to_numpy()
    order = np.argsort(-n)
    over = np.flatnonzero(np.cumsum(rows[order]) > most)
    least = int(n[order][over[0]]) + 1 if len(over) else 0
    out = counts.where(F.col("n") >= least)
    out._stash = getattr(counts, "_stash", None)  # the caller's to forget
    return out


LONG, INT, STRING, DOUBLE, BOOL, BINARY = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.BinaryType()


def schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])
