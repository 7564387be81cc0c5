"""Helpers shared by the operators: durable tables in the shared folder, connected components, word hashes."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, which spark.checkpoint.dir names; only a local master may do without (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="daymark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def trimmed(run):
    """run (batches to batches), giving the memory that it has freed back to the system at its end: idle workers stay small."""

    def outer(batches):
        yield from run(batches)
        release()

    return outer


def release() -> None:
    """Give memory that Arrow and the allocator hold but don't use back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Tables made by save() that are still there, and those that each thread made.
_SAVED: set[str] = set()
_OWN = threading.local()


def save(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there and no executor's disk is needed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/daymark/{uuid.uuid4().hex}"
    _SAVED.add(path)
    _OWN.__dict__.setdefault("made", set()).add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._daymark_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _SAVED.discard(path)


def forget(*saved: DataFrame) -> None:
    """Delete tables made by save() that no later plan reads."""
    for df in saved:
        if path := getattr(df, "_daymark_path", None):
            _delete(df.sparkSession, path)


def saved_alone(make) -> DataFrame:
    """make()'s table saved, and the tables that were made on the way to it deleted."""
    before = set(getattr(_OWN, "made", ()))
    out = save(make())
    for path in (_OWN.made - before - {out._daymark_path}) & _SAVED:
        _delete(out.sparkSession, path)
    return out


def sweep(spark: SparkSession) -> None:
    """Delete every table made by save() that is still there: for a caller who has written the operators' results out.

    An operator's result is a plan that reads such tables, so they stay until then.
    """
    for path in list(_SAVED):
        _delete(spark, path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b long): rows (node, component), component the smallest node id reached.

    Each round every node hooks onto its smallest neighbour, pointers are followed once more, and the edges are
    rewritten between the hooked-to nodes; nodes with an edge left at least halve every other round. Only minima
    are aggregated (map-side first), so a node with very many edges is never gathered. No edges: no rows.
    """
    live = save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = save(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("component", F.col("node")))
    while not live.isEmpty():
        low = (
            live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
            .groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("to"))
        )
        low = save(low)
        hop = low.select(F.col("n").alias("n2"), F.col("to").alias("to2"))
        jump = save(low.join(hop, low["to"] == hop["n2"], "left").select("n", F.coalesce("to2", "to").alias("to")))
        new_label = save(
            label.join(jump, label["component"] == jump["n"], "left")
            .select("node", F.coalesce("to", "component").alias("component"))
        )
        ja, jb = jump.select(F.col("n").alias("na"), F.col("to").alias("ta")), jump.select(F.col("n").alias("nb"), F.col("to").alias("tb"))
        moved = live.join(ja, live["a"] == ja["na"]).join(jb, live["b"] == jb["nb"]).where("ta <> tb")
        new_live = save(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        forget(low, jump, live, label)
        live, label = new_live, new_label
    forget(live)
    return label


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, by minima over edges and pointer following."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over a uint64 array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX[0]
        x = (x ^ (x >> np.uint64(27))) * MIX[1]
        return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done, step = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while done < n:
            take = min(done, n - done)
            out[done : done + take] = out[:take] * step
            done += take
            step = step * step
    return out


_BASE = 0xD6E8FEB86659FD93
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(256, dtype=np.uint64) + MIX[2])
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, in order, and each word's text number.

    The bytes are hashed by differences of one running polynomial sum, so that no Python loop visits a word.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8) if raw else np.empty(0, np.uint8)
    blank = _SPACE[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(len(data), _BASE), out=total[1:])
        h = mix((total[end] - total[start]) * _powers(len(data), _UNBASE)[start] + (end - start).astype(np.uint64))
    first = np.zeros(len(raw), np.int64)
    np.cumsum(sizes[:-1] + 1, out=first[1:])
    return h, np.searchsorted(first, start, side="right") - 1


def slabs(texts: list, size: int = 2_000_000):
    """Runs of texts (null read as empty) of about `size` characters together, or one longer text."""
    run, n = [], 0
    for t in texts:
        run.append(t or "")
        n += len(run[-1])
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run


def map_texts(df: DataFrame, added: str, run, text: str = "text", keep_text: bool = False, setup=None) -> DataFrame:
    """df's other columns unchanged (any types, nulls whole) and the columns `added` (DDL) made from its text column.

    run(texts) gets a list of strings (null read as empty) of a few million characters together, or one longer text,
    and returns a list of columns. With setup, run(setup_value, texts): setup() is called once for each task.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    kept = [c for c in df.columns if keep_text or c != text]
    more = StructType.fromDDL(added)
    arrow = [f.type for f in to_arrow_schema(more)]
    schema = StructType([f for f in df.schema if f.name in kept] + list(more))
    names = schema.names

    def batches(source):
        value = setup() if setup else None
        for batch in source:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            lo = 0
            for run_of in slabs(texts):
                got = run(value, run_of) if setup else run(run_of)
                part = batch.slice(lo, len(run_of))
                cols = [part.column(part.schema.get_field_index(c)) for c in kept]
                cols += [pa.array(x, type=kind) for x, kind in zip(got, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                lo += len(run_of)

    return df.mapInArrow(trimmed(batches), schema)


def map_rows(df: DataFrame, schema: str, run, text: str = "text") -> DataFrame:
    """The rows that run makes of df's: run(columns) gets a dict of lists and returns the lists of `schema` (DDL), one value a row.

    A call holds a few million characters of the column `text` together, or one longer text.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    out = to_arrow_schema(StructType.fromDDL(schema))

    def batches(source):
        for batch in source:
            lo = 0
            for texts in slabs(batch.column(batch.schema.get_field_index(text)).to_pylist()):
                columns = batch.slice(lo, len(texts)).to_pydict()
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(run(columns), out, strict=True)], schema=out)
                lo += len(texts)

    return df.mapInArrow(trimmed(batches), schema)
