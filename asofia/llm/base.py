"""Helpers that the operators of this folder share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

# Text of one slice of rows that a task works on at a time.
SLICE_BYTES = 4 << 20
# Labelled texts longer than this are not sampled for training (they are scored like any other).
TRAIN_BYTES = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one.

    Only a local session, where driver and executors are one process, may do
    without spark.checkpoint.dir.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again.

    Cuts the lineage: what is read later is the same rows, also after an
    executor is lost, and no consumer computes them twice.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column has it (case does not count)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def dealt(df: DataFrame) -> DataFrame:
    """Rows spread over the cores when the input has fewer files than that.

    Only the number of tasks depends on it, never a result.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, whatever their path; once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "asofia.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow of code of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def map_rows(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow over slices; `make` returns the output columns of a slice by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for part in slices(batches, text):
            made = make(part)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in wanted], schema=wanted)

    return map_batches(df, run, schema)


def in_fold(doc_id) -> F.Column:
    """Held-out rows: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most `per_class` labelled texts of each class.

    Rows of the held-out fold and null or contradictory labels take no part.
    The smallest hashes of the id are taken, so the sample is the same for any
    partitioning; its bound makes the broadcast safe. Texts over TRAIN_BYTES
    are left out of the sample.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~in_fold(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min(target).alias("y"), F.max(target).alias("_y2")).where("y = _y2").drop("_y2"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = known.where("y = 0").orderBy(*order).limit(per_class).unionAll(known.where("y = 1").orderBy(*order).limit(per_class))
    return (docs.select("doc_id", "text").where(F.octet_length(F.coalesce("text", F.lit(""))) <= TRAIN_BYTES)
            .join(F.broadcast(picked), "doc_id"))


def fit_in_task(rows: DataFrame, fit: Callable[[list[dict]], object]):
    """The object that `fit` makes of all rows of a bounded sample, computed in one task.

    Rows are handed over in order of doc_id and then of the rest, so that the
    result does not depend on partitioning.
    """
    import pickle

    def run(batches):
        from asofia.llm import units
        units.forget()
        found = [r for b in batches for r in b.to_pylist()]
        found.sort(key=lambda r: (r["doc_id"], repr(sorted(r.items()))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(found))], pa.binary())], names=["model"])

    made = map_batches(rows.repartition(1), run, "model binary").first()
    return pickle.loads(made.model) if made else fit([])   # an empty sample may have no task
