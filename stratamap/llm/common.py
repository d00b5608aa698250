"""Helpers shared by the operators: words, shared storage, ranks and running sums without a single task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets that ranks and running sums are split into; a bucket holds rows / BUCKETS rows.
BUCKETS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark's reader only (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, of spark.checkpoint.dir or setCheckpointDir(). Only where the session
    names none and runs in one process is it a folder of our own; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not at:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="stratamap-"))
        return sc._jsc.sc().getCheckpointDir().get()
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of narrow rows with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """Writes a table into the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that no plan reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str, bucket: Column) -> DataFrame:
    """Adds gapless ranks from 0 in each group. Rows are ranked in hash buckets of the group, and a bucket's
    rank starts at the count of the buckets before it, so that a group's rows never meet in one task."""
    w = Window.partitionBy(*group, "_b").orderBy(*order)
    inner = df.withColumn("_b", bucket).withColumn("_r", F.row_number().over(w) - 1)
    counts = df.select(*group, bucket.alias("_b")).groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_o", F.sum("_n").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_n")).drop("_n")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "_b"]]
    both = inner.alias("l").join(before.alias("r"), on)
    return both.select("l.*", (F.col("r._o") + F.col("l._r")).cast("long").alias(rank)).drop("_b", "_r")


def sorted_starts(df: DataFrame, order: list[str], starts: dict[str, str]) -> DataFrame:
    """Adds for each (start, value) of starts the sum of value over all rows before a row in the given total order. The
    (narrow) rows are range partitioned and checkpointed once; each partition then starts at the sum of those before it."""
    by = [F.col(c).asc_nulls_first() for c in order]
    at = cut(df.repartitionByRange(*by).sortWithinPartitions(*by)).withColumn("_p", F.spark_partition_id())
    sums = at.groupBy("_p").agg(*[F.sum(v).alias(f"_s{i}") for i, v in enumerate(starts.values())])
    # One row per partition: bounded by the number of shuffle partitions.
    earlier = Window.orderBy("_p")
    before = sums.select("_p", *[(F.sum(f"_s{i}").over(earlier) - F.col(f"_s{i}")).alias(f"_o{i}") for i in range(len(starts))])
    w = Window.partitionBy("_p").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for i, v in enumerate(starts.values()):
        at = at.withColumn(f"_i{i}", F.sum(v).over(w) - F.col(v))
    at = at.join(F.broadcast(before), "_p")
    for i, name in enumerate(starts):
        at = at.withColumn(name, (F.col(f"_o{i}") + F.col(f"_i{i}")).cast("long")).drop(f"_o{i}", f"_i{i}")
    return at.drop("_p")


def with_fields(df: DataFrame, fields: str) -> StructType:
    """The frame's schema and more fields, given as DDL (a schema's own add() would change the frame's)."""
    return StructType([*df.schema.fields, *StructType.fromDDL(fields).fields])


def free(names: Sequence[str], taken: Iterable[str]) -> list[str]:
    """The names, each with underscores behind it until no column that is taken has it (in any case of letters)."""
    used, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


Rows = Iterator[tuple[Sequence[int] | None, list]]


def arrow_map(df: DataFrame, keep: Sequence[str], need: Sequence[str | Column], work: Callable[..., Rows], fields: str) -> DataFrame:
    """Runs Python over the batches of a frame. ``work`` gets the needed columns of a batch as Arrow arrays and yields
    (rows, new columns): which rows of the batch the new ones belong to (None: each its own), and a list or array for
    each of ``fields``. The kept columns never leave Arrow, so that long ids come back as they went in, next to nulls
    too. A field whose name a kept column has gets underscores behind it."""
    new = StructType.fromDDL(fields).fields
    new = [StructField(n, f.dataType) for n, f in zip(free([f.name for f in new], keep), new, strict=True)]
    schema = StructType([*(df.schema[c] for c in keep), *new])
    types = [f.type for f in to_arrow_schema(StructType(new))]
    names, k = [f.name for f in schema], len(keep)
    columns = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    columns += [(F.col(f"`{c}`") if isinstance(c, str) else c).alias(f"n{i}") for i, c in enumerate(need)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, out in work(*b.columns[k:]):
                kept = b.columns[:k]
                if rows is not None:
                    at = pa.array(rows, pa.int64())
                    kept = [c.take(at) for c in kept]
                made = [x if isinstance(x, pa.Array) else pa.array(x, t, from_pandas=False) for x, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=names)

    return df.select(*columns).mapInArrow(run, schema)


def pair_key(doc_id: str, text: str) -> Column:
    """One string for a row's id and text, never null: rows of equal ids and texts (or both without) share it."""
    return F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("-")))
