"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only a local session without that setting (tests) gets a folder of its own, which is then set as
    its checkpoint folder; a cluster without it is an error, since executors share no local folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to a new shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(key: Column, parts: int, part: int) -> Column:
    """True for rows whose crc32 of the id, written as text, leaves remainder `part`; false for null ids."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source with the job, once for each application: executors need no install."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, keys: Sequence[str], most: int, seed: int = 7, value: Column | None = None) -> DataFrame:
    """`most` rows, those with the smallest hashes of `keys`; all rows when there are no more than `most`.

    `value` may give a hash that was computed before.

    `keys` should tell rows apart (an id and a text), so that copies of a text are drawn one by one.  Hashes
    are counted by their first 16 bits; only rows up to the range that fills the sample are sorted.
    """
    value = F.xxhash64(F.lit(seed), *keys) if value is None else value
    part = F.shiftrightunsigned(value, 48)
    upto, edge = 0, -1
    for row in df.groupBy(part.alias("part")).count().orderBy("part").collect():  # 65,536 rows at most
        upto, edge = upto + row["count"], row["part"]
        if upto >= most:
            break
    return df.filter(part <= edge).orderBy(value, *keys).limit(most)


def annotated(df: DataFrame, text: str, out: str, compute: Callable[[Iterator[list]], Iterator[dict[str, Sequence]]], without: Sequence[str] = ()) -> DataFrame:
    """`df` with the columns of the schema `out`, computed from the values of the column `text`, batch by batch.

    `compute` takes the batches' values and gives a sequence for each new column.  All other columns pass
    as they are, whole numbers beside nulls too.  A column of `df` that has the name of a new one gives way
    to it, as do those in `without`.
    """
    ship(df.sparkSession)
    fields = StructType.fromDDL(out)
    new = {n.lower() for n in [*fields.names, *without]}
    kept = [c for c in df.columns if c.lower() not in new]
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def values() -> Iterator[list]:
            for batch in batches:
                passed.append(batch)
                yield batch.column(batch.num_columns - 1).to_pylist()

        for found in compute(values()):
            batch = passed.pop()
            added = [pa.array(found[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*kept, *fields.names])

    schema = StructType([df.schema[c] for c in kept] + fields.fields)
    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias(free_name(kept, "input"))).mapInArrow(run, schema)


def free_name(taken: Iterable[str], wish: str) -> str:
    """`wish`, lengthened until no column of that name (in any case) is taken."""
    names = {x.lower() for x in taken}
    while wish.lower() in names:
        wish += "_"
    return wish
