"""Writing intermediate tables where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


#: Bytes of texts that an operator looks at together; its arrays take some fifty times as much.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a local temporary folder serves a local
    master (tests); on a cluster its absence is an error, since one machine's
    folder is not visible to the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = getattr(shared_dir, "_own", None)
    if folder is None:
        folder = shared_dir._own = "file://" + tempfile.mkdtemp(prefix="pathflow-")
    return folder


def written(df: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: later stages read replicated files, so a lost
    executor costs a re-read and no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pathflow-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``written`` returned and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes in one column, a row at least and ``rows`` at most."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and (total + n > most or i - begin >= rows):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def parallelism(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, or with so many ``_`` at its end that none of the columns has it, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
