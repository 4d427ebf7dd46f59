"""Session helpers: table access, checkpoints in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if Catalyst's own size estimate stays under this many bytes.
BROADCAST_LIMIT = 8 << 20
#: Only scans under this many bytes are ever spread over the cores by a shuffle.
SPREAD_LIMIT = 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; ``name.parquet`` may be a file or a directory of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir.

    Where none is set, a session in one process gets a folder that goes when it ends; on a cluster
    that is an error, as executors share no folder of the driver's machine.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """A reliable checkpoint: survives the loss of executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, rows: int, bytes_per_row: int = 64) -> DataFrame:
    """Broadcast hint for ``df`` if its known row count keeps it under the limit, else unchanged."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_LIMIT else df


def spread(df: DataFrame) -> DataFrame:
    """A small scan with fewer partitions than there are cores, spread over them; others unchanged.

    For plain scans before heavy work on each row. Large inputs have partitions enough, so
    nothing is shuffled there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.rdd().getNumPartitions() >= cores or estimated_bytes(df) > SPREAD_LIMIT:
        return df
    return df.repartition(cores)


class Folder:
    """A folder on any file system that Spark reaches, local or not."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path.rstrip("/"), spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        """What lies in the folder, sorted; nothing if there is no folder."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(""))) if self.exists() else []

    def write(self, name: str, text: str) -> None:
        """A small file, in place only once complete; an older one of that name is replaced."""
        part = f".{name}.part" if "/" not in name else f"{name}.part"
        out = self._fs.create(self._at(part), True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(self._at(name), False)
        self._fs.rename(self._at(part), self._at(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
