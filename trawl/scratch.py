"""Tables that cut lineage: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from trawl.model import IndexStorageError

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; where it names none, a temporary one, on a local master alone."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise IndexStorageError(f"{CHECKPOINT_DIR} names no folder that all machines share")
        folder = _temporary()
    return folder.rstrip("/")


def _temporary(_made: list[str] = []) -> str:  # noqa: B006 one folder a process
    if not _made:
        _made.append("file://" + tempfile.mkdtemp(prefix="trawl-"))
    return _made[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/trawl/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the shared folder and reads it again. Unlike a cache it survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Files by Hadoop's interface, so that folders may be in any store that Spark writes to."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self.jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        place, system = self._at(path)
        return system.exists(place)

    def read(self, path: str) -> str:
        place, system = self._at(path)
        stream = system.open(place)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Under another name first, then by a rename, so that readers never see a part."""
        new, system = self._at(f"{path}.{uuid.uuid4().hex}.new")
        stream = system.create(new, True)
        stream.write(text.encode())
        stream.close()
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), self.conf)
        context.rename(new, self.jvm.org.apache.hadoop.fs.Path(path), options)

    def delete(self, path: str) -> None:
        place, system = self._at(path)
        system.delete(place, True)

    def size(self, path: str) -> int:
        place, system = self._at(path)
        return system.getContentSummary(place).getLength() if system.exists(place) else 0

    def names(self, path: str) -> list[str]:
        place, system = self._at(path)
        return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
