"""Session settings that every plan here relies on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "strataline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` adds or overrides settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it.

    Only where it is unset and Spark runs in this process (tests, a laptop) a
    local folder is set; on a cluster that would be each machine's own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not (own := getattr(spark.sparkContext, "_strataline_dir", None)):
        own = f"file://{os.path.join(tempfile.gettempdir(), 'strataline-shared')}"
        spark.sparkContext._strataline_dir = own
        spark.sparkContext.setCheckpointDir(own)
    return own


#: Most bytes of rows in one Arrow batch from the first saved table on; a longer row comes alone.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


#: Where new Scratch folders are made, if not right in the shared folder.
_TOP: ContextVar[str | None] = ContextVar("strataline_scratch_top", default=None)


class Scratch:
    """Tables and folders under the shared folder that cut lineage within one run.

    A table that is saved survives the loss of any executor.  Tables that the
    returned DataFrame still reads have to stay; `drop` removes one earlier,
    and `within` everything that others make meanwhile.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{_TOP.get() or shared_dir(spark) + '/strataline'}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def folder(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Writes df and reads it back.

        Python workers are handed batches of bounded size, whatever the length
        of rows.  The setting is made once and stays, so that threads of one
        session don't undo it for each other.
        """
        path = self.folder(name)
        if self.spark.conf.get(_BATCH_SETTING) != str(BATCH_BYTES):
            self.spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._strataline_path = path
        return out

    @contextmanager
    def within(self, name: str) -> Iterator[None]:
        """Scratch folders made in the block lie in one of their own, which is deleted at its end."""
        top = self.folder(name)
        token = _TOP.set(top)
        try:
            yield
        finally:
            _TOP.reset(token)
            self._delete(top)

    def drop(self, df: DataFrame) -> None:
        self._delete(df._strataline_path)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
