"""Session settings and the cutting of lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session for local work; on a cluster spark-submit brings its own. Workers find the package beside this file."""
    importable()
    b = SparkSession.builder.master(master).appName("berkas")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def importable() -> None:
    """Puts the folder of the package on the path of the Python workers that a local session starts; on a cluster the
    package is installed or goes along as an archive (`--py-files`)."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])


_STORED: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset (tests, one machine) a local
    folder is made and set, which only a local master may use."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        where = "file://" + tempfile.mkdtemp(prefix="berkas-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """`df` written once to the shared folder as Parquet and read again: cuts the lineage, survives the loss of
    executors, and is not computed twice. `by`: columns to hash-partition the write by."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/berkas-{uuid.uuid4().hex}"
    if by:
        df = df.repartition(*by)
    schema = df.schema
    _STORED.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def clear_stored(since: int = 0, until: int | None = None) -> int:
    """Deletes the tables that `stored` has written, from the given number on (and before the other, -1 for all but the last),
    and gives their count: for when the results built on them have been read or written. Until then a lazy result still
    reads them."""
    gone = _STORED[since:until]
    del _STORED[since:until]
    for spark, path in gone:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(gone)


@contextmanager
def scratch():
    """What `stored` writes inside is deleted at the end: `with scratch(): query(spark, folder).write.parquet(out)`."""
    since = len(_STORED)
    try:
        yield
    finally:
        clear_stored(since)
