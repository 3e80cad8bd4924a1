"""Session helpers: a tuned session for tests and the bench, and lineage cuts that survive executor loss."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "textorigin", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench. On a cluster the submitted conf wins."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, for sessions whose executors do not have it installed."""
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="textorigin-")  # the driver's copy; Spark sends it from there
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))


#: rows of a few numbers that are worth a file of their own
ROWS_PER_FILE = 20_000
_OWN_FOLDERS: dict[str, str] = {}
_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session in one process (``local[...]``, as in tests) may do without: it gets a temporary folder that goes at its end.
    On a cluster the setting is needed, for a folder of one machine would lose what the others write.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="textorigin-")
        atexit.register(shutil.rmtree, _OWN_FOLDERS[app], ignore_errors=True)
    return _OWN_FOLDERS[app]


def scratch_mark() -> int:
    """Where the list of written tables stands now, for :func:`scratch_since`."""
    return len(_SCRATCH)


def scratch_since(mark: int) -> list[str]:
    """The tables that :func:`cut_lineage` has written since."""
    return _SCRATCH[mark:]


def drop_scratch(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete the tables that :func:`cut_lineage` has written, all or those of ``paths``, once nothing reads them any more. Returns their number."""
    done = 0
    for name in list(_SCRATCH) if paths is None else list(paths):
        if name in _SCRATCH:
            _SCRATCH.remove(name)
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return done


#: py4j tells the JVM of objects that Python has let go about once a second
_LET_GO = 1.3


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of tables that are written: Spark deletes them once the driver has collected what refers to them."""
    gc.collect()
    time.sleep(_LET_GO)
    spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame, rows: int | None = None, per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, for results that several jobs use.

    A lost executor then costs a re-read, not a re-computation, and the plan knows the table's size. Where it is known that ``df``
    has at most ``rows`` rows, these go to one file for each ``per_file`` of them, or for each core if those are more, and not to one for
    each shuffle partition: for every file and its folder Hadoop starts processes that set its rights, each a copy of the executor for a moment.
    """
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_file)))
    return written(df)[0]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The table :func:`cut_lineage` gives, and the path by which :func:`drop_scratch` deletes it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/textorigin-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
