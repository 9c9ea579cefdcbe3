"""Session set-up and the shared folder in which intermediate tables are written."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stockloom")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so that case is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="stockloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# Folders of staged tables with a weak reference to what every plan that reads them holds; when files were last released.
_FOLDERS: dict[str, tuple] = {}
_RELEASED = {"at": 0.0}
RELEASE_S = 5.0


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative jobs. A written table survives the loss of executors, is
    computed once, and gives the optimizer a true size for the joins that follow. Its files
    are deleted some time after the last table that reads them is gone.
    """
    spark = df.sparkSession
    release(spark)
    path = f"{shared_folder(spark)}/stockloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    files = table._jdf.queryExecution().analyzed().relation().location()
    _FOLDERS[path] = (spark.sparkContext.applicationId, spark._jvm.java.lang.ref.WeakReference(files))
    return sized(table)


def release(spark: SparkSession, every: float = RELEASE_S) -> None:
    """Delete staged files that no table reads any more, and shuffle files of queries that are done.

    Both are told by the driver's garbage collector, which else runs long after they have filled the disks.
    Does nothing if it was called less than ``every`` seconds ago.
    """
    if time.monotonic() - _RELEASED["at"] < every:
        return
    jvm, application = spark._jvm, spark.sparkContext.applicationId
    jvm.System.gc()  # Spark's cleaner drops the shuffles it finds unreachable
    for path, (owner, files) in list(_FOLDERS.items()):
        if owner != application:  # ended with its files
            del _FOLDERS[path]
        elif files.refersTo(None):
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            del _FOLDERS[path]
    _RELEASED["at"] = time.monotonic()


def sized(table: DataFrame) -> DataFrame:
    """``table``, as it was read from Parquet files, with the size its rows take instead of that of its files.

    The optimizer broadcasts a table by the bytes of its files. Columns that compress well can hold a hundred times
    as much, all of which the driver would collect. Rows are counted from the footers; a table whose files
    are less than a 64th of the limit for broadcasts keeps their size.
    """
    spark, jvm = table.sparkSession, table.sparkSession._jvm
    relation = table._jdf.queryExecution().analyzed()
    stored = relation.relation().sizeInBytes()
    if 64 * stored < spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        return table
    size = max(stored, table.count() * (8 + relation.schema().defaultSize()))
    none, nothing, no_entries = _scala(jvm.scala, "None"), _scala(jvm.scala.collection.immutable, "Nil"), _scala(jvm.scala.collection.immutable, "Map").empty()
    catalyst = jvm.org.apache.spark.sql.catalyst
    entry = catalyst.catalog.CatalogTable(
        catalyst.TableIdentifier("files", none), _scala(catalyst.catalog, "CatalogTableType").EXTERNAL(), _scala(catalyst.catalog, "CatalogStorageFormat").empty(),
        relation.schema(), none, nothing, none, "", 0, -1, "", no_entries, jvm.scala.Some(_statistics(spark, size)), none, none, none, nothing, False, True, no_entries, none,
    )
    told = relation.copy(relation.relation(), relation.output(), jvm.scala.Some(entry), False, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, told), spark)


def _statistics(spark: SparkSession, size: int):
    """Spark's statistics of a table of ``size`` bytes. They take a Scala number, which py4j would make a Java one on its way; so it is made of text within one call."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    named = jvm.java.lang.Class.forName
    number, made = named("scala.math.BigInt"), named("org.apache.spark.sql.catalyst.catalog.CatalogStatistics")

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for k, value in enumerate(values):
            out[k] = value
        return out

    lookup, kind = jvm.java.lang.invoke.MethodHandles.publicLookup(), jvm.java.lang.invoke.MethodType.methodType
    types = array(jvm.java.lang.Class, number, named("scala.Option"), named("scala.collection.immutable.Map"))
    of_number = lookup.findConstructor(made, kind(jvm.java.lang.Void.TYPE, types))
    of_text = lookup.findStatic(number, "apply", kind(number, named("java.lang.String")))
    given = jvm.java.util.ArrayList()
    for value in (str(size), _scala(jvm.scala, "None"), _scala(jvm.scala.collection.immutable, "Map").empty()):
        given.add(value)
    return jvm.java.lang.invoke.MethodHandles.filterArguments(of_number, 0, array(jvm.java.lang.invoke.MethodHandle, of_text)).invokeWithArguments(given)


def _scala(package, name: str):
    """The single instance of a Scala object."""
    return getattr(getattr(package, f"{name}$"), "MODULE$")
