"""Session defaults and the shared scratch folder."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus=8, name="netloom", partitions=None) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
             .config("spark.sql.shuffle.partitions", str(partitions or cpus))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is used only where nothing is set and the master is local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="netloom-")
        spark.sparkContext.setCheckpointDir(base)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def cut(df, name="stage"):
    """Materialise ``df`` in the scratch folder and read it back: lineage ends here, and a lost
    executor re-reads files instead of recomputing the plan."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df, by, name="stage", n=None, dealt=False, ordered=True):
    """As ``cut``, with the rows of each ``by`` in one of ``n`` buckets, by default as many as there are shuffle
    partitions: a later sum over ``by`` or a join on it starts from the files without a shuffle. ``dealt`` rows come
    from a plan that has dealt them to ``n`` partitions by ``by``."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    n, table = n or int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    out = (df if dealt else df.repartition(n, by)).write.bucketBy(n, by)
    (out.sortBy(by) if ordered else out).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, only the name goes
    return out
