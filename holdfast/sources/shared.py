"""The folder that the driver and all executors see, and files in it through Spark's own file systems."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}
_SCRATCH: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where it is unset and everything runs on this machine, a folder of our own, one for an application. On a cluster it must be set, as executors see no folder of the driver's."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="holdfast-shared-")
    return _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by `clear` or when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    atexit.register(_drop, spark, path)
    return path


def clear(spark: SparkSession) -> None:
    """Remove all scratch paths made so far. For a long session, once the results that read them are written."""
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and its lineage cut, so that a lost executor costs a reread."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jvm is None:
        return
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001 - the gateway closes at an unknown point of the interpreter's exit
        return


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.mkdirs(where)


def sizes(spark: SparkSession, path: str, suffix: str) -> list[int]:
    """Bytes of the files in a folder whose names end so."""
    fs, where = _fs(spark, path)
    return [x.getLen() for x in fs.listStatus(where) if x.isFile() and x.getPath().getName().endswith(suffix)] if fs.exists(where) else []


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, a = _fs(spark, old)
    if not fs.rename(a, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} could not be renamed to {new}")


def replace(spark: SparkSession, old: str, new: str) -> None:
    """Rename a file onto another in one step of the file system, so that readers see the older or the newer one, never none."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    a, b = hadoop.Path(old), hadoop.Path(new)
    context = hadoop.FileContext.getFileContext(_fs(spark, new)[0].getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(a, b, options)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Whole or not at all: another name first, then a rename over the older file."""
    fs, part = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    replace(spark, part.toString(), path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    write_text(spark, path, json.dumps(value, sort_keys=True, indent=1))


def read_json(spark: SparkSession, path: str) -> dict | None:
    return json.loads(read_text(spark, path)) if exists(spark, path) else None
