"""The vector store: a Parquet table (key_hash, key, vec, seq) that grows by appending, with a metadata file and a failure log."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.frames import first_per_key, joinable
from holdfast.operators.ordered import running_sums
from holdfast.sources import shared
from holdfast.sources.shared import written

VECTORS, FAILURES = "key_hash string, key string, vec array<float>, seq long", "key_hash string, key string, error string, seq long"
INDEX = "key_hash string, seq long"
STAGED = "key_hash string, key string, vec array<float>, error string"
Compute = Callable[[list[str]], tuple[list[list[float]], list[str | None]]]


def key_hash(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 24)


class VectorStore:
    """Vectors, an index of their keys, failures and a metadata file under one path. The first row of a key counts, by seq; the last failure of one.

    A flush appends vectors, then their index part, so the index never names a vector that
    is not there. What was computed is staged first, as a checkpoint: opening the store
    again finishes a flush that was cut off. The metadata file names the folder of the
    vectors, and is replaced in one step when they are rewritten.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int, model: str = "none"):
        self.spark, self.path = spark, path
        want = {"dim": dim, "model": model}
        if (have := shared.read_json(spark, f"{path}/meta.json")) is None:
            shared.write_json(spark, f"{path}/meta.json", want | {"table": "vectors"})
        elif {k: have.get(k) for k in want} != want:
            raise ValueError(f"the store was made with {have}, not with {want}")
        self.dim = dim
        for name in shared.children(spark, path):
            if name.startswith("staged-"):
                self._resume(name)

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if shared.exists(self.spark, f"{self.path}/{name}") else self.spark.createDataFrame([], schema)

    def _vectors_at(self) -> str:
        return shared.read_json(self.spark, f"{self.path}/meta.json")["table"]

    def rows(self) -> DataFrame:
        return self._table(self._vectors_at(), VECTORS)

    def vectors(self) -> DataFrame:
        return compact(self.rows())

    def index(self) -> DataFrame:
        """key_hash, seq of every vector that was flushed."""
        return self._table("index", INDEX)

    def failures(self) -> DataFrame:
        return last_failure(self._table("failures", FAILURES))

    def missing(self, keys: DataFrame) -> DataFrame:
        """Distinct keys (key) that have no vector."""
        own = keys.filter("key is not null").select("key").distinct().withColumn("key_hash", key_hash(F.col("key")))
        return own.join(self.index().select("key_hash").distinct(), "key_hash", "left_anti")

    def put(self, rows: DataFrame, seq: int) -> None:
        """Append (key, vec) and their index part; vectors of another width are an error."""
        wrong = F.raise_error(F.lit(f"a vector does not have {self.dim} elements"))
        own = rows.select(key_hash(F.col("key")).alias("key_hash"), "key", F.when(F.size("vec") == self.dim, F.col("vec").cast("array<float>")).otherwise(wrong).alias("vec"), F.lit(seq).cast("long").alias("seq"))
        own.write.mode("append").parquet(f"{self.path}/{self._vectors_at()}")
        self.rows().filter(F.col("seq") == seq).select("key_hash", "seq").write.mode("append").parquet(f"{self.path}/index")

    def stage(self, keys: DataFrame, compute: Compute, seq: int) -> str:
        """Compute the missing keys only, batch by batch, and keep the results as a checkpoint; compute returns vectors and, where there is none, errors."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                vectors, errors = compute(frame["key"].tolist())
                yield frame.assign(vec=vectors, error=errors)

        name = f"staged-{seq}"
        self.missing(keys).mapInPandas(run, STAGED).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return name

    def _resume(self, name: str) -> None:
        """Flush a checkpoint that is whole; one that is not is dropped, as its keys are still missing."""
        path = f"{self.path}/{name}"
        if shared.exists(self.spark, f"{path}/_SUCCESS"):
            seq, done = int(name.rsplit("-", 1)[1]), self.spark.read.schema(STAGED).parquet(path)
            self.put(done.filter("error is null").select("key", "vec"), seq)
            done.filter("error is not null").select("key_hash", "key", "error", F.lit(seq).cast("long").alias("seq")).write.mode("append").parquet(f"{self.path}/failures")
        shared.delete(self.spark, path)

    def embed(self, keys: DataFrame, compute: Compute, seq: int) -> None:
        """Compute the missing keys, keep them as a checkpoint, and flush them."""
        self._resume(self.stage(keys, compute, seq))

    def rewrite(self, files: int | None = None) -> None:
        """One row for each key, in so many files: written beside, then named by the metadata file in one step."""
        old, new = self._vectors_at(), f"vectors-{uuid.uuid4().hex}"
        rows = self.vectors()
        (rows.coalesce(files) if files else rows).write.parquet(f"{self.path}/{new}")
        meta = shared.read_json(self.spark, f"{self.path}/meta.json")
        shared.write_json(self.spark, f"{self.path}/meta.json", meta | {"table": new})
        shared.delete(self.spark, f"{self.path}/{old}")

    def reclaim(self, least_bytes: int = 64 << 20) -> int:
        """Merge files that are too small for one: rewritten if they hold fewer than least_bytes on average. Returns the number of files."""
        sizes = shared.sizes(self.spark, f"{self.path}/{self._vectors_at()}", ".parquet")
        if len(sizes) > 1 and sum(sizes) < least_bytes * len(sizes):
            self.rewrite(max(1, sum(sizes) // least_bytes))
        return len(shared.sizes(self.spark, f"{self.path}/{self._vectors_at()}", ".parquet"))


def compact(rows: DataFrame) -> DataFrame:
    """First row of each key_hash, by seq and key."""
    return first_per_key(rows, ["key_hash"], [F.col("seq"), F.col("key")])


def last_failure(rows: DataFrame) -> DataFrame:
    return first_per_key(rows, ["key_hash", "key"], [F.desc("seq"), F.col("error")])


def drop_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select(key_hash(F.col("key")).alias("key_hash")).distinct(), "key_hash", "left_anti")


def read(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (key) with their vec, null where there is none, and found."""
    own = keys.select("key").distinct().withColumn("key_hash", key_hash(F.col("key")))
    return own.join(compact(rows).select("key_hash", "vec"), "key_hash", "left").select("key", "vec", F.col("vec").isNotNull().alias("found"))


def fingerprint(keys: DataFrame, key: str, **params: object) -> DataFrame:
    """One row, the fingerprint of a set of keys and parameters whatever their order: count, and sums of two parts of each distinct key's SHA-256, so that keys are not gathered."""
    digest = F.sha2("k", 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)"))
    rows = keys.select(F.col(key).cast("string").alias("k")).filter("k is not null").distinct().agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b"))
    said = F.concat_ws("|", F.col("n").cast("string"), F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string"), *[F.lit(f"{k}={v}") for k, v in sorted(params.items())])
    return rows.select(F.sha2(said, 256).alias("fingerprint"))


def cached(df_keys: DataFrame, key: str, path: str, compute: Callable[[], DataFrame], **params: object) -> DataFrame:
    """The table published at path if its fingerprint fits and it has every key; an incomplete one is an error; else compute, write and publish it."""
    now = fingerprint(df_keys, key, **params).first()[0]
    if (meta := shared.read_json(df_keys.sparkSession, f"{path}/meta.json")) and meta["fingerprint"] == now:
        return with_every_key(published(df_keys.sparkSession, path), df_keys, key, path)
    return publish(compute(), path, now)


def published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{shared.read_json(spark, f'{path}/meta.json')['table']}")


def publish(df: DataFrame, path: str, mark: str) -> DataFrame:
    """Write df under a new name and make it the table of path in one step; the older one goes."""
    spark, old = df.sparkSession, shared.read_json(df.sparkSession, f"{path}/meta.json")
    name = f"table-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    shared.write_json(spark, f"{path}/meta.json", {"fingerprint": mark, "table": name, "rows": spark.read.parquet(f"{path}/{name}").count()})
    if old:
        shared.delete(spark, f"{path}/{old['table']}")
    return published(spark, path)


def with_every_key(found: DataFrame, df_keys: DataFrame, key: str, path: str) -> DataFrame:
    if not df_keys.filter(F.col(key).isNotNull()).join(found.select(F.col("key").alias(key)), key, "left_anti").isEmpty():
        raise ValueError(f"{path} lacks keys")
    return found


def materialized(df_keys: DataFrame, key: str, path: str, compute: Callable[[], DataFrame], policy: str = "metadata", **params: object) -> DataFrame:
    """Features that were published at path, made again if the policy finds fault with them.

    policy: trust_complete takes whatever was published whole; metadata asks that the
    fingerprint of the keys and parameters fits too; full that also the number of rows is
    the published one and every key is there.
    """
    if policy not in ("trust_complete", "metadata", "full"):
        raise ValueError(f"no policy {policy}")
    spark = df_keys.sparkSession
    meta = shared.read_json(spark, f"{path}/meta.json")
    whole = meta is not None and shared.exists(spark, f"{path}/{meta['table']}/_SUCCESS")
    if whole and policy == "trust_complete":
        return published(spark, path)
    now = fingerprint(df_keys, key, **params).first()[0]
    if whole and meta["fingerprint"] == now:
        found = published(spark, path)
        if policy == "metadata":
            return found
        rest = df_keys.filter(F.col(key).isNotNull()).join(found.select(F.col("key").alias(key)), key, "left_anti")
        if found.count() == meta["rows"] and rest.isEmpty():
            return found
    return publish(compute(), path, now)


def mixed_batches(df: DataFrame, order: list[str], chunk: int, seed: int, per_batch: int = 32) -> DataFrame:
    """df with chunk and batch: the rows, in order (which must be total), cut into runs of `chunk`; the runs in an order drawn by hash of seed and number, and `per_batch` of them in each batch. Rows and runs are numbered over ranges, so no task holds all."""
    numbered = running_sums(df.withColumns({"_at": F.struct(*order), "_one": F.lit(1).cast("long")}), "_at", ["_one"])
    rows = written(numbered.withColumn("chunk", F.floor((F.col("sum__one") - 1) / chunk)).drop("_at", "_one", "sum__one"), "chunks")
    chunks = rows.select("chunk").distinct().withColumns({"_drawn": F.struct(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("chunk").cast("string")), 256).alias("h"), "chunk"), "_one": F.lit(1).cast("long")})
    places = running_sums(chunks, "_drawn", ["_one"]).select("chunk", F.floor((F.col("sum__one") - 1) / per_batch).alias("batch"))
    return rows.join(joinable(places), "chunk").select(*df.columns, "chunk", "batch")
