"""Feature assembly: label indexes, lookups in vector stores, scaled blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.vectors import concat_blocks, nan_to_zero


def label_index(train: DataFrame, all_: DataFrame) -> DataFrame:
    """label, index: labels of train sorted from 0, then the others sorted. The window runs over distinct labels."""
    own = train.select("label").distinct().withColumn("extra", F.lit(False))
    rest = all_.select("label").distinct().join(own, "label", "left_anti").withColumn("extra", F.lit(True))
    order = Window.partitionBy(F.lit(0)).orderBy("extra", "label")
    return own.unionByName(rest).filter("label is not null").select("label", (F.row_number().over(order) - 1).alias("index"))


def assemble(df: DataFrame, stores: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """df with features: for each (key column, store (key, v), width) the vector of the key, zeros where the store lacks it, what is not finite as 0; and n_missing, how many blocks were not there."""
    found, blocks = df, []
    for i, (key, store, width) in enumerate(stores):
        own = store.select(F.col("key").alias(f"_k{i}"), F.col("v").cast("array<double>").alias(f"_v{i}"))
        found = found.join(own, F.col(key) == F.col(f"_k{i}"), "left")
        blocks.append((nan_to_zero(F.col(f"_v{i}")), width))
    missing = sum((F.col(f"_v{i}").isNull().cast("int") for i in range(len(stores))), F.lit(0))
    found = found.withColumns({"features": concat_blocks(blocks), "n_missing": missing})
    return found.drop(*[f"_{x}{i}" for i in range(len(stores)) for x in "kv"])
