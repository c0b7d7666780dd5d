"""What the operators of this subpackage share: the cluster's shared folder, staged tables, table reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import fresh_path, shared_dir  # noqa: F401

#: A key of more rows than HOT_ROWS may be dealt to several tasks; so many keys at most, those with the most rows, are.
HOT_ROWS, HOT_KEYS = 256, 10_000


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and reread it: lineage is cut, and a lost executor loses nothing."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Removes staged tables from the shared folder; nothing that is still to be computed may read them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(counts: DataFrame) -> DataFrame | None:
    """counts: key columns and n, a row per key. The keys of more than HOT_ROWS rows with __salts, one for so many rows; None
    if there are none. At most HOT_KEYS, so it may be sent to every task; a key that isn't in it has less than one in
    HOT_KEYS of all rows."""
    top = counts.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), *[c for c in counts.columns if c != "n"]).limit(HOT_KEYS)
    found = top.withColumn("n", F.ceil(F.col("n") / HOT_ROWS).cast("int")).withColumnRenamed("n", "__salts").collect()
    return counts.sparkSession.createDataFrame(found, counts.drop("n").schema.add("__salts", T.IntegerType())) if found else None


def dealt(df: DataFrame, keys: list[str], hot: DataFrame | None, by: list[str]) -> DataFrame:
    """Adds __salt, by which a hot key's rows are dealt to as many tasks as it has salts; 0 for any other key."""
    if hot is None:
        return df.withColumn("__salt", F.lit(0))
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("__salts")).cast("int"), F.lit(0))
    return df.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__salts")


def spread(df: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """A row for each salt of its key."""
    if hot is None:
        return df.withColumn("__salt", F.lit(0))
    salts = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    return df.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(salts)).drop("__salts")


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """many joined with one, which has a row per key; hot keys' rows are dealt by the columns ``by``. how: inner or left."""
    if hot is None:
        return many.join(one, keys, how)
    return dealt(many, keys, hot, by).join(spread(one, keys, hot), [*keys, "__salt"], how).drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; operators take a path as a parameter, queries use this one."""
    import public_tokenizers

    return public_tokenizers.path(name)
