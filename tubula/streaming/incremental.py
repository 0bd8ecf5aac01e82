"""Incremental intake and per-case functions."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Partition columns of the table of keys.
_PLACES = [StructField("batch", LongType()), StructField("_bucket", IntegerType())]


def run_incremental(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, job: Callable[[DataFrame], DataFrame], keys: list[str], buckets: int = 64) -> None:
    """Process the Parquet files that came since the last run, once. The keys of each batch are appended to ``out``_keys,
    which is split into ``buckets`` by a hash of the keys: a batch leaves out keys that earlier batches have, and reads
    only the buckets that its own keys are in. If it runs again after a failure, it writes its own results and keys
    anew. Set ``buckets`` to some multiple of the keys of a usual batch, and don't change it afterwards."""
    table = f"{out}_keys"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = fs_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def batch(df: DataFrame, number: int) -> None:
        df = df.withColumn("_bucket", bucket)
        if files.exists(fs_path):
            touched = [r[0] for r in df.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
            done = spark.read.schema(StructType([*(df.schema[k] for k in keys), *_PLACES])).parquet(table).filter(F.col("_bucket").isin(touched) & (F.col("batch") < number)).select("_bucket", *keys)
            df = df.join(done, ["_bucket", *keys], "left_anti")
        job(df.drop("_bucket")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        df.select(*keys, "_bucket").distinct().repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{table}/batch={number}")

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


#: Types that pandas sees the same way in a batch as in a case of its own (for keys: those before the floats).
_PLAIN = ("tinyint", "smallint", "int", "bigint", "string", "boolean", "float", "double")


def apply_per_case(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "case_id") -> DataFrame:
    """A function over the rows of each case, which come as one frame: a case must be bounded, so aggregate
    what can be before. The result has the function's columns and an error column; a case that fails gives
    one row with its id and message, and the others go on. Cases of plain columns are dealt to all tasks of an exchange, as they
    cost time, not bytes, and come sorted, many in a batch."""
    names = [c.split()[0] for c in schema.split(",")]
    spark = df.sparkSession

    def run(part: pd.DataFrame) -> pd.DataFrame:
        try:
            return function(part).assign(error=None)
        except Exception as e:  # noqa: BLE001  the error is the row's result
            return pd.DataFrame([{n: part[key].iloc[0] if n == key else None for n in names} | {"error": f"error: {e}"}])

    whole = StructType.fromDDL(f"{schema}, error string")
    kinds = [k for fields in (df.dtypes, [(f.name, f.dataType.simpleString()) for f in whole]) for _, k in fields]
    if any(k not in _PLAIN for k in kinds) or dict(df.dtypes)[key] not in _PLAIN[:6]:
        return df.groupBy(key).applyInPandas(run, whole)
    shape = to_arrow_schema(whole)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pd.DataFrame]]:
        """The cases of each batch; the one that a batch ends in waits for the next batch."""
        held = []
        for batch in batches:
            rows = pa.Table.from_batches([*held, batch])
            k = rows.column(key).combine_chunks()
            now, last = k.slice(1), k.slice(0, max(len(k) - 1, 0))
            new = pc.or_(pc.fill_null(pc.not_equal(now, last), False), pc.not_equal(now.is_null(), last.is_null()))
            at = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist()]
            yield cut(rows, at)
            held = rows.slice(at[-1]).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield cut(rows, [0, rows.num_rows])

    def cut(rows: pa.Table, at: list[int]) -> list[pd.DataFrame]:
        """Cases between places; a column with NULL somewhere may be of another type in a case that has none."""
        if any(c.null_count for c in rows.columns):
            return [rows.slice(i, j - i).to_pandas() for i, j in itertools.pairwise(at)]
        one = rows.to_pandas()
        return [one.iloc[i:j].set_axis(pd.RangeIndex(j - i)) for i, j in itertools.pairwise(at)]

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cases in frames(b for b in batches if b.num_rows):
            if done := [columns(part) for part in cases]:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*done, strict=True)], schema=shape)

    def columns(part: pd.DataFrame) -> list[pa.Array]:
        try:
            result = function(part)
        except Exception as e:  # noqa: BLE001  the error is the row's result
            one = {key: part[key].iloc[0], "error": f"error: {e}"}
            return [pa.array([one.get(f.name)], f.type, from_pandas=True) for f in shape]
        return [*(pa.array(result[n], shape.field(n).type, from_pandas=True) for n in names), pa.nulls(len(result), pa.string())]

    # by a hash of the key: by the key itself, adaptive execution would join the few bytes of many cases in one task
    dealt = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key))
    return dealt.sortWithinPartitions(key).mapInArrow(many, whole)


def errors(results: DataFrame) -> DataFrame:
    """The failed cases and their messages."""
    return results.filter("error is not null").select("case_id", F.col("error"))
