"""Maps as JSON arrays of ``[k, v]`` in key order, sets as arrays of keys.

A JSON document is one string, so it is made in one task and only fits small
data; :func:`pair_lines` gives one ``[k, v]`` a row without that limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _json(c: Column, kind: T.DataType) -> Column:
    """One value as JSON text."""
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.coalesce(F.to_json(c), F.lit("null"))
    if isinstance(kind, T.BinaryType):
        c = F.base64(c)
    # One-field objects get the escaping right; the wrapping is cut off again.
    wrapped = F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def _pair(df: DataFrame) -> Column:
    return F.concat(F.lit("["), _json(F.col("k"), df.schema["k"].dataType), F.lit(","), _json(F.col("v"), df.schema["v"].dataType), F.lit("]"))


def pair_lines(df: DataFrame) -> DataFrame:
    """``json``: one ``[k,v]`` a row, in key order."""
    return df.orderBy("k").select(_pair(df).alias("json"))


def pairs_to_json(df: DataFrame) -> DataFrame:
    """One row ``json`` for the whole of ``k, v``."""
    rows = df.select(F.struct("k", _pair(df).alias("j")).alias("r"))
    return rows.agg(F.concat(F.lit("["), F.concat_ws(",", F.transform(F.array_sort(F.collect_list("r")), lambda r: r["j"])), F.lit("]")).alias("json"))


def keys_to_json(df: DataFrame) -> DataFrame:
    """One row ``json`` for the keys ``k``."""
    rows = df.select(F.struct("k", _json(F.col("k"), df.schema["k"].dataType).alias("j")).alias("r")).distinct()
    return rows.agg(F.concat(F.lit("["), F.concat_ws(",", F.transform(F.array_sort(F.collect_list("r")), lambda r: r["j"])), F.lit("]")).alias("json"))


def parse_pairs_column(df: DataFrame, text: str, key_type: str, value_type: str) -> DataFrame:
    """``pos, k, v`` of the pairs in a column of JSON documents (one document a row)."""
    pairs = df.select(F.posexplode(F.from_json(F.col(text), "array<array<string>>")).alias("pos", "p"))
    value = F.from_json(F.col("p")[1], value_type) if value_type.startswith(("array", "struct", "map")) else F.col("p")[1].cast(value_type)
    key = F.unbase64(F.col("p")[0]) if key_type == "binary" else F.col("p")[0].cast(key_type)
    return pairs.select(F.col("pos").cast("long").alias("pos"), key.alias("k"), value.alias("v"))


def parse_pairs(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """``pos, k, v`` of one JSON document; ``schema`` names the types of ``k`` and ``v``."""
    kind = T.StructType.fromDDL(schema)
    return parse_pairs_column(spark.createDataFrame([(text,)], "j string"), "j", kind["k"].dataType.simpleString(), kind["v"].dataType.simpleString())
