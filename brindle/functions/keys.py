"""Key projections as column expressions.

A key has a model input (a double, monotonic but not strictly) and a sortable form
(whose Spark order is the keys' order).  Byte and string keys take their model
input from the first 8 bytes and their exact ordinal from the first 16, both
padded with zero bytes on the right and read big-endian.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidKeyError


def _hex_prefix(b: Column, size: int) -> Column:
    return F.rpad(F.hex(F.substring(b, 1, size)), 2 * size, "0")


def _unsigned(hex16: Column) -> Column:
    """16 hex digits as decimal(20,0)."""
    return F.conv(hex16, 16, 10).cast("decimal(20,0)")


def bytes_to_model_input(b: Column) -> Column:
    return _unsigned(_hex_prefix(b, 8)).cast("double")


def bytes_to_exact_ordinal(b: Column) -> Column:
    """16 bytes whose unsigned order is that of the ordinal."""
    return F.unhex(_hex_prefix(b, 16))


def bytes_to_ordinal_number(b: Column) -> Column:
    """The ordinal, the 16 bytes minus 2**127, as ``high * 2**64 + low``; decimals hold each part, not the whole."""
    h = F.hex(bytes_to_exact_ordinal(b))
    high = _unsigned(F.substring(h, 1, 16)) - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.struct(high.alias("high"), _unsigned(F.substring(h, 17, 16)).alias("low"))


def int_to_model_input(k: Column) -> Column:
    return k.cast("double")


def int_to_exact_ordinal(k: Column) -> Column:
    return k.cast("decimal(38,0)")


def u128_to_model_input(b: Column) -> Column:
    """16 big-endian bytes of an unsigned number as a double (rounded in two steps)."""
    h = F.hex(b)
    return _unsigned(F.substring(h, 1, 16)).cast("double") * F.lit(2.0**64) + _unsigned(F.substring(h, 17, 16)).cast("double")


def i128_to_model_input(b: Column) -> Column:
    """The same of a signed number stored with its sign bit flipped."""
    return u128_to_model_input(b) - F.lit(2.0**127)


def encode_u128(value: int) -> bytes:
    if not 0 <= value < 1 << 128:
        raise InvalidKeyError(f"{value} is not an unsigned 128-bit integer")
    return value.to_bytes(16, "big")


def encode_i128(value: int) -> bytes:
    if not -(1 << 127) <= value < 1 << 127:
        raise InvalidKeyError(f"{value} is not a signed 128-bit integer")
    return (value + (1 << 127)).to_bytes(16, "big")


def decode_u128(b: bytes) -> int:
    return int.from_bytes(b, "big")


def decode_i128(b: bytes) -> int:
    return int.from_bytes(b, "big") - (1 << 127)


@dataclass(frozen=True)
class KeyCodec:
    """How a key column is placed and ordered; give your own for other key types."""

    name: str
    spark_type: str
    model_input: Callable[[Column], Column]
    ordinal: Callable[[Column], Column]
    sortable: Callable[[Column], Column] = lambda k: k


def _text(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda k: f(F.encode(k, "UTF-8"))


#: Integer keys by name and the Spark type that holds all their values.
INTEGERS = {"u8": "smallint", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)", "i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint"}

CODECS: dict[str, KeyCodec] = {
    **{n: KeyCodec(n, t, int_to_model_input, int_to_exact_ordinal) for n, t in INTEGERS.items()},
    "u128": KeyCodec("u128", "binary", u128_to_model_input, lambda k: k),
    "i128": KeyCodec("i128", "binary", i128_to_model_input, lambda k: k),
    "bytes": KeyCodec("bytes", "binary", bytes_to_model_input, bytes_to_exact_ordinal),
    "string": KeyCodec("string", "string", _text(bytes_to_model_input), _text(bytes_to_exact_ordinal)),
}


def codec_for(df: DataFrame, key: str) -> KeyCodec:
    """The codec that fits a column's Spark type."""
    kind = df.schema[key].dataType.simpleString()
    if kind == "string":
        return CODECS["string"]
    if kind == "binary":
        return CODECS["bytes"]
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal(") and kind.endswith(",0)"):
        return CODECS["i64"]
    raise InvalidKeyError(f"a column of type {kind} can't be a key")


def fixed_bytes(df: DataFrame, key: str, size: int) -> DataFrame:
    """``df`` with a key column that must hold exactly ``size`` bytes; fails at run time otherwise."""
    return df.withColumn(key, F.when(F.octet_length(key) == size, F.col(key)).otherwise(F.raise_error(F.lit(f"invalid key: not {size} bytes")).cast("binary")))
