import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.config import Config, EngineConfig
from brindle.errors import EmptyDataError, InvalidKeyError, NotSortedError
from brindle.functions import keys as K
from brindle.functions.bounds import KeyRange, closed, excluded, included


def test_byte_projections(spark):
    raw = [b"", b"a", b"\xff" * 8, b"\x00" * 20, b"\x80" + b"\x01" * 15, "é😀".encode(), b"0123456789abcdefXYZ"]
    df = spark.createDataFrame([(bytearray(b),) for b in raw], "k binary")
    rows = df.select("k", K.bytes_to_model_input(F.col("k")).alias("x"), K.bytes_to_exact_ordinal(F.col("k")).alias("o"), K.bytes_to_ordinal_number(F.col("k")).alias("n")).collect()
    for r in rows:
        b = bytes(r["k"])
        assert r["x"] == float(struct.unpack(">Q", b[:8].ljust(8, b"\0"))[0])
        assert bytes(r["o"]) == b[:16].ljust(16, b"\0")
        assert int(r["n"]["high"]) * 2**64 + int(r["n"]["low"]) == int.from_bytes(b[:16].ljust(16, b"\0"), "big") - 2**127


@given(st.integers(0, 2**128 - 1), st.integers(0, 2**128 - 1))
def test_wide_integers_keep_their_order(a, b):
    assert (K.encode_u128(a) < K.encode_u128(b)) == (a < b) and K.decode_u128(K.encode_u128(a)) == a
    a, b = a - 2**127, b - 2**127
    assert (K.encode_i128(a) < K.encode_i128(b)) == (a < b) and K.decode_i128(K.encode_i128(a)) == a


def test_wide_model_inputs(spark):
    values = [0, 1, 2**64, 2**127, 2**128 - 1]
    df = spark.createDataFrame([(bytearray(K.encode_u128(v)), bytearray(K.encode_i128(v - 2**127))) for v in values], "u binary, i binary")
    for v, r in zip(values, df.select(K.u128_to_model_input(F.col("u")), K.i128_to_model_input(F.col("i"))).collect()):
        assert r[0] == pytest.approx(float(v)) and r[1] == pytest.approx(float(v - 2**127), abs=2.0**76)


def test_codecs(spark):
    df = spark.createDataFrame([(1, "a", 1.5)], "i long, s string, d double")
    assert K.codec_for(df, "i").name == "i64" and K.codec_for(df, "s").name == "string"
    with pytest.raises(InvalidKeyError):
        K.codec_for(df, "d")
    with pytest.raises(InvalidKeyError):
        K.encode_u128(-1)
    sized = K.fixed_bytes(spark.createDataFrame([(bytearray(b"abcd"),)], "k binary"), "k", 4)
    assert sized.count() == 1


def test_big_unsigned_keys_order(spark):
    from decimal import Decimal

    ks = [Decimal(x) for x in (0, 2**63, 2**64 - 1, 17_000_000_000_000_000_000)]
    df = spark.createDataFrame([(k,) for k in ks], "k decimal(20,0)")
    assert [r["k"] for r in df.orderBy("k").collect()] == sorted(ks)
    assert df.select(K.int_to_model_input(F.max("k"))).first()[0] == float(2**64 - 1)


@pytest.mark.parametrize("r, expect", [
    (KeyRange(2, 5), [2, 3, 4]), (closed(2, 5), [2, 3, 4, 5]), (KeyRange(excluded(2), included(5)), [3, 4, 5]), (KeyRange(7), [7, 8, 9]), (KeyRange(None, 2), [0, 1]), (KeyRange(None, included(2)), [0, 1, 2]), (KeyRange(), list(range(10))), (KeyRange(5, 2), []),
])
def test_ranges(spark, r, expect):
    assert sorted(x[0] for x in spark.range(10).where(r.predicate(F.col("id"))).collect()) == expect


def test_range_pruning():
    assert KeyRange(5, 9).may_meet(1, 5) and not KeyRange(excluded(5)).may_meet(1, 5)
    assert not KeyRange(5, 9).may_meet(9, 12) and closed(5, 9).may_meet(9, 12) and not closed(5, 9).may_meet(10, 12)


def test_config_and_errors():
    c = Config(expansion_factor=3.0)
    assert Config.from_json(c.to_json()) == c and c.for_bulk_load().range_headroom == 1.0
    assert EngineConfig.from_json(EngineConfig(100).to_json()).flush_threshold == 100
    for bad in ({"expansion_factor": 0.5}, {"range_headroom": -1.0}, {"tombstone_ratio_threshold": 0.0}, {"tombstone_ratio_threshold": 1.5}):
        with pytest.raises(ValueError):
            Config(**bad)
    assert str(EmptyDataError()) == "input data is empty" and str(NotSortedError()) == "input data is not sorted" and str(InvalidKeyError("overflow")) == "invalid key: overflow"
