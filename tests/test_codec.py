import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamlog.functions import codec
from loamlog.functions.codec import CodecError, canonical_key, decode, encode

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.binary(max_size=30) | st.text(max_size=30),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=5) | st.integers(-99, 99), inner, max_size=4),
    max_leaves=12,
)


@pytest.mark.parametrize(
    ("value", "raw"),
    [(None, "f6"), (False, "f4"), (True, "f5"), (0, "00"), (23, "17"), (24, "1818"), (255, "18ff"), (256, "190100"),
     (65535, "19ffff"), (65536, "1a00010000"), (-1, "20"), (-24, "37"), (-25, "3818"), (-100, "3863"), (-1000, "3903e7"),
     ("", "60"), ("a", "6161"), ("ü", "62c3bc"), (b"\x01", "4101"), ([1, 2], "820102"), ({"b": 1, "aa": 2}, "a261620162616102"),
     ({10: 1, -1: 2}, "a20a012002")],
)
def test_known(value, raw):
    assert encode(value).hex() == raw
    assert decode(bytes.fromhex(raw)) == value


@given(VALUES)
@settings(max_examples=200, deadline=None)
def test_round_trip(value):
    raw = encode(value)
    assert encode(decode(raw)) == raw
    assert decode(raw + b"\x00") == decode(raw)  # what follows isn't read


@pytest.mark.parametrize("raw", ["f93c00", "fa3f800000", "9f01ff", "1817", "190001", "a2616101616102", "a261620161610 2".replace(" ", ""),
                                 "61ff", "62c3", "1bffffffffffffffff", "c001", ""])
def test_rejected(raw):
    with pytest.raises(CodecError):
        decode(bytes.fromhex(raw))


def test_undefined_reads_as_null():
    assert decode(b"\xf7") is None


def test_order():
    assert sorted(["b", "aa", 1, -1, -2, None, True, b"x"], key=canonical_key) == [1, -1, -2, b"x", "b", "aa", True, None]


def test_columns_are_encoded_like_values(spark):
    rows = [(2**53 + 1, None, "é", b"\x00\xff", [1, None, -70000], True, {"bb": 1, "a": -2}), (None, 5, None, None, None, None, None),
            (-(2**63), -1, "", b"", [], False, {}), (23, 24, "x" * 300, b"y", [256, 65536, 2**32], True, {"": None})]
    schema = "long_field long, i int, t string, b binary, l array<long>, o boolean, m map<string,long>"
    df = spark.createDataFrame(rows, schema)
    row = F.struct(*df.columns)
    got = df.select(codec.encode_integers(F.col("long_field")).alias("x"), codec.encode_as(row, df.schema).alias("r")).collect()
    names = df.columns
    for r, g in zip(rows, got, strict=True):
        assert bytes(g["x"]) == codec.encode(r[0])
        assert bytes(g["r"]) == codec.encode(dict(zip(names, r, strict=True)))
    with pytest.raises(codec.CodecError):
        codec.encode_as(F.lit(1.5), spark.range(1).select(F.lit(1.5)).schema[0].dataType)
