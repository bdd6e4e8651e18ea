"""Text of numbers: exact rounding against decimal arithmetic over the binary value, shortest digits against repr."""

import random
import struct
from decimal import ROUND_HALF_UP, Decimal

import pytest

from barquet.functions import scalars

VALUES = [
    0.0, -0.0, 1.005, 2.675, 0.615, 0.125, 0.375, -0.125, 1e-9, -0.001, 0.005, 0.015, 0.5, 1.5, 2.5, 99.995, 0.995, 0.999999999, 123456.785, 1e15 + 0.3, 2.0**53, 2.0**60 + 2.0**20, 1e20, 0.00001234, 25_000_000.0, 1.234e-7, 1e-6,
    9.999999e-7, 1e21, 1.5e300, 0.1 + 0.2, 2.0e-3, 1e22, 123456789012345680000.0, 4.35, 0.045, 1.255, 8.345, 1e-5,
]


def numbers():
    rng = random.Random(6)
    out = [*VALUES, *(round(rng.uniform(-1e4, 1e4), 3) for _ in range(400)), *(rng.randrange(1, 10**6) / 2 ** rng.randrange(1, 12) for _ in range(300))]
    out += [x for x in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(600)) if x == x and 1e-300 < abs(x) < 1e300]
    return out


def to_fixed(x, n):
    if abs(x) >= 1e21:
        return to_text(x)
    sign = "-" if x < 0 else ""
    return sign + f"{Decimal(abs(x)).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP):f}" if x else f"{0:.{n}f}"


def to_text(x):
    digits, exponent = f"{abs(Decimal(repr(x))):e}".split("e") if x else ("0", "0")
    digits = digits.rstrip("0").rstrip(".") if "." in digits else digits
    e = int(exponent)
    if 1e-6 <= abs(x) < 1e21 or x == 0:
        text = f"{abs(Decimal(repr(x))):f}"
        text = text.rstrip("0").rstrip(".") if "." in text else text
    else:
        text = f"{digits}e{'+' if e > 0 else ''}{e}"
    return ("-" if x < 0 else "") + text


@pytest.mark.parametrize("places", [0, 2, 4, 8])
def test_fixed(spark, places, monkeypatch):
    import decimal

    decimal.getcontext().prec = 1200
    df = spark.createDataFrame([(x,) for x in numbers()], "x double").select("x", scalars.fixed("x", places).alias("text"))
    wrong = [(r["x"], r["text"], to_fixed(r["x"], places)) for r in df.collect() if r["text"] != to_fixed(r["x"], places)]
    assert not wrong


def test_shortest(spark):
    df = spark.createDataFrame([(x,) for x in numbers()], "x double").select("x", scalars.number_text("x").alias("text"))
    wrong = [(r["x"], r["text"], to_text(r["x"])) for r in df.collect() if r["text"] != to_text(r["x"])]
    assert not wrong


def test_no_numbers(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    for f in (scalars.number_text("x"), scalars.fixed("x", 2)):
        assert [r[0] for r in df.select(f).collect()] == [None, "NaN", "Infinity", "-Infinity"]
    assert df.select(scalars.ratio_text("x").alias("t")).collect()[2]["t"] == "inf"
