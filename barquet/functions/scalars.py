"""Small functions of columns: text of numbers and dates, parsing, bands, ages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def fixed(x: Column | str, decimals: int) -> Column:
    """Text with up to eight decimals, rounded by the exact binary value, halves away from zero: 1.005 is 1.00, as it is a little less than that.

    A negative number keeps its sign even where only zeros are left. From 1e21 on it is ``number_text``.
    """
    ten = 10**decimals

    def halves(part: Column) -> Column:
        """A part below one, times a power of ten, as an exact sum."""
        spread = part * F.lit(134217729.0)
        high = spread - (spread - part)
        return F.struct((high * float(ten)).alias("up"), ((part - high) * float(ten)).alias("down"))

    def rounded(sum_: Column) -> Column:
        up, down = sum_["up"], sum_["down"]
        more = F.when(F.abs(down) < 0.25, F.lit(0.0)).otherwise(F.floor(down).cast("double"))
        rest = up - F.floor(up).cast("double")
        over = down - more
        return F.floor(up) + more.cast("long") + (over >= 0.5 - rest).cast("long") + (over >= 1.5 - rest).cast("long")

    def small(size: Column) -> Column:
        tail = lambda n: F.concat(F.lit("."), F.lpad((n % ten).cast("string"), decimals, "0")) if decimals else F.lit("")
        n = _let(halves(size - F.floor(size).cast("double")), rounded)
        return _let(n, lambda n: F.concat((F.floor(size) + F.when(n >= ten, 1).otherwise(0)).cast("string"), tail(n)))

    def large(size: Column) -> Column:
        """From 2**53 on numbers are whole; two parts hold them exactly."""
        thousands = F.floor(size / 4294967296.0)
        whole = thousands.cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(10,0)") + (size - thousands.cast("double") * 4294967296.0).cast("decimal(20,0)")
        return F.concat(whole.cast("string"), F.lit("." + "0" * decimals if decimals else ""))

    def text(x: Column) -> Column:
        size = F.abs(x)
        plain = F.concat(F.when(x < 0, "-").otherwise(""), F.when(size < 2.0**53, _let(size, small)).otherwise(_let(size, large)))
        return F.when(x.isNull(), F.lit(None)).when(F.isnan(x) | (size >= 1e21), number_text(x)).otherwise(plain)

    # Up to 2**43 the product is off by less than 1/512, so that only what is close to a half has to be looked at exactly.
    x = _c(x).cast("double")
    product = F.abs(x) * float(ten)
    n = F.floor(product + 0.5)
    tail = F.concat(F.lit("."), F.lpad((n % ten).cast("string"), decimals, "0")) if decimals else F.lit("")
    sure = (product < 2.0**43) & (F.abs(product - F.floor(product).cast("double") - 0.5) > 1 / 256)
    quick = F.concat(F.when(x < 0, "-").otherwise(""), ((n - n % ten) / ten).cast("long").cast("string"), tail)
    return F.when(sure, quick).otherwise(_let(x, text))


def number_text(x: Column | str) -> Column:
    """The shortest text that is this number (below 1e-300 perhaps a digit more): plain from 0.000001 to below 1e21, else with an exponent."""
    trimmed = lambda c: F.regexp_replace(c, r"\.?0+$", "")  # noqa: E731  of texts that hold a point

    def shortest(size: Column) -> Column:
        out = size.cast("string")
        for digits in (17, 16):
            candidate = F.format_string(f"%.{digits - 1}e", size)
            out = F.when(candidate.try_cast("double") == size, candidate).otherwise(out)
        return out

    def scientific(short: Column) -> Column:
        exponent = F.regexp_extract(short, r"[eE]([+-]?\d+)$", 1).try_cast("int")
        return F.concat(trimmed(F.regexp_extract(short, r"^[\d.]+", 0)), F.lit("e"), F.when(exponent > 0, "+").otherwise(""), exponent.cast("string"))

    def text(x: Column) -> Column:
        size = F.abs(x)
        places = lambda short: F.when(size >= 1, short.try_cast("decimal(38,16)").cast("string")).otherwise(short.try_cast("decimal(38,24)").cast("string"))
        written = _let(shortest(size), lambda short: F.when((size >= 1e-6) & (size < 1e21), trimmed(places(short))).otherwise(scientific(short)))
        number = F.concat(F.when(x < 0, "-").otherwise(""), F.when(size == 0, "0").otherwise(written))
        return F.when(x.isNull(), F.lit(None)).when(F.isnan(x), "NaN").when(size == float("inf"), F.when(x > 0, "Infinity").otherwise("-Infinity")).otherwise(number)

    return _let(_c(x).cast("double"), text)


def quantity_text(x: Column | str) -> Column:
    """Eight decimals below one, else four."""
    return F.when(_c(x) < 1, fixed(x, 8)).otherwise(fixed(x, 4))


def price_text(x: Column | str) -> Column:
    """Two decimals from a thousand, four from one, else six."""
    return F.when(_c(x) >= 1000, fixed(x, 2)).when(_c(x) >= 1, fixed(x, 4)).otherwise(fixed(x, 6))


def ratio_text(x: Column | str) -> Column:
    """Two decimals; infinity is written inf."""
    return F.when(_c(x) == float("inf"), "inf").otherwise(fixed(x, 2))


def magnitude_unit(x: Column | str) -> Column:
    return F.when(_c(x) >= 1e9, "B").when(_c(x) >= 1e6, "M").when(_c(x) >= 1e3, "K").otherwise("")


def magnitude_text(x: Column | str) -> Column:
    """Two decimals in thousands, millions or billions."""
    x = _c(x)
    scaled = F.when(x >= 1e9, x / 1e9).when(x >= 1e6, x / 1e6).when(x >= 1e3, x / 1e3).otherwise(x)
    return F.concat(fixed(scaled, 2), magnitude_unit(x))


def csv_escape(x: Column | str) -> Column:
    """Quoted if it holds a comma, a quote or a line break."""
    return F.when(_c(x).rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(_c(x), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(_c(x))


def utc(ms: Column | str) -> Column:
    """The UTC time of day of ms since 1970, as a timestamp without time zone: the session's zone doesn't matter."""
    return F.timestamp_add("MILLISECOND", _c(ms), F.lit("1970-01-01").cast("timestamp_ntz"))


def iso_day(ms: Column | str) -> Column:
    return F.date_format(utc(ms), "yyyy-MM-dd")


def utc_time(ms: Column | str) -> Column:
    return F.date_format(utc(ms), "yyyy-MM-dd HH:mm:ss 'UTC'")


def midnight(ms: Column | str, days_before: int = 0) -> Column:
    """The start of the day, in ms of UTC, or of one some days before."""
    return ((F.floor(_c(ms) / 86_400_000) - days_before) * 86_400_000).cast("long")


def days_between(a: Column | str, b: Column | str) -> Column:
    return (_c(b) - _c(a)) / F.lit(86_400_000.0)


def strip_quote(symbol: Column | str, quote: str = "USDT") -> Column:
    return F.regexp_replace(_c(symbol), f"{quote}$", "")


def is_quoted_in(symbol: Column | str, quote: str = "USDT") -> Column:
    return F.endswith(_c(symbol), F.lit(quote))


def number(text: Column | str) -> Column:
    """A number from text; null if it is none."""
    return _c(text).try_cast("double")


def first_number(text: Column | str) -> Column:
    """The first number in a text; null without one."""
    return F.nullif(F.regexp_extract(_c(text), r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def spaced(x: Column | str) -> Column:
    return F.replace(_c(x), F.lit("_"), F.lit(" "))


def percent_change(now: Column | str, before: Column | str) -> Column:
    """Null from a zero."""
    return F.try_divide(_c(now) - _c(before), _c(before)) * 100


def fear_greed_band(x: Column | str) -> Column:
    return F.when(_c(x) <= 20, "extreme_fear").when(_c(x) <= 40, "fear").when(_c(x) <= 60, "neutral").when(_c(x) <= 80, "greed").otherwise("extreme_greed")


def funding_band(rate: Column | str) -> Column:
    return F.when(_c(rate) > 0, "positive").when(_c(rate) < 0, "negative").otherwise("flat")


def long_short_band(ratio: Column | str) -> Column:
    return F.when(_c(ratio) > 1, "long").when(_c(ratio) < 1, "short").otherwise("even")


def style_interval(style: Column | str) -> Column:
    """The interval in which a style is optimised; 1h for others."""
    return F.when(_c(style) == "scalping", "5m").when(_c(style) == "swing_trading", "4h").when(_c(style) == "position_trading", "1d").otherwise("1h")


def age_text(ms: Column | str, now: int) -> Column:
    """Whole seconds, minutes or hours since a time."""
    s = F.floor((F.lit(now) - _c(ms)) / 1000)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h")))


def sparkline(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with scaled: the value between its key's lowest and highest, or -10 and 10 if these lie within."""
    w = W.partitionBy(key)
    low, high = F.least(F.lit(-10.0), F.min(value).over(w)), F.greatest(F.lit(10.0), F.max(value).over(w))
    return rows.withColumn("scaled", (F.col(value) - low) / (high - low))
