"""Style values as columns: numbers, colours and their similarities."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Keywords that are no number.
KEYWORDS = ("normal", "auto", "none", "medium", "thin", "thick")
RGB = r"rgba?\(\s*([\d.]+),\s*([\d.]+),\s*([\d.]+)(?:,\s*([\d.]+))?\s*\)"


def parse_number(value: Column) -> Column:
    """First number in a style value; null for keywords and without one."""
    found = F.regexp_extract(value, r"-?\d+(?:\.\d+)?", 0)
    return F.when(F.lower(F.trim(value)).isin(*KEYWORDS), None).otherwise(found.try_cast("double"))


def parse_rgb(value: Column) -> Column:
    """[red, green, blue, alpha] of an rgb() or rgba() value, or null."""
    part = lambda i: F.regexp_extract(value, RGB, i)
    alpha = F.when(part(4) == "", 1.0).otherwise(part(4).try_cast("double"))
    return F.when(F.rlike(value, F.lit(RGB)), F.array(*(part(i).try_cast("double") for i in (1, 2, 3)), alpha))


def numeric_similarity(a: Column, b: Column, floor: float = 1.0) -> Column:
    """1 less the difference relative to the larger value, floor at least; null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(floor))))


def colour_similarity(a: Column, b: Column) -> Column:
    """Nine tenths of the RGB distance, one tenth of the alpha distance, as similarities; null if either is. a, b: from parse_rgb."""
    distance = F.sqrt(reduce(lambda x, y: x + y, [(a[i] - b[i]) ** 2 for i in range(3)]))
    rgb = F.greatest(F.lit(0.0), 1 - distance / F.sqrt(F.lit(3.0 * 255 * 255)))
    return F.when(a.isNotNull() & b.isNotNull(), 0.9 * rgb + 0.1 * F.greatest(F.lit(0.0), 1 - F.abs(a[3] - b[3])))


def _lab(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CIE L*a*b* of rows of sRGB 0-255 under D65."""
    c = rgb[:, :3] / 255
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    t = linear @ SRGB.T / WHITE
    f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t / (3 * (6 / 29) ** 2) + 4 / 29)
    return 116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])


# sRGB to XYZ, and the white point D65.
SRGB = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
WHITE = np.array([0.95047, 1.0, 1.08883])


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """CIEDE2000 of rows of colours, by its published formula."""
    (l1, a1, b1), (l2, a2, b2) = _lab(a), _lab(b)
    c_mean = (np.hypot(a1, b1) + np.hypot(a2, b2)) / 2
    g = 0.5 * (1 - np.sqrt(c_mean**7 / (c_mean**7 + 25.0**7)))
    a1, a2 = (1 + g) * a1, (1 + g) * a2
    c1, c2 = np.hypot(a1, b1), np.hypot(a2, b2)
    h1, h2 = np.degrees(np.arctan2(b1, a1)) % 360, np.degrees(np.arctan2(b2, a2)) % 360
    grey, turn, both = c1 * c2 == 0, h2 - h1, h1 + h2
    dh = np.where(grey, 0.0, np.where(turn > 180, turn - 360, np.where(turn < -180, turn + 360, turn)))
    mean_h = np.where(grey, both, np.where(np.abs(turn) <= 180, both / 2, np.where(both < 360, (both + 360) / 2, (both - 360) / 2)))
    dl, dc, big_h = l2 - l1, c2 - c1, 2 * np.sqrt(c1 * c2) * np.sin(np.radians(dh / 2))
    mean_l, mean_c = (l1 + l2) / 2, (c1 + c2) / 2
    cos = lambda x: np.cos(np.radians(x))
    t = 1 - 0.17 * cos(mean_h - 30) + 0.24 * cos(2 * mean_h) + 0.32 * cos(3 * mean_h + 6) - 0.20 * cos(4 * mean_h - 63)
    s_l = 1 + 0.015 * (mean_l - 50) ** 2 / np.sqrt(20 + (mean_l - 50) ** 2)
    s_c, s_h = 1 + 0.045 * mean_c, 1 + 0.015 * mean_c * t
    turned = -np.sin(np.radians(60 * np.exp(-(((mean_h - 275) / 25) ** 2)))) * 2 * np.sqrt(mean_c**7 / (mean_c**7 + 25.0**7))
    x, y, z = dl / s_l, dc / s_c, big_h / s_h
    return np.sqrt(np.maximum(0.0, x * x + y * y + z * z + turned * y * z))


def ciede2000(a: Column, b: Column) -> Column:
    """The CIEDE2000 difference of two colours from parse_rgb; null if either is.

    In numpy batches: as one column expression its shared parts would be computed again and again.
    """

    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        there = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        if len(there):
            out[there] = difference(np.stack(a.iloc[there].to_list()), np.stack(b.iloc[there].to_list()))
        return pd.Series(out).where(~np.isnan(out))

    return F.pandas_udf(of, "double")(a, b)


def ciede2000_similarity(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - ciede2000(a, b) / 100)


def log_penalty_score(bad: Column, total: Column) -> Column:
    """(1 - log2(1 + bad / (total + 1))) * 100 within 0 and 100; 100 without anything to judge."""
    score = (1 - F.log2(1 + bad / (total + 1.0))) * 100
    return F.when(total <= 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


# Properties whose values are names.
NAMED_PROPERTIES = ("font-family", "text-align", "text-transform")


def _ratio(x: str, y: str) -> float:
    return SequenceMatcher(None, x, y).ratio()


#: Style values are few and come again and again; only short ones are kept.
_known_ratio, KEPT = lru_cache(1 << 14)(_ratio), 128


def spelling_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    there = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    out = np.full(len(a), np.nan)
    out[there] = [(_known_ratio if len(x) + len(y) <= KEPT else _ratio)(x, y) for x, y in zip(a.iloc[there], b.iloc[there], strict=True)]
    return pd.Series(out).where(~np.isnan(out))


@F.pandas_udf(DoubleType())
def _spelling(a: pd.Series, b: pd.Series) -> pd.Series:
    return spelling_ratios(a, b)


def categorical_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, else the likeness of their spelling; null if either is missing or both are blank."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when(a.isNull() | b.isNull() | ((x == "") & (y == "")), None).when(x == y, 1.0).otherwise(_spelling(F.when(x != y, x), y))


def _parsed(parse: Callable[[Column], Column], a: Column, b: Column, similarity: Callable[[Column, Column], Column]) -> Column:
    """similarity of two values, each parsed once, however often the formula names it."""
    return F.transform(F.array(F.struct(parse(a).alias("a"), parse(b).alias("b"))), lambda p: similarity(p["a"], p["b"]))[0]


def property_similarity(name: Column, a: Column, b: Column) -> Column:
    """By kind: colours, opacity, names, else numbers; what is none of its kind is compared as a name, opacity apart."""
    number = _parsed(parse_number, a, b, numeric_similarity)
    colour = F.when(F.contains(name, F.lit("color")), _parsed(parse_rgb, a, b, colour_similarity))
    as_name = name.isin(*NAMED_PROPERTIES) | F.endswith(name, F.lit("-style"))
    # spelling is compared in Python, and for all rows that have both texts: so only those that need it have them
    needed = colour.isNull() & ~F.coalesce(name == "opacity", F.lit(False)) & (F.coalesce(as_name, F.lit(False)) | number.isNull())
    named = categorical_similarity(F.when(needed, a), b)
    rest = F.when(name == "opacity", number).when(as_name, named).otherwise(F.coalesce(number, named))
    return F.coalesce(colour, rest)
