"""Seeded random numbers as column expressions: the same on every engine that has md5, ln, sqrt and cos."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(parts: tuple[Column | str, ...]) -> Column:
    """md5 of the parts as text, joined by a bar."""
    return F.md5(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def _share(digest: Column, at: int) -> Column:
    return (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def uniform(*parts: Column | str) -> Column:
    """A number between 0 and 1, neither of them, from the first eight digits of the md5 of the parts."""
    return _share(_digest(parts), 1)


def normal(*parts: Column | str) -> Column:
    """A standard normal draw, by the polar angle and radius that two stretches of eight digits of the md5 give."""
    digest = _digest(parts)
    return F.sqrt(F.lit(-2.0) * F.log(_share(digest, 1))) * F.cos(F.lit(2 * math.pi) * _share(digest, 9))
