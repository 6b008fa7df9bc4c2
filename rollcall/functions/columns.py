"""Small column helpers: rounding, safe ratios, labels, group lists, arg-max."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order of client rows inside a user's history: time, then poll, then row id.
ROW_ORDER = ("ts", "snapshot_id", "id")

# Fixed value: label prefix of a channel without a cached name ("Channel 7").
CHANNEL_LABEL_PREFIX = "Channel "


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


_SPLIT = 134217729.0  # 2**27 + 1, splits a double into two 26-bit halves


def round_half_even_exact(col: str | Column, digits: int = 2) -> Column:
    """Round a double to ``digits`` decimals the way Python's ``round`` does.

    Python rounds the exact binary value (``round(9.415, 2) == 9.41`` because
    9.415 is stored as 9.41499...; exact ties such as 0.125 go to even).
    ``F.round`` rounds the shortest decimal text instead (9.42).  Here the
    product ``x * 10**digits`` is computed with its exact rounding error
    (Dekker's split), which decides the rare products that land on ``.5``.
    All built-in arithmetic, so it stays inside generated code.
    """
    scale = float(10 ** digits)
    x = _c(col).cast("double")
    p = x * scale
    t = x * _SPLIT
    hi = t - (t - x)
    lo = x - hi
    err = (hi * scale - p) + lo * scale
    k = F.floor(p).cast("double")
    frac = p - k
    up = (frac > 0.5) | ((frac == 0.5) & ((err > 0) | ((err == 0) & (F.abs(k % 2.0) == 1.0))))
    return (k + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / scale


def round2(col: str | Column) -> Column:
    return round_half_even_exact(col, 2)


def safe_div(num: str | Column, den: str | Column) -> Column:
    """``num / den`` as double, NULL when ``den`` is 0 or NULL (no ANSI error)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct(num: str | Column, den: str | Column) -> Column:
    """Percentage rounded to 2 decimals, 0 when the base is empty."""
    return F.coalesce(round2(safe_div(num, den) * 100), F.lit(0.0))


def channel_label(channel_id: str | Column = "channel_id",
                  channel_name: str | Column = "channel_name") -> Column:
    """The cached name, or ``Channel <id>`` when it is missing or empty."""
    name = _c(channel_name)
    return F.when(name.isNull() | (name == ""),
                  F.concat(F.lit(CHANNEL_LABEL_PREFIX), _c(channel_id).cast("string"))).otherwise(name)


def latest(col: str | Column, order: tuple[str, ...] = ROW_ORDER) -> Column:
    """Value of ``col`` on the latest row by ``(ts, snapshot_id, id)``."""
    return F.max_by(_c(col), F.struct(*[F.col(c) for c in order]))


def split_groups(groups: str | Column = "server_groups") -> Column:
    """Comma split without trimming; NULL or empty text gives an empty array."""
    g = _c(groups)
    return F.when(g.isNull() | (g == ""), F.array().cast("array<string>")).otherwise(F.split(g, ",", -1))


def trim_groups(groups: str | Column = "server_groups") -> Column:
    """Comma split, each id trimmed, blanks dropped (repeats kept)."""
    parts = F.transform(split_groups(groups), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def flag_value(raw: str | Column) -> Column:
    """Payload flag to boolean: true only when the value equals 1 (``1``, ``"1"``,
    ``1.0`` or JSON ``true``, which equals 1 as a number); anything else is false."""
    text = F.lower(F.trim(_c(raw)))
    return F.coalesce((text.try_cast("double") == 1.0) | (text == "true"), F.lit(False))
