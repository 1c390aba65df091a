"""Small numeric Column helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def steady(c, digits: int = 4) -> Column:
    """Round for comparison between engines; the boundary sits off the exact decimal ties."""
    scale = float(10**digits)
    return F.floor(as_col(c).cast("double") * F.lit(scale) + F.lit(0.50001)) / F.lit(scale)


def clip(c, low: float, high: float) -> Column:
    return F.greatest(F.least(as_col(c), F.lit(float(high))), F.lit(float(low)))


def finite(c) -> Column:
    c = as_col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def mixed_uniform(*parts) -> Column:
    """A repeatable uniform in [0,1) from hashed columns: the same under any partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


_WORD = 1 << 32
_FACTOR = 73244475


def _mixed(x: int) -> int:
    for _ in range(2):
        x = (x ^ x >> 16) * _FACTOR % _WORD
    return x ^ x >> 16


def spread_key(c, seed: int = 0) -> Column:
    """Hash of a whole number and a seed into 0..2^32-1: both halves of the number, shifted and multiplied twice modulo
    2^32. No product leaves 64 bits, and any SQL engine reproduces it (`spread_sql`)."""
    c = as_col(c).cast("long")
    low = F.lit(_WORD - 1)
    x = c.bitwiseAND(low).bitwiseXOR(F.shiftright(c, 32).bitwiseAND(low)).bitwiseXOR(F.lit(_mixed(seed % _WORD)))
    for _ in range(2):
        x = F.pmod(x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(_FACTOR), F.lit(_WORD))
    return x.bitwiseXOR(F.shiftright(x, 16))


def spread_uniform(*ids, seed: int = 0) -> Column:
    """A uniform number in [0, 1) of whole numbers and a seed: the same under any partitioning and in any engine (`spread_uniform_sql`)."""
    h = spread_key(ids[0], seed)
    for c in ids[1:]:
        h = spread_key(F.shiftleft(F.shiftright(h, 1), 32).bitwiseXOR(as_col(c).cast("long")), seed)
    return h / F.lit(float(_WORD))


def spread_uniform_sql(*exprs: str, seed: int = 0) -> str:
    h = spread_sql(exprs[0], seed)
    for e in exprs[1:]:
        h = spread_sql(f"xor(({h} >> 1) << 32, CAST({e} AS BIGINT))", seed)
    return f"({h} / {_WORD}.0::DOUBLE)"


def text_key(*parts) -> Column:
    """60 bits of the MD5 of some values as text, for draws by names."""
    text = F.concat_ws("|", *[as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def text_key_sql(*exprs: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({e} AS VARCHAR)' for e in exprs)})), 1, 15) AS BIGINT)"


def spread_sql(expr: str, seed: int = 0) -> str:
    """The same hash as SQL text."""
    c = f"CAST({expr} AS BIGINT)"
    x = f"xor(xor({c} & {_WORD - 1}, ({c} >> 32) & {_WORD - 1}), {_mixed(seed % _WORD)})"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * {_FACTOR}) % {_WORD})"
    return f"xor({x}, {x} >> 16)"
