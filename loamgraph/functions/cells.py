"""Grid cells as Column expressions: the bit layout of hexagonal cell ids, geohashes and square cells.

A hexagonal cell id is 64 bits, written as 15 hex digits: the resolution in bits
52 to 55, the base cell in bits 45 to 51 and then 15 digits of 3 bits, unused ones 7.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The resolutions stored beside the finest cell.
STORED_RESOLUTIONS = (3, 5, 7, 9, 11)
FINEST = 15

_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def cell_field(resolution: int) -> str:
    """Name of the field that holds cells of a resolution; the finest has the bare name."""
    if resolution == FINEST:
        return "_h3"
    if resolution not in STORED_RESOLUTIONS:
        raise ValueError(f"resolution must be one of {(*STORED_RESOLUTIONS, FINEST)}")
    return f"_h3_{resolution}"


def cell_bits(cell: Column) -> Column:
    """The id as a bigint; null for text that is not 15 or 16 hex digits below the sign bit."""
    return F.when(cell.rlike("^0?[0-9a-f]{15}$"), F.conv(cell, 16, 10).try_cast("bigint"))


def cell_text(bits: Column) -> Column:
    return F.lower(F.hex(bits))


def cell_resolution(cell: Column) -> Column:
    return F.shiftright(cell_bits(cell), 52).bitwiseAND(F.lit(15)).cast("int")


def cell_parent(cell: Column, resolution: int) -> Column:
    """The cell of a coarser resolution that holds a cell; null if the cell is coarser already."""
    bits = cell_bits(cell)
    clear, fill = ~(15 << 52), (1 << (3 * (15 - resolution))) - 1
    parent = bits.bitwiseAND(F.lit(clear).cast("bigint")).bitwiseOR(F.lit((resolution << 52) | fill).cast("bigint"))
    return F.when(cell_resolution(cell) >= resolution, cell_text(parent))


def geohash(lat: Column, lng: Column, precision: int) -> Column:
    """The base-32 geohash of a position, its bits interleaved from two integers."""
    n = 5 * precision
    nx, ny = (n + 1) // 2, n // 2
    x = F.least(F.floor((lng + 180) / 360 * F.lit(float(1 << nx))), F.lit((1 << nx) - 1)).cast("bigint")
    y = F.least(F.floor((lat + 90) / 180 * F.lit(float(1 << ny))), F.lit((1 << ny) - 1)).cast("bigint")
    chars = []
    for c in range(precision):
        value = F.lit(0).cast("bigint")
        for k in range(5):
            i = 5 * c + k
            source, width, place = (x, nx, i // 2) if i % 2 == 0 else (y, ny, i // 2)
            bit = F.shiftright(source, width - 1 - place).bitwiseAND(F.lit(1).cast("bigint"))
            value = value.bitwiseOR(F.shiftleft(bit, 4 - k))
        chars.append(F.substr(F.lit(_BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.when(lat.isNotNull() & lng.isNotNull(), F.concat(*chars))


def next_prefix(text: str) -> str:
    """The least text above all that begin with ``text``, in base 32; past the last letter ``{``."""
    digits = list(text)
    while digits:
        i = _BASE32.find(digits[-1])
        if i < 0:
            raise ValueError(f"{text!r} is not base 32")
        if i + 1 < len(_BASE32):
            return "".join(digits[:-1]) + _BASE32[i + 1]
        digits.pop()
    return "{"


def bbox_precision(west: float, south: float, east: float, north: float, most: int = 9) -> int:
    """The finest geohash length at which a box spans at most one cell each way, at least 1."""
    for precision in range(most, 0, -1):
        n = 5 * precision
        if (east - west) <= 360 / (1 << (n + 1) // 2) and (north - south) <= 180 / (1 << n // 2):
            return precision
    return 1


def geohash_cover(west: float, south: float, east: float, north: float, precision: int, margin: int = 1) -> list[str]:
    """Geohashes that cover a box and ``margin`` neighbours around it."""
    n = 5 * precision
    nx, ny = (n + 1) // 2, n // 2
    x0, x1 = (int((v + 180) / 360 * (1 << nx)) for v in (west, east))
    y0, y1 = (int((v + 90) / 180 * (1 << ny)) for v in (south, north))
    out = []
    for y in range(max(0, y0 - margin), min((1 << ny) - 1, y1 + margin) + 1):
        for x in range(x0 - margin, x1 + margin + 1):
            out.append(_join_bits(x % (1 << nx), y, nx, ny, precision))
    return list(dict.fromkeys(out))


def _join_bits(x: int, y: int, nx: int, ny: int, precision: int) -> str:
    bits = [(x >> nx - 1 - i // 2) & 1 if i % 2 == 0 else (y >> ny - 1 - i // 2) & 1 for i in range(nx + ny)]
    return "".join(_BASE32[int("".join(map(str, bits[5 * c : 5 * c + 5])), 2)] for c in range(precision))


#: The highest zoom at which each resolution is shown; above the last, the finest stored one.
ZOOM_RESOLUTIONS = ((7, 3), (11, 5), (14, 7), (17, 9))


def zoom_resolution(zoom: float | None) -> int:
    if zoom is None or zoom != zoom:
        return STORED_RESOLUTIONS[0]
    return next((r for most, r in ZOOM_RESOLUTIONS if zoom <= most), STORED_RESOLUTIONS[-1])
