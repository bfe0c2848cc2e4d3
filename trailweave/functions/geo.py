"""Geodesy and gridding as SQL text that Spark and DuckDB read alike.

Each function takes SQL expressions and returns one; ``pyspark.sql.functions.expr``
makes it a column, so all of it stays in generated code.
"""

from __future__ import annotations

_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_C = 2 * _N**0.5 / (1 + _N)


def num(x: float) -> str:
    """A double literal in both dialects."""
    return f"{x!r}" if "e" in repr(x) else f"{x!r}e0"


def _sinh(x: str) -> str:
    return f"((exp({x}) - exp(-({x}))) / 2e0)"


def _cosh(x: str) -> str:
    return f"((exp({x}) + exp(-({x}))) / 2e0)"


def _atanh(x: str) -> str:
    return f"(5e-1 * ln((1e0 + {x}) / (1e0 - {x})))"


def utm_zone(lon: str) -> str:
    """Zone 1 to 60; 180 degrees east belongs to 60."""
    return f"least(60, cast(floor(({lon} + 180e0) / 6e0) as int) + 1)"


def utm_epsg(lon: str, lat: str) -> str:
    return f"(case when {lat} >= 0e0 then 32600 else 32700 end + {utm_zone(lon)})"


def to_utm(lon: str, lat: str, epsg: str) -> tuple[str, str]:
    """Easting and northing in the zone of ``epsg``: third-order Krueger series."""
    phi = f"radians({lat})"
    lam = f"radians({lon} - (({epsg} % 100) * 6e0 - 183e0))"
    inner = f"({_atanh(f'sin({phi})')} - {num(_C)} * {_atanh(f'({num(_C)} * sin({phi}))')})"
    t = _sinh(inner)
    xi, eta = f"atan2({t}, cos({lam}))", _atanh(f"(sin({lam}) / sqrt(1e0 + {t} * {t}))")
    east = " + ".join([eta, *(f"{num(a)} * cos({2 * j}e0 * {xi}) * {_sinh(f'{2 * j}e0 * {eta}')}" for j, a in enumerate(_ALPHA, 1))])
    north = " + ".join([xi, *(f"{num(a)} * sin({2 * j}e0 * {xi}) * {_cosh(f'{2 * j}e0 * {eta}')}" for j, a in enumerate(_ALPHA, 1))])
    scale = num(_K0 * _RADIUS)
    return f"(500000e0 + {scale} * ({east}))", f"((case when {epsg} >= 32700 then 10000000e0 else 0e0 end) + {scale} * ({north}))"


def from_utm(east: str, north: str, epsg: str) -> tuple[str, str]:
    """Longitude and latitude of an easting and northing."""
    scale = num(_K0 * _RADIUS)
    xi = f"(({north} - (case when {epsg} >= 32700 then 10000000e0 else 0e0 end)) / {scale})"
    eta = f"(({east} - 500000e0) / {scale})"
    xi1 = "(" + " - ".join([xi, *(f"{num(b)} * sin({2 * j}e0 * {xi}) * {_cosh(f'{2 * j}e0 * {eta}')}" for j, b in enumerate(_BETA, 1))]) + ")"
    eta1 = "(" + " - ".join([eta, *(f"{num(b)} * cos({2 * j}e0 * {xi}) * {_sinh(f'{2 * j}e0 * {eta}')}" for j, b in enumerate(_BETA, 1))]) + ")"
    chi = f"asin(sin({xi1}) / {_cosh(eta1)})"
    lat = " + ".join([chi, *(f"{num(d)} * sin({2 * j}e0 * {chi})" for j, d in enumerate(_DELTA, 1))])
    lon = f"(({epsg} % 100) * 6e0 - 183e0 + degrees(atan2({_sinh(eta1)}, cos({xi1}))))"
    return lon, f"degrees({lat})"


def truncated(x: str) -> str:
    """Towards zero, as an int in both dialects."""
    return f"cast(case when {x} < 0e0 then ceil({x}) else floor({x}) end as int)"


def grid_index(value: str, low: str, high: str, size: str, southward: bool = False) -> str:
    """Cell of a coordinate: clamped to the box, then to the grid; 0 where the box has no extent."""
    inside = f"least(greatest({value}, {low}), {high})"
    part = f"({high} - {inside})" if southward else f"({inside} - {low})"
    cell = f"cast(floor({part} / nullif({high} - {low}, 0e0) * {size}) as int)"
    return f"coalesce(least(greatest({cell}, 0), {size} - 1), 0)"


def grid_index_plain(value: str, low: str, high: str, size: str, southward: bool = False) -> str:
    """Cell in degree space: truncated, not clamped."""
    part = f"({high} - {value})" if southward else f"({value} - {low})"
    return truncated(f"({part} / nullif({high} - {low}, 0e0) * {size})")


def grid_index_loose(east: str, north: str, box: tuple[str, str, str, str], width: str, height: str) -> tuple[str, str]:
    """Cells without clamping to the box ``(x_min, y_min, x_max, y_max)`` before, only to the grid; (0, 0) where a coordinate is null or a side has no extent."""
    x_min, y_min, x_max, y_max = box
    none = f"{east} is null or {north} is null or {x_max} = {x_min} or {y_max} = {y_min}"
    cell = lambda part, size: f"(case when {none} then 0 else least(greatest({truncated(f'({part} * {size})')}, 0), {size} - 1) end)"
    return cell(f"({east} - {x_min}) / nullif({x_max} - {x_min}, 0e0)", width), cell(f"({y_max} - {north}) / nullif({y_max} - {y_min}, 0e0)", height)


def file_name(prefix: str, box: tuple[str, str, str, str]) -> str:
    """A file's name with a box rounded to a tenth, in SQL; ``file_name_exact`` is Spark's."""
    return f"printf('{prefix}_%s_%.1f_%.1f_%.1f_%.1f', animal_id, {', '.join(box)})"


def tenth(x: str) -> str:
    """A double with one decimal as C prints it, for Spark, whose ``printf`` rounds the shortest decimal that reads as ``x``, and its ties up.

    The double itself is rounded, its ties to even: what ``x`` has beyond
    whole degrees is an integer in units of 2^-57, down to a 32nd.
    """
    whole = f"cast(floor(abs({x})) as bigint)"
    tens = f"(cast((abs({x}) - floor(abs({x}))) * {2**57}e0 as bigint) * 10)"
    digit, rest = f"shiftright({tens}, 57)", f"({tens} & {2**57 - 1}L)"
    up = f"(case when {rest} > {2**56}L or ({rest} = {2**56}L and {digit} % 2 = 1) then 1 else 0 end)"
    number = f"({whole} * 10 + {digit} + {up})"
    sign = f"(case when startswith(cast({x} as string), '-') then '-' else '' end)"
    return f"concat({sign}, cast({number} div 10 as string), '.', cast({number} % 10 as string))"


def file_name_exact(prefix: str, box: tuple[str, str, str, str]) -> str:
    """``file_name`` in Spark, digit by digit as DuckDB's; null without an animal."""
    return f"concat('{prefix}_', animal_id, {', '.join(f"'_', {tenth(c)}" for c in box)})"


def layers_key(D: str, width: str, height: str, T: str, x: str, y: str, terrain: str) -> str:
    """The first eight digits of the SHA-1 of a walk's parameters."""
    return f"substr(sha1(concat_ws('-', {D}, {width}, {height}, {T}, {x}, {y}, {terrain})), 1, 8)"


def grid_coordinate(cell: str, low: str, high: str, size: str, southward: bool = False) -> str:
    """Coordinate of a cell; divides by ``size - 1`` where the index multiplies by ``size``."""
    part = f"coalesce({cell} / nullif({size} - 1e0, 0e0), 0e0) * ({high} - {low})"
    return f"({high} - {part})" if southward else f"({low} + {part})"


def resolution(lon_min: str, lon_max: str, lat_min: str, lat_max: str, samples: int, half_even: str) -> tuple[str, str]:
    """Cells across and down: ``samples`` along the longer side; ``half_even`` names the dialect's rounding."""
    wide = f"greatest(({lon_max} - {lon_min}) * 111320e0 * cos(radians(({lat_min} + {lat_max}) / 2e0)), 1e-12)"
    high = f"greatest(({lat_max} - {lat_min}) * 111320e0, 1e-12)"
    other = lambda a, b: f"greatest(1, cast({half_even}({samples} * {a} / {b}, 0) as int))"
    return (
        f"(case when {wide} >= {high} then {samples} else {other(wide, high)} end)",
        f"(case when {wide} >= {high} then {other(high, wide)} else {samples} end)",
    )


def padded(low: str, high: str, padding: float, limit: float) -> tuple[str, str]:
    """A range with ``padding`` of itself on either side; one of no extent becomes 1e-6 wide; clamped to the globe."""
    flat = f"{high} - {low} = 0e0"
    a = f"(case when {flat} then {low} - 5e-7 else {low} - {num(padding)} * ({high} - {low}) end)"
    b = f"(case when {flat} then {high} + 5e-7 else {high} + {num(padding)} * ({high} - {low}) end)"
    return f"greatest({a}, {num(-limit)})", f"least({b}, {num(limit)})"


def budget(x0: str, y0: str, x1: str, y1: str) -> str:
    """Points of a bridge: the Manhattan distance, five at least."""
    return f"greatest(5, abs({x1} - {x0}) + abs({y1} - {y0}))"
