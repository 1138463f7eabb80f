"""Geodesy, projections and boxes. Points are latitude, longitude in degrees."""

from __future__ import annotations

from skyframe.functions.formula import Formula

# Radii in metres and metres per degree.
R_EARTH, R_LAMBERT, R_BEAM, M_PER_DEG = 6371008.8, 6371229.0, 4 / 3 * 6371000.0, 111320.0

haversine = Formula("G1: metres between (lat {0}, lon {1}) and (lat {2}, lon {3}).", f"2 * {R_EARTH} * asin(least(1, sqrt(pow(sin(radians({{2}} - {{0}}) / 2), 2) + cos(radians({{0}})) * cos(radians({{2}})) * pow(sin(radians({{3}} - {{1}}) / 2), 2))))")
bearing = Formula("G2: initial bearing in degrees from north, -180 to 180.", "degrees(atan2(sin(radians({3} - {1})) * cos(radians({2})), cos(radians({0})) * sin(radians({2})) - sin(radians({0})) * cos(radians({2})) * cos(radians({3} - {1}))))")
destination_lat = Formula("G3: latitude of the point {3} metres from ({0}, {1}) on bearing {2}.", f"degrees(asin(sin(radians({{0}})) * cos({{3}} / {R_EARTH}) + cos(radians({{0}})) * sin({{3}} / {R_EARTH}) * cos(radians({{2}}))))")
destination_lon = Formula("G3: its longitude.", f"(degrees(radians({{1}}) + atan2(sin(radians({{2}})) * sin({{3}} / {R_EARTH}) * cos(radians({{0}})), cos({{3}} / {R_EARTH}) - sin(radians({{0}})) * (sin(radians({{0}})) * cos({{3}} / {R_EARTH}) + cos(radians({{0}})) * sin({{3}} / {R_EARTH}) * cos(radians({{2}}))))) + 540) % 360 - 180")
along_track = Formula("G6: metres of ({3}, {4}) along bearing {2} from ({0}, {1}), on a local plane.", f"({{4}} - {{1}}) * {M_PER_DEG} * cos(radians({{0}})) * sin(radians({{2}})) + ({{3}} - {{0}}) * {M_PER_DEG} * cos(radians({{2}}))")
cone_half_width = Formula("G4: half width of the forecast cone at {0} metres.", "4000 + 0.28 * {0}")
beam_height = Formula("G8: height above the radar at slant range {0} and elevation {1} degrees, 4/3 earth.", f"sqrt({{0}} * {{0}} + {R_BEAM} * {R_BEAM} + 2 * {{0}} * {R_BEAM} * sin(radians({{1}}))) - {R_BEAM}")
ground_distance = Formula("G8: ground distance at slant range {0} and elevation {1} degrees.", f"{R_BEAM} * asin({{0}} * cos(radians({{1}})) / ({R_BEAM} + {beam_height.text}))")
_slant0 = "{0} / greatest(cos(radians({1})), 0.05)"
_slant1 = f"({_slant0}) * {{0}} / ({ground_distance.sql(_slant0, '{1}')})"
slant_range = Formula("G8: slant range over ground distance {0} (over 1 m) at elevation {1}, by two fixed-point steps.", f"({_slant1}) * {{0}} / ({ground_distance.sql(_slant1, '{1}')})")
merc_x = Formula("G18: Web-Mercator x, 0 to 1.", "({0} + 180) / 360")
merc_y = Formula("G18: Web-Mercator y, 0 to 1.", "0.5 - ln((1 + sin(radians({0}))) / (1 - sin(radians({0})))) / (4 * pi())")
wind_speed = Formula("M2, G19: length of (u, v).", "sqrt({0} * {0} + {1} * {1})")
wind_dir = Formula("G19: direction the wind (u, v) blows from, 0 to 360.", "(degrees(atan2(0 - {0}, 0 - {1})) + 360) % 360")
km_per_pixel = Formula("G17: kilometres per pixel at the sub-satellite point: scan step, satellite distance, equatorial radius.", "abs({0}) * ({1} - {2}) / 1000")
in_lon_range = Formula("P8: longitude {0} within west {1} .. east {2}, which may cross the date line.", "CASE WHEN {1} <= {2} THEN {0} >= {1} AND {0} <= {2} ELSE {0} >= {1} OR {0} <= {2} END")
wrap_lon = Formula("P13: longitude in -180 .. 180.", "(({0} + 180) % 360 + 360) % 360 - 180")
boxes_overlap = Formula("P10: west, south, east, north of two boxes.", "{0} <= {6} AND {4} <= {2} AND {1} <= {7} AND {5} <= {3}")
best_satellite = Formula("P15: satellite for a storm of basin {0} at longitude {1}.", "CASE WHEN {0} IN ('WP', 'IO', 'SH') AND ({1} > 80 OR {1} < -170) THEN 'HIMAWARI' WHEN {1} < -105 THEN 'WEST' ELSE 'EAST' END")
storm_west, storm_east = Formula("P16: west of a storm's box.", "{0} - 5.5"), Formula("P16: its east.", "{0} + 5.5")
storm_south, storm_north = Formula("P16: its south, -65 at least.", "greatest(-65, {0} - 4.5)"), Formula("P16: its north, 65 at most.", "least(65, {0} + 4.5)")


def lambert(lat1: float, lat2: float, lov: float, lad: float) -> dict[str, Formula]:
    """X, y of (lat {0}, lon {1}) and lat, lon of (x {0}, y {1}) on a Lambert conformal cone of a spherical earth."""
    import math

    p1, p2, p0 = (math.radians(v) for v in (lat1, lat2, lad))
    t = lambda p: math.tan(math.pi / 4 + p / 2)
    n = math.sin(p1) if abs(p1 - p2) < 1e-9 else math.log(math.cos(p1) / math.cos(p2)) / math.log(t(p2) / t(p1))
    rf = R_LAMBERT * math.cos(p1) * t(p1) ** n / n
    rho0 = rf / t(p0) ** n
    rho, th = f"({rf!r} / pow(tan(pi() / 4 + radians({{0}}) / 2), {n!r}))", f"({n!r} * radians({{1}} - ({lov!r})))"
    rv = f"({math.copysign(1, n)!r} * sqrt({{0}} * {{0}} + ({rho0!r} - {{1}}) * ({rho0!r} - {{1}})))"
    return {
        "x": Formula("x", f"{rho} * sin({th})"), "y": Formula("y", f"{rho0!r} - {rho} * cos({th})"),
        "lon": Formula("lon", f"{lov!r} + degrees(atan2({{0}}, {rho0!r} - {{1}}) / {n!r})"), "lat": Formula("lat", f"degrees(2 * atan(pow({rf!r} / {rv}, {1 / n!r})) - pi() / 2)"),
    }


# A geostationary projection's height over the earth's centre and radii in metres, east longitude in degrees.
GEO_H, GEO_REQ, GEO_RPOL, GEO_LON0 = 42164160.0, 6378137.0, 6356752.31414, -75.2


def fixed_grid(lon0: float = GEO_LON0, h: float = GEO_H, req: float = GEO_REQ, rpol: float = GEO_RPOL, sweep: str = "x") -> dict[str, Formula]:
    """Lon, lat of scan angles (x {0}, y {1}); scan x, y of (lat {0}, lon {1}). Null off the disk."""
    e, q = req * req / (rpol * rpol), h * h - req * req
    lx, ly, lz = ("cos({1}) * cos({0})", "cos({1}) * sin({0})", "(-sin({1}))") if sweep == "y" else ("cos({0}) * cos({1})", "(-sin({0}))", "cos({0}) * sin({1})")
    a, b = f"({lx} * {lx} + {ly} * {ly} + {e!r} * {lz} * {lz})", f"(-2 * {h!r} * {lx})"
    disc = f"({b} * {b} - 4 * {a} * {q!r})"
    rs = f"((-{b} - sqrt(greatest(0, {disc}))) / (2 * {a}))"
    sx, sy, sz = (f"({rs} * {v})" for v in (lx, ly, lz))
    seen = f"CASE WHEN {disc} >= 0 THEN "
    pc = f"atan({rpol * rpol / (req * req)!r} * tan(radians({{0}})))"
    rc = f"({rpol!r} / sqrt(1 - {1 - rpol * rpol / (req * req)!r} * pow(cos({pc}), 2)))"
    dl = f"radians({{1}} - ({lon0!r}))"
    ex, ey, ez = f"({h!r} - {rc} * cos({pc}) * cos({dl}))", f"(-{rc} * cos({pc}) * sin({dl}))", f"({rc} * sin({pc}))"
    face = f"CASE WHEN {h!r} * ({h!r} - {ex}) >= {ey} * {ey} + {e!r} * {ez} * {ez} THEN "
    far = f"sqrt({ex} * {ex} + {ey} * {ey} + {ez} * {ez})"
    x, y = (f"atan({ey} / {ex})", f"asin(-{ez} / {far})") if sweep == "y" else (f"asin(-({ey}) / {far})", f"atan({ez} / {ex})")
    return {
        "lon": Formula("lon", f"{seen} {lon0!r} - degrees(atan({sy} / ({h!r} - {sx}))) END"),
        "lat": Formula("lat", f"{seen} degrees(atan({e!r} * {sz} / sqrt(({h!r} - {sx}) * ({h!r} - {sx}) + {sy} * {sy}))) END"),
        "x": Formula("x", f"{face} {x} END"), "y": Formula("y", f"{face} {y} END"),
    }


_g = "(2 * pi() / 365 * ({0} - 1.5 + {1}))"
declination = Formula("G20: solar declination in radians on day {0} of the year at day fraction {1}.", f"0.006918 - 0.399912 * cos({_g}) + 0.070257 * sin({_g}) - 0.006758 * cos(2 * {_g}) + 0.000907 * sin(2 * {_g}) - 0.002697 * cos(3 * {_g}) + 0.00148 * sin(3 * {_g})")
subsolar_lon = Formula("G20: subsolar longitude in degrees.", f"-(({{1}} * 1440 + 229.18 * (0.000075 + 0.001868 * cos({_g}) - 0.032077 * sin({_g}) - 0.014615 * cos(2 * {_g}) - 0.040849 * sin(2 * {_g}))) / 4 - 180)")
sun_height = Formula("G20: sine of the sun's elevation at (lat {0}, lon {1}) on day {2}, fraction {3}.", f"sin(radians({{0}})) * sin({declination.sql('{2}', '{3}')}) + cos(radians({{0}})) * cos({declination.sql('{2}', '{3}')}) * cos(radians({{1}} - ({subsolar_lon.sql('{2}', '{3}')})))")
day_weight = Formula("G20: weight of day over night from the sine of the sun's elevation: 0 at -6, 1 at +6 degrees, smooth.", "pow(least(1, greatest(0, (degrees(asin({0})) + 6) / 12)), 2) * (3 - 2 * least(1, greatest(0, (degrees(asin({0})) + 6) / 12)))")
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
compass = Formula("F8: compass point of 16.", "split_part('" + ",".join(COMPASS) + "', ',', CAST(floor((({0} % 360) + 360) % 360 / 22.5 + 0.5) AS INT) % 16 + 1)")
