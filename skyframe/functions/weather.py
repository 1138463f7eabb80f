"""Physical values: codes, moisture, comfort, severe-weather composites, precipitation and quantisation."""

from __future__ import annotations

from skyframe.functions.formula import Formula

clamp01 = "least(1, greatest(0, {0}))"
gate_value = Formula("P1: value of code {0} by scale {1} (0 counts as 1) and offset {2}; codes under 2 are missing.", "CASE WHEN {0} >= 2 THEN ({0} - {2}) / CASE WHEN {1} = 0 THEN 1 ELSE CAST({1} AS DOUBLE) END END")
encode_gate = Formula("P2: code of value {0} by scale {1}, offset {2}, up to code {3}; missing is 0.", "CASE WHEN {0} IS NULL THEN 0 ELSE CAST(least({3}, greatest(2, floor({0} * {1} + {2} + 0.5))) AS INT) END")
to_display = Formula("P6: {0} in display units by factor {1} and offset {2}.", "{0} * {1} + {2}")
above_floor = Formula("P7: {0} is data for a product floor {1}.", "{0} IS NOT NULL AND {0} >= {1}")
quantize = Formula("P17: 16-bit code of {0} between {1} and {2}; 0 is missing.", "CASE WHEN {0} IS NULL THEN 0 ELSE CAST(1 + floor(least(1, greatest(0, ({0} - {1}) / ({2} - {1}))) * 65534 + 0.5) AS INT) END")
dequantize = Formula("P17: value of 16-bit code {0} between {1} and {2}.", "CASE WHEN {0} > 0 THEN {1} + ({0} - 1) / 65534e0 * ({2} - {1}) END")
dewpoint = Formula("M5: dew point (K) from temperature (K) and relative humidity.", "CASE WHEN {1} > 0 THEN 243.04 * (ln(least(100, greatest(1, {1})) / 100) + 17.625 * ({0} - 273.15) / (243.04 + {0} - 273.15)) / (17.625 - (ln(least(100, greatest(1, {1})) / 100) + 17.625 * ({0} - 273.15) / (243.04 + {0} - 273.15))) + 273.15 END")
relative_humidity = Formula("M6: relative humidity from temperature and dew point (K).", "least(100, greatest(0, 100 * exp(17.625 * ({1} - 273.15) / (243.04 + {1} - 273.15) - 17.625 * ({0} - 273.15) / (243.04 + {0} - 273.15))))")
_ln = "(ln(least(100, greatest(1, {1})) / 100) + 17.67 * {0} / ({0} + 243.5))"
dew_from_rh = Formula("M7: dew point (C) from temperature (C) and relative humidity, profile constants.", f"243.5 * {_ln} / (17.67 - {_ln})")
_simple = "(0.5 * ({0} + 61 + ({0} - 68) * 1.2 + {1} * 0.094))"
_full = "(-42.379 + 2.04901523 * {0} + 10.14333127 * {1} - 0.22475541 * {0} * {1} - 0.00683783 * {0} * {0} - 0.05481717 * {1} * {1} + 0.00122874 * {0} * {0} * {1} + 0.00085282 * {0} * {1} * {1} - 0.00000199 * {0} * {0} * {1} * {1})"
heat_index = Formula("M8: heat index (F) from temperature (F) and humidity.", f"CASE WHEN ({{0}} + {_simple}) / 2 < 80 THEN {_simple} WHEN {{1}} < 13 AND {{0}} BETWEEN 80 AND 112 THEN {_full} - (13 - {{1}}) / 4 * sqrt(greatest(0, 17 - abs({{0}} - 95)) / 17) WHEN {{1}} > 85 AND {{0}} BETWEEN 80 AND 87 THEN {_full} + (({{1}} - 85) / 10) * ((87 - {{0}}) / 5) ELSE {_full} END")
wind_chill = Formula("M8: wind chill (F) from temperature (F) and wind (mph).", "35.74 + 0.6215 * {0} - 35.75 * pow({1}, 0.16) + 0.4275 * {0} * pow({1}, 0.16)")
_tf, _mph = "({0} * 1.8 - 459.67)", "(sqrt({2} * {2} + {3} * {3}) * 2.2369362920544)"
feels_like = Formula("M8: apparent temperature (K) from T (K), RH, u, v.", f"(CASE WHEN {_tf} >= 80 AND {{1}} IS NOT NULL THEN {heat_index.sql(_tf, '{1}')} WHEN {_tf} <= 50 AND {_mph} > 3 THEN {wind_chill.sql(_tf, _mph)} ELSE {_tf} END + 459.67) / 1.8")
feels_like_from_dewpoint = Formula("M8: the same from T, Td, u, v.", feels_like.sql("{0}", relative_humidity.sql("{0}", "{1}"), "{2}", "{3}"))
lapse_rate = Formula("M9: lapse rate (C/km) from T700, T500, z500, z700.", "CASE WHEN {2} - {3} > 0 THEN ({0} - {1}) / ({2} - {3}) * 1000 END")
lcl_height = Formula("M10: height of the LCL over the surface from both heights.", "greatest(0, {0} - {1})")
lcl_from_spread = Formula("M10: the same from T and Td.", "125 * ({0} - {1})")
negate = Formula("M11", "-{0}")
ehi = Formula("M12: energy-helicity index from CAPE and SRH.", "greatest(0, {0}) * {1} / 160000")
scp = Formula("M13: supercell composite from CAPE, SRH and shear (m/s).", "CASE WHEN {2} < 10 THEN 0 ELSE greatest(0, {0} / 1000 * {1} / 50 * least(20, {2}) / 20) END")
stp = Formula("M14: significant tornado from CAPE, LCL height, SRH, shear (m/s), CIN.", "greatest(0, {0} / 1500 * CASE WHEN {1} <= 1000 THEN 1 WHEN {1} >= 2000 THEN 0 ELSE (2000 - {1}) / 1000 END * {2} / 150 * CASE WHEN {3} < 12.5 THEN 0 WHEN {3} > 30 THEN 1.5 ELSE {3} / 20 END * CASE WHEN {4} >= -50 THEN 1 WHEN {4} < -200 THEN 0 ELSE (200 + {4}) / 150 END)")
precip_type_rate = Formula("M4: 50 x phase + rate (mm/h, 49.99 at most) from PRATE and the rain, freezing rain, ice, snow flags.", "CASE WHEN {0} > 0 THEN 50 * CASE WHEN {4} > 0 THEN 3 WHEN {3} > 0 THEN 2 WHEN {2} > 0 THEN 1 ELSE 0 END + least(49.99, {0} * 3600) END")
precip_phase = Formula("M4: its phase by name.", "CASE least(3, greatest(0, floor({0} / 50))) WHEN 0 THEN 'Rain' WHEN 1 THEN 'Freezing rain' WHEN 2 THEN 'Ice pellets' ELSE 'Snow' END")
kuchera_ratio = Formula("M16: snow to liquid by the warmest temperature (K) of the layer; unknown is 10.", "CASE WHEN {0} IS NULL THEN 10 WHEN {0} <= 271.16 THEN 12 + 2 * (271.16 - {0}) ELSE greatest(0, 12 + 271.16 - {0}) END")
auto_estimator_rate = Formula("R7: rain rate (mm/h) by cloud-top temperature (K).", "CASE WHEN {0} > 0 AND {0} < 250 THEN 1.1183e11 * exp(-0.036382 * pow({0}, 1.2)) ELSE 0 END")
echo_top = Formula("M23: echo top of a code: low seven bits less 2.", "({0} & 127) - 2")
hundredths_to_mm = Formula("M23: hundredths of an inch in mm.", "{0} * 0.254")
tier4 = Formula("M30: tier 0..3 of {0} by ascending stops {1}, {2}, {3}.", "CASE WHEN {0} >= {3} THEN 3 WHEN {0} >= {2} THEN 2 WHEN {0} >= {1} THEN 1 ELSE 0 END")
nice_step = Formula("M32: contour step of 1, 2 or 5 x a power of ten for span {0} / 8.", "CASE WHEN {0} / 8 / pow(10, floor(log10({0} / 8))) < 1.5 THEN 1 WHEN {0} / 8 / pow(10, floor(log10({0} / 8))) < 3.5 THEN 2 WHEN {0} / 8 / pow(10, floor(log10({0} / 8))) < 7.5 THEN 5 ELSE 10 END * pow(10, floor(log10({0} / 8)))")
flight_category = Formula("F16: flight category from visibility (mi) and ceiling (ft).", "CASE WHEN {0} IS NULL AND {1} IS NULL THEN NULL WHEN coalesce({0}, 99) < 1 OR coalesce({1}, 99999) < 500 THEN 'LIFR' WHEN coalesce({0}, 99) < 3 OR coalesce({1}, 99999) < 1000 THEN 'IFR' WHEN coalesce({0}, 99) <= 5 OR coalesce({1}, 99999) <= 3000 THEN 'MVFR' ELSE 'VFR' END")
pressure_code = Formula("F18: last three digits of tenths of hPa.", "lpad(CAST(CAST(floor({0} * 10 + 0.5) AS BIGINT) % 1000 AS VARCHAR(3)), 3, '0')")
storm_category = Formula("F20: category from wind (kt).", "CASE WHEN {0} >= 137 THEN 'Category 5' WHEN {0} >= 113 THEN 'Category 4' WHEN {0} >= 96 THEN 'Category 3' WHEN {0} >= 83 THEN 'Category 2' WHEN {0} >= 64 THEN 'Category 1' WHEN {0} >= 34 THEN 'Tropical Storm' ELSE 'Tropical Depression' END")
fahrenheit_to_c = Formula("F17, F19: degrees F in C.", "({0} - 32) * 5 / 9")
sea_level_pressure = Formula("F17: MSLP, else the altimeter setting (inHg) in hPa.", "coalesce({0}, {1} * 33.8639)")
gust = Formula("F17: gust, else the peak.", "coalesce({0}, {1})")
exceedance = Formula("M21: rain above guidance from QPE and QPE / guidance.", "CASE WHEN {0} > 0 AND {1} > 1 THEN {0} * (1 - 1 / {1}) END")
guidance = Formula("M20: guidance from QPE and QPE / guidance.", "CASE WHEN {0} > 0 AND {1} > 0 THEN {0} / {1} END")
calibrate = Formula("R1: count {0} by scale {1} and offset {2}; fill {3} is missing.", "CASE WHEN {0} <> {3} THEN {0} * {1} + {2} END")
planck_temperature = Formula("R2: brightness temperature of radiance {0} by fk1 {1}, fk2 {2}, bc1 {3}, bc2 {4}; radiance <= 0 is missing.", "CASE WHEN {0} > 0 THEN ({2} / ln({1} / {0} + 1) - {3}) / {4} END")
ir_gray = Formula("R4: infrared grey 0..255, 313 K black, 183 K white.", "CAST(floor(255 * least(1, greatest(0, (313 - {0}) / 130))) AS INT)")
visible_gray = Formula("R4: visible grey 0..255 of reflectance, square root.", "CAST(floor(255 * sqrt(least(1, greatest(0, {0})))) AS INT)")
stretch = Formula("R5: {0} from {1} .. {2} to 0..255 with gamma {3}.", "CAST(floor(255 * pow(least(1, greatest(0, ({0} - {1}) / ({2} - {1}))), 1.0 / {3})) AS INT)")
synthetic_green = Formula("R5: green from red, blue and near infrared.", "0.45 * {0} + 0.45 * {1} + 0.1 * {2}")
