"""Record identity, grid cells and distance, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
NUL = "\0"


def number_text(x: Column) -> Column:
    """A double's shortest decimal form with an exponent below 1e-4 and from 1e16 on alone, as JSON writers of other
    languages give it; Spark's own turns to exponents below 1e-3 and from 1e7 on."""
    s = x.cast("string")
    form = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    sign, lead, exponent = F.regexp_extract(s, form, 1), F.regexp_extract(s, form, 2), F.regexp_extract(s, form, 4).try_cast("int")
    rest = F.regexp_replace(F.regexp_extract(s, form, 3), "^0$", "")
    digits = F.concat(lead, rest)
    whole = F.rpad(digits, exponent + 1, F.lit("0"))  # cuts where there are more digits
    beyond = F.substr(digits, exponent + 2, F.length(digits))
    large = F.concat(whole, F.lit("."), F.when(beyond == "", "0").otherwise(beyond))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    power = F.concat(lead, F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.when(exponent < 0, "e-").otherwise("e+"), F.format_string("%02d", F.abs(exponent)))
    plain = F.when(exponent.between(0, 15), large).when(exponent.between(-4, -1), small).otherwise(power)
    return F.when(s.contains("E"), F.concat(sign, plain)).otherwise(s)


def _lower_escapes(json: Column) -> Column:
    """JSON with control characters' code points in lower-case digits. An escaped backslash before a u is no escape."""
    out = json
    for code in (0x0B, 0x0E, 0x0F, 0x1A, 0x1B, 0x1C, 0x1D, 0x1E, 0x1F):
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u00{code:02X}", rf"$1\\u00{code:02x}")
    return F.when(json.rlike(r"\\u00[01][A-F]"), out).otherwise(json)


def canonical(fields: Column, latitude: Column, longitude: Column, name: Column) -> Column:
    """Compact JSON of the record's content with sorted keys."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(fields, F.create_map().cast("map<string,string>")))))
    named = F.to_json(F.struct(name.alias("name")), {"ignoreNullFields": "false"})
    lat, lon = (F.coalesce(number_text(x.cast("double")), F.lit("null")) for x in (latitude, longitude))
    return F.concat(F.lit('{"fields":'), _lower_escapes(F.to_json(ordered, {"ignoreNullFields": "false"})), F.lit(',"latitude":'), lat, F.lit(',"longitude":'), lon, F.lit(","), _lower_escapes(F.substring(named, 2, 1 << 30)))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(NUL, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def content_id(source: Column, canon: Column) -> Column:
    return digest(source, canon)


def record_id(source: Column, canon: Column, ordinal: Column) -> Column:
    return digest(source, canon, ordinal)


def has_coordinates(latitude: Column, longitude: Column) -> Column:
    return latitude.isNotNull() & longitude.isNotNull()


def cell(value: Column, other: Column, size: float) -> Column:
    """Grid index of a coordinate; null where either coordinate is missing. Not finite: an error."""
    checked = F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit("coordinate is not finite"))).otherwise(value)
    return F.when(has_coordinates(value, other), F.floor(checked / F.lit(float(size))))


def located(latitude: Column, longitude: Column) -> Column:
    """The latitude, or an error where either coordinate is missing: a distance from nowhere is refused."""
    return F.when(has_coordinates(latitude, longitude), latitude).otherwise(F.raise_error(F.lit("distance needs both coordinates of both records")).cast("double"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """haversine_km(), refused where a coordinate is missing."""
    return haversine_km(located(lat1, lon1), lon1, located(lat2, lon2), lon2)


def populatedness(fields: Column, name: Column, latitude: Column, longitude: Column) -> Column:
    """How many of the record's values are given: non-empty fields, the name, the coordinates."""
    given = F.size(F.filter(F.map_values(fields), lambda v: v != ""))
    return F.coalesce(given, F.lit(0)) + F.coalesce((name != "").cast("int"), F.lit(0)) + has_coordinates(latitude, longitude).cast("int")
