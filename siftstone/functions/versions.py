"""Version codes: three base-36 signs for x.y.z, the first of which is the release."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_digit(sign: Column) -> Column:
    """0-9 and a-z, either case, to 0-35; null for any other."""
    return F.when(sign.rlike("^[0-9A-Za-z]$"), F.conv(sign, 36, 10).cast("int"))


def decode_version(code: Column) -> Column:
    """struct(x, y, z), or null unless the code has exactly three signs."""
    part = lambda i: decode_digit(F.substring(code, i, 1))
    return F.when(code.rlike("^[0-9A-Za-z]{3}$"), F.struct(part(1).alias("x"), part(2).alias("y"), part(3).alias("z")))


def version_string(code: Column) -> Column:
    v = decode_version(code)
    return F.when(v.isNotNull(), F.concat_ws(".", v["x"], v["y"], v["z"]))


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"(?i)\.zip$", "")


def stem_parts(name: Column) -> Column:
    """38331-ia0 to struct(spec, code, version, release)."""
    flat, code = F.split_part(name, F.lit("-"), F.lit(1)), F.split_part(name, F.lit("-"), F.lit(2))
    return F.struct(
        F.concat_ws(".", F.substring(flat, 1, 2), F.substring(flat, 3, 100)).alias("spec"),
        code.alias("code"), version_string(code).alias("version"), decode_version(code)["x"].alias("release"),
    )


def series_folder(base: Column, spec: Column) -> Column:
    return F.format_string("%s/%s_series/%s/", base, F.split_part(spec, F.lit("."), F.lit(1)), spec)
