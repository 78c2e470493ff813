"""Package names, request paths and release targets as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCOPED, _PLAIN, _FILE = r"(@[^/]+(?:/|%2[Ff])[^/]+)", r"([^/@][^/]*)", r"([^/]+\.tgz)"


def normal_name(name: Column) -> Column:
    """A scope's separator as a slash."""
    return F.regexp_replace(name, "%2[Ff]", "/")


def encoded_name(name: Column) -> Column:
    """The name for a registry path: percent-encoded but for the leading @."""
    return F.when(name.startswith("@"), F.concat(F.lit("@"), F.url_encode(F.substr(name, F.lit(2))))).otherwise(F.url_encode(name))


def tarball_version(name: Column, filename: Column) -> Column:
    """The version in a tarball's file name, null if the name does not fit the package."""
    prefix = F.concat(F.when(name.startswith("@"), F.substring_index(name, "/", -1)).otherwise(name), F.lit("-"))
    inner = F.substr(filename, F.length(prefix) + 1, F.greatest(F.length(filename) - F.length(prefix) - 4, F.lit(0)))
    return F.when(filename.endswith(".tgz") & filename.startswith(prefix), inner)


def request_kind(path: Column) -> Column:
    """struct(kind, name, filename) of a request path: packument, tarball or unknown."""
    p = F.ltrim(path, F.lit("/"))
    hit = lambda pattern: p.rlike(f"^{pattern}$")
    part = lambda pattern, k: F.regexp_extract(p, f"^{pattern}$", k)
    none = F.lit(None).cast("string")
    told = lambda kind, name, file=none: F.struct(F.lit(kind).alias("kind"), name.alias("name"), file.alias("filename"))
    scoped, plain = f"{_SCOPED}/-/{_FILE}", f"{_PLAIN}/-/{_FILE}"
    return (
        F.when(path.isNull() | path.isin("", "/", "/-/ping"), told("unknown", none))
        .when(hit(scoped), told("tarball", part(scoped, 1), part(scoped, 2)))
        .when(hit(plain), told("tarball", part(plain, 1), part(plain, 2)))
        .when(hit(_SCOPED), told("packument", part(_SCOPED, 1)))
        .when(hit(_PLAIN), told("packument", part(_PLAIN, 1)))
        .otherwise(told("unknown", none))
    )


def target(text: Column) -> Column:
    """struct(name, version) of `name@version`, split at the last @ that is not the first character; null otherwise."""
    version = F.substring_index(text, "@", -1)
    name = F.substr(text, F.lit(1), F.length(text) - F.length(version) - 1)
    return F.when((F.instr(text, "@") > 0) & (F.length(name) > 0) & (F.length(version) > 0), F.struct(name.alias("name"), version.alias("version")))
