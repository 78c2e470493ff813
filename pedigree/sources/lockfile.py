"""Lockfiles and listings of remote releases as rows: documents whose member names are not known in advance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedigree.operators.projection import _at, _list, _object, _text, once


def installed(lockfiles: DataFrame, column: str = "document") -> DataFrame:
    """One row per installed package of every lockfile: the other columns, path, package_name, version, integrity, link.

    A package's name is what its entry says, else what follows the last `node_modules` folder of its path. The
    root entry (empty path), entries that are no objects and texts that are no JSON object give no row; an empty
    or non-text integrity is null. Entries are read within their document, row by row, without a shuffle.
    """
    entry = "struct<name:variant,version:variant,integrity:variant,link:variant>"
    part = lambda v: F.nullif(_text(v), F.lit(""))
    entries = F.transform(F.map_entries(_object(_at(F.try_parse_json(column), "packages"))), lambda e: F.struct(e["key"].alias("path"), F.try_variant_get(e["value"], "$", entry).alias("v")))
    entries = F.filter(entries, lambda e: (e["path"] != "") & e["v"].isNotNull())
    rows = F.transform(entries, lambda e: F.struct(
        e["path"].alias("path"), F.coalesce(part(e["v"]["name"]), F.element_at(F.split(e["path"], "(^|/)node_modules/"), -1)).alias("package_name"), _text(e["v"]["version"]).alias("version"),
        part(e["v"]["integrity"]).alias("integrity"), F.coalesce(F.try_variant_get(e["v"]["link"], "$", "boolean"), F.lit(False)).alias("link"),
    ))
    others = [c for c in lockfiles.columns if c not in (column, "path", "package_name", "version", "integrity", "link")]
    return lockfiles.select(*others, F.inline(rows))


def of_package(rows: DataFrame, name: str) -> DataFrame:
    """The installed rows of one package at the top of its tree."""
    return rows.where(F.col("path") == f"node_modules/{name}")


def listed_releases(listings: DataFrame, column: str = "document") -> DataFrame:
    """One row per release of every listing (a JSON list): tag, published_at, assets (name -> address).

    An asset without a name or an address does not count, of two with one name the later one does; a release without a
    list of assets has none.
    """
    text = lambda v: F.nullif(_text(v), F.lit(""))

    def assets(listed: Column) -> Column:
        pairs = F.transform(F.try_variant_get(listed, "$", "array<variant>"), lambda a: once(F.try_variant_get(a, "$", "struct<name:variant,browser_download_url:variant>"), lambda x: F.struct(text(x["name"]).alias("k"), text(x["browser_download_url"]).alias("v"))))
        pairs = F.filter(F.coalesce(pairs, F.array().cast("array<struct<k:string,v:string>>")), lambda x: x["k"].isNotNull() & x["v"].isNotNull())
        return once(pairs, lambda all_: F.map_from_entries(F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"]))))

    releases = F.transform(_list(F.try_parse_json(column)), lambda r: F.try_variant_get(r, "$", "struct<tag_name:variant,published_at:variant,assets:variant>"))
    rows = F.transform(F.filter(releases, lambda r: r.isNotNull()), lambda r: F.struct(_text(r["tag_name"]).alias("tag"), _text(r["published_at"]).alias("published_at"), assets(r["assets"]).alias("assets")))
    return listings.select(F.inline(rows))


def assets_of(releases: DataFrame, wanted: list[str]) -> DataFrame:
    """(tag, urls, missing, available): the addresses of the wanted files, null if any is missing, and what is said then."""
    want = F.array(*map(F.lit, wanted))
    missing: Column = F.filter(want, lambda f: ~F.map_contains_key("assets", f))
    return releases.select("tag", F.when(F.size(missing) == 0, F.map_filter("assets", lambda k, v: F.array_contains(want, k))).alias("urls"), missing.alias("missing"), F.array_sort(F.map_keys("assets")).alias("available"))
