"""Registry documents as variants: the full projection of their releases, their files, and documents without blocked releases.

A field of another type than expected counts as absent; an entry that is no object is no release. A variant holds the
names of its whole document, so no row may hold a variant of its own entry: entries are read within their document,
and rows hold plain fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedigree.functions.columns import clean_text, is_prerelease, is_semver, semver_key

#: Characters that are kept of each field.
GIT_HEAD, TOOL, MAINTAINER, URL, FILENAME, TARBALL = 64, 80, 200, 500, 500, 1000


def _at(v: Column, *path: str) -> Column:
    return F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path), "variant")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _text(v: Column) -> Column:
    """The text of a JSON string, null for everything else."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _object(v: Column) -> Column:
    """Members of an object, null for everything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def _size(v: Column) -> Column:
    return F.coalesce(F.size(F.map_keys(_object(v))), F.lit(0)).cast("long")


def _json(v: Column) -> Column:
    """The JSON text of what is not empty."""
    return F.when((_size(v) > 0) | (F.coalesce(F.size(_list(v)), F.lit(0)) > 0), F.to_json(v))


def _maintainers(v: Column) -> Column:
    part = lambda m, name: F.nullif(F.substring(_text(_at(m, name)), 1, MAINTAINER), F.lit(""))
    told = F.transform(_list(v), lambda m: F.struct(part(m, "name").alias("name"), part(m, "email").alias("email")))
    told = F.filter(told, lambda m: m["name"].isNotNull() | m["email"].isNotNull())
    return F.when(F.size(told) > 0, told)


#: The members of a release that are read; the others are passed over.
_READ = "gitHead _npmVersion maintainers dependencies devDependencies peerDependencies optionalDependencies bundledDependencies bundleDependencies repository".split()
_RELEASE = f"struct<{','.join(f'`{n}`:variant' for n in _READ)},dist:struct<shasum:variant,tarball:variant,unpackedSize:variant,integrity:variant,attestations:variant>,scripts:struct<preinstall:variant,install:variant,postinstall:variant>,`_npmUser`:struct<name:variant,email:variant>>"


def _release(name: Column, version: Column, v: Column, published: Column) -> Column:
    """All fields of one release as a struct; `v` is its members."""
    dist, scripts, user = v["dist"], v["scripts"], v["_npmUser"]
    script = lambda k: F.coalesce(F.length(_text(scripts[k])) > 0, F.lit(False))
    held = lambda c: F.coalesce(_size(c), F.lit(0))
    only = lambda n: once(v[n], lambda x: F.when(_object(x).isNotNull(), _json(x)))
    bundled = F.coalesce(*(F.when(~_is(v[n], "VOID"), v[n]) for n in ("bundledDependencies", "bundleDependencies")))

    def fields(x: Column) -> Column:
        hash_, tarball, number, bundle = x["hash"], x["tarball"], x["number"], x["bundle"]
        algo, attested = F.when(hash_.isNotNull(), "sha1"), x["attestations"].isNotNull()
        file = F.struct(
            F.substring(F.substring_index(tarball, "/", -1), 1, FILENAME).alias("filename"), F.lit("tarball").alias("packagetype"), hash_.alias("content_hash"), algo.alias("content_hash_algo"),
            number.alias("size_bytes"), published.alias("uploaded_at"), F.substring(tarball, 1, TARBALL).alias("url"),
        )
        return F.struct(
            name.alias("package_name"), version.alias("version"), published.alias("published_at"), hash_.alias("content_hash"), algo.alias("content_hash_algo"), _text(dist["integrity"]).alias("integrity_hash"),
            clean_text(_text(v["gitHead"]), GIT_HEAD).alias("git_head"), number.alias("package_size_bytes"),
            *(held(v[n]).alias(a) for n, a in (("dependencies", "dependency_count"), ("devDependencies", "dev_dependency_count"), ("peerDependencies", "peer_dependency_count"), ("optionalDependencies", "optional_dependency_count"))),
            (held(bundle) + F.coalesce(F.size(_list(bundle)), F.lit(0))).alias("bundled_dependency_count"), F.coalesce(_json(v["dependencies"]), F.lit("{}")).alias("dependencies"),
            *(only(n).alias(a) for n, a in (("devDependencies", "dev_dependencies"), ("peerDependencies", "peer_dependencies"), ("optionalDependencies", "optional_dependencies"))),
            _json(bundle).alias("bundled_dependencies"), _text(user["name"]).alias("publisher_name"), _text(user["email"]).alias("publisher_email"),
            F.concat(F.lit("npm@"), clean_text(_text(v["_npmVersion"]), TOOL)).alias("publisher_tool"), _maintainers(v["maintainers"]).alias("maintainers"),
            F.when(attested, "oidc").otherwise("unknown").alias("publish_method"), attested.alias("provenance_present"), x["attestations"].alias("provenance_details"),
            (script("preinstall") | script("install") | script("postinstall")).alias("has_install_scripts"),
            F.substring(F.coalesce(_text(v["repository"]), _text(_at(v["repository"], "url"))), 1, URL).alias("source_repo_url"), F.lit(None).cast("string").alias("license"),
            F.when(tarball.isNotNull(), F.array(file)).otherwise(F.array().cast("array<struct<filename:string,packagetype:string,content_hash:string,content_hash_algo:string,size_bytes:double,uploaded_at:string,url:string>>")).alias("files"),
        )

    number = once(dist["unpackedSize"], lambda size: once(F.schema_of_variant(size), lambda kind: F.when((kind == "BIGINT") | (kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")), F.try_variant_get(size, "$", "double"))))
    attestations = F.when(_object(dist["attestations"]).isNotNull(), F.to_json(dist["attestations"]))
    return once(F.struct(_text(dist["shasum"]).alias("hash"), _text(dist["tarball"]).alias("tarball"), number.alias("number"), bundled.alias("bundle"), attestations.alias("attestations")), fields)


def project(documents: DataFrame, column: str = "document") -> DataFrame:
    """One row per release of every document, with all fields that the store keeps and its `files`."""
    none = F.create_map().cast("map<string,variant>")

    def releases(top: Column) -> Column:
        member = lambda name: F.try_element_at(top, F.lit(name))
        timed = F.map_zip_with(_object(member("versions")), F.coalesce(_object(member("time")), none), lambda version, v, t: F.struct(F.try_variant_get(v, "$", _RELEASE).alias("v"), _text(t).alias("t")))
        found = F.filter(F.map_entries(timed), lambda e: e["value"]["v"].isNotNull())
        return once(_text(member("name")), lambda name: F.transform(found, lambda e: _release(name, e["key"], e["value"]["v"], e["value"]["t"])))

    return documents.select(F.inline(once(_object(F.try_parse_json(column)), releases)))


def version_files(projected: DataFrame) -> DataFrame:
    """File rows of the releases."""
    return projected.select("package_name", "version", F.explode("files").alias("f")).select("package_name", "version", "f.*")


def own_files(projected: DataFrame) -> DataFrame:
    """The releases with the names of the files that they hold themselves, sorted; null if they hold none."""
    return projected.withColumn("filenames", F.when(F.size("files") > 0, F.sort_array(F.transform("files", lambda f: f["filename"]))))


def files_of(releases: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """The releases with their files' names, sorted, where the files are a table of their own.

    The join is named: Spark takes what comes out of documents for hundreds of times smaller than it is, and would send a file a release through the driver.
    """
    names = files.groupBy(*key).agg(F.sort_array(F.collect_list("filename")).alias("filenames"))
    return releases.join(names.hint("merge"), key, "left")


def rewrite_documents(documents: DataFrame, decisions: DataFrame, key: str = "package_name", column: str = "document") -> DataFrame:
    """(key, document, changed, kept, blocked, warned, downgrades): documents as clients may see them, and what was done.

    Blocked releases leave `versions` and `time`; tags on them move to the highest release left (`latest` to no
    prerelease) or go. All other members pass as they are, and a document without blocked releases is untouched.
    A reason is the first detail of the decision that says anything. Decisions are (key, version, disposition, results); of several on one
    release the strictest counts, of equally strict ones the one with the least reason.
    """
    reason = F.coalesce(F.try_element_at(F.filter(F.transform("results", lambda r: r["detail"]), lambda d: F.coalesce(F.length(d) > 0, F.lit(False))), F.lit(1)), F.lit(""))
    # No filter: it would be pushed below the gates and make all of them once more. Nulls are not collected.
    told = F.when(F.col("disposition").isin("WARN", "BLOCK"), F.struct("version", "disposition", reason.alias("reason")))
    some = decisions.groupBy(key).agg(F.array_sort(F.collect_list(told)).alias("_some"))
    first = F.filter("_some", lambda x, i: (i == 0) | ~F.get("_some", i - 1)["version"].eqNullSafe(x["version"]))  # BLOCK sorts before WARN
    told = some.select(key, F.map_from_entries(F.transform(F.filter(first, lambda x: x["version"].isNotNull()), lambda x: F.struct(x["version"], F.struct(x["disposition"], x["reason"])))).alias("_told"))
    # Members are taken from the document at their path: a map of all members copies every one of them, which only changed documents need.
    none = F.create_map().cast("map<string,variant>")
    rows = documents.withColumn("_doc", F.try_parse_json(column)).join(told, key, "left")
    rows = rows.withColumns({"_versions": F.coalesce(_object(_at(F.col("_doc"), "versions")), none), "_told": F.coalesce("_told", F.create_map().cast("map<string,struct<disposition:string,reason:string>>"))})
    said = lambda d: F.transform(F.filter(F.map_keys("_versions"), lambda v: F.try_element_at("_told", v)["disposition"] == d), lambda v: F.struct(v.alias("version"), F.try_element_at("_told", v)["reason"].alias("reason")))
    rows = rows.withColumns({"blocked": said("BLOCK"), "warned": said("WARN")})
    rows = rows.withColumns({"changed": F.size("blocked") > 0, "_gone": F.transform("blocked", lambda b: b["version"])})
    gone = lambda v: F.array_contains("_gone", v)
    rows = rows.withColumns({"_left": F.map_filter("_versions", lambda v, x: ~gone(v)), "_tags": F.when(F.col("changed"), _object(_at(F.col("_doc"), "dist-tags")))})
    # Where tags move to is asked of changed documents only, and each version's key is made once.
    keys = F.transform(F.filter(F.map_keys("_left"), is_semver), lambda v: F.struct(semver_key(v).alias("k"), v.alias("v")))
    rows = rows.withColumn("_keys", F.when(F.col("_tags").isNotNull(), keys))
    rows = rows.withColumns({"_any": F.array_max("_keys")["v"], "_release": F.array_max(F.filter("_keys", lambda x: ~is_prerelease(x["v"])))["v"]})
    target = _text
    best = lambda tag: F.when(tag == "latest", F.col("_release")).otherwise(F.col("_any"))
    hit = F.map_filter("_tags", lambda tag, v: F.coalesce(gone(target(v)), F.lit(False)))
    downgrades = F.transform(F.map_entries(hit), lambda e: F.struct(e["key"].alias("tag"), target(e["value"]).alias("from"), best(e["key"]).alias("to")))
    moved = F.map_filter(F.transform_values("_tags", lambda tag, v: F.when(F.coalesce(gone(target(v)), F.lit(False)), best(tag).cast("variant")).otherwise(v)), lambda tag, v: v.isNotNull())
    as_member = lambda name, m: F.when(m.isNotNull(), F.create_map(F.lit(name), F.to_variant_object(m))).otherwise(none)
    rest = F.map_filter(_object(F.col("_doc")), lambda k, v: ~k.isin("versions", "time") & ~((k == "dist-tags") & F.col("_tags").isNotNull()))
    time = F.map_filter(F.coalesce(_object(_at(F.col("_doc"), "time")), none), lambda k, v: ~gone(k))
    rebuilt = F.to_json(F.map_concat(rest, as_member("versions", F.col("_left")), as_member("time", time), as_member("dist-tags", moved)))
    return rows.select(
        key, F.when(F.col("changed"), rebuilt).otherwise(F.col(column)).alias("document"), "changed", F.size("_left").cast("long").alias("kept"), "blocked", "warned",
        F.when(F.col("changed") & F.col("_tags").isNotNull(), downgrades).otherwise(F.array().cast("array<struct<tag:string,from:string,to:string>>")).alias("downgrades"),
    )
