"""The column functions for SQL text: temporary functions of a session, scalar ones and tables of a document.

`register(spark)` makes them known; they are expanded into the query's plan, so there is no Python and no
call a row. The body of a table is one `inline` and nothing else: so it is generated from the row at hand, where any
other body is joined back by the whole document. Scalars: `version_key`, `version_major`, `release_identity`, `mail_domain`, `mail_provider`. Tables:
`document_releases`, `document_tags`, `lockfile_packages`, used as `FROM docs, LATERAL document_releases(docs.document)`.
Null in any argument that a function reads gives what the column function gives; a text that is no
JSON object gives no rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from pedigree.functions.columns import _BLANK, SEMVER
from pedigree.params import FREE_WEBMAIL, PRIVACY_PROVIDERS

_ESCAPED = "".join(c if c == " " else f"\\u{ord(c):04x}" for c in _BLANK)
_PATTERN = SEMVER.replace("\\", "\\\\")


def _trim(x: str) -> str:
    return f"btrim({x}, '{_ESCAPED}')"


def _digits(x: str) -> str:
    short = f"if(ltrim('0', {x}) = '', '0', ltrim('0', {x}))"
    return f"concat(lpad(cast(length({short}) as string), 4, '0'), {short})"


def _names(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _members(document: str, name: str) -> str:
    return f"try_variant_get(try_variant_get(try_parse_json({document}), '$[\"{name}\"]', 'variant'), '$', 'map<string,variant>')"


def _text(v: str) -> str:
    """The text of a JSON string, null for everything else."""
    return f"if(schema_of_variant({v}) = 'STRING', try_variant_get({v}, '$', 'string'), null)"


def _package(key: str) -> str:
    """The package that an installed path names: what follows the last node_modules folder."""
    return f"element_at(split({key}, '(^|/)node_modules/'), -1)"


_RELEASE = "struct<dist:struct<integrity:variant,shasum:variant,attestations:variant>,`_npmUser`:struct<name:variant,email:variant>>"

#: Name -> (arguments, result, body).
FUNCTIONS = {
    "version_key": (
        "version STRING",
        "STRING",
        f"""CASE WHEN {_trim("version")} RLIKE '{_PATTERN}' THEN concat('a',
  array_join(transform(split(regexp_extract({_trim("version")}, '^[0-9]+[.][0-9]+[.][0-9]+', 0), '[.]'), d -> {_digits("d")}), ''),
  CASE WHEN regexp_extract({_trim("version")}, '{_PATTERN}', 4) = '' THEN '~'
       ELSE concat('-', array_join(transform(split(regexp_extract({_trim("version")}, '{_PATTERN}', 4), '[.]'), i -> if(i RLIKE '^[0-9]+$', concat('0', {_digits("i")}), concat('1', i))), '!')) END)
ELSE concat('z', version) END""",
    ),
    "version_major": (
        "version STRING",
        "DECIMAL(38,0)",
        f"try_cast(coalesce(if({_trim('version')} RLIKE '{_PATTERN}', nullif(regexp_extract({_trim('version')}, '{_PATTERN}', 1), ''), null), nullif(regexp_extract(version, '^([0-9]+)[.]', 1), '')) AS DECIMAL(38,0))",
    ),
    "release_identity": ("name STRING, email STRING", "STRING", f"coalesce(nullif({_trim('name')}, ''), concat('<', nullif(lower({_trim('email')}), ''), '>'))"),
    "mail_domain": ("email STRING", "STRING", f"CASE WHEN instr(email, '@') > 0 THEN nullif(lower({_trim('substring_index(email, chr(64), -1)')}), '') END"),
    "mail_provider": (
        "host STRING, versions BIGINT, least BIGINT",
        "STRING",
        f"CASE WHEN host IS NULL THEN 'unknown' WHEN host IN ({_names(PRIVACY_PROVIDERS)}) THEN 'privacy' WHEN host IN ({_names(FREE_WEBMAIL)}) THEN 'free-webmail' WHEN coalesce(versions, 0) >= least THEN 'verified-corporate' ELSE 'unverified' END",
    ),
    "document_releases": (
        "document STRING",
        "TABLE (package_name STRING, version STRING, published_at STRING, integrity_hash STRING, content_hash STRING, publisher_name STRING, publisher_email STRING, provenance_present BOOLEAN)",
        f"""SELECT * FROM inline(get(transform(array(try_variant_get(try_parse_json(document), '$', 'struct<name:variant,time:map<string,variant>,versions:map<string,variant>>')), d ->
  transform(filter(map_entries(map_zip_with(d.versions, coalesce(d.time, cast(map() as map<string,variant>)), (k, v, t) -> named_struct('v', try_variant_get(v, '$', '{_RELEASE}'), 't', {_text("t")}))), e -> e.value.v IS NOT NULL),
    e -> named_struct('package_name', {_text("d.name")}, 'version', e.key, 'published_at', e.value.t, 'integrity_hash', {_text("e.value.v.dist.integrity")}, 'content_hash', {_text("e.value.v.dist.shasum")},
      'publisher_name', {_text("e.value.v._npmUser.name")}, 'publisher_email', {_text("e.value.v._npmUser.email")}, 'provenance_present', try_variant_get(e.value.v.dist.attestations, '$', 'map<string,variant>') IS NOT NULL))), 0))""",
    ),
    "document_tags": (
        "document STRING",
        "TABLE (tag STRING, version STRING)",
        f"SELECT * FROM inline(filter(transform(map_entries({_members('document', 'dist-tags')}), e -> named_struct('tag', e.key, 'version', {_text('e.value')})), t -> t.version IS NOT NULL))",
    ),
    "lockfile_packages": (
        "document STRING",
        "TABLE (path STRING, package_name STRING, version STRING, integrity STRING, link BOOLEAN)",
        f"""SELECT * FROM inline(transform(filter(transform(map_entries({_members("document", "packages")}), e -> named_struct('k', e.key, 'v', try_variant_get(e.value, '$', 'struct<name:variant,version:variant,integrity:variant,link:variant>'))), e -> e.k <> '' AND e.v IS NOT NULL),
  e -> named_struct('path', e.k, 'package_name', coalesce(nullif({_text("e.v.name")}, ''), {_package("e.k")}), 'version', {_text("e.v.version")}, 'integrity', nullif({_text("e.v.integrity")}, ''), 'link', coalesce(try_variant_get(e.v.link, '$', 'boolean'), false))))""",
    ),
}


def register(spark: SparkSession) -> SparkSession:
    """Make the functions known to a session; registering again replaces them."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return spark
