"""Column functions: text clean-up, identities, providers, semantic versions, rates. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from pedigree.params import FREE_WEBMAIL, MACHINE_EMAIL, PRIVACY_PROVIDERS, Parameter

#: White space that is trimmed: ASCII, no-break, Ogham, the U+2000 block, line and paragraph ends, ideographic, byte-order mark.
_BLANK = " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Core, prerelease and build of a version.
SEMVER = r"^([0-9]+)\.([0-9]+)\.([0-9]+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def param(value: Parameter) -> Column:
    """A parameter as a column: a literal, or the grid column that it names."""
    return F.col(value) if isinstance(value, str) else F.lit(value)


def trim_all(c: Column) -> Column:
    """Without any Unicode white space at either end."""
    return F.btrim(c, F.lit(_BLANK))


def clean_text(c: Column, limit: int) -> Column:
    """Trimmed and cut to `limit` characters; null if nothing is left."""
    return F.substring(F.nullif(trim_all(c), F.lit("")), 1, limit)


def identity(name: Column, email: Column) -> Column:
    """The trimmed name, else the lower-case address in angle brackets, else null."""
    address = F.nullif(F.lower(trim_all(email)), F.lit(""))
    return F.coalesce(F.nullif(trim_all(name), F.lit("")), F.concat(F.lit("<"), address, F.lit(">")))


def domain(email: Column) -> Column:
    """What follows the last @, trimmed and in lower case; null if there is none."""
    return F.when(F.instr(email, "@") > 0, F.nullif(F.lower(trim_all(F.substring_index(email, "@", -1))), F.lit("")))


def provider(domain_: Column, versions: Column, min_verified: Parameter) -> Column:
    """Class of a mail domain; `versions` is the number of the package's releases that use it."""
    return (
        F.when(domain_.isNull(), "unknown")
        .when(domain_.isin(*PRIVACY_PROVIDERS), "privacy")
        .when(domain_.isin(*FREE_WEBMAIL), "free-webmail")
        .when(F.coalesce(versions, F.lit(0)) >= param(min_verified), "verified-corporate")
        .otherwise("unverified")
    )


def is_machine(email: Column) -> Column:
    """Whether an address is the CI bot's; null is not."""
    return F.coalesce(F.lower(trim_all(email)) == MACHINE_EMAIL, F.lit(False))


def _number(digits: Column) -> Column:
    """Digits so that text order is numeric order, of any length."""
    short = F.ltrim(digits, F.lit("0"))
    short = F.when(short == "", "0").otherwise(short)
    return F.concat(F.lpad(F.length(short).cast("string"), 4, "0"), short)


def is_semver(version: Column) -> Column:
    return F.coalesce(trim_all(version).rlike(SEMVER), F.lit(False))


def semver_part(version: Column, group: int) -> Column:
    """Major, minor, patch or prerelease (1 to 4) of a parseable version, else null."""
    return F.when(is_semver(version), F.nullif(F.regexp_extract(trim_all(version), SEMVER, group), F.lit("")))


def is_prerelease(version: Column) -> Column:
    return semver_part(version, 4).isNotNull()


def semver_key(version: Column) -> Column:
    """Text whose order is semantic-version precedence; unparseable versions follow in text order.

    A release sorts after its prereleases, numeric identifiers before others, a shorter list of
    identifiers before its extensions; build metadata does not count.
    """
    v = trim_all(version)
    core = F.array_join(F.transform(F.split(F.regexp_extract(v, r"^[0-9]+\.[0-9]+\.[0-9]+", 0), r"\."), _number), "")
    pre = F.regexp_extract(v, SEMVER, 4)
    ids = F.transform(F.split(pre, r"\."), lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("0"), _number(x))).otherwise(F.concat(F.lit("1"), x)))
    tail = F.when(pre == "", "~").otherwise(F.concat(F.lit("-"), F.array_join(ids, "!")))
    return F.when(v.rlike(SEMVER), F.concat(F.lit("a"), core, tail)).otherwise(F.concat(F.lit("z"), version))


def tied(by: str, order: str) -> Column:
    """Whether another row of the group has the same value; only such rows need what decides among them."""
    rows = Window.partitionBy(by).orderBy(order)
    same = lambda c: F.coalesce(c == F.col(order), F.lit(False))
    return same(F.lag(order).over(rows)) | same(F.lead(order).over(rows))


def major(version: Column) -> Column:
    """The major number, of unparseable versions the digits before the first dot, else null; null too beyond 38 digits."""
    # Where a version begins with digits and a dot, these are its major number, parseable or not; others need a closer look.
    return F.coalesce(F.nullif(F.regexp_extract(version, r"^([0-9]+)\.", 1), F.lit("")), semver_part(version, 1)).try_cast("decimal(38,0)")


def matches_range(version: Column, range_: Column) -> Column:
    """Whether a version satisfies all comparators (>=, <=, >, <, =) of a range; null or empty matches nothing.

    A token that is no comparator with a version raises an error.
    """
    token = r"^(>=|<=|>|<|=)(.+)$"
    tokens = F.filter(F.split(trim_all(range_), r"\s+"), lambda t: t != "")

    def holds(t: Column) -> Column:
        op, bound = F.regexp_extract(t, token, 1), F.regexp_extract(t, token, 2)
        a, b = semver_key(version), semver_key(bound)
        a, b = (F.when(is_semver(version) & is_semver(bound), x).otherwise(y) for x, y in ((a, version), (b, bound)))
        wrong = F.raise_error(F.concat(F.lit("unparseable range comparator: "), t)).cast("boolean")
        return F.when(~t.rlike(token) | ~is_semver(bound), wrong).otherwise(
            ((op == ">=") & (a >= b)) | ((op == "<=") & (a <= b)) | ((op == ">") & (a > b)) | ((op == "<") & (a < b)) | ((op == "=") & (a == b))
        )

    return F.when(F.coalesce(trim_all(range_), F.lit("")) == "", False).otherwise(F.forall(tokens, holds))


def round4(x: Column) -> Column:
    """To four decimals, halves up; null if not finite."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300), F.floor(x * 10_000 + 0.5) / 10_000)


def rate(part: Column, whole: Column) -> Column:
    """A share to four decimals, null of nothing."""
    return F.when(whole > 0, round4(part / whole))


def wilson(successes: Column, n: Column, side: int, z: float = 1.959964) -> Column:
    """Lower (side -1) or upper (side 1) end of the score interval of a share; null of nothing."""
    p = successes / n
    half = z * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    end = (p + F.lit(z * z) / (2 * n) + side * half) / (1 + F.lit(z * z) / n)
    return F.when(n > 0, round4(F.least(F.lit(1.0), F.greatest(F.lit(0.0), end))))


def shorten(c: Column, limit: int, absent: str) -> Column:
    """For display: cut with an ellipsis, or a word for what is absent."""
    return F.coalesce(F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c), F.lit(absent))


def iso_millis(c: Column) -> Column:
    """Milliseconds of an ISO-8601 date or time, null if it is none."""
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    return F.when(c.rlike(iso), F.unix_millis(c.try_cast("timestamp")))
