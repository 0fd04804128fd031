"""Column expressions shared by the rules and reports: path classes, normalised lines, fingerprints, encodings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

GENERATED_SEGMENTS = (
    "__pycache__ .pytest_cache .mypy_cache .ruff_cache .git build dist .eggs .venv venv env .tox htmlcov .coverage "
    "node_modules bower_components _vendor vendor vendored third_party third-party site-packages .claude workspace"
).split()
TEXT_SUFFIXES = ".py .js .jsx .ts .tsx .go .rs .java .cs .kt .kts .sh .bash .sql .tf .hcl .md .txt .toml .yml .yaml .json".split()
CODE_SUFFIXES = [s for s in TEXT_SUFFIXES if s not in (".md", ".txt")]
IMAGE_FILES = ("Dockerfile", "Containerfile")
SAMPLE_SEGMENTS = "example fixture sample examples fixtures samples".split()
SEVERITIES = ("low", "medium", "high", "critical")
SECRET_WORDS = ("api[_-]?key", "secret", "token", "password")
SECRET_TEXT = rf"(?i)\b(?:{'|'.join(SECRET_WORDS)})\b\s*[=:]\s*(?:'|\")[0-9A-Za-z_-]{{8,}}(?:'|\")"
HTTP_URL = r"(?i)http://[\w.:/-]+"
INERT_HOSTS = (
    "example.com example.org example.net example.edu localhost 127.0.0.1 0.0.0.0 www.w3.org w3.org schemas.xmlsoap.org purl.org www.iana.org "
    "ns.adobe.com tempuri.org dublincore.org schemas.openxmlformats.org schemas.microsoft.com docbook.org"
).split()
INERT_HOST_ENDING = r"\.(w3\.org|xmlsoap\.org|local|test|invalid|example|localhost)$"


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last dot and what follows it, in lower case; '' for a name that only begins with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def has_segment(path: Column, names) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def under(path: Column, prefixes) -> Column:
    """Whether path is one of prefixes or lies below one."""
    return any_of([(path == p) | path.startswith(p + "/") for p in (x.rstrip("/") for x in prefixes)])


def scope_class(path: Column) -> Column:
    """The class of a relative path: eight ordered rules, the first that holds."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", "")
    name = file_name(p)
    stem = F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")
    parts = F.split(p, "/")
    begins = lambda a, b: (F.try_element_at(parts, F.lit(1)) == a) & (F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")) == b)
    return (
        F.when(has_segment(p, GENERATED_SEGMENTS), "generated")
        .when(begins("shared", "tools"), "maintainer-probes")
        .when(begins("docs", "roadmap"), "roadmap-evidence")
        .when(has_segment(p, SAMPLE_SEGMENTS), "fixtures")
        .when(has_segment(p, ("docs", "doc", ".github")), "docs-evidence")
        .when(has_segment(p, ("tests",)) | name.startswith("test_") | stem.endswith("_test"), "tests")
        .when(name.isin(*IMAGE_FILES) | suffix(p).isin(*CODE_SUFFIXES), "runtime-source")
        .otherwise("support")
    )


def squash(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.array_join(F.filter(F.split(text, r"\s+"), lambda x: x != ""), " ")


def fingerprint(ci_id: Column, signal: Column, path: Column, symbol: Column, content: Column) -> Column:
    """Identity of a finding that line shifts keep: 16 hex digits over its rule, file, enclosing symbol and squashed line."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(F.sha2(F.concat_ws("|", ci_id, signal, path, empty(symbol), empty(content)), 256), 1, 16)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^http://([^/:?#]*)", 1))


def inert_host(host: Column) -> Column:
    return host.isin(*INERT_HOSTS) | host.rlike(INERT_HOST_ENDING)


def replaced(text: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def encode_message(text: Column) -> Column:
    return replaced(text, [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")])


def encode_param(text: Column) -> Column:
    return replaced(encode_message(text), [(":", "%3A"), (",", "%2C")])


def low_value_number(n: Column) -> Column:
    """Integers that are common without being magic: small, few round ones, powers of two and all-ones masks."""
    a = F.abs(n)
    return n.isin(1000) | (a < 256) | (a.bitwiseAND(a - 1) == 0) | (a.bitwiseAND(a + 1) == 0)


def value_shaped(text: Column) -> Column:
    """Literals whose shape tells of one owner: URIs, paths, templates."""
    return (
        text.rlike(r"(?i)^[a-z][+.a-z0-9-]*://")
        | text.rlike(r"^(/|\./|\.\./)")
        | text.contains("\\")
        | text.rlike(r"^[A-Za-z]:[\\/]")
        | text.rlike(r"/[^\s/]*[.][0-9A-Za-z]{1,6}(?:$|/)")
        | (text.contains("{") & text.contains("}"))
        | text.rlike("%[ #0+-]?[0-9]*[.]?[0-9]*[%cdefgiorsxX]")
    )
