"""Column functions on urls, links, index lines and archive paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.constants import (INDEX_KEY, META_DIR_SWAP, META_SUFFIX_SWAP, SITE_PREFIX,
                               TEXT_DIR_SWAP, TEXT_SUFFIX_SWAP)

# fixed values: url patterns
SCHEME_HOST = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)"
HREF = r"""href="([^"]*)\""""
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*:"


# ------------------------------------------------------------ index lines

def json_part(line: Column) -> Column:
    """Everything from the first ``{`` (index lines carry text before the JSON).
    A line without ``{`` gives the empty string."""
    return F.regexp_extract(line, r"\{.*", 0)


def json_key(js: Column, key: str = INDEX_KEY) -> Column:
    """Value of a top-level JSON key as a string (NULL when missing or malformed)."""
    return F.get_json_object(js, f"$.{key}")


def text_archive_path(path: Column) -> Column:
    """Archive path -> path of its plain-text archive."""
    return F.replace(F.replace(path, F.lit(TEXT_DIR_SWAP[0]), F.lit(TEXT_DIR_SWAP[1])),
                     F.lit(TEXT_SUFFIX_SWAP[0]), F.lit(TEXT_SUFFIX_SWAP[1]))


def meta_archive_path(path: Column) -> Column:
    """Archive path -> path of its metadata archive."""
    return F.replace(F.replace(path, F.lit(META_DIR_SWAP[0]), F.lit(META_DIR_SWAP[1])),
                     F.lit(META_SUFFIX_SWAP[0]), F.lit(META_SUFFIX_SWAP[1]))


def normalize_path(path: Column) -> Column:
    """Local paths and ``file:`` URIs to one form (``/dir/file``), so a listed
    path and the file name Spark reports for a record compare equal."""
    return F.regexp_replace(path, r"^file:/+", "/")


def header(headers: Column, name: str) -> Column:
    """First value of a record header by name (``headers`` is a list of
    ``(name, value)`` with lower-cased names; NULL when absent or empty)."""
    wanted = name.lower()
    hit = F.try_element_at(F.filter(headers, lambda h: h["name"] == F.lit(wanted)), F.lit(1))
    return F.nullif(hit["value"], F.lit(""))


def output_name(path: Column) -> Column:
    """Per-archive output file name: slashes to underscores, ``.json`` appended."""
    return F.concat(F.translate(path, "/", "_"), F.lit(".json"))


# ------------------------------------------------------------ urls and links

def site_base(url: Column) -> Column:
    """``scheme://host[:port]`` of a url ('' when it has none)."""
    return F.regexp_extract(url, SCHEME_HOST, 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def href_links(html: Column) -> Column:
    """Every ``href="..."`` target of an html text, in page order."""
    return F.regexp_extract_all(html, F.lit(HREF), 1)


def link_urls(link_objects: Column) -> Column:
    """Array of link objects ``{url}`` -> array of urls; a link without ``url``
    is dropped on its own (the page keeps its other links). Native field
    extraction and ``array_compact``, no lambdas."""
    return F.array_compact(link_objects["url"])


def site_links(links: Column, prefix: str = SITE_PREFIX, legacy: bool = False) -> Column:
    """Links internal to the site.

    Default: links starting with ``prefix``. ``legacy``: the first five
    characters of the link must occur inside ``prefix`` (so '', '/', '/wik'
    and '/wikipedia' pass too).
    """
    if legacy:
        return F.filter(links, lambda l: F.instr(F.lit(prefix), F.substring(l, 1, 5)) > 0)
    return F.filter(links, lambda l: l.startswith(prefix))


def absolute_links(links: Column, base: Column) -> Column:
    """Prefix site-relative links with the page's ``scheme://host``; links that
    already carry a scheme are kept as they are."""
    return F.transform(links, lambda l: F.when(l.rlike(ABSOLUTE), l)
                       .otherwise(F.concat(base, l)))


# ------------------------------------------------------------ url patterns

def url_matches(url: Column, pattern: str) -> Column:
    """Index url pattern: ``*.host`` (the domain and its subdomains),
    ``prefix*`` (urls starting with prefix) or an exact url."""
    if pattern.startswith("*."):
        dom = pattern[2:].lower()
        h = host(url)
        return (h == F.lit(dom)) | h.endswith("." + dom)
    if pattern.endswith("*"):
        return url.startswith(pattern[:-1])
    return url == F.lit(pattern)


def percent_encoded(text: Column) -> Column:
    """Percent-encoding of a path segment (``url_encode`` is the form encoding,
    which differs for the space, ``*`` and ``~``)."""
    form = F.url_encode(text)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")),
                     F.lit("%7E"), F.lit("~"))


def dataset_label(pattern: Column) -> Column:
    """Output label of an index query: the kind of its url pattern (``domain-``,
    ``prefix-``, nothing for an exact url), then the pattern without wildcards
    or scheme, slashes as dashes, percent-encoded, and a closing dash."""
    kind = (F.when(pattern.startswith("*"), F.struct(F.lit("domain-").alias("name"), F.lit(r"^[*.]+|[*.]+$").alias("junk")))
            .when(pattern.endswith("*"), F.struct(F.lit("prefix-").alias("name"), F.lit(r"^[*]+|[*]+$").alias("junk")))
            .otherwise(F.struct(F.lit("").alias("name"), F.lit(r"^(https?:)?//").alias("junk"))))
    named = F.concat(kind["name"], F.regexp_replace(pattern, kind["junk"], F.lit("")))
    return F.concat(percent_encoded(F.translate(F.regexp_replace(named, r"^/+|/+$", ""), "/", "-")), F.lit("-"))


def page_label(page: Column, n_pages: int) -> Column:
    """Zero-padded page number, as wide as the page count."""
    return F.lpad(page.cast("string"), len(str(n_pages)), "0")
