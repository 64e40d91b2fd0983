"""Address handling in plain SQL expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaforge.functions.common import has_any, let, strip
from qaforge.rules import lexicons as R

_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def authority(url: Column) -> Column:
    """Host with port and user part, as between `//` and the next slash, question mark or hash."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def site_name(url: Column, dots_only: bool = False) -> Column:
    """Authority as a file-name-safe word."""
    host = authority(url)
    if dots_only:
        return F.replace(host, F.lit("."), F.lit("_"))
    return F.regexp_replace(host, r"[^\p{L}\p{N}_]+", "_")


def same_domain(url: Column, base: Column) -> Column:
    """Equal authorities; another port is another domain."""
    return authority(url) == authority(base)


def _dot_segments(path: Column) -> Column:
    """Resolve `.` and `..` in an absolute path."""
    parts = F.split(path, "/")

    def folded(p: Column) -> Column:
        kept = F.aggregate(
            F.slice(p, F.lit(2), F.size(p)),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
            .otherwise(F.array_append(acc, s)),
        )
        tail = F.when(F.element_at(p, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))

        def join(k: Column) -> Column:
            body = F.concat(F.lit("/"), F.array_join(k, "/"))
            return F.when((F.size(k) > 0), F.concat(body, tail)).otherwise(F.lit("/"))

        return let(kept, join)

    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), let(parts, folded)).otherwise(path)


def normalize_url(base: Column, href: Column) -> Column:
    """Resolve a reference against its page and drop the fragment."""

    def resolve(b: Column) -> Column:
        page, ref = b["base"], b["ref"]
        sch, auth = scheme(page), authority(page)
        root = F.concat(sch, F.lit("://"), auth)
        base_path = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
        base_query = F.regexp_extract(page, r"^[^?#]*(\?[^#]*)", 1)
        folder = F.regexp_extract(base_path, r"^(.*/)", 1)
        folder = F.when(folder == "", F.lit("/")).otherwise(folder)
        ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
        ref_query = F.regexp_extract(ref, r"^[^?#]*(\?[^#]*)", 1)
        own_auth = authority(ref)
        own_path = F.regexp_extract(ref, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)
        return (
            F.when(ref == "", F.concat(root, base_path, base_query))
            .when(
                ref.rlike(_ABSOLUTE + "//") & scheme(ref).isin("http", "https"),
                F.concat(scheme(ref), F.lit("://"), own_auth, own_path, ref_query),
            )
            .when(ref.rlike(_ABSOLUTE), ref)
            .when(ref.startswith("//"), F.concat(sch, F.lit("://"), own_auth, own_path, ref_query))
            .when(ref.startswith("?"), F.concat(root, base_path, ref_query))
            .when(ref.startswith("/"), F.concat(root, _dot_segments(ref_path), ref_query))
            .otherwise(F.concat(root, _dot_segments(F.concat(folder, ref_path)), ref_query))
        )

    bound = F.struct(
        base.alias("base"), strip(F.regexp_replace(F.coalesce(href, F.lit("")), "#.*$", "")).alias("ref")
    )
    return let(bound, resolve)


def is_asset(url: Column, suffix_only: bool = False) -> Column:
    """Static file or tracking address, by pattern anywhere or by suffix."""
    if suffix_only:
        out = F.lit(False)
        for s in R.ASSET_SUFFIXES:
            out = out | url.endswith(s)
        return out
    return url.rlike(R.ASSET_PATTERN)


def is_trap(url: Column, base: Column) -> Column:
    """The site's authority turns up again past the length of the base address."""
    return F.contains(F.substr(url, F.length(base) + 1), authority(base))


def has_keyword(url: Column, cues: Sequence[str] = tuple(R.HELP_URL_WORDS)) -> Column:
    return has_any(F.lower(url), list(cues))
