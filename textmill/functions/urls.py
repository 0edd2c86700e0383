"""URL expressions: parts, normal form, resolution of references, file names."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern: RFC 3986 appendix B, with user info set apart.
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:[?]([^#]*))?(#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL, 1))


def authority(url: Column) -> Column:
    """Host with port, lower case, without user info."""
    return F.lower(F.regexp_extract(url, URL, 2))


def raw_path(url: Column) -> Column:
    return F.regexp_extract(url, URL, 3)


def decoded_path(url: Column) -> Column:
    """Escapes resolved; a plus sign stays itself, as it does in paths."""
    return F.try_url_decode(F.replace(raw_path(url), F.lit("+"), F.lit("%2B")))


def _encode_path(path: Column) -> Column:
    """Escapes what a path may not hold, and leaves what it may."""
    keep = {"%2F": "/", "%24": "$", "%26": "&", "%2B": "+", "%2C": ",", "%3A": ":", "%3B": ";", "%3D": "=", "%40": "@", "%7E": "~", "%21": "!", "%27": "'", "%28": "(", "%29": ")"}
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), keep.items(), F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")))


def normalize_url(url: Column) -> Column:
    """One form for URLs of one resource.

    Scheme and host in lower case; no fragment, user info or trailing slash; an empty path is "/"; query pairs decoded,
    sorted by key, then value, and encoded again, always as key=value. Not a URL: null.
    """
    path = F.regexp_replace(F.coalesce(decoded_path(url), raw_path(url)), "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(_encode_path(path))
    query = F.regexp_extract(url, URL, 4)

    def cut(p: Column) -> Column:
        key, value = F.regexp_extract(p, "^([^=]*)", 1), F.regexp_extract(p, "^[^=]*=(.*)$", 1)
        return F.struct(F.coalesce(F.try_url_decode(key), key).alias("k"), F.coalesce(F.try_url_decode(value), value).alias("v"))

    pairs = F.array_sort(F.transform(F.filter(F.split(query, "&"), lambda p: F.length(p) > 0), cut))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    tail = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), text)).otherwise(F.lit(""))
    return F.when(url.rlike(URL), F.concat(scheme(url), F.lit("://"), authority(url), path, tail))


def _resolve(base: pd.Series, ref: pd.Series) -> pd.Series:
    from urllib.parse import urldefrag, urljoin, urlsplit

    def one(b: str | None, r: str | None) -> str | None:
        if b is None or r is None:
            return None
        try:
            out = urldefrag(urljoin(b, r))[0]
            return out if urlsplit(out).scheme in ("http", "https") else None
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref, strict=True)], dtype=object)


def resolve_url(base: Column, ref: Column) -> Column:
    """RFC 3986 reference resolution; http and https only, without fragment; else null."""
    return F.pandas_udf(_resolve, "string")(base, ref)


def url_to_filepath(base: str, url: Column) -> Column:
    """Place of a page below the output folder, by its path; the query is ignored, an empty path is "index"."""
    from urllib.parse import urlsplit

    root = urlsplit(base)
    if not root.scheme or not root.netloc:
        raise ValueError(f"not a URL: {base!r}")
    path = F.coalesce(decoded_path(url), raw_path(url))
    prefix = root.path.rstrip("/")
    inner = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 20)).otherwise(path) if prefix else path
    clean = F.regexp_replace(F.regexp_replace(inner, "/+", "/"), "/[.](?=/|$)", "")
    for _ in range(4):  # each pass takes away one step up
        clean = F.regexp_replace(clean, "(^|/)(?![.][.](?:/|$))[^/]+/[.][.](?=/|$)", "")
    slash = clean.endswith("/")
    name = F.regexp_replace(clean, "^/+|/+$", "")
    return F.when(name == "", F.lit("index")).when(slash, F.concat(name, F.lit("/index"))).otherwise(name)


def url_to_filename(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(url, "^https://", ""), "^http://", "")
    name = F.regexp_replace(F.regexp_replace(bare, "[^A-Za-z0-9-]", "_"), "^_+|_+$", "")
    return F.when(name == "", F.lit("doc")).otherwise(name)


def host_to_dir(host: str) -> str:
    return host.removeprefix("www.").replace(".", "-")


def glob_to_regex(pattern: str) -> str | None:
    """Shell pattern over a path as an anchored expression: * and ? stay within a segment. Malformed: None."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            out += _literal(pattern[i])
        elif c == "[":
            i += 1
            negate = pattern[i : i + 1] == "^"
            i += negate
            members = ""
            while i < len(pattern) and (pattern[i] != "]" or not members):
                if pattern[i] == "\\":
                    i += 1
                    if i == len(pattern):
                        return None
                elif pattern[i] == "-" and members:
                    members += "-"
                    i += 1
                    continue
                members += _literal(pattern[i])
                i += 1
            if i == len(pattern) or not members or members[-1] == "-":
                return None
            out += f"[{'^' if negate else ''}{members}]"
        else:
            out += _literal(c)
        i += 1
    return f"^{out}$"


def _literal(c: str) -> str:
    return c if c.isalnum() or c in "/_ " or ord(c) > 127 else f"\\{c}"
