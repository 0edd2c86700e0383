"""Which URLs belong to a crawl, as one predicate that reaches the scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.urls import authority, decoded_path, glob_to_regex, raw_path


@dataclass(frozen=True)
class Scope:
    """Depth, host (with port), raw prefix, include and exclude globs over the decoded path; excludes win."""

    prefix: str = ""
    includes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    max_depth: int = 0
    same_domain: bool = False

    def allows(self, url: Column, depth: Column) -> Column:
        tests = [self._depth(depth), self._domain(url), self._prefix(url), self._globs(url, self.includes, F.lit(True)), ~self._globs(url, self.excludes, F.lit(False))]
        return reduce(lambda a, b: a & b, tests)

    def _depth(self, depth: Column) -> Column:
        return depth <= self.max_depth if self.max_depth > 0 else F.lit(True)

    def _domain(self, url: Column) -> Column:
        return authority(url) == _host(self.prefix) if self.same_domain and self.prefix else F.lit(True)

    def _prefix(self, url: Column) -> Column:
        return url.startswith(base_of(self.prefix)) if self.prefix else F.lit(True)

    @staticmethod
    def _globs(url: Column, globs: tuple[str, ...], without: Column) -> Column:
        """Whether any glob matches; a malformed one matches nothing."""
        path = F.coalesce(decoded_path(url), raw_path(url))
        found = [path.rlike(r) for g in globs if (r := glob_to_regex(g))]
        if not globs:
            return without
        return reduce(lambda a, b: a | b, found) if found else F.lit(False)


def _host(url: str) -> str:
    return urlsplit(url).netloc.rpartition("@")[2].lower()


def base_of(url: str) -> str:
    """The prefix with scheme and host in lower case, without fragment and user info; the query stays."""
    at = urlsplit(url)
    return f"{at.scheme.lower()}://{_host(url)}{at.path}{'?' + at.query if at.query else ''}"
