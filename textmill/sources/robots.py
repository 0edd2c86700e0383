"""robots.txt: groups parsed on the driver (one small file a host), tests as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.urls import decoded_path, raw_path


@dataclass(frozen=True)
class Robots:
    """Rules of the group that applies: (allow, pattern); the longest pattern wins, allow at a tie. No rules: all is allowed."""

    rules: tuple[tuple[bool, str], ...] = ()
    crawl_delay_s: float = 0.0

    def allows(self, url: Column) -> Column:
        path = F.coalesce(decoded_path(url), raw_path(url))
        path = F.when(path == "", F.lit("/")).otherwise(path)
        best = F.lit(None).cast("struct<n:int,ok:boolean>")
        hits = [F.when(path.rlike(_pattern(p)), F.struct(F.lit(len(p)).alias("n"), F.lit(ok).alias("ok"))).otherwise(best) for ok, p in self.rules]
        if not hits:
            return F.lit(True)
        longest = hits[0] if len(hits) == 1 else F.greatest(*hits)
        return F.coalesce(longest["ok"], F.lit(True))


def _pattern(rule: str) -> str:
    end = rule.endswith("$")
    body = ".*".join(re.escape(x) for x in (rule[:-1] if end else rule).split("*"))
    return f"^{body}{'$' if end else ''}"


def parse(text: str | None, user_agent: str) -> Robots:
    """The group whose agent is the longest part of ours, else that of "*"; groups of one agent are merged."""
    groups: dict[str, list[tuple[str, str]]] = {}
    agents: list[str] = []
    open_ = False
    for line in (text or "").splitlines():
        key, _, value = (x.strip() for x in line.split("#", 1)[0].partition(":"))
        key = key.lower()
        if key == "user-agent":
            agents = [*agents, value.lower()] if open_ else [value.lower()]
            open_ = True
            groups.setdefault(value.lower(), [])
        elif key:
            open_ = False
            for a in agents:
                groups[a].append((key, value))
    own = max((a for a in groups if a != "*" and a in user_agent.lower()), key=len, default="*")
    lines = groups.get(own, [])
    rules = tuple((k == "allow", v) for k, v in lines if k in ("allow", "disallow") and v)
    delays = [float(v) for k, v in lines if k == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", v)]
    return Robots(rules, delays[0] if delays else 0.0)


def from_response(status: int, body: str | None, user_agent: str) -> Robots:
    """404 allows all; so does any other failure, which callers treat as no restrictions."""
    return parse(body if status == 200 else None, user_agent)


