"""Parsing, normalising and filtering of urls, and the robots rules."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes of urls that are never fetched.
IGNORED_SUFFIXES = (".jpg", ".jpeg", ".gif", ".png", ".txt")
_PORTS = {"http": 80, "https": 443}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_parts(url: Column | str) -> Column:
    """Struct of protocol, host, port and path; absent parts are null, an absent path is "/"."""
    url = _col(url)
    pattern = r"^(?:([^:/]+)://([^:/]*)(?::([0-9]*))?)?(.*)$"
    part = [F.nullif(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2, 3)]
    path = F.regexp_extract(url, pattern, 4)
    return F.struct(part[0].alias("protocol"), part[1].alias("host"), part[2].alias("port"), F.when(path == "", "/").otherwise(path).alias("path"))


def normalize_url(url: str | None, base: str | None = None) -> str | None:
    """The absolute form with explicit port and without fragment, user and query kept; null for what is no web page."""
    if url is None:
        return None
    try:
        joined = urlsplit(urljoin(base, url) if base else url)
        port = joined.port
    except ValueError:
        return None
    scheme = joined.scheme.lower()
    user, at, host = joined.netloc.rpartition("@")
    host = re.sub(r":\d*$", "", host)
    if scheme not in _PORTS or not host or re.search(r"\s", url):
        return None
    path = joined.path or "/"
    if path.lower().endswith(IGNORED_SUFFIXES):
        return None
    return f"{scheme}://{user}{at}{host}:{port or _PORTS[scheme]}{path}" + (f"?{joined.query}" if joined.query else "")


@F.pandas_udf(T.StringType())
def normalized(url: pd.Series, base: pd.Series) -> pd.Series:
    """Column form of `normalize_url`, over Arrow batches: resolving relative paths has no built-in."""
    return pd.Series([normalize_url(u, b) for u, b in zip(url, base, strict=True)], dtype=object)


def normalized_absolute(url: Column | str) -> Column:
    """`normalize_url` for urls that have a scheme and no dot segments, as a built-in expression."""
    url = _col(url)
    pattern = r"^([a-zA-Z]+)://([^/?#@]*@)?([^/?#:@]+)(?::([0-9]+))?([^?#]*)(\?[^#]+)?"
    scheme, user, host, port, path, query = (F.regexp_extract(url, pattern, k) for k in range(1, 7))
    scheme = F.lower(scheme)
    known = F.coalesce(F.nullif(port, F.lit("")), F.when(scheme == "https", "443").otherwise("80"))
    path = F.when(path == "", "/").otherwise(path)
    kept = scheme.isin(*_PORTS) & (host != "") & ~F.lower(path).rlike(r"\.(jpg|jpeg|gif|png|txt)$") & ~url.rlike(r"\s")
    return F.when(kept, F.concat(scheme, F.lit("://"), user, host, F.lit(":"), known, path, query))


def is_ignored(url: Column | str) -> Column:
    return _col(url).rlike(r"(?i)\.(jpg|jpeg|gif|png|txt)$")


def is_ascii(url: Column | str) -> Column:
    return _col(url).rlike(r"^[\x00-\x7F]*$")


def blacklist_pattern(lines: Iterable[str]) -> str:
    """One regular expression for a list of patterns, in which * stands for anything; never matches for an empty list."""
    parts = [line.strip().replace(".", r"\.").replace("*", ".*") for line in lines if line.strip()]
    return "^(?:" + "|".join(f"(?:{p})" for p in parts) + ")$" if parts else "$^a"


def is_blacklisted(url: Column | str, lines: Iterable[str]) -> Column:
    """Whether a url as a whole matches a pattern of the list."""
    return _col(url).rlike(blacklist_pattern(lines))


def host_key_name(url: Column | str) -> Column:
    """Host of a url in lower case without a leading www., as hosts are keyed."""
    return F.regexp_replace(F.lower(url_parts(url)["host"]), r"^www\.", "")


DENIED, ALLOWED, WAIT = 0, 1, 2


@dataclass
class Block:
    """What a robots text says to one agent: rules in order as (allow, path), and the first crawl delay in seconds."""

    rules: list[tuple[bool, str]] = field(default_factory=list)
    delay: float | None = None


@functools.lru_cache(maxsize=1024)
def parse_robots(text: str | None, strict: bool = True) -> dict[str, Block]:
    """Blocks by agent in lower case; lines before the first agent belong to `*`, which always has one.

    Keys and values are parted by a line's first colon; lines without a value do not count, nor do delays that are no
    numbers. Every agent line opens its own block; with strict=False agents named in a row share what follows, and
    comments behind # are taken off first.
    """
    blocks = {"*": Block()}
    current = [blocks["*"]]
    named = False
    for line in re.split(r"[\r\n]", text or ""):
        key, found, value = (line if strict else line.split("#", 1)[0]).partition(":")
        key, value = key.strip().lower(), value.strip()
        if not found or not value:
            continue
        if key == "user-agent":
            block = blocks.setdefault(value.lower(), Block())
            current = [*current, block] if named and not strict else [block]
        elif key in ("allow", "disallow"):
            for block in current:
                block.rules.append((key == "allow", value))
        elif key == "crawl-delay":
            for block in current:
                if block.delay is None:
                    try:
                        block.delay = float(value)
                    except ValueError:
                        pass
        named = key == "user-agent"
    return blocks


def robots_decision(robots: str | None, path: str | None, agent: str, now_ms: int, last_ms: int | None, strict: bool = True) -> int:
    """DENIED, ALLOWED or WAIT: the first rule in order whose path begins the url's path, then the crawl delay, 0 if none.

    The block is that of the longest agent that is `*` or part of one's own name.
    """
    blocks = parse_robots(robots, strict)
    block = blocks[max((n for n in blocks if n == "*" or n in agent.lower()), key=lambda n: (len(n), n != "*", n))]
    for allow, prefix in block.rules:
        if (path or "/").startswith(prefix):
            if not allow:
                return DENIED
            break
    if last_ms is not None and now_ms < last_ms + 1000 * (block.delay or 0.0):
        return WAIT
    return ALLOWED


def longest_match(robots: str | None, path: str | None, agent: str) -> tuple[bool, float]:
    """The other policy: whether the longest matching rule allows a path (Allow wins ties), and the delay, 1.0 by default."""
    blocks = parse_robots(robots, strict=False)
    block = blocks.get(agent.lower()) or blocks["*"]
    fitting = [(len(prefix), allow) for allow, prefix in block.rules if (path or "/").startswith(prefix)]
    return (max(fitting)[1] if fitting else True), 1.0 if block.delay is None else block.delay


def robots_decisions(agent: str):
    """A vectorised function of columns robots, path, now and last (milliseconds)."""

    @F.pandas_udf(T.IntegerType())
    def decide(robots: pd.Series, path: pd.Series, now: pd.Series, last: pd.Series) -> pd.Series:
        rows = zip(robots, path, now, last, strict=True)
        return pd.Series([robots_decision(r, p, agent, int(n), None if pd.isna(t) else int(t)) for r, p, n, t in rows])

    return decide
