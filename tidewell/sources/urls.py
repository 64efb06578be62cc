"""Relative URLs and international hosts, which expressions do not resolve."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

from tidewell.functions import text as tx

#: URLs that resolving leaves as they are, but for their host and the order of their query: with a path from the root, without empty
#: segments or such as begin with a dot, parameters and white space, and with names and values that need no escape.
PLAIN = re.compile(r"(https?://[A-Za-z0-9.-]+)?((?:/[^\s\x00-\x20\x7f-\xa0./?#;\\][^\s\x00-\x20\x7f-\xa0/?#;\\]*)+/?)(?:\?((?:[A-Za-z0-9_.~-]+=[A-Za-z0-9_.~-]*&)*[A-Za-z0-9_.~-]+=[A-Za-z0-9_.~-]*))?")
#: How most bases begin; what follows does not matter to a path from the root.
HOST = re.compile(r"https?://[A-Za-z0-9.-]+(?=[/?#]|\Z)")


def canonical(url: str, base: str) -> str:  # S10 with relative URLs and international hosts
    m = PLAIN.fullmatch(url)
    if not m:
        return resolved(url, base) if url else itself(base)
    host = HOST.match(base)
    query = sorted(x for p in m[3].split("&") if (x := tuple(p.split("=")))[0].lower() not in tx.TRACKING) if m[3] else ()
    return origin(m[1] or "/", host[0] if host else base) + m[2] + ("?" + "&".join(map("=".join, query)) if query else "")


@lru_cache(4096)
def origin(url: str, base: str) -> str:
    """Scheme, host and port of a URL without a path."""
    return resolved(url, base)[:-1]


@lru_cache(4096)
def itself(base: str) -> str:
    return resolved("", base)


def resolved(url: str, base: str) -> str:
    parts = urlsplit(urljoin(base, url.strip()))
    host = (parts.hostname or "").rstrip(".").lower()
    if not parts.scheme or not host or parts.username is not None:
        raise ValueError("no usable URL")
    host = host.encode("idna").decode("ascii")
    port = "" if parts.port is None or (parts.scheme, parts.port) == ("https", 443) else f":{parts.port}"
    query = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in tx.TRACKING)
    return urlunsplit((parts.scheme.lower(), host + port, re.sub("/{2,}", "/", parts.path or "/"), urlencode(query), ""))


def canonical_or_none(url: str | None, base: str | None) -> str | None:
    try:
        return canonical(url or "", base or "")
    except ValueError:
        return None
