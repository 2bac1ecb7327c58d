"""Resolvers of URIs to texts, for modules and documents: a caller's own, or these."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable
from urllib.parse import urlsplit

Resolver = Callable[[str], str | None]


def http(prefixes: list[str], timeout: float = 10.0, most: int = 64 << 20) -> Resolver:
    """Texts over HTTP(S) whose URI starts with one of the prefixes; anything else, and what can't be had, isn't there.

    Redirects are not followed, as they could lead beyond the prefixes.  A text over ``most`` bytes isn't taken.
    """
    for p in prefixes:
        parts = urlsplit(p)
        if parts.scheme not in ("http", "https") or not parts.netloc or not parts.path.endswith("/"):
            raise ValueError(f"{p}: a prefix has a scheme, a host and a path that ends with /")

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *a):
            return None

    def resolve(uri: str) -> str | None:
        if "/.." in uri or not any(uri.startswith(p) for p in prefixes):
            return None
        try:
            with urllib.request.build_opener(Stay).open(uri, timeout=timeout) as answer:
                raw = answer.read(most + 1)
                charset = answer.headers.get_content_charset() or "utf-8"
        except (urllib.error.URLError, OSError):
            return None
        return raw.decode(charset, "replace") if len(raw) <= most else None

    return resolve


def chain(*resolvers: Resolver | dict[str, str]) -> Resolver:
    """The first of the resolvers (or mappings) that has the URI."""

    def resolve(uri: str) -> str | None:
        for r in resolvers:
            found = r(uri) if callable(r) else r.get(uri)
            if found is not None:
                return found
        return None

    return resolve
