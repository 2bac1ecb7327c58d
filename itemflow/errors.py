"""Errors with the codes of the XPath and XSLT standards."""

from __future__ import annotations


class EngineError(Exception):
    """``code`` is the local name of the standard's error, such as FOAR0001."""

    def __init__(self, code: str, message: str = "", value: object = None):
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.message, self.value = code, message, value


class Unsupported(Exception):
    """An expression has no column form; the caller falls back to per-document evaluation."""
