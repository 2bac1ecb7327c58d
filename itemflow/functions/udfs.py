"""The functions that need Python, as Arrow-batched column functions; each has the plain Python form beside it."""

from __future__ import annotations

import datetime
import email.utils
import unicodedata
import urllib.parse

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import pictures


def encode_uri(s: str) -> str:
    return urllib.parse.quote(s, safe="-_.~")


def iri(s: str) -> str:
    return "".join(c if 0x21 <= ord(c) < 0x7F and c not in '<>"{}|\\^`' else urllib.parse.quote(c, safe="") for c in s)


def html_uri(s: str) -> str:
    return "".join(c if 0x20 <= ord(c) < 0x7F else urllib.parse.quote(c, safe="") for c in s)


def normalized(s: str, form: str) -> str:
    form = form.strip().upper()
    return s if not form else unicodedata.normalize(form, s)


def collation_key(s: str, name: str) -> str:
    """Text that compares as a UCA collation of ``name`` does, as far as strength and case go."""
    options = dict(p.split("=", 1) for p in name.partition("?")[2].replace("&", ";").split(";") if "=" in p)
    strength = options.get("strength", "tertiary")
    base = unicodedata.normalize("NFD", s)
    letters = "".join(c for c in base if not unicodedata.combining(c)).casefold()
    if options.get("numeric") == "yes":
        import re

        letters = re.sub(r"\d+", lambda m: f"{int(m[0]):020d}", letters)
    if strength in ("primary", "1"):
        return letters
    if strength in ("secondary", "2"):
        return letters + "\0" + base.casefold()
    upper = options.get("caseFirst") == "upper"
    case = "".join(("0" if c.isupper() == upper else "1") if c.isalpha() else "0" for c in base)
    return letters + "\0" + base.casefold() + "\0" + case


def resolved(relative: str | None, base: str) -> str | None:
    if relative is None:
        return None
    return urllib.parse.urljoin(base, relative) if base else relative


def ietf(s: str | None) -> str | None:
    """The ISO form of an IETF date, with its zone (GMT where it says none)."""
    if not s or not s.strip():
        return None
    found = email.utils.parsedate_to_datetime(s.strip())
    found = found if found.tzinfo else found.replace(tzinfo=datetime.UTC)
    return found.isoformat().replace("+00:00", "Z")


@F.pandas_udf(StringType())
def python_encode_for_uri(c: pd.Series) -> pd.Series:
    return c.map(encode_uri)


@F.pandas_udf(StringType())
def python_iri_to_uri(c: pd.Series) -> pd.Series:
    return c.map(iri)


@F.pandas_udf(StringType())
def python_escape_html_uri(c: pd.Series) -> pd.Series:
    return c.map(html_uri)


@F.pandas_udf(StringType())
def python_normalize_unicode(c: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([normalized(a, f) for a, f in zip(c, form, strict=True)])


@F.pandas_udf(StringType())
def python_collation_text(c: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([collation_key(a, n) for a, n in zip(c, name, strict=True)])


def keyed_by(key):
    """The column of a caller's collation key."""

    def python_key(c: pd.Series) -> pd.Series:
        return c.map(key, na_action="ignore")

    python_key.__annotations__ = {"c": pd.Series, "return": pd.Series}
    return F.pandas_udf(python_key, StringType())


@F.pandas_udf(StringType())
def python_resolve_uri(c: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolved(a, x) for a, x in zip(c, base, strict=True)])


@F.pandas_udf(StringType())
def python_parse_ietf_date(c: pd.Series) -> pd.Series:
    return c.map(ietf)


@F.pandas_udf(StringType())
def python_format_datetime(c: pd.Series, picture: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else pictures.format_stamp(a, p, x) for a, p, x in zip(c, picture, lang, strict=True)])


@F.pandas_udf(StringType())
def python_format_number(c: pd.Series, picture: pd.Series) -> pd.Series:
    return pd.Series([pictures.format_number(a, p) for a, p in zip(c, picture, strict=True)])


@F.pandas_udf(StringType())
def python_format_integer(c: pd.Series, picture: pd.Series) -> pd.Series:
    return pd.Series(["" if pd.isna(a) else pictures.format_integer(int(a), p) for a, p in zip(c, picture, strict=True)])


# the functions have names by which a column that holds one is known: Spark takes none into a lambda (``values.let``)
encode_for_uri = python_encode_for_uri
iri_to_uri = python_iri_to_uri
escape_html_uri = python_escape_html_uri
normalize_unicode = python_normalize_unicode
collation_text = python_collation_text
resolve_uri = python_resolve_uri
parse_ietf_date = python_parse_ietf_date
format_datetime = python_format_datetime
format_number = python_format_number
format_integer = python_format_integer
