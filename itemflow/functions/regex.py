"""Regular expressions of the standard to Java's and Python's: the same text after a check and small rewrites."""

from __future__ import annotations

import re

from ..errors import EngineError

#: Sets of the XML Schema escapes.
_ESCAPES = {"i": r"\p{L}_:", "c": r"\p{L}\p{N}._:\-"}
_ALLOWED = set("nrt\\|.?*+(){}-[]^$pPsSiIcCdDwW0123456789")


def _walk(pattern: str, java: bool) -> str:
    out, i, in_class, depth = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 >= len(pattern):
                raise EngineError("FORX0002", pattern)
            d = pattern[i + 1]
            if d not in _ALLOWED:
                raise EngineError("FORX0002", f"\\{d} in {pattern}")
            if d in "iIcC":
                body = _ESCAPES[d.lower()]
                out.append(body if in_class and d.islower() else f"[{'^' if d.isupper() else ''}{body}]")
            elif d in "dD" and java:
                out.append(r"\p{Nd}" if d == "d" else r"\P{Nd}")
            elif d in "wW" and java:
                out.append((r"[^\p{P}\p{Z}\p{C}]" if d == "w" else r"[\p{P}\p{Z}\p{C}]") if not in_class else f"\\{d}")
            elif d in "sS":
                body = r" \t\n\r"
                out.append(body if in_class and d == "s" else f"[{'^' if d == 'S' else ''}{body}]")
            elif d in "pP" and pattern[i + 2 : i + 3] == "{":
                end = pattern.find("}", i)
                name = pattern[i + 3 : end]
                out.append(f"\\{d}{{{'In' + name[2:] if name.startswith('Is') and java else name}}}")
                i = end + 1
                continue
            else:
                out.append("\\" + d)
            i += 2
            continue
        if in_class:
            if c == "[":
                if pattern[i - 1] != "-":
                    raise EngineError("FORX0002", pattern)
                out[-1] = "&&[^"  # subtraction
                in_class += 1
                i += 2 if pattern[i + 1 : i + 2] != "^" else 2
                if pattern[i - 1] != "^":
                    i -= 1
                else:
                    out[-1] = "&&["
                continue
            if c == "]":
                in_class -= 1
            elif c == "&" and pattern[i : i + 2] == "&&":
                out.append("\\&")
                i += 1
                continue
        elif c == "[":
            in_class = 1
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            continue
        elif c == "(":
            if pattern[i + 1 : i + 2] == "?" and pattern[i + 2 : i + 3] != ":":
                raise EngineError("FORX0002", f"{pattern[i : i + 3]} in {pattern}")
            depth += 1
        elif c == ")":
            depth -= 1
        elif c in "*+}?" and pattern[i + 1 : i + 2] == "+":
            raise EngineError("FORX0002", f"possessive quantifier in {pattern}")
        out.append(c)
        i += 1
    if in_class or depth:
        raise EngineError("FORX0002", pattern)
    return "".join(out)


def _flags(flags: str) -> str:
    if set(flags) - set("smixq"):
        raise EngineError("FORX0001", flags)
    return flags


def to_java(pattern: str, flags: str = "") -> str:
    f = _flags(flags)
    if "q" in f:
        return ("(?i)" if "i" in f else "") + re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", pattern)
    if "x" in f:
        pattern = _squeeze(pattern)
    inline = "".join({"i": "iu", "s": "s", "m": "m"}.get(x, "") for x in sorted(set(f)))
    return (f"(?{inline})" if inline else "") + _walk(pattern, True)


def _squeeze(pattern: str) -> str:
    out, in_class = [], False
    for k, c in enumerate(pattern):
        escaped = k and pattern[k - 1] == "\\"
        if c == "[" and not escaped:
            in_class = True
        elif c == "]" and not escaped:
            in_class = False
        if in_class or c not in " \t\n\r":
            out.append(c)
    return "".join(out)


def to_python(pattern: str, flags: str = ""):
    """Compiled with the ``regex`` module, which knows Unicode categories."""
    import regex

    f = _flags(flags)
    how = regex.V1 | (regex.I if "i" in f else 0) | (regex.S if "s" in f else 0) | (regex.M if "m" in f else 0)
    body = regex.escape(pattern) if "q" in f else _walk(_squeeze(pattern) if "x" in f else pattern, False).replace("&&[^", "--[")
    try:
        return regex.compile(body, how)
    except regex.error as x:
        raise EngineError("FORX0002", f"{pattern}: {x}") from None


def matches_empty(java: str) -> bool:
    import regex

    try:
        return regex.compile(java.replace("(?iu", "(?i"), regex.V1).match("") is not None and regex.compile(java.replace("(?iu", "(?i"), regex.V1).fullmatch("") is not None
    except regex.error:
        return False


def groups(java: str) -> int:
    return len(re.findall(r"(?<!\\)\((?!\?)", java))


def replacement(text: str, literal: bool, n: int) -> str:
    """A replacement string for Java."""
    if literal:
        return text.replace("\\", "\\\\").replace("$", "\\$")
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            if text[i + 1 : i + 2] not in ("\\", "$") or i + 1 >= len(text):
                raise EngineError("FORX0004", text)
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == "$":
            m = re.match(r"\d+", text[i + 1 :])
            if not m:
                raise EngineError("FORX0004", text)
            digits = m[0]
            while len(digits) > 1 and int(digits) > n:
                digits = digits[:-1]
            rest = m[0][len(digits) :]
            out.append((f"${digits}" if int(digits) <= n else "") + rest)
            i += 1 + len(m[0])
            continue
        out.append(c)
        i += 1
    return "".join(out)
