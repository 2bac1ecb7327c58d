"""What is there, read off the registries: ``python -m itemflow.coverage`` prints it as Markdown."""

from __future__ import annotations


def functions() -> list[tuple[str, bool, bool]]:
    """(name, in columns, in documents) of every function."""
    from .functions import library as columns
    from .perdoc import library as documents
    from .perdoc.stylesheet import RUNTIME

    names = sorted({*columns.FUNCTIONS, *documents.FUNCTIONS, *RUNTIME})
    return [(n, n in columns.FUNCTIONS, n in documents.FUNCTIONS or n in RUNTIME) for n in names]


def instructions() -> list[str]:
    from .perdoc.stylesheet import SheetCompiler

    return sorted(m[2:].replace("_", "-") for m in dir(SheetCompiler) if m.startswith("i_"))


DECLARATIONS = "accumulator attribute-set character-map decimal-format function global-context-item import include key mode namespace-alias output package param preserve-space strip-space template use-package variable".split()


def report() -> str:
    from .catalog import oracle_sql, queries
    from .perdoc.evaluate import AXES
    from .perdoc.items import BASE

    q, s = queries(), oracle_sql()
    mark = lambda x: "yes" if x else "-"
    lines = ["# Coverage", "", f"{len(q)} queries besides the training-data operators, {len(s)} of them with SQL for the same rows.", ""]
    lines += ["## Functions", "", "| Function | columns | documents |", "|---|---|---|"]
    lines += [f"| `{n}` | {mark(c)} | {mark(d)} |" for n, c, d in functions()]
    lines += ["", "## Instructions", "", ", ".join(f"`xsl:{i}`" for i in instructions()), "", "## Declarations", "", ", ".join(f"`xsl:{d}`" for d in DECLARATIONS)]
    lines += ["", "## Axes", "", ", ".join(f"`{a}`" for a in AXES), "", "## Derived types", "", ", ".join(f"`xs:{t}`" for t in sorted(BASE))]
    lines += ["", "## Queries", ""] + [f"* `{n}`" + ("" if n in s else " (no SQL; see tests)") for n in q]
    return "\n".join(lines) + "\n"


if __name__ == "__main__":
    print(report(), end="")
