"""Markdown reports from small result tables."""

from __future__ import annotations

import os
import platform
import sys

from pyspark.sql import DataFrame

MOST_ROWS = 10_000


def cell(value: object, digits: int = 3) -> str:
    if value is None or value != value:
        return "–"
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def interval(pt: float | None, lo: float | None, hi: float | None, digits: int = 3) -> str:
    """"x [lo, hi]", what `ngram.parse_cell` reads."""
    return cell(pt, digits) if lo is None or hi is None else f"{cell(pt, digits)} [{cell(lo, digits)}, {cell(hi, digits)}]"


def table(df: DataFrame, digits: int = 3, most: int = MOST_ROWS) -> str:
    """A Markdown table of a result of at most `most` rows; a row has pt, lo and hi joined to one cell."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    joined = {"pt", "lo", "hi"} <= set(df.columns)
    names = [c for c in df.columns if not (joined and c in ("lo", "hi"))]
    out = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    for r in rows:
        out.append("| " + " | ".join(interval(r["pt"], r["lo"], r["hi"], digits) if joined and c == "pt" else cell(r[c], digits) for c in names) + " |")
    return "\n".join(out)


def report(title: str, sections: dict[str, DataFrame | str], digits: int = 3) -> str:
    parts = [f"# {title}"]
    for name, s in sections.items():
        parts += [f"## {name}", s if isinstance(s, str) else table(s, digits)]
    return "\n\n".join(parts) + "\n"


def machine_profile() -> dict[str, str]:
    """What a report says about where it was made."""
    return {"system": platform.platform(), "processor": platform.processor() or platform.machine(), "cores": str(os.cpu_count()), "python": sys.version.split()[0]}
