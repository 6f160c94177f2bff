"""Reports of one-row tables of measures, as JSON, text and Markdown."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame


def measures(df: DataFrame) -> dict[str, float]:
    """The one row of a table of measures."""
    row = df.limit(2).collect()
    if len(row) != 1:
        raise ValueError(f"a report is of one row, not of {len(row)}")
    return row[0].asDict()


def text(named: dict[str, dict[str, float]]) -> str:
    """Aligned lines under each name."""
    lines = []
    for name, values in named.items():
        lines += [name, *(f"  {k:<24}{v:>14.4f}" if isinstance(v, float) else f"  {k:<24}{v!s:>14}" for k, v in values.items())]
    return "\n".join(lines) + "\n"


def markdown(title: str, named: dict[str, dict[str, float]]) -> str:
    """A table with a column per name."""
    keys = list(dict.fromkeys(k for values in named.values() for k in values))
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    rows = ["| measure | " + " | ".join(named) + " |", "|-" * (len(named) + 1) + "|"]
    rows += [f"| {k} | " + " | ".join(cell(values.get(k)) for values in named.values()) + " |" for k in keys]
    return f"# {title}\n\n" + "\n".join(rows) + "\n"


def write(folder: str, title: str, tables: dict[str, DataFrame]) -> None:
    """report.json, report.txt and report.md in a folder of the driver."""
    named = {name: measures(df) for name, df in tables.items()}
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    (target / "report.json").write_text(json.dumps(named, indent=2))
    (target / "report.txt").write_text(text(named))
    (target / "report.md").write_text(markdown(title, named))
