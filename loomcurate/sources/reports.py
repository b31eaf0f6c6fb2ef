"""Small reports of collected results as Markdown and HTML. The tables they take must be small by their nature."""

from __future__ import annotations

import difflib
import html
import re
from pathlib import Path

from pyspark.sql import DataFrame

ROWS = 10_000


def _rows(df: DataFrame) -> list:
    rows = df.limit(ROWS + 1).collect()
    if len(rows) > ROWS:
        raise ValueError(f"a report takes at most {ROWS} rows")
    return rows


def _cell(value: object) -> str:
    text = "" if value is None else f"{value:.3f}" if isinstance(value, float) else str(value)
    return re.sub(r"\r\n?|\n", " ", text.replace("|", r"\|"))


def markdown_table(df: DataFrame) -> str:
    """A table in the order of the rows."""
    lines = [df.columns, ["---"] * len(df.columns), *([_cell(v) for v in r] for r in _rows(df))]
    return "".join(f"| {' | '.join(line)} |\n" for line in lines)


_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif}}pre{{background:#f4f4f4;padding:8px;overflow:auto}}section{{border-top:1px solid #ccc}}</style>
<h1>{title}</h1><p>{summary}</p><label>Show <select id="kind"><option value="">all</option>{options}</select></label>{cases}
<script>document.getElementById("kind").onchange=e=>document.querySelectorAll("section").forEach(s=>s.hidden=e.target.value&&s.dataset.kind!==e.target.value)</script>
"""


def case_report(cases: DataFrame, title: str, summary: str = "") -> str:
    """An HTML page of paired cases (task_id, transition, before, after) with their differences; all data are escaped text."""
    rows = _rows(cases)
    e = lambda v: html.escape("" if v is None else str(v), quote=True)
    parts = []
    for r in rows:
        changed = "\n".join(difflib.unified_diff((r["before"] or "").splitlines(), (r["after"] or "").splitlines(), "before", "after", lineterm=""))
        parts.append(f'<section data-kind="{e(r["transition"])}"><h2>{e(r["task_id"])}: {e(r["transition"])}</h2><pre>{e(r["before"])}</pre><pre>{e(r["after"])}</pre><pre>{e(changed)}</pre></section>')
    kinds = sorted({r["transition"] for r in rows if r["transition"] is not None})
    return _PAGE.format(title=e(title), summary=e(summary), options="".join(f'<option value="{e(k)}">{e(k)}</option>' for k in kinds), cases="".join(parts))


def broken_links(root: str | Path, documents: list[str | Path]) -> list[tuple[str, str]]:
    """(document, target) of links in Markdown and HTML files to files that don't exist; web addresses and anchors aside."""
    found = []
    for name in documents:
        path = Path(root) / name
        text = path.read_text(encoding="utf-8")
        for target in re.findall(r"\]\(([^)\s]+)|(?:href|src)=[\"']([^\"']+)", text):
            link = next(filter(None, target)).partition("#")[0]
            if link and not re.match(r"[a-z][a-z0-9+.-]*:", link) and not (path.parent / link).exists():
                found.append((str(name), link))
    return found


def write_new(text: str, path: str | Path) -> None:
    """Writes a report unless it exists."""
    with open(path, "x", encoding="utf-8") as f:
        f.write(text)
