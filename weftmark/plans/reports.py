"""Reports over findings, written on the driver: JSON, text, Markdown and HTML. A report is of one corpus' findings, and small."""

from __future__ import annotations

import html
import json
from datetime import UTC, datetime
from itertools import groupby

from pyspark.sql import DataFrame

from weftmark.plans import findings


def _rows(found: DataFrame) -> list:
    order = found.orderBy(findings.rank("severity"), "category", "title")
    return list(order.toLocalIterator())


def as_json(found: DataFrame) -> str:
    """{total, files, categories: [{name, severity, count, findings}]}"""
    rows = _rows(found)
    files = {x.file for r in rows for x in r.locations if x.file}
    out = []
    for (severity, name), own in groupby(rows, key=lambda r: (r.severity, r.category)):
        listed = [{"title": r.title, "suggestion": r.suggestion, "snippet": r.snippet, "auto_fix": r.auto_fix, "locations": [x.asDict() for x in r.locations], "details": findings.multimap([(d.label, d.value) for d in r.details])} for r in own]
        out.append({"name": name, "severity": severity, "count": len(listed), "findings": listed})
    return json.dumps({"total": len(rows), "files": len(files), "categories": out}, ensure_ascii=False, indent=2)


def as_text(found: DataFrame, shown: int = 10) -> str:
    rows, out = _rows(found), []
    for (severity, name), own in groupby(rows, key=lambda r: (r.severity, r.category)):
        listed = list(own)
        out.append(f"{name}: {len(listed)} {'finding' if len(listed) == 1 else 'findings'} ({severity})")
        for r in listed:
            out.append(f"  {r.title}")
            out += [f"    {x.file}{f':{x.line}' if x.line else ''}" for x in r.locations[:shown]]
            out += [f"    and {len(r.locations) - shown} more"] if len(r.locations) > shown else []
    return "\n".join(out) + "\n" if out else "No findings.\n"


def as_markdown(found: DataFrame, now: datetime | None = None) -> tuple[str, str]:
    """(file name, text) of a checklist by file and category."""
    stamp = (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")
    items = sorted(((x.file or "(no file)", r.category, x.line or 0, r.title, r.suggestion) for r in _rows(found) for x in (r.locations or [None]) if x is not None))
    out = [f"# Suggestions {stamp}", "", f"{len(items)} items in {len({i[0] for i in items})} files"]
    for file, own in groupby(items, key=lambda i: i[0]):
        out += ["", f"## {file}"]
        for category, each in groupby(own, key=lambda i: i[1]):
            out += ["", f"### {category}", *(f"- [ ] line {line}: {title} ({hint})" for _, _, line, title, hint in each)]
    return f"suggestions-{stamp}.md", "\n".join(out) + "\n"


def as_html(found: DataFrame, title: str = "Audit", shown: int = 8) -> str:
    """A page of its own with a text filter and a switch for each severity; everything is escaped."""
    rows = _rows(found)
    body = []
    for r in rows:
        places = [html.escape(f"{x.file}:{x.line}" if x.line else str(x.file)) for x in r.locations]
        rest = f"<details><summary>{len(places) - shown} more</summary>{'<br>'.join(places[shown:])}</details>" if len(places) > shown else ""
        body.append(f'<article data-severity="{r.severity}"><b>{html.escape(r.category)}</b> {html.escape(r.title)}<p>{html.escape(r.suggestion or "")}</p>{"<br>".join(places[:shown])}{rest}</article>')
    toggles = "".join(f'<label><input type="checkbox" checked value="{s}"> {s} ({sum(r.severity == s for r in rows)})</label> ' for s in findings.SEVERITIES)
    script = "const q=document.querySelector('#q'),b=[...document.querySelectorAll('[type=checkbox]')];function f(){const on=new Set(b.filter(x=>x.checked).map(x=>x.value)),t=q.value.toLowerCase();document.querySelectorAll('article').forEach(a=>a.hidden=!on.has(a.dataset.severity)||!a.textContent.toLowerCase().includes(t))}q.oninput=f;b.forEach(x=>x.onchange=f)"
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><input id="q" placeholder="filter"> {toggles}{"".join(body)}<script>{script}</script>\n'
