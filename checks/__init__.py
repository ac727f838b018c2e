"""Check SQL: the telemetry views and the reports once more, as plain SQL for DuckDB."""

from __future__ import annotations

import re

from checks.reports import REPORTS
from checks.views import VIEWS


def _needed(sql: str) -> list[str]:
    """Views the text uses, with the views those use, in definition order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in VIEWS:
            if name in words and name not in found:
                found.add(name)
                todo.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


def _with_views(sql: str) -> str:
    ctes = ",\n".join(f"{name} as ({VIEWS[name]})" for name in _needed(sql))
    if not ctes:
        return sql
    body = sql.strip()
    if body.startswith("with "):
        return f"with {ctes},\n{body.removeprefix('with ')}"
    return f"with {ctes}\n{body}"


def check_sql() -> dict[str, str]:
    return {name: _with_views(sql) for name, sql in REPORTS.items()}
