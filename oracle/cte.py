"""Named DuckDB views, combined into one WITH statement per query."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}
RECURSIVE: set[str] = set()


def view(name: str, deps: str, sql: str, recursive: bool = False) -> None:
    VIEWS[name] = (tuple(deps.split()), sql.strip())
    if recursive:
        RECURSIVE.add(name)


def build(deps: str, body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in deps.split():
        visit(n)
    if not order:
        return body.strip()
    rec = "RECURSIVE " if any(n in RECURSIVE for n in order) else ""
    parts = ",\n".join(
        f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({VIEWS[n][1]})" for n in order
    )
    return f"WITH {rec}{parts}\n{body.strip()}"
