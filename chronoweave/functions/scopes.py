"""Scope paths (``type:id/type:id/...``) and the views over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefixes(scope: Column | str) -> Column:
    """All prefixes of a scope path, the path itself last. Null for a null scope."""
    parts = F.split(scope, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def prefix_list(scope: str) -> list[str]:
    parts = scope.split("/")
    return ["/".join(parts[:n]) for n in range(1, len(parts) + 1)]


def parent(scope: Column | str) -> Column:
    """The path without its last part, null at the root."""
    up = F.regexp_replace(scope, "/[^/]*$", "")
    return F.when(up != (F.col(scope) if isinstance(scope, str) else scope), up)


def in_view(column: str, scope: str, view: str = "local") -> Column:
    """Whether a row's scope is seen from ``scope``. local (and any unknown view): only itself; holistic: itself and
    what lies above; descend: itself and what lies below. All are simple predicates that reach the scan."""
    if view == "holistic":
        return F.col(column).isin(*prefix_list(scope))
    if view == "descend":
        return (F.col(column) == scope) | F.col(column).startswith(scope + "/")
    return F.col(column) == scope
