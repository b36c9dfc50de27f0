"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from revlens.plans import inputs, review

for _name in ("findings", "packages", "packing", "evaluation", "diffs", "texts", "states", "context", "comments", "forge"):
    import_module(f"revlens.plans.{_name}")

QUERIES = review.QUERIES | inputs.QUERIES
SQL = review.SQL | inputs.SQL
