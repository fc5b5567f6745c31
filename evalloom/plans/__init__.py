"""Registered queries: each runs an operator over whole given tables, with SQL to check it."""

from importlib import import_module

MODULES = (
    "foundations", "tables", "texts", "builders", "joining", "grades", "measures", "rubric_docs", "id_sequences", "letter_eval", "streams",
)


def all_queries() -> dict:
    found = {}
    for module in MODULES:
        for name, item in import_module(f"evalloom.plans.{module}").QUERIES.items():
            if name in found:
                raise ValueError(f"query {name!r} registered twice")
            found[name] = item
    return found
