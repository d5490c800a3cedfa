"""The subpackage's queries and their SQL, by module."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and ORACLES.
MODULES = ("secrets", "tokens", "imatch", "mixing", "pu_quality", "jaccard", "debruijn", "packing", "host_rules", "nb_toxicity")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").ORACLES.items()}
