"""Registered queries: each binds an operator to the given tables and states the same result as DuckDB SQL."""

from bindings.registry import REGISTRY  # noqa: F401
from bindings import explore, ingest, loads, modelling, star, transforms, reports  # noqa: F401,E401
