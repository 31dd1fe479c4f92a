"""The same queries as DuckDB SQL."""

from pageknow.plans.queries import AREAS

ORACLES = {name: sql for area in AREAS for name, sql in area.ORACLES.items()}
