"""Registered queries over the driver tables, one or more per operator."""

from pageknow.plans import assistant, knowledge, pages, retrieval, workflow

AREAS = (retrieval, pages, knowledge, workflow, assistant)
QUERIES = {name: q for area in AREAS for name, q in area.QUERIES.items()}
