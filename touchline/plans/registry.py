"""All queries of the core and their SQL."""

from __future__ import annotations

from touchline.plans import automata, cleaning, edges, inventory, pipelines, reference, reviews

FLAGSHIP = "association_state"


def queries() -> dict:
    return {**cleaning.QUERIES, **reference.QUERIES, **automata.QUERIES, **pipelines.QUERIES, **reviews.QUERIES, **inventory.QUERIES, **edges.QUERIES}


def oracles() -> dict:
    return {**cleaning.ORACLES, **reference.ORACLES, **automata.ORACLES, **pipelines.ORACLES, **reviews.ORACLES, **inventory.ORACLES, **edges.ORACLES}
