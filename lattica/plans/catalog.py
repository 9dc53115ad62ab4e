"""All queries outside the llm subpackage, with their oracles."""

from __future__ import annotations

from lattica.plans import grids, meshes, models, pipelines, points


def queries():
    return {**meshes.register.queries, **points.register.queries, **grids.register.queries, **models.register.queries, **pipelines.register.queries}


def oracle_sql():
    return {**meshes.register.oracles, **points.register.oracles, **grids.register.oracles, **models.register.oracles, **pipelines.register.oracles}
