"""One registered query per operator, with the SQL that states the same answer."""

from folioframe.queries import audit, geometry, intake, layout, readings, semantics, structure, templates

ALL = [readings, geometry, layout, audit, semantics, structure, templates, intake]


def queries():
    return {name: q for module in ALL for name, q in module.CATALOGUE.queries.items()}


def oracle_sql():
    return {name: q for module in ALL for name, q in module.CATALOGUE.oracles.items()}
