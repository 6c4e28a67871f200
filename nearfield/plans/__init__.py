"""The registered queries and, where SQL can say the same, their SQL counterparts."""

from nearfield.plans import files, keyword, metrics, vectors

_MODULES = (vectors, keyword, files, metrics)


def all_queries() -> dict:
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
