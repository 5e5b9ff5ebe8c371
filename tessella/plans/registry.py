"""Every registered query of the catalog engine, with its oracle SQL where SQL can express it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, oracle: str | None = None):
    """Register the decorated ``(spark, sf_dir) -> DataFrame`` function under a name."""

    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add
