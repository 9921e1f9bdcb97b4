"""Registered queries: each pairs a Spark callable with the SQL that checks it."""

import importlib

QUERIES, ORACLES = {}, {}
MODULES = ["sources", "filters", "joins", "aggregates", "ranking", "reshape", "nulls", "fits", "composites", "streams"]


def query(name, sql=None):
    """Register ``fn(views) -> DataFrame`` under ``name``."""
    def deco(fn):
        from netloom.catalog.standins import Views, expand

        def run(spark, sf_dir):
            return fn(Views(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = expand(sql)
        return fn
    return deco


def load():
    for m in MODULES:
        importlib.import_module(f"netloom.catalog.{m}")
    return QUERIES, ORACLES
