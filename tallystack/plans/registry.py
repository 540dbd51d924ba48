"""name -> (spark builder(spark, sf_dir) -> DataFrame, oracle SQL or None)."""

from __future__ import annotations

REGISTRY: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict:
    # importing the modules fills the registry
    from tallystack.plans import (q_sources, q_extract, q_clean, q_relate,  # noqa: F401
                                  q_features, q_profile, q_prep, q_evaluate, q_models)
    return REGISTRY
