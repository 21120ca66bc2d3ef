"""All registered queries: name -> (spark_fn, oracle SQL or None)."""

from __future__ import annotations

from sievekit.plans import catalog_extract, catalog_group, catalog_job, catalog_profile, catalog_query, catalog_registry, catalog_results, catalog_store, catalog_tree, catalog_version

CATALOGS = [catalog_extract.CATALOG, catalog_profile.CATALOG, catalog_version.CATALOG, catalog_group.CATALOG, catalog_query.CATALOG,
            catalog_store.CATALOG, catalog_tree.CATALOG, catalog_registry.CATALOG, catalog_job.CATALOG, catalog_results.CATALOG]


def all_entries() -> dict:
    out: dict = {}
    for cat in CATALOGS:
        for name, entry in cat.items():
            if name in out:
                raise ValueError(f"duplicate query name {name}")
            out[name] = entry
    return out
