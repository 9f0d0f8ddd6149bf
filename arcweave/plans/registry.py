"""All registered queries of the engine and their DuckDB twins."""

from __future__ import annotations

from importlib import import_module

from ..model import ESSENCE, angle, concepts, r
from ..operators import claims, exchange, markers, models, placement, search
from ..streaming import runlog
from .dialect import DUCK

MODULES = ("dictionary", "rules", "replies", "claims", "curation", "statistics", "inference")

#: Queries that are DataFrame programs: (ids, function, DuckDB twin or None).
NATIVE = {
    "knn_angle_7d": (
        "TOP-01 GEO-04 JOIN-07",
        search.knn_angle_7d,
        f"""WITH {concepts(DUCK)}, p AS (SELECT q.id AS query_id, c.id, {angle('q.', 'c.', ESSENCE, '90e0')} AS t FROM concepts q JOIN concepts c ON q.id <> c.id),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(t, 9), id) AS INTEGER) AS place FROM p)
        SELECT query_id, place, id, {r('t', 4)} AS angle FROM k WHERE place <= 10""",
    ),
    "stream_final_records": ("STR-01 STR-02 SNK-06", runlog.stream_final_records, runlog.ORACLE),
    "stream_window_rates": ("STR-01", runlog.stream_window_rates, runlog.RATES_ORACLE),
    "self_claim_sentences": ("MCH-01 MCH-02 MCH-03 MCH-04 TXT-07", markers.self_claim_sentences, markers.oracle({**claims.PROFILE, **claims.OVERRIDES})),
    "placed_cores": ("CUR-15", placement.placed_cores, None),
    **exchange.QUERIES,
    **models.QUERIES,
}


def _all():
    return [q for m in MODULES for q in import_module(f"arcweave.operators.{m}").QUERIES]


def queries() -> dict:
    return {**{n: f for n, (_, f, _) in NATIVE.items()}, **{q.name: q.run for q in _all()}}


def oracles() -> dict:
    return {**{n: sql for n, (_, _, sql) in NATIVE.items() if sql}, **{q.name: q.oracle() for q in _all()}}


def operators() -> dict[str, str]:
    """Inventory ids by query."""
    return {**{n: ids for n, (ids, _, _) in NATIVE.items()}, **{q.name: q.ids for q in _all()}}
