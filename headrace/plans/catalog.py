"""All registered queries, gathered from the family modules."""

from __future__ import annotations

from . import q_calibration, q_cleaning, q_features, q_metrics, q_models, q_naming, q_outage

QUERIES: dict = {}
ORACLE: dict = {}
for _m in (q_cleaning, q_features, q_naming, q_calibration, q_outage, q_metrics, q_models):
    QUERIES.update(_m.REG.queries)
    ORACLE.update(_m.REG.sql)
