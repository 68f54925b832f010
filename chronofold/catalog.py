"""All registered queries of the engine and their SQL."""

from __future__ import annotations

import importlib

#: Modules of ``chronofold.plans`` with a QUERIES list of (name, query, SQL or None).
MODULES = ["time", "relational", "evaluation", "texts", "retrieval", "inputs", "flows", "labelling", "plugged"]

#: Operators that share a query with another one: the same rows show both.
SHARED = {
    "sink_jsonl": "sink_json",
    "guard_domain": "audit_rules",
    "fn_canonical": "fn_legal_name",
    "fn_last_completed_quarter": "fn_quarter_label",
    "fn_md5_id": "fn_sha_id",
    "fn_expit": "fn_logit_clip",
    "fn_bounded_score": "fn_logit_clip",
    "win_drawdown": "win_cumprod",
    "topk_vector": "ret_vector",
    "ml_scale_robust": "ml_scale",
    "ml_scale_standard": "ml_scale",
}


def _entries():
    for name in MODULES:
        yield from importlib.import_module(f"chronofold.plans.{name}").QUERIES


def queries() -> dict:
    own = {name: query for name, query, _ in _entries()}
    return own | {name: own[other] for name, other in SHARED.items()}


def oracle_sql() -> dict:
    own = {name: sql for name, _, sql in _entries() if sql}
    return own | {name: own[other] for name, other in SHARED.items() if other in own}
