"""Registered queries over the provided tables, with SQL oracles."""

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = [
    "q_advantages",
    "q_correction",
    "q_losses",
    "q_metrics",
    "q_batches",
    "q_rewards",
    "q_behaviour",
    "q_datasets",
    "q_retrieval",
]


def load_all():
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
