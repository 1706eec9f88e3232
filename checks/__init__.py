"""Checked queries over the driver tables and their DuckDB oracles."""

import importlib

MODULES = ["q_contacts", "q_geo", "q_detections", "q_evaluation", "q_conditioning", "q_physics", "q_live"]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"checks.{m}")
