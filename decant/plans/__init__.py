"""Registered queries; importing this package fills the registry."""

import importlib

MODULES = ("evaluation", "stores", "texts", "cascades", "telemetry", "embeds", "building", "tokenise", "synthetic", "streams")
for _m in MODULES:
    importlib.import_module(f"decant.plans.{_m}")
