"""Named queries over the given tables; importing the package fills the registry."""

import importlib

from convolake.plans.registry import ENTRIES

for _family in (
    "retrieval",
    "predicates",
    "joins",
    "stats",
    "text",
    "trees",
    "context",
    "hooks",
    "paging",
    "sets",
    "merge",
    "billing",
    "access",
    "sources",
    "streams",
    "requests",
):
    importlib.import_module(f"convolake.plans.{_family}")

__all__ = ["ENTRIES"]
