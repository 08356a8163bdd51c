"""Queries over the supplied tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "curation", "residues", "descriptors", "motifs", "edits", "prompts", "vectors", "novelty", "pools",
    "association", "families", "ablations", "baselines", "documents", "files",
]


def entries() -> dict:
    out = {}
    for module in MODULES:
        for name, entry in import_module(f"seqloom.catalog.{module}").ENTRIES.items():
            if name in out:
                raise ValueError(f"two queries named {name}")
            out[name] = entry
    return out
