"""Registries of methods: one JSON object {method: {params, tuning_grid, nested_params, tag_param, ...}}.

A section that is absent is None (grids and nesting: empty); one of another shape raises a ValueError that names the
file, the method and the section. Values of hyper-parameters are checked by the methods themselves.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

#: Sections that only make sense for methods with random starts (fixed values).
CONSENSUS_METHODS = ("kmeans", "gmm", "spectral")
STABILITY_METHODS = ("kmeans", "gmm")


class BadEntry(ValueError):
    """An entry of the registry has another shape than it should."""


@dataclass(frozen=True)
class MethodEntry:
    """What a registry says of one method."""

    method: str
    params: Mapping[str, object]
    grid: Mapping[str, list] = field(default_factory=dict)
    nested: tuple[str, ...] = ()
    tags: tuple[tuple[str, str], ...] = ()
    omit: Mapping[str, object] = field(default_factory=dict)
    consensus: Mapping | None = None
    stability: Mapping | None = None

    def tag(self, values: Mapping[str, object] | None = None) -> str | None:
        """prefix and value of each tagged parameter, joined by _; without tags None, and all of them omitted raises."""
        if not self.tags:
            return None
        values = {**self.params, **(values or {})}
        said = [f"{prefix}{values[name]}" for name, prefix in self.tags if name not in self.omit or values[name] != self.omit[name]]
        if not said:
            raise BadEntry(f"{self.method}: the tag is empty, all its parts are omitted")
        return "_".join(said)

    def free(self) -> list[str]:
        """Axes of the grid that are swept jointly."""
        return [name for name in self.grid if name not in self.nested]


def _whole(v: object) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and v >= 1


def _names(v: object) -> bool:
    return isinstance(v, list) and all(isinstance(x, str) for x in v) and len(set(v)) == len(v)


def _axis(v: object) -> bool:
    return isinstance(v, list) and bool(v) and not any(isinstance(x, list | dict) for x in v) and len({json.dumps(x) for x in v}) == len(v)


def _repeats(v: object) -> bool:
    return isinstance(v, dict) and _whole(v.get("n_repeats"))


def _fraction(v: object) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool) and 0 < v < 1


def read_method(path: str | Path, method: str) -> MethodEntry:
    """The checked entry of one method. A missing file raises FileNotFoundError."""
    registry = json.loads(Path(path).read_text(encoding="utf-8"))

    def need(ok: bool, section: str, what: str) -> None:
        if not ok:
            raise BadEntry(f"{path}: {method}.{section}: {what}")

    if not isinstance(registry, dict):
        raise BadEntry(f"{path}: not a JSON object")
    entry = registry.get(method)
    if not isinstance(entry, dict):
        raise BadEntry(f"{path}: no object for method {method!r}, there are {sorted(registry)}")
    params, grid = entry.get("params"), entry.get("tuning_grid", {})
    need(isinstance(params, dict), "params", "not an object")
    need(isinstance(grid, dict) and ("tuning_grid" not in entry or bool(grid)), "tuning_grid", "not an object with an axis")
    for name, values in grid.items():
        need(_axis(values), f"tuning_grid.{name}", "not a list of plain, different values")
    names, prefixes, omit = entry.get("tag_param", []), entry.get("tag_prefix", []), entry.get("tag_omit", {})
    need(_names(names), "tag_param", "not a list of different names")
    need(isinstance(prefixes, list) and all(isinstance(p, str) for p in prefixes) and len(prefixes) == len(names), "tag_prefix", "not a text for each tag_param")
    need(set(names) <= set(params), "tag_param", f"not in params: {sorted(set(names) - set(params))}")
    need(isinstance(omit, dict) and set(omit) <= set(names), "tag_omit", "not an object of tagged parameters")
    nested = entry.get("nested_params", [])
    need(_names(nested) and set(nested) <= set(grid), "nested_params", "not a list of different axes of the grid")
    need(not nested or len(grid) - len(nested) in (1, 2), "nested_params", "must leave one or two axes free")
    consensus, stability = entry.get("consensus"), entry.get("stability")
    if "consensus" in entry:
        need(method in CONSENSUS_METHODS, "consensus", f"only for {CONSENSUS_METHODS}")
        need(isinstance(consensus, dict) and bool(consensus) and set(consensus) <= {"rsc", "monti"}, "consensus", "not an object of rsc and monti")
        for part, block in consensus.items():
            need(_repeats(block), f"consensus.{part}", "n_repeats is not a whole number from 1")
        need("monti" not in consensus or _fraction(consensus["monti"].get("subsample_fraction")), "consensus.monti", "subsample_fraction is not between 0 and 1")
    if "stability" in entry:
        need(method in STABILITY_METHODS, "stability", f"only for {STABILITY_METHODS}")
        need(_repeats(stability) and set(stability) == {"nuisance_values", "n_init_range", "n_repeats"}, "stability", "not nuisance_values, n_init_range and n_repeats from 1")
        need(_names(stability["nuisance_values"]) and bool(stability["nuisance_values"]), "stability.nuisance_values", "not a list of different names")
        starts = stability["n_init_range"]
        need(isinstance(starts, list) and bool(starts) and all(map(_whole, starts)), "stability.n_init_range", "not a list of whole numbers from 1")
    made = MethodEntry(method, params, grid, tuple(nested), tuple(zip(names, prefixes, strict=True)), omit, consensus, stability)
    made.tag()
    return made
