"""Parameters of one analysis."""

from __future__ import annotations

import json
from collections.abc import Mapping
from copy import deepcopy
from dataclasses import asdict, dataclass, field
from typing import Any

# The published sections and options of a configuration file, and the fields below that they set.
SECTIONS = {
    "io": {"input_data_path": "input_path"},
    "columns": {
        "grouping_column": "grouping",
        "filter_values": "groups",
        "categorical": "categorical",
        "continuous_to_analyze": "continuous",
        "continuous_units_map": "units",
        "value_mapping": "value_names",
        "column_name_mapping": "column_names",
    },
    "preprocessing": {
        "min_combination_size_input": "min_combination_size",
        "quantization_n_classes_input": "n_bins",
    },
    "clustering": {
        "clustering_min_k": "min_k",
        "clustering_max_k": "max_k",
        "percent_drop_threshold_input": "max_drop_percent",
    },
    "hdr_analysis": {"hdr_threshold_percentage": "hdr_excluded_percent"},
    "visualization": {"x_axis_label": "x_axis_label", "quantized_axis_label": "bin_axis_label"},
}


@dataclass(frozen=True)
class AnalysisSpec:
    """Column roles and options of one analysis."""

    name: str = "analysis"
    input_path: str | None = None
    grouping: str | None = None
    groups: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    continuous: list[str] = field(default_factory=list)
    units: dict[str, str] = field(default_factory=dict)
    value_names: dict[str, dict[str, str]] = field(default_factory=dict)
    column_names: dict[str, str] = field(default_factory=dict)
    min_combination_size: int | str = "auto-knee"
    n_bins: int | str = "auto"
    min_k: int = 2
    max_k: int = 10
    max_drop_percent: float = 5.0
    hdr_excluded_percent: float = 90.0
    x_axis_label: str = "Value"
    bin_axis_label: str = "Bin"

    @classmethod
    def from_config(cls, config: Mapping[str, Any], name: str = "analysis") -> AnalysisSpec:
        """Build from a sectioned configuration; an unknown option is an error."""
        values: dict[str, Any] = {"name": name}
        for section, options in config.items():
            known = SECTIONS.get(section, {})
            for option, value in (options or {}).items():
                if option not in known:
                    raise ValueError(f"Unknown option '{section}.{option}'.")
                if value is not None:
                    values[known[option]] = value
        return cls(**values)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> AnalysisSpec:
        return cls(**json.loads(text))


def merged(base: Mapping[str, Any], override: Mapping[str, Any] | None) -> dict[str, Any]:
    """``override`` laid over ``base``, section by section."""
    out = deepcopy(dict(base))
    for key, value in (override or {}).items():
        both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = merged(out[key], value) if both else deepcopy(value)
    return out


def load_config(path: str) -> dict[str, Any]:
    """Read a JSON or YAML configuration; an empty file is an empty configuration."""
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    try:
        if path.lower().endswith(".json"):
            return json.loads(text) if text.strip() else {}
        try:
            import yaml
        except ImportError as exc:
            raise RuntimeError("Reading YAML needs the yaml module; use JSON instead.") from exc
        try:
            return yaml.safe_load(text) or {}
        except yaml.YAMLError as exc:
            raise ValueError(f"Invalid YAML in {path}") from exc
    except json.JSONDecodeError as exc:
        raise ValueError(f"Invalid JSON in {path}") from exc


def specs_from_config(config: Mapping[str, Any]) -> list[AnalysisSpec]:
    """The active analyses of a configuration, in the listed order.

    Names without a block are skipped; each block lies over the common settings.
    """
    active = config.get("active_config_names")
    if not active or not isinstance(active, list):
        raise ValueError("'active_config_names' has to list the analyses to run.")
    common = config.get("common_settings") or {}
    return [AnalysisSpec.from_config(merged(common, config[n]), n) for n in active if config.get(n)]
