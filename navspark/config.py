"""Settings of the programs: defaults, a YAML or JSON file, dotted overrides."""

from __future__ import annotations

import copy
import json
import os
from typing import Any

# The published defaults.
DEFAULTS: dict[str, Any] = {
    "paths": {
        "dataset_dir": "dataset/dataset",
        "epochs_dir": "results/epochs",
        "features": "data/features",
        "baseline_predictions": "data/baseline_predictions.csv",
        "baseline_column": "baseline_pred",
        "results_dir": "results/detectors",
        "real_data_dir": "data/real_nmea",
    },
    "receivers": {"rx1": ["192.168.0.10", 62996], "rx2": ["192.168.0.11", 62997]},
    "extraction": {"save_epoch_series": True, "validate_checksums": False},
    "features": {"profile": "full", "format": "parquet"},
    "preprocessing": {
        "ablate_families": ["snr", "gsa"],
        "zero_variance_eps": 1.0e-10,
        "nan_col_drop_threshold": 0.5,
        "skew_threshold": 5.0,
        "winsorize": True,
        "winsorize_quantiles": [0.01, 0.99],
        "correlation_threshold": 0.95,
    },
    "split": {"regime": "repetition", "kfold_n": 5, "param_holdout_preset": "a3_speed_low"},
    "models": {
        "tier": "default",
        "svm": {"enabled": True, "train_on_full_set": True, "subsample_size": 10000},
        "trees": 500,
        "rounds": 500,
        "max_depth": None,
        "seed": 42,
    },
    "thresholds": {"enabled": True, "val_fraction": 0.25, "target_fprs": [0.01, 0.05]},
    "real_data": {"window_s": 120, "stride_s": 60, "min_epochs": 60},
}


class Settings(dict):
    """Nested mapping with attribute access."""

    def __getattr__(self, key: str):
        if key not in self:
            raise AttributeError(key)
        value = self[key]
        return Settings(value) if isinstance(value, dict) else value


def _merge(base: dict, extra: dict) -> dict:
    for key, value in extra.items():
        if isinstance(value, dict) and isinstance(base.get(key), dict):
            _merge(base[key], value)
        else:
            base[key] = value
    return base


def load_settings(path: str | None = None, overrides: dict[str, Any] | None = None) -> Settings:
    """Defaults, then the file, then ``{"section.key": value}``; ``None`` overrides nothing."""
    settings = copy.deepcopy(DEFAULTS)
    if path:
        with open(path) as handle:
            if os.path.splitext(path)[1] == ".json":
                loaded = json.load(handle)
            else:
                import yaml

                loaded = yaml.safe_load(handle)
        _merge(settings, loaded or {})
    for dotted, value in (overrides or {}).items():
        if value is not None:
            *sections, key = dotted.split(".")
            node = settings
            for section in sections:
                node = node.setdefault(section, {})
            node[key] = value
    return Settings(settings)
