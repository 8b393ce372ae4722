"""Column names of epochs and feature vectors, and the two feature profiles."""

from __future__ import annotations

from pyspark.sql import types as T

# The published column names, in their published order.
RAW_KEYS = [
    "sog_knots", "cog_deg",
    "num_satellites", "hdop", "altitude",
    "pdop", "hdop_gsa", "vdop", "fix_mode",
    "mean_snr", "std_snr", "min_snr", "max_snr", "num_sats_with_snr",
    "sog_vtg_knots", "sog_vtg_kmh", "cog_true", "cog_magnetic",
]
DERIVED_KEYS = [
    "position_jump_m", "computed_sog_knots", "sog_discrepancy",
    "cog_change_rate", "cog_heading_discrepancy", "time_delta",
]
PAIR_KEYS = ["inter_rx_distance_m", "inter_rx_sog_diff", "inter_rx_cog_diff"]
STATS = ("mean", "std", "min", "max", "median")
LAB_ONLY_KEYS = [
    "mean_snr", "std_snr", "min_snr", "max_snr", "num_sats_with_snr",
    "pdop", "hdop_gsa", "vdop", "fix_mode",
]
META_COLUMNS = [
    "filename", "scenario", "label", "index",
    "param_1_name", "param_1_value", "param_2_name", "param_2_value",
]
FAMILY_PATTERNS = {
    "snr": ("snr",),
    "gsa": ("pdop", "vdop", "hdop_gsa", "fix_mode"),
}

PROFILES = {
    "full": RAW_KEYS,
    "deployable": [key for key in RAW_KEYS if key not in LAB_ONLY_KEYS],
}


def raw_keys(profile: str) -> list[str]:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; expected one of {sorted(PROFILES)}")
    return PROFILES[profile]


def series_keys(profile: str = "full") -> list[str]:
    return [*raw_keys(profile), *DERIVED_KEYS, *PAIR_KEYS]


def feature_names(profile: str = "full") -> list[str]:
    def block(keys):
        return [f"{key}_{stat}" for key in keys for stat in STATS]

    return [
        *block(raw_keys(profile)),
        *block(DERIVED_KEYS),
        "clock_regularity",
        *block(PAIR_KEYS),
        "n_epochs_rx1",
        "n_epochs_rx2",
    ]


def family_of(column: str) -> str | None:
    """Sensor family a column belongs to, judged by its name."""
    return next(
        (family for family, marks in FAMILY_PATTERNS.items() if any(m in column for m in marks)),
        None,
    )


def drop_families(columns: list[str], families=("snr", "gsa")) -> list[str]:
    unwanted = set(families or ())
    return [c for c in columns if family_of(c) not in unwanted]


INTEGER_FEATURES = {"n_epochs_rx1", "n_epochs_rx2"}

EPOCH_SCHEMA = T.StructType(
    [
        T.StructField("recording", T.StringType(), False),
        T.StructField("receiver", T.IntegerType(), False),
        T.StructField("utc_time", T.DoubleType(), False),
        T.StructField("lat_deg", T.DoubleType()),
        T.StructField("lon_deg", T.DoubleType()),
        *[
            T.StructField(key, T.LongType() if key == "num_sats_with_snr" else T.DoubleType())
            for key in RAW_KEYS
        ],
    ]
)
