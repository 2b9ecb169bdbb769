"""Sources, tasks and feature protocols as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field

from panelspan.functions.timeutil import duration_steps

PITCH_RULE = (-10.0, 95.0)


@dataclass(frozen=True)
class SourceSpec:
    dataset_id: str
    entities: tuple[str, ...]
    target: str
    time_convention: str
    resolution_minutes: int = 10
    columns: dict[str, object] = field(default_factory=dict)


# fixed values: registered sources, their entities, targets and native column names
_BANNER_COLUMNS = {
    "speed": "Wind speed (m/s)",
    "ambient": "Nacelle ambient temperature (°C)",
    "internal": "Nacelle temperature (°C)",
    "generator": "Generator RPM (RPM)",
    "rotor": "Rotor speed (RPM)",
    "pitch": ("Blade angle (pitch position) A (°)", "Blade angle (pitch position) B (°)", "Blade angle (pitch position) C (°)"),
    "direction": "Wind direction (°)",
    "nacelle": "Nacelle position (°)",
}
SOURCES = {
    d.dataset_id: d
    for d in (
        SourceSpec("kelmarsh", tuple(f"Kelmarsh {i}" for i in range(1, 7)), "Power (kW)", "source_utc_naive", columns=_BANNER_COLUMNS),
        SourceSpec("penmanshiel", tuple(f"Penmanshiel {i:02d}" for i in range(1, 16) if i != 3), "Power (kW)", "source_utc_naive", columns=_BANNER_COLUMNS),
        SourceSpec(
            "hill_of_towie", tuple(f"T{i:02d}" for i in range(1, 22)), "wtc_ActPower_mean", "source_utc_naive_interval_end",
            columns={
                "speed": "wtc_AcWindSp_mean", "ambient": "tur_temp__wtc_ambietmp_mean", "internal": "tur_temp__wtc_naceltmp_mean", "generator": "wtc_GenRpm_mean",
                "rotor": "wtc_MainSRpm_mean", "pitch": ("wtc_PitcPosA_mean", "wtc_PitcPosB_mean", "wtc_PitcPosC_mean"), "direction": "wtc_ActualWindDirection_mean", "nacelle": "wtc_YawPos_mean",
            },
        ),
        SourceSpec(
            "sdwpf_kddcup", tuple(str(i) for i in range(1, 135)), "Patv", "derived_day_clock_naive",
            columns={"speed": "Wspd", "ambient": "Etmp", "internal": "Itmp", "pitch": ("Pab1", "Pab2", "Pab3"), "nacelle": "Ndir", "relative": "Wdir"},
        ),
    )
}


def dataset(dataset_id: str) -> SourceSpec:
    try:
        return SOURCES[dataset_id]
    except KeyError:
        raise ValueError(f"unknown dataset {dataset_id!r}; known: {', '.join(sorted(SOURCES))}") from None


@dataclass(frozen=True)
class TaskSpec:
    history: str
    forecast: str
    stride: str = ""
    mode: str = "farm"

    @property
    def task_id(self) -> str:
        return f"{self.mode}_{self.history}_to_{self.forecast}"

    def steps(self, minutes: int) -> tuple[int, int, int]:
        return duration_steps(self.history, minutes), duration_steps(self.forecast, minutes), duration_steps(self.stride, minutes) if self.stride else 1


# fixed values: protocol names, and the value columns of each by role, in order; roles are resolved by protocols.role_columns
PROTOCOLS = {
    "power_only": (),
    "power_ws_hist": ("speed",),
    "power_atemp_hist": ("ambient",),
    "power_itemp_hist": ("internal",),
    "power_wd_hist_sincos": ("wd_sin", "wd_cos"),
    "power_ws_wd_hist_sincos": ("speed", "wd_sin", "wd_cos"),
    "power_wd_yaw_hist_sincos": ("wd_sin", "wd_cos", "yaw_sin", "yaw_cos"),
    "power_wd_yaw_pitchmean_hist_sincos": ("wd_sin", "wd_cos", "yaw_sin", "yaw_cos", "pitch_mean"),
    "power_wd_yaw_pmean_hist_sincos_masked": ("wd_sin", "wd_cos", "yaw_sin", "yaw_cos", "pitch_mean"),
    "power_wd_yaw_lrpm_hist_sincos": ("wd_sin", "wd_cos", "yaw_sin", "yaw_cos", "rotor"),
    "world_model_v1": ("speed", "wd_sin", "wd_cos", "yaw_sin", "yaw_cos", "pitch_mean", "rotor", "generator", "ambient", "internal"),
}
MASKED = ("power_wd_yaw_pmean_hist_sincos_masked", "world_model_v1")
#: Sources that masked protocols are defined for (fixed values).
MASKED_SOURCES = ("kelmarsh", "penmanshiel")

# fixed values: the column groups that a protocol has beside its values by role. Names of columns, in order
_EVENT_SUMMARY = ("evt_any_active", "evt_active_count", "evt_total_overlap_seconds", "evt_stop_active", "evt_warning_active", "evt_informational_active")
_FARM_METERS = ("farm_pmu__gms_current_a", "farm_pmu__gms_power_kw", "farm_pmu__gms_reactive_power_kvar")


@dataclass(frozen=True)
class Groups:
    """local and global observations are read from the panel as they are; static and pairwise name columns of the side tables."""

    local: tuple[str, ...] = ()
    site: tuple[str, ...] = ()
    known_future: tuple[str, ...] = ()
    static: tuple[str, ...] = ()
    pairwise: tuple[str, ...] = ()


GROUPS = {
    "world_model_v1": Groups(
        local=_EVENT_SUMMARY,
        site=(*_FARM_METERS, *[f"farm_{c}" for c in _EVENT_SUMMARY]),
        known_future=("dataset", "timestamp", "calendar_hour_sin", "calendar_hour_cos", "calendar_weekday_sin", "calendar_weekday_cos", "calendar_month_sin", "calendar_month_cos", "calendar_is_weekend"),
        static=("dataset", "turbine_id", "turbine_index", "latitude", "longitude", "coord_x", "coord_y", "coord_kind", "coord_crs", "elevation_m", "rated_power_kw", "hub_height_m", "rotor_diameter_m"),
        pairwise=("src_turbine_id", "dst_turbine_id", "src_turbine_index", "dst_turbine_index", "delta_x_m", "delta_y_m", "distance_m", "bearing_deg", "elevation_diff_m", "distance_in_rotor_diameters"),
    )
}


def groups_of(protocol: str) -> Groups:
    """A protocol's groups; all but world_model_v1 have the plain time axis and nothing else."""
    return GROUPS.get(protocol, Groups(known_future=("dataset", "timestamp")))
