"""Configuration: every threshold of the engine in frozen dataclasses.

The numbers are fixed values of the detection method; change them per deployment by
constructing another instance, never by editing operators.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Severity category scores.
NONE_SCORE, LOW_SCORE, MEDIUM_SCORE, HIGH_SCORE = 0.2, 0.4, 0.6, 0.8

# One connection per second over a day.
STROBE_CONNECTIONS = 86_400
DAY_SECONDS = 86_400

# Network identifiers given to hosts without a sensor identity.
PUBLIC_NETWORK_ID = "ffffffff-ffff-ffff-ffff-ffffffffffff"
UNKNOWN_PRIVATE_NETWORK_ID = "ffffffff-ffff-ffff-ffff-fffffffffffe"

# Address ranges.
PRIVATE_SUBNETS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fd00::/8")
MANDATORY_NEVER_INCLUDE = (
    "0.0.0.0/32",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "224.0.0.0/4",
    "255.255.255.255/32",
    "::/128",
    "::1/128",
    "fe80::/10",
    "ff00::/8",
)
LOOPBACK_AND_LINK_LOCAL = (
    "127.0.0.0/8",
    "169.254.0.0/16",
    "224.0.0.0/24",
    "::1/128",
    "fe80::/10",
    "ff02::/16",
)
EXFIL_INTERNAL_SUBNETS = (
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "127.0.0.0/8",
    "169.254.0.0/16",
)
NEVER_EXTERNAL_SUBNETS = ("224.0.0.0/4", "239.0.0.0/8", "255.255.255.255/32", "0.0.0.0/8")


@dataclass(frozen=True)
class Thresholds:
    base: float
    low: float
    medium: float
    high: float


@dataclass(frozen=True)
class FilterConfig:
    internal_subnets: tuple[str, ...] = PRIVATE_SUBNETS
    always_subnets: tuple[str, ...] = ()
    never_subnets: tuple[str, ...] = MANDATORY_NEVER_INCLUDE
    always_domains: tuple[str, ...] = ()
    never_domains: tuple[str, ...] = ()
    drop_external_to_internal: bool = True


@dataclass(frozen=True)
class BeaconConfig:
    min_unique_ts: int = 4
    ts_weight: float = 0.25
    ds_weight: float = 0.25
    duration_weight: float = 0.25
    histogram_weight: float = 0.25
    min_hours_seen: int = 6
    ideal_hours_seen: int = 12
    mode_sensitivity: float = 0.05
    bimodal_outliers: int = 1
    bimodal_min_hours: int = 11
    bins: int = 24
    thresholds: Thresholds = Thresholds(50, 70, 90, 100)


@dataclass(frozen=True)
class ModifierConfig:
    intel_size_bytes: int = 25_000_000
    intel_size_step: float = 0.15
    prevalence_low: float = 0.02
    prevalence_high: float = 0.5
    prevalence_step: float = 0.15
    first_seen_recent_days: float = 7
    first_seen_old_days: float = 30
    first_seen_step: float = 0.15
    missing_host_step: float = 0.10
    rare_signature_step: float = 0.15
    c2_direct_step: float = 0.15
    mime_mismatch_step: float = 0.15


@dataclass(frozen=True)
class ScoreConfig:
    beacon: BeaconConfig = BeaconConfig()
    long_connection: Thresholds = Thresholds(3600, 14400, 28800, 43200)
    subdomains: Thresholds = Thresholds(100, 500, 800, 1000)
    strobe_score: float = HIGH_SCORE
    intel_score: float = HIGH_SCORE
    modifiers: ModifierConfig = ModifierConfig()
    rolling: bool = False


@dataclass(frozen=True)
class FloodConfig:
    window_seconds: int = 10
    baseline_windows: int = 30
    z_threshold: float = 4.0
    entropy_z_threshold: float = 3.0
    epsilon: float = 1e-9
    syn_ratio: float = 0.8
    udp_ratio: float = 0.8
    reflection_ratio: float = 3.0
    reflection_sources: int = 10
    spoofing_sources: int = 20
    min_flows: int = 5


@dataclass(frozen=True)
class ExfilConfig:
    ratio: float = 10.0
    volume_floor: int = 50_000
    window_seconds: int = 60
    min_observations: int = 3
    internal_subnets: tuple[str, ...] = EXFIL_INTERNAL_SUBNETS
    special_subnets: tuple[str, ...] = NEVER_EXTERNAL_SUBNETS


@dataclass(frozen=True)
class TlsConfig:
    ratio_reference: float = 2.0
    ratio_scale: float = 2.0
    size_reference: float = 360.0
    size_scale: float = 300.0
    ratio_weight: float = 0.6
    size_weight: float = 0.4
    threshold: float = 0.50


@dataclass(frozen=True)
class ScanConfig:
    hosts: int = 25
    ports: int = 15
    window: str = "5 minutes"


@dataclass(frozen=True)
class EngineConfig:
    filters: FilterConfig = field(default_factory=FilterConfig)
    scores: ScoreConfig = field(default_factory=ScoreConfig)
    flood: FloodConfig = field(default_factory=FloodConfig)
    exfil: ExfilConfig = field(default_factory=ExfilConfig)
    tls: TlsConfig = field(default_factory=TlsConfig)
    scan: ScanConfig = field(default_factory=ScanConfig)
    correlation_seconds: int = 300
    beacon_alert_score: float = 0.75
    beacon_material_change: float = 0.15
