"""Tuning constants of the alignment operators, as one frozen record. Times are seconds, sizes bits or rows."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # frame content and reference choice
    content: float = 50.0
    content_relaxed: float = 25.0
    first_content_span: float = 120.0
    reference_skip: float = 30.0
    reference_tiers: tuple[float, float] = (30.0, 60.0)
    refs_skip_start: float = 30.0
    refs_skip_end: float = 60.0
    refs_search: float = 5.0
    # nearest-neighbour scans
    coarse_step: int = 6
    fine_window: int = 22
    threshold: int = 12
    multi_refs: int = 5
    reject_factor: int = 2
    intro_guard: float = 8.0
    dense_samples: int = 48
    dense_window: float = 2.0
    dense_hd: int = 16
    curvature: float = 1e-9
    reach: float = 0.95
    max_deviation: float = 0.100
    # intro anchor
    probes: tuple[float, ...] = (2.0, 8.0, 18.0, 35.0, 60.0, 90.0)
    probe_tolerance: float = 0.35
    probe_margin: int = 2
    # signals
    sample_rate: int = 16000
    bin_s: float = 0.020
    low_pct: float = 0.30
    high_pct: float = 0.90
    mix: float = 0.5
    max_lag: float = 60.0
    audio_bands: tuple[float, float] = (0.55, 0.35)
    cut_bands: tuple[float, float] = (0.50, 0.30)
    min_cuts: int = 5
    speech: float = 0.05
    refine_min_length: float = 30.0
    refine_min_bins: int = 50
    refine_peak: float = 0.20
    refine_residual: float = 1.5
    # segments
    jump: float = 0.200
    trigger: float = 0.180
    new_delta: float = 0.300
    max_hd: int = 8
    solo_hd: int = 4
    robust: tuple[float, float] = (0.12, 0.88)
    spike: float = 0.65
    agree: float = 0.42
    passes: int = 6
    cluster_tolerance: float = 0.150
    merge: float = 0.300
    blocking: float = 0.50
    isolation: tuple[float, float] = (1.0, 600.0)
    min_filler: float = 0.030
    black_min: float = 0.30
    # decisions
    inliers: int = 3
    stdev: float = 0.080
    audio_quality: float = 0.30
    audio_reach: float = 1.5
    near: float = 0.300
    confirm: float = 0.1
    borderline: float = 0.5
    consensus_agree: float = 0.15
    consensus_apart: float = 0.5
    cut_fallback: float = 0.30
    audio_fallback: float = 0.35
    # verification
    verify_samples: int = 150
    verify_window: float = 0.75
    verify_edge: float = 5.0
    verify_hd: int = 28
    verify_audio: float = 15.0
    verify_lag: float = 0.50
    verify_peak: float = 0.20
    pair_cuts: float = 1.00
    # names
    similar: float = 0.40
    similar_ui: float = 0.65


DEFAULT = Config()
