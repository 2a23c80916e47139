"""Record schemas, parameters and error classes."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

SPECTRUM = "native_id string, scan_number long, ms_level short, retention_time_min double, filter_string string, mz array<double>, intensity array<float>"
CENTROID = "mz double, intensity double"
REGION = "start_idx int, end_idx int, mz_start double, mz_end double, max_intensity float, apex_idx int"
STATS = "n_regions int, n_lasso int, n_pass2_refits int, n_centroids int, sigma_used double, lambda_rough double"

# Ion-trap scan rates as (kTh/s, letter, word, FWHM, sigma, grid spacing or None).
SCAN_RATES = (
    (33.0, "n", "normal", 0.5, 0.212, 1.0 / 30.0),
    (67.0, "r", "rapid", 0.6, 0.255, 1.0 / 15.0),
    (125.0, "t", "turbo", 0.8, 0.340, 1.0 / 8.0),
    (200.0, "u", "ultra", 2.0, 0.849, None),
)
FALLBACK_SIGMA = 0.340
# Wavelet scales in points, and 1 / sqrt(5), which turns the best scale into sigma.
SCALES = (3.5, 4.2, 5.1, 6.2, 7.5, 9.0, 11.0, 13.3, 16.2, 19.5, 23.6, 28.5)
SCALE_TO_SIGMA = 0.447213595


class SieveError(Exception):
    """Base of all errors of this library."""


class MzmlError(SieveError):
    """A document that is not readable as mzML."""


class NotProfileError(SieveError):
    """A centroided spectrum where profile data is required."""


class CalibrationError(SieveError):
    """Calibration without a usable result."""


class ConfigError(SieveError):
    """A parameter or input path that is not valid."""


def scan_rate(name: str) -> tuple:
    """The row of SCAN_RATES for a letter or word, in any case."""
    for row in SCAN_RATES:
        if name.lower() in row[1:3]:
            return row
    raise ConfigError(f"unknown scan rate {name!r}")


@dataclass(frozen=True)
class Config:
    """All parameters of centroiding; every one is honoured."""

    input: tuple[str, ...] = ()
    output: str | None = None
    scan_rate: str | None = None
    sigma: float | None = None
    sigma_ms1: float | None = None
    sigma_ms2: float | None = None
    grid_spacing: float | None = None
    grid_offset: float = 0.0
    n_calibration_spectra: int = 50
    lambda_factor: float = 3.0
    max_lasso_iter: int = 2000
    lasso_tol: float = 1e-6
    lambda_change_threshold: float = 0.20
    signal_threshold_sigma: float = 3.0
    merge_gap_points: int = 2
    extension_points: int = 3
    min_region_width: int = 3
    noise_window_da: float = 20.0
    noise_step_da: float = 5.0
    min_centroid_separation: float | None = None
    stats_output: str | None = None
    keep_empty: bool = True
    by_region: bool = False
    quiet: bool = False
    verbose: bool = False
    threads: int | None = None

    def __post_init__(self):
        if self.threads is not None and self.threads < 1:
            raise ConfigError("threads must be positive")
        if self.noise_step_da <= 0 or self.noise_window_da <= 0 or self.lambda_factor < 0 or self.max_lasso_iter < 1:
            raise ConfigError("windows and iterations must be positive, lambda_factor not negative")
        if self.scan_rate is not None:
            scan_rate(self.scan_rate)

    def sigma_for(self, level: int) -> float | None:
        """The set sigma of a level: its own, then the common one, then the scan rate's."""
        own = self.sigma_ms1 if level == 1 else self.sigma_ms2
        if own is not None:
            return own
        return self.sigma if self.sigma is not None else scan_rate(self.scan_rate)[4] if self.scan_rate else None

    def spacing(self) -> float | None:
        """The set grid spacing, else the scan rate's, else None: to be detected."""
        if self.grid_spacing is not None:
            return self.grid_spacing
        return scan_rate(self.scan_rate)[5] if self.scan_rate else None

    @classmethod
    def load(cls, path: str | None = None, **given) -> Config:
        """Values of a YAML file, over which those given (not None) win."""
        found: dict = {}
        if path:
            import yaml

            with open(path) as f:
                found = yaml.safe_load(f) or {}
        known = {f.name for f in fields(cls)}
        if unknown := set(found) - known:
            raise ConfigError(f"unknown parameters {sorted(unknown)}")
        merged = found | {k: v for k, v in given.items() if v is not None}
        if isinstance(merged.get("input"), str):
            merged["input"] = (merged["input"],)
        if "input" in merged:
            merged["input"] = tuple(merged["input"])
        return cls(**merged)

    def but(self, **changes) -> Config:
        return replace(self, **changes)
