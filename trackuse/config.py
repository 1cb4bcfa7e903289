"""Parameters of the analysis. Nothing downstream is hard-wired."""

from __future__ import annotations

from dataclasses import dataclass

from trackuse.fixed_values import REFERENCE_POINTS


@dataclass(frozen=True)
class Config:
    # cleaning
    start: str = "2013-06-01"
    end: str = "2025-06-01"
    exclude_sites: tuple[str, ...] = ("PL",)
    min_lat_range: float = 5.0
    max_lat: float = 42.0
    fixes_per_day: int = 4
    # clustering
    grid_m: float = 250.0
    eps_m: float = 30_000.0
    min_pts: int = 1_500
    # naming: (name, latitude, longitude)
    reference_points: tuple[tuple[str, float, float], ...] = REFERENCE_POINTS
    # season
    anchor_month: int = 6
    anchor_day: int = 1
    window_days: int = 14
    cycle_days: int = 366
    recent: int = 2

    @property
    def eps_cells(self) -> float:
        """Cluster radius in lattice cells."""
        return self.eps_m / self.grid_m
