"""All thresholds in one place. They are this project's choices."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    cutoff: str = "2024-01-11 00:00:00"  # the normal period ends here
    start: str = "2024-01-01 00:00:00"
    hours: int = 720  # expected hours
    target: str = "error"  # the abnormal tag
    fuel: str = "signup"  # rows that stand for substituted fuel
    tags: tuple[str, ...] = ("click", "error", "purchase", "signup", "view")
    z_alert: float = 1.5
    mad_alert: float = 3.5
    iqr_factor: float = 1.5
    episode_gap_hours: int = 3
    session_gap_minutes: int = 30
    precursor_hours: int = 24
    lead_hours: int = 6
    smooth_rows: int = 24
    stuck_eps: float = 0.5
    ewma_alpha: float = 0.3
    idle_days: float = 365.0  # a stream forgets a user after so long without readings
    weights: tuple[tuple[str, float], ...] = (("error", 0.5), ("click", 0.3), ("purchase", 0.1), ("signup", 0.1), ("view", 0.1))
    high: float = 75.0
    medium: float = 50.0

    def weight(self, tag: str) -> float:
        return dict(self.weights)[tag]


DEFAULT = Config()
