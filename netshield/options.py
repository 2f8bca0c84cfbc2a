from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Tunable parameters; defaults are the documented production values."""

    window_seconds: int = 60
    threshold: float = 0.7
    min_records: int = 3
    min_rps: float = 2.0
    lookback_seconds: int = 30
    tick_seconds: int = 5
    series_max_age_seconds: int = 100
    block_seconds: int = 1800
    burst_gap_seconds: float = 0.1
    buffer_rows: int = 1000
    hostname_timeout_seconds: int = 300
    requests_per_second: int = 1000
    log_tag: str = "access"
    alert_tag: str = "alert"
    alert_priority: int = 1
    watermark: str = "100 seconds"
    flush_interval: str = "3 seconds"
    broadcast_rows: int = 200_000
    task_rows: int = 50_000

    @property
    def window_us(self) -> int:
        return self.window_seconds * 1_000_000

    @property
    def burst_gap_us(self) -> int:
        return round(self.burst_gap_seconds * 1_000_000)
