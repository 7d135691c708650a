"""Settings of a study: window lengths, rates, thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    win_s: float = 60.0
    step_s: float = 5.0
    short_s: float = 15.0
    chunk_s: float = 3600.0  # a recording is windowed in stretches of this length, apart from each other
    purity: float = 0.9
    keep_labels: tuple[int, ...] = (1, 2, 3)
    fs: dict[str, float] = field(default_factory=lambda: {"acc_x": 32.0, "acc_y": 32.0, "acc_z": 32.0, "bvp": 64.0, "eda": 4.0, "temp": 4.0, "hr": 1.0, "label": 700.0})
    baseline_s: float = 600.0
    motion_sd: float = 0.05
    scr_min_amp: float = 0.01
    eda_split: str = "median"  # or "sparse": deconvolution, the median where it does not settle
    scr_find: str = "prominence"  # or "onset": onset and half recovery
    acc_band: tuple[float, float] = (0.3, 10.0)
    hr_range: tuple[float, float] = (20.0, 220.0)
    n_ref: int = 100
    clip: float = 20.0
    min_ref: int = 5

    def panes(self, seconds: float) -> int:
        """Steps in ``seconds``; windows are made of whole steps."""
        n = round(seconds / self.step_s)
        if abs(n * self.step_s - seconds) > 1e-9:
            raise ValueError(f"{seconds} s is not a whole number of steps of {self.step_s} s")
        return n

    def pane_size(self, stream: str) -> int:
        """Samples of a stream in a step."""
        n = round(self.fs[stream] * self.step_s)
        if abs(n - self.fs[stream] * self.step_s) > 1e-9:
            raise ValueError(f"a step has no whole number of {stream} samples; use windows.slice_windows")
        return n


def one_hertz() -> Config:
    """Every stream at 1 Hz."""
    return Config(fs=dict.fromkeys(("acc_x", "acc_y", "acc_z", "eda", "temp", "hr", "label"), 1.0))
