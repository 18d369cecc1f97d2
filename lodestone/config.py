"""Settings. Scores are doubles; matching costs are integer hundredths, which keeps their sums exact."""

from __future__ import annotations

from dataclasses import dataclass

#: Prefix, first and last number of each range of codes, in vocabulary order.
RANGES = (("A", 1, 260), ("B", 261, 520), ("C", 521, 760), ("D", 761, 1000))


@dataclass(frozen=True)
class Settings:
    """Every tunable, with the values that results are compared under."""

    ranges: tuple[tuple[str, int, int], ...] = RANGES
    # Matching, in hundredths.
    max_distance: int = 200
    per_digit: int = 70
    margin: int = 25
    spurious: int = 150
    dropped: int = 100
    confused: int = 40
    replaced: int = 100
    # Recognition.
    least_score: float = 0.35
    enough: float = 0.90
    certain: float = 0.99
    orientations: tuple[int, ...] = (0, 180)
    angles: tuple[int, ...] = tuple(range(0, 360, 30))
    upright: float = 1.5
    # Segmentation.
    threshold: int | None = None
    least_area: float = 0.25
    split_from: float = 1.6
    split_steps: int = 24
    enough_blobs: int = 5
    kernel: int = 5
    # Crops and rendering.
    pad: int = 6
    crop_edge: int = 512
    fill: int = 128
    thumbnail: int = 200
    dim: float = 0.45
    known_bgr: tuple[int, int, int] = (255, 0, 255)
    unknown_bgr: tuple[int, int, int] = (255, 255, 0)
    outline: float = 0.0035
    # Names.
    longest_name: int = 40


SETTINGS = Settings()
