"""Parameters of an assembly, with the defaults and checks of the command line."""

from __future__ import annotations

import warnings
from dataclasses import dataclass


@dataclass(frozen=True)
class AssemblyConfig:
    read_len: int
    min_overlap: int
    max_tiplen: int | None = None
    num_iters: int | None = None
    bubblelen: int = 10
    min_contiglen: int | None = None
    dedup: str = "exact"
    bloom_bits: int = 36
    bloom_hashes: int = 2
    trim_dead_ends: bool = True
    keep_best_arm: bool = False

    def __post_init__(self):
        if not 1 <= self.read_len:
            raise ValueError("read_len must be positive")
        if not 9 < self.min_overlap < self.read_len:
            raise ValueError("min_overlap must be over 9 and under read_len")
        if self.max_tiplen is not None and self.max_tiplen < 0:
            raise ValueError("max_tiplen must not be negative")
        if self.bubblelen <= 0:
            raise ValueError("bubblelen must be positive")
        if self.bloom_bits < 1 or not 1 <= self.bloom_hashes <= 5:
            raise ValueError("bloom_bits must be positive, bloom_hashes 1 to 5")
        if self.dedup not in ("exact", "bloom"):
            raise ValueError("dedup is exact or bloom")
        if self.num_iters is not None and self.num_iters < 0:
            raise ValueError("num_iters must not be negative")

    @property
    def tip_limit(self) -> int:
        return 2 * self.read_len if self.max_tiplen is None else self.max_tiplen

    @property
    def tip_schedule(self) -> list[int]:
        """Node counts allowed to a tip, one after the other: 1, and one stride more for each step."""
        steps = 2 * self.read_len // 5 if self.num_iters is None else self.num_iters
        stride = self.tip_limit // steps if steps else 1
        if stride < 1:
            warnings.warn("more steps than max_tiplen; a stride of 1 is used", stacklevel=2)
            stride = 1
        return sorted({min(self.tip_limit, 1 + stride * k) for k in range(steps + 1)})

    @property
    def contig_limit(self) -> int:
        return 2 * self.read_len if self.min_contiglen is None else self.min_contiglen
