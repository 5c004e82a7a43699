"""Settings of the chunker."""

from __future__ import annotations

from dataclasses import dataclass

#: Amount of each threshold type where none is given.
AMOUNTS = {"percentile": 70.0, "std": 0.5, "iqr": 0.0}


@dataclass(frozen=True)
class ChunkConfig:
    """Budget in words, and how gaps between sentences become cuts.

    parent_max_tokens asks for parents of that size too; parent_min_tokens is a quarter of it if not given.
    """

    max_tokens: int = 256
    min_tokens: int = 48
    window: int = 3
    threshold_type: str = "percentile"
    threshold_amount: float | None = None
    strategy: str = "optimal"
    discourse_weight: float = 0.25
    paragraph_bonus: float = 2.0
    min_size_penalty: float = 100.0
    overlap_sentences: int = 0
    respect_structure: bool = True
    parent_max_tokens: int | None = None
    parent_min_tokens: int | None = None

    def __post_init__(self) -> None:
        if self.min_tokens >= self.max_tokens:
            raise ValueError(f"min_tokens ({self.min_tokens}) must be below max_tokens ({self.max_tokens})")
        if self.strategy not in ("optimal", "greedy"):
            raise ValueError(f"no such strategy: {self.strategy!r}")
        if self.threshold_type not in AMOUNTS:
            raise ValueError(f"no such threshold type: {self.threshold_type!r}")
        if self.parent_max_tokens is not None and self.parent_max_tokens <= self.max_tokens:
            raise ValueError(f"parent_max_tokens ({self.parent_max_tokens}) must be above max_tokens ({self.max_tokens})")
        object.__setattr__(self, "window", max(1, self.window))
        object.__setattr__(self, "overlap_sentences", max(0, self.overlap_sentences))

    @property
    def amount(self) -> float:
        return AMOUNTS[self.threshold_type] if self.threshold_amount is None else self.threshold_amount

    @property
    def parent_least(self) -> int:
        return self.parent_min_tokens if self.parent_min_tokens is not None else (self.parent_max_tokens or 0) // 4
