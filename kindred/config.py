"""Configurations, checked when they are made and against schemas before any job starts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from kindred.errors import NO_KEYS, InvalidConfigError, one_of, require_columns

MODES = ("exact", "fuzzy", "exact then fuzzy")
COMPARISON_TYPES = ("exact", "name", "email", "phone", "date")

DEFAULT_THRESHOLD = 0.9
HIGHEST_THRESHOLD = 0.999
DEFAULT_SEED = 42


@dataclass(frozen=True)
class CleanConfig:
    """A cleaning run: normalise, then dedup on ``keys``."""

    keys: tuple[str, ...]
    normalize: dict[str, list[str]] = field(default_factory=dict)
    mode: str = "exact"
    threshold: float = 85
    block_size: int = 1
    scorer: object = "token_sort_ratio"

    def __post_init__(self):
        object.__setattr__(self, "keys", tuple(self.keys))
        object.__setattr__(self, "mode", self.mode.lower())
        if not self.keys:
            raise InvalidConfigError(NO_KEYS)
        if self.mode not in MODES:
            raise InvalidConfigError(one_of("Mode", self.mode, MODES))

    @classmethod
    def of(cls, config: CleanConfig | dict) -> CleanConfig:
        return config if isinstance(config, cls) else cls(**config)


@dataclass(frozen=True)
class LinkConfig:
    """A linkage run. ``comparisons`` maps column to comparison type; ``blocking`` names the
    columns a candidate pair must agree on (at least one), by default all compared columns.

    ``random_pairs`` bounds the random pairs from which the shares of partial agreement are
    estimated (shares of equality are exact); they come from rows chosen by a hash. EM stops
    when nothing moves by ``tolerance`` any more, at the latest after ``em_rounds``; the model
    says which."""

    comparisons: dict[str, str]
    threshold: float = DEFAULT_THRESHOLD
    seed: int = DEFAULT_SEED
    blocking: tuple[str, ...] | None = None
    random_pairs: int = 1_000_000
    em_rounds: int = 25
    tolerance: float = 1e-4

    def __post_init__(self):
        if self.random_pairs < 1 or self.em_rounds < 1:
            raise InvalidConfigError("Training needs random pairs and EM rounds.")
        if not self.comparisons:
            raise InvalidConfigError("A linkage needs columns to compare; none is configured.")
        for name, kind in self.comparisons.items():
            if kind not in COMPARISON_TYPES:
                raise InvalidConfigError(one_of(f"Comparison of '{name}' by", kind, COMPARISON_TYPES))
        object.__setattr__(self, "threshold", min(self.threshold, HIGHEST_THRESHOLD))
        if self.threshold <= 0:
            raise InvalidConfigError("Every pair would match: set a threshold over zero.")
        object.__setattr__(self, "blocking", tuple(self.blocking) if self.blocking else None)

    @classmethod
    def of(cls, config: LinkConfig | dict) -> LinkConfig:
        if isinstance(config, cls):
            return config
        return cls(**{"comparisons": {}, **config})

    @property
    def columns(self) -> list[str]:
        return list(self.comparisons)

    @property
    def blocking_columns(self) -> list[str]:
        return list(self.blocking or self.comparisons)

    def check(self, df: DataFrame, label: str = "the table") -> None:
        require_columns(df, self.comparisons, "Comparison column", label)
        require_columns(df, self.blocking_columns, "Blocking column", label)

    def plan(self, kind: str = "dedupe") -> dict:
        """What will be compared and which rules make candidates, as plain data."""
        from kindred.functions.compare import LEVELS

        if kind not in ("dedupe", "link"):
            raise InvalidConfigError(one_of("Run", kind, ("dedupe", "link")))
        return {
            "kind": kind,
            "comparisons": [
                {"column": c, "type": t, "levels": list(LEVELS[t])}
                for c, t in self.comparisons.items()
            ],
            "rules": [
                {"match_key": i, "equal": c, "not_equal": self.blocking_columns[:i]}
                for i, c in enumerate(self.blocking_columns)
            ],
            "threshold": self.threshold,
            "seed": self.seed,
        }
