"""Engine settings: immutable, changed with ``dataclasses.replace``."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace
from enum import Enum


class StatType(str, Enum):
    BASIC = "BASIC"
    BASIC_NDV = "BASIC_NDV"
    NDV_HYPERLOG = "NDV_HYPERLOG"
    NDV_WITH_MODE = "NDV_WITH_MODE"
    HISTOGRAM = "HISTOGRAM"


class Prune(str, Enum):
    MIN_FREQ = "MIN_FREQ"
    NO_TYPED_INNER_NODES = "NO_TYPED_INNER_NODES"
    MAX_NO_PATHS = "MAX_NO_PATHS"
    UNIQUE_SUFFIX = "UNIQUE_SUFFIX"
    MAX_PREFIX_LENGTH = "MAX_PREFIX_LENGTH"


#: Type suffixes of key paths.
SUFFIXES = {"num": "num", "str": "str", "bool": "bool", "arr": "arr", "obj": "obj", "null": ""}


@dataclass(frozen=True)
class EngineConfig:
    """What a statistics build and its estimates depend on.

    ``sampling_rate`` is the fraction of documents that is left out.
    """

    stats_type: StatType = StatType.HISTOGRAM
    sampling_rate: float = 0.0
    seed: int = 0
    hll_error: float = 0.05
    buckets: int = 64
    singleton_plus: bool = True
    enum_arrays: bool = False
    prune: frozenset[Prune] = field(default_factory=frozenset)
    min_freq: float = 0.001
    max_paths: int = 100
    max_prefix: int = 3
    key_sep: str = "."
    type_sep: str = "_"

    def __post_init__(self) -> None:
        if not 0 <= self.sampling_rate < 1:
            raise ValueError("sampling_rate must be in [0, 1)")
        if self.buckets < 1:
            raise ValueError("buckets must be positive")
        if {Prune.MAX_PREFIX_LENGTH, Prune.UNIQUE_SUFFIX} <= self.prune:
            raise ValueError("MAX_PREFIX_LENGTH and UNIQUE_SUFFIX exclude each other")

    def changed(self, **values) -> EngineConfig:
        """A copy with other values; unknown names raise."""
        return replace(self, **values)

    def active(self) -> dict:
        """Only the settings that have an effect: what two equal builds share."""
        own = asdict(self)
        own["stats_type"] = self.stats_type.value
        own["prune"] = sorted(p.value for p in self.prune)
        for name, needs in (("min_freq", Prune.MIN_FREQ), ("max_paths", Prune.MAX_NO_PATHS), ("max_prefix", Prune.MAX_PREFIX_LENGTH)):
            if needs not in self.prune:
                own.pop(name)
        if self.stats_type is not StatType.HISTOGRAM:
            own.pop("buckets")
            own.pop("singleton_plus")
        if self.stats_type is not StatType.NDV_HYPERLOG:
            own.pop("hll_error")
        if not self.sampling_rate:
            own.pop("seed")
        return own

    def key(self) -> str:
        return hashlib.sha256(json.dumps(self.active(), sort_keys=True).encode()).hexdigest()[:16]


def settings_grid(
    stat_types: tuple[StatType, ...] = tuple(StatType),
    prunes: tuple[frozenset[Prune], ...] = (
        frozenset(), frozenset({Prune.MAX_NO_PATHS}), frozenset({Prune.MIN_FREQ}), frozenset({Prune.MAX_PREFIX_LENGTH}),
        frozenset({Prune.NO_TYPED_INNER_NODES, Prune.UNIQUE_SUFFIX}),
    ),
    buckets: tuple[int, ...] = (6, 16, 32, 64, 128, 512),
    sampling_rates: tuple[float, ...] = (0.0, 0.7, 0.9, 0.98, 0.995),
    parameters: tuple[tuple[float, int, int], ...] = ((0.01, 200, 4), (0.003, 400, 4), (0.001, 500, 5)),
) -> list[EngineConfig]:
    """Every distinct configuration of the grid; settings without effect are not varied."""
    out: dict[str, EngineConfig] = {}
    for kind in stat_types:
        for bins in buckets if kind is StatType.HISTOGRAM else buckets[:1]:
            for strategy in prunes:
                for min_freq, max_paths, max_prefix in parameters:
                    for rate in sampling_rates:
                        c = EngineConfig(kind, rate, buckets=bins, prune=strategy, min_freq=min_freq, max_paths=max_paths, max_prefix=max_prefix)
                        out.setdefault(c.key(), c)
    return list(out.values())
