"""Settings of maps and log-structured tables; all of them round-trip through JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

#: Levels of a log-structured table and runs at which a level is merged (fixed values).
NUM_LEVELS, MAX_RUNS_PER_LEVEL = 4, 4


@dataclass(frozen=True)
class Config:
    """Settings of a sorted map.

    ``expansion_factor`` and ``range_headroom`` shape placement models;
    ``rebuild_depth_threshold`` is the number of runs, and
    ``tombstone_ratio_threshold`` the share of deleted rows, at which a map that has
    ``auto_rebuild`` rewrites itself.  The defaults are fixed values.  ``key_codec`` names the
    kind of the keys where their Spark type doesn't tell it (``u128`` and ``i128``).
    """

    expansion_factor: float = 2.0
    auto_rebuild: bool = True
    rebuild_depth_threshold: int = 8
    tombstone_ratio_threshold: float = 0.5
    range_headroom: float = 0.0
    key_codec: str | None = None

    def __post_init__(self) -> None:
        if self.expansion_factor < 1.0:
            raise ValueError(f"expansion_factor must be >= 1.0, got {self.expansion_factor}")
        if not 0.0 < self.tombstone_ratio_threshold <= 1.0:
            raise ValueError(f"tombstone_ratio_threshold must be in (0, 1], got {self.tombstone_ratio_threshold}")
        if self.range_headroom < 0.0:
            raise ValueError(f"range_headroom must be >= 0, got {self.range_headroom}")

    def for_bulk_load(self) -> Config:
        """Bulk loads leave room for at least as many keys again."""
        return replace(self, range_headroom=max(1.0, self.range_headroom))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls(**json.loads(text))


@dataclass(frozen=True)
class EngineConfig:
    """``flush_threshold``: bytes of buffered keys and values at which a table flushes.

    ``memtable``: the kind of buffer, ``hash`` (sorted when flushed) or ``sorted`` (kept in order).
    """

    flush_threshold: int = 4 * 1024 * 1024
    max_runs_per_level: int = MAX_RUNS_PER_LEVEL
    num_levels: int = NUM_LEVELS
    memtable: str = "hash"

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> EngineConfig:
        return cls(**json.loads(text))
