"""Engine options, with the documented defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from math import ceil, e, log


@dataclass(frozen=True)
class Options:
    bloom_expected_elements: int = 6
    bloom_false_positive_rate: float = 0.02
    cache_capacity: int = 20
    memtable_entries: int = 6
    memtable_tables: int = 2
    page_size: int = 2
    page_cache: int = 3
    summary_thinning: int = 2
    block_size: int = 50
    blocks_per_segment: int = 5
    low_watermark: int = 0
    run_capacity: int = 100_000
    bucket_capacity: int = 5
    bucket_interval_us: int = 1_000
    header_bytes: int = 30
    dictionary: bool = False
    single_file: bool = False

    @property
    def payload_limit(self) -> int:
        """Most bytes of key and value that fit in a segment beside the headers of its blocks."""
        return self.blocks_per_segment * (self.block_size - self.header_bytes)

    @classmethod
    def load(cls, path: str) -> Options:
        """Options from a JSON object; unknown names are an error, missing ones keep their defaults."""
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        if unknown := set(given) - {x.name for x in fields(cls)}:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return replace(cls(), **given)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter for n elements and false-positive rate p."""
    m = ceil(n * abs(log(p)) / log(2) ** 2)
    return m, ceil(m / n * log(2))


def count_min_size(epsilon: float, delta: float) -> tuple[int, int]:
    """Width and depth of a Count-Min sketch."""
    return ceil(e / epsilon), ceil(log(e / delta))
