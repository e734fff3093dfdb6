"""What a record looks like, and settings from a file."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class RecordSpec:
    """Fixed-width records: ``key_size`` leading bytes are the key; a text record ends with a line feed."""

    record_size: int = 1024
    key_size: int = 8

    def __post_init__(self) -> None:
        if self.key_size < 1:
            raise ValueError("a key has at least one byte")
        if self.record_size < self.key_size:
            raise ValueError(f"a record of {self.record_size} bytes can't hold a key of {self.key_size}")

    @property
    def text_size(self) -> int:
        """Characters of a text record without its line feed."""
        return self.record_size - 1


@dataclass(frozen=True)
class Settings:
    """Sizes in bytes, latencies in seconds, bandwidths in bytes a second; for the cost model and the generator."""

    cache_size: int = 1 << 20
    dram_capacity: int = 100 << 20
    dram_latency: float = 1e-6
    dram_bandwidth: int = 100 << 20
    ssd_capacity: int = 10 << 30
    ssd_latency: float = 1e-4
    ssd_bandwidth: int = 200 << 20
    hdd_latency: float = 5e-3
    hdd_bandwidth: int = 100 << 20
    record_size: int = 1024
    key_size: int = 8
    num_records: int = 0
    batch: int = 4096
    seed: int = 100
    input_file: str = ""
    output_file: str = ""


def read_settings(path: str) -> Settings:
    """Settings from lines ``name=value``; blank lines and lines that begin with # are skipped."""
    kinds = {f.name: type(getattr(Settings(), f.name)) for f in fields(Settings)}
    found = {}
    with open(path, encoding="utf-8") as lines:
        for number, line in enumerate(lines, 1):
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            name, equals, value = (x.strip() for x in line.partition("="))
            if not equals or name.lower() not in kinds:
                raise ValueError(f"{path}:{number}: {line!r} is no setting")
            found[name.lower()] = kinds[name.lower()](value)
    return Settings(**found)
