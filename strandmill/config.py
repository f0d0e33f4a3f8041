"""Settings of a run as frozen dataclasses, with overlay from JSON or YAML."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Simulation:
    genome_length: int = 1_000_000
    num_reads: int = 50_000
    read_length: int = 100
    methylation_rate: float = 0.7
    error_rate: float = 0.01
    conversion_rate: float = 0.99


@dataclass(frozen=True)
class Adapters:
    trim: bool = False
    #: names in the adapter table; None: the one found most often, the first mate's for the second
    first: str | None = None
    second: str | None = None
    min_overlap: int = 6
    max_error: float = 0.1


@dataclass(frozen=True)
class Umi:
    dedup: bool = False
    #: header, inline_5prime, inline_3prime, or auto
    location: str = "auto"
    length: int = 8


@dataclass(frozen=True)
class Aligner:
    #: None: by read length
    seed_length: int | None = None


@dataclass(frozen=True)
class Correction:
    #: of reads: mapq, clip, pair, unconverted, model; of sites: consensus, context
    strategies: tuple[str, ...] = ()
    min_mapq: int = 20
    max_clip: float = 0.5
    max_unconverted: int = 3
    max_insert: int = 1000
    min_depth: int = 5
    high: float = 0.7
    low: float = 0.3
    threshold: float = 0.5


@dataclass(frozen=True)
class Settings:
    conversion: str = "ct"
    mode: str = "se"
    seed: int = 42
    min_cov: int = 1
    simulation: Simulation = field(default_factory=Simulation)
    adapters: Adapters = field(default_factory=Adapters)
    umi: Umi = field(default_factory=Umi)
    aligner: Aligner = field(default_factory=Aligner)
    correction: Correction = field(default_factory=Correction)


def overlay(settings: Settings, given: dict) -> Settings:
    """``settings`` with the given keys; an unknown key is an error."""
    changes = {}
    for key, value in given.items():
        now = getattr(settings, key)  # AttributeError names an unknown key
        if dataclasses.is_dataclass(now):
            value = dataclasses.replace(now, **{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})
        changes[key] = value
    return dataclasses.replace(settings, **changes)


def load(path: str) -> Settings:
    with open(path) as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return overlay(Settings(), yaml.safe_load(f) or {})
        return overlay(Settings(), json.load(f))


def batch(samples: int = 4) -> dict:
    """Settings of a batch: half of the samples in each of two groups, both conversions."""
    rows = [{"sample": f"sample_{i + 1}", "group": "control" if i < samples // 2 else "treated", "conversion": "ct" if i % 2 == 0 else "ag", "seed": 42 + i} for i in range(samples)]
    return {"simulation": {"genome_length": 10_000, "num_reads": 500, "read_length": 50}, "samples": rows}


def write(given: dict, path: str) -> str:
    """A batch or settings as JSON or YAML, by the file's suffix."""
    with open(path, "w") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            yaml.safe_dump(given, f, sort_keys=False)
        else:
            json.dump(given, f, indent=1)
    return path


def load_batch(path: str) -> list[tuple[dict, Settings]]:
    """(sample and group, settings) of each sample; what a sample doesn't say is the batch's."""
    with open(path) as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            given = yaml.safe_load(f)
        else:
            given = json.load(f)
    shared = {k: v for k, v in given.items() if k != "samples"}
    names = ("sample", "group")
    return [({k: row.get(k, "none") for k in names}, overlay(Settings(), shared | {k: v for k, v in row.items() if k not in names})) for row in given["samples"]]
