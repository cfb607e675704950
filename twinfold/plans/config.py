"""Settings: six keys with defaults, kept in a folder as versions, of which the last whole one holds.

A version is a file that is seen whole or not at all, under a number of its own; the one before is deleted only after it. So a save that
breaks off leaves the settings as they were.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import SparkSession

from twinfold.functions.hashes import HASH_FUNCTIONS
from twinfold.plans.storage import list_files, read_text, remove, write_text


@dataclass(frozen=True)
class DedupConfig:
    deduplicateThumbs: bool = True
    #: (domain, deduplicate_thumbs or None) in the order of entry; later ones override, None is skipped.
    domainSettings: tuple[tuple[str, bool | None], ...] = ()
    hashFunction: str = "dctHash"
    maxHammingDistance: int = 8
    partitionByDomain: bool = True
    showHashValues: bool = False

    def __post_init__(self):
        if self.hashFunction not in HASH_FUNCTIONS:
            raise ValueError(f"unknown hash function: {self.hashFunction}")
        if not 0 <= self.maxHammingDistance <= 64:
            raise ValueError("maxHammingDistance: 0 to 64")
        if not isinstance(self.deduplicateThumbs, bool):
            raise ValueError("deduplicateThumbs: a default is needed")


def _versions(spark: SparkSession, path: str) -> list[str]:
    return [x for x in list_files(spark, path) if x.startswith("settings-") and x.endswith(".json")]


def save_settings(spark: SparkSession, path: str, config: DedupConfig) -> None:
    """Store as a new version; the last one and the one before are kept."""
    old = _versions(spark, path)
    number = int(old[-1][9:-5]) + 1 if old else 1
    write_text(spark, f"{path}/settings-{number:012d}.json", json.dumps(asdict(config)))
    for name in old[:-1]:
        remove(spark, f"{path}/{name}")


def update_settings(spark: SparkSession, path: str, **changes) -> DedupConfig:
    """Store some settings; the others stay."""
    config = replace(load_settings(spark, path), **changes)
    save_settings(spark, path, config)
    return config


def reset_settings(spark: SparkSession, path: str) -> None:
    """Back to the defaults."""
    save_settings(spark, path, DedupConfig())


def load_settings(spark: SparkSession, path: str) -> DedupConfig:
    """What is stored over the defaults; the defaults where nothing is. A damaged version is told in a warning, and the one before it holds, or the defaults."""
    for name in reversed(_versions(spark, path)):
        try:
            stored = json.loads(read_text(spark, f"{path}/{name}"))
            known = {f.name for f in fields(DedupConfig)}
            values = {k: v for k, v in stored.items() if k in known and v is not None}
            if "domainSettings" in values:
                values["domainSettings"] = tuple((d, v["deduplicateThumbs"] if isinstance(v, dict) else v) for d, v in values["domainSettings"])
            return DedupConfig(**values)
        except (ValueError, AttributeError, TypeError, KeyError) as damaged:
            warnings.warn(f"{path}/{name} is damaged: {damaged}", stacklevel=2)
    return DedupConfig()
