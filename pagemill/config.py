"""Run settings shared by the plans."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    base_url: str = "https://shop.example/"
    request_delay_sec: float = 0.5
    domain_delays: str = ""
    max_retries: int = 3
    respect_robots: bool = True
    incremental: bool = False
    dedup_ttl_sec: int | None = 86_400
    content_hash_ttl_sec: int | None = 604_800
    bloom_capacity: int = 1_000_000
    bloom_error_rate: float = 0.001
    max_pages: int = 5
    chunk_size: int = 10

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        readers = {
            "base_url": ("SCRAPE_BASE_URL", str),
            "request_delay_sec": ("REQUEST_DELAY", float),
            "domain_delays": ("DOMAIN_DELAYS", str),
            "max_retries": ("MAX_RETRIES", int),
            "respect_robots": ("RESPECT_ROBOTS", _flag),
            "incremental": ("INCREMENTAL", _flag),
            "dedup_ttl_sec": ("DEDUP_TTL", int),
            "content_hash_ttl_sec": ("CONTENT_HASH_TTL", int),
            "bloom_capacity": ("BLOOM_CAPACITY", int),
            "bloom_error_rate": ("BLOOM_ERROR_RATE", float),
        }
        given = {
            field: read(env[name]) for field, (name, read) in readers.items() if name in env
        }
        return cls(**given)


def _flag(text: str) -> bool:
    return text.lower() == "true"
