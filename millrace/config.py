"""Limits, configured sources and sinks; what a run is parameterised with."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """A configuration that can't be run."""


@dataclass(frozen=True)
class Limits:
    max_message_bytes: int = 65_536
    max_field_bytes: int = 8_192
    max_field_count: int = 512
    max_nested_depth: int = 32
    max_connections: int = 256
    max_batch_events: int = 500
    max_delivery_retries: int = 5
    retry_backoff_seconds: float = 1.0


#: Limits that other engines know and that have no meaning here: queues are micro-batches, a column plan has no time per message, a spool is a folder.
ELSEWHERE = frozenset({"max_queue_size", "max_parse_seconds", "max_spool_bytes"})


@dataclass(frozen=True)
class Source:
    """A configured source; unset members match anything, at least one of the four anchors must be set."""

    source_id: str
    transport: str | None = None
    peer_ip: str | None = None
    port: int | None = None
    file_path: str | None = None
    vendor: str | None = None
    product: str | None = None
    parser_hint: str | None = None


@dataclass(frozen=True)
class Config:
    limits: Limits = Limits()
    sources: tuple[Source, ...] = ()
    listeners: tuple[dict, ...] = ()
    siem: dict = field(default_factory=dict)
    api: dict = field(default_factory=dict)
    reference_year: int | None = None
    """Year of stamps that have none; the current one if None. Set it for results that repeat."""
    csv_schema: tuple[str, ...] | None = None
    csv_delimiter: str | None = None


def from_dict(cfg: Any) -> Config:
    if not isinstance(cfg, dict):
        raise ConfigError("configuration must be a JSON object")
    known = {"limits", "listeners", "sources", "siem", "api"}
    if odd := sorted(set(cfg) - known):
        raise ConfigError(f"unknown keys: {', '.join(odd)}")
    own = {f.name for f in fields(Limits)}
    if odd := sorted(set(cfg.get("limits", {})) - own - ELSEWHERE):
        raise ConfigError(f"unknown limits: {', '.join(odd)}")
    try:
        limits = Limits(**{k: v for k, v in cfg.get("limits", {}).items() if k in own})
        sources = tuple(Source(**s) for s in cfg.get("sources", []))
    except TypeError as e:
        raise ConfigError(str(e)) from e
    for x in cfg.get("listeners", []):
        if x.get("type") not in ("udp", "tcp", "file"):
            raise ConfigError(f"listener type must be udp, tcp or file, not {x.get('type')!r}")
        if x["type"] == "file" and not x.get("path"):
            raise ConfigError("a file listener needs a path")
        if x["type"] != "file" and not 0 < int(x.get("port", 0)) < 65_536:
            raise ConfigError("a network listener needs a port")
    if (kind := cfg.get("siem", {}).get("type", "spool")) not in ("spool", "syslog", "qradar", "elastic"):
        raise ConfigError(f"siem type must be spool, syslog, qradar or elastic, not {kind!r}")
    if low := [n for n in ("max_message_bytes", "max_field_bytes", "max_field_count", "max_nested_depth", "max_connections", "max_batch_events") if getattr(limits, n) < 1]:
        raise ConfigError(f"must be at least 1: {', '.join(low)}")
    return Config(limits, sources, tuple(cfg.get("listeners", [])), cfg.get("siem", {}), cfg.get("api", {}))


def load(path: str) -> Config:
    try:
        return from_dict(json.loads(Path(path).read_text(encoding="utf-8")))
    except OSError as e:
        raise ConfigError(f"can't read {path}: {e}") from e
    except ValueError as e:
        raise ConfigError(f"{path} is no valid configuration: {e}") from e


def secret(cfg: dict, key: str) -> str | None:
    """cfg[key], or the environment variable that cfg[key + '_env'] names."""
    if name := cfg.get(f"{key}_env"):
        if name not in os.environ:
            raise ConfigError(f"environment variable {name} is not set")
        return os.environ[name]
    return cfg.get(key)
