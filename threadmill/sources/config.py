"""Model configuration: a YAML or JSON mapping with environment overrides, read on the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

try:
    import yaml
except ImportError:  # not everywhere installed
    yaml = None

ROLES = ("embedder", "labeler", "generator")


class ConfigError(ValueError):
    """The configuration is incomplete."""


def parse_mapping(text: str) -> dict:
    """The mapping that a configuration holds, in YAML where its library is installed, else in JSON (which is YAML too)."""
    try:
        top = yaml.safe_load(text) if yaml else json.loads(text)
    except (ValueError, *((yaml.YAMLError,) if yaml else ())) as e:
        raise ConfigError(f"malformed configuration: {e}") from e
    if not isinstance(top, dict):
        raise ConfigError("the configuration is not a mapping")
    return top


def load(path: str | None = None, env: Mapping[str, str] = os.environ, roles: tuple[str, ...] = ROLES) -> dict:
    """``{roles: {role: model}, base_url}``. ``THREADMILL_CONFIG`` names another file, ``THREADMILL_<ROLE>_MODEL`` a model."""
    path = env.get("THREADMILL_CONFIG") or path
    if not path:
        raise ConfigError("no configuration file")
    with open(path) as f:
        top = parse_mapping(f.read())
    models = top.get("roles") or {}
    missing = [r for r in roles if not models.get(r)]
    if missing or not (top.get("provider") or {}).get("base_url"):
        raise ConfigError(f"missing: {', '.join(missing) or 'provider.base_url'}")
    return {"roles": {r: env.get(f"THREADMILL_{r.upper()}_MODEL") or models[r] for r in roles}, "base_url": top["provider"]["base_url"]}


def api_key(names: tuple[str, ...], env: Mapping[str, str] = os.environ) -> str:
    """The first variable that is set and not empty."""
    for n in names:
        if env.get(n):
            return env[n]
    raise ConfigError(f"none of {', '.join(names)} is set")
