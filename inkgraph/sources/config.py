"""The configuration file (S10): versioned YAML at the root; wrong values are errors, unknown keys notices."""

from __future__ import annotations

import os
from dataclasses import fields
from typing import Any

from ..model import Config

FILE = ".inkgraph.yml"
MAX_BYTES = 1 << 20
KEYS = {
    "version": int, "roots": list, "contentRoots": list, "inboundThreshold": int, "structureFindingsSeverity": str, "linkSuggestionMinShared": int,
    "farFromRootThreshold": int, "emitExclude": list, "okf": bool, "respectGitignore": bool,
}
FIELDS = {
    "roots": "roots", "contentRoots": "content_roots", "inboundThreshold": "inbound_threshold", "structureFindingsSeverity": "structure_severity", "linkSuggestionMinShared": "min_shared",
    "farFromRootThreshold": "far_threshold", "emitExclude": "emit_exclude", "okf": "okf", "respectGitignore": "respect_gitignore",
}


class ConfigError(ValueError):
    """A configuration that is understood and wrong."""


def decode(text: str) -> tuple[dict[str, Any], list[tuple[str, str, str]]]:
    """(options for :class:`Config`, notices)."""
    import yaml

    if len(text.encode()) > MAX_BYTES:
        raise ConfigError("the configuration is too large")
    if text.count("*") > 1000:
        raise ConfigError("too many aliases")
    try:
        found = yaml.safe_load(text)
    except (yaml.YAMLError, RecursionError) as bad:
        raise ConfigError(f"not valid YAML: {bad}") from bad
    if found is None:
        return {}, []
    if not isinstance(found, dict):
        raise ConfigError("the configuration is not a mapping")
    notices = [("config", FILE, f"unknown key {k!r}") for k in sorted(map(str, found)) if k not in KEYS]
    options: dict[str, Any] = {}
    for key, kind in KEYS.items():
        if key not in found:
            continue
        value = found[key]
        if not isinstance(value, kind) or kind is int and isinstance(value, bool):
            raise ConfigError(f"{key} is not {kind.__name__}")
        if kind is int and value < 0:
            raise ConfigError(f"{key} is negative")
        if kind is list:
            if not all(isinstance(x, str) for x in value):
                raise ConfigError(f"{key} holds something that is no text")
            value = tuple(value)
        if key == "structureFindingsSeverity" and value not in ("info", "warning"):
            raise ConfigError(f"{key} is info or warning")
        if key == "version":
            if value != 1:
                raise ConfigError(f"version {value} is not known")
        else:
            options[FIELDS[key]] = value
    if "version" not in found:
        notices.insert(0, ("config", FILE, "no version, read as 1"))
    return options, notices


def load(root: str, **flags: Any) -> tuple[Config, list[tuple[str, str, str]]]:
    """The configuration of a tree; flags win over the file, roots add up."""
    path = os.path.join(root, FILE)
    options: dict[str, Any] = {}
    notices: list[tuple[str, str, str]] = []
    if os.path.islink(path):
        notices.append(("config", FILE, "symbolic link not followed"))
    elif os.path.isfile(path):
        if os.path.getsize(path) > MAX_BYTES:
            notices.append(("config", FILE, "larger than 1 MiB, not used"))
        else:
            with open(path, encoding="utf-8") as f:
                options, notices = decode(f.read())
    flags = {k: v for k, v in flags.items() if v is not None and k in {f.name for f in fields(Config)}}
    if "roots" in flags:
        flags["roots"] = (*options.get("roots", ()), *flags["roots"])
    return Config(**{**options, **flags}), notices
