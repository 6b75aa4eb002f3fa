"""Settings in layers: defaults, the user's file, the workspace's file, the environment, and overrides."""

from __future__ import annotations

import json
import os
from pathlib import Path

# The defaults, which decide budgets, caps and presets.
PROFILES = ["full", "editor", "explorer"]
_USUAL = {"include_files": True, "include_tree": True, "tree_mode": "auto", "codemap_usage": "auto", "git_inclusion": "none", "meta_prompts": []}
DEFAULTS = {
    "roots": ["."],
    "profile": "full",
    "budgets": {"discovery": 160_000, "plan": 120_000},
    "caps": {"search_chars": 50_000, "structure_tokens": 6000, "tree_tokens": 10_000, "git_patch_lines": 300, "file_size_bytes": 10_000_000},
    "codemaps": {"languages": ["ts", "tsx", "js", "py", "swift", "go", "rust", "java", "c", "cpp", "c_sharp", "ruby", "php", "dart"], "cache_dir": ".lodestone/codemap-cache"},
    "ignore": {"extra": [], "ios_preset": "auto"},
    "search": {},
    "dynamic_roots": {"enabled": True, "max": 4},
    "tools": {"apply_edits": True, "file_actions": True, "git": True},
    "selection": {"auto_codemaps": True, "persist": True, "scope": "session"},
    "presets": {
        "standard": _USUAL,
        "plan": _USUAL | {"meta_prompts": ["Architect"]},
        "review": _USUAL | {"codemap_usage": "selected", "git_inclusion": "selected", "meta_prompts": ["Review"]},
        "diff-followup": _USUAL | {"include_files": False, "include_tree": False, "tree_mode": "selected", "codemap_usage": "none", "git_inclusion": "diff"},
        "mvp": _USUAL | {"tree_mode": "selected", "meta_prompts": ["MVP"]},
    },
    "packager": {"section_order": ["file_map", "file_contents", "git_diff", "meta_prompts", "user_instructions"], "duplicate_instructions_at_top": False},
    "paths": "relative",
}
PREFIX = "LODESTONE"


def merged(*layers: dict) -> dict:
    """Later layers over earlier ones: mappings meet, lists and values are replaced."""
    result: dict = {}
    for layer in layers:
        for key, value in layer.items():
            both = isinstance(value, dict) and isinstance(result.get(key), dict)
            result[key] = merged(result[key], value) if both else merged(value) if isinstance(value, dict) else list(value) if isinstance(value, list) else value
    return result


def from_environment(env: dict[str, str], defaults: dict = DEFAULTS, path: tuple[str, ...] = ()) -> dict:
    """LODESTONE_SECTION_KEY variables as settings; a value must read as what its default is. Presets have none."""
    found = {}
    for key, default in defaults.items():
        if not path and key == "presets":
            continue
        if isinstance(default, dict):
            if inner := from_environment(env, default, (*path, key)):
                found[key] = inner
            continue
        raw = env.get("_".join((PREFIX, *path, key)).upper())
        if raw is None:
            continue
        name = ".".join((*path, key))
        if isinstance(default, bool):
            if raw not in ("true", "false"):
                raise ValueError(f"{name} must be true or false, not {raw!r}")
            found[key] = raw == "true"
        elif isinstance(default, int):
            try:
                found[key] = int(raw) if raw.strip().lstrip("+-").isdigit() else float(raw)
            except ValueError:
                raise ValueError(f"{name} must be a number, not {raw!r}") from None
            if found[key] != found[key] or found[key] in (float("inf"), float("-inf")):
                raise ValueError(f"{name} must be a number, not {raw!r}")
        elif isinstance(default, list):
            found[key] = [part.strip() for part in raw.split(",") if part.strip()]
        else:
            found[key] = raw
    return found


def _file(path: Path) -> dict:
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}


def load(root: str, overrides: dict | None = None, env: dict[str, str] | None = None, home: str | None = None) -> dict:
    """The settings of a workspace. A file that is missing counts as empty; one that is not JSON is an error."""
    user = Path(home or Path.home()) / ".config" / "lodestone" / "config.json"
    settings = merged(DEFAULTS, _file(user), _file(Path(root) / "lodestone.config.json"), from_environment(dict(os.environ) if env is None else env), overrides or {})
    if settings["profile"] not in PROFILES:
        raise ValueError(f"no such profile: {settings['profile']}")
    return settings
