"""Who may use what: profiles, switched-off tools, checked arguments, and roots that are opened on demand."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable
from pathlib import Path

from lodestone.operators.packaging import SECTIONS
from lodestone.plans.config import PROFILES

# The tools, and those that change files.
TOOLS = ["file_search", "read_file", "get_file_tree", "get_code_structure", "manage_selection", "prompt", "workspace_context", "apply_edits", "file_actions", "git"]
MUTATING = ["apply_edits", "file_actions"]
MAX_PATHS, MAX_TREE_TOKENS = 32, 50_000
#: Bounds of this library on what one call of git gives.
MAX_COMMITS, MAX_BLAMED = 1000, 2000


def refusal(tool: str, settings: dict) -> dict | None:
    """Why a tool is not available, or None. A switch in the settings comes before the profile."""
    if tool not in TOOLS:
        return {"code": "unknown_tool", "tool": tool}
    if settings["tools"].get(tool) is False:
        return {"code": "tool_disabled_by_config", "tool": tool, "profile": settings["profile"], "message": f"the settings switch {tool} off"}
    if settings["profile"] == "explorer" and tool in MUTATING:
        return {"code": "tool_disabled_by_profile", "tool": tool, "profile": settings["profile"], "message": f"an explorer may not use {tool}"}
    return None


# The arguments of each tool, with the type or the choices that each one takes. "+" is a number from 1,
# "0" one from 0, "sha" a SHA-256 in lower-case hexadecimal digits, and "!" marks what may not be left out.
ARGUMENTS = {
    "file_search": {"pattern": "text!", "mode": ["auto", "path", "content", "both"], "regex": "flag", "whole_word": "flag", "filters": "map", "contextPaths": "list", "context_lines": "0", "max_results": "+"},
    "read_file": {"path": "text", "paths": "list", "start_line": "number", "limit": "+"},
    "get_file_tree": {"mode": ["auto", "full", "folders", "selected"], "max_depth": "0", "max_tokens": "+", "path": "text"},
    "get_code_structure": {"paths": "list", "scope": ["selected"], "max_results": "+"},
    "manage_selection": {
        "op": ["!", "get", "add", "remove", "set", "clear", "promote", "demote", "save_profile", "load_profile", "list_profiles"], "mode": ["full", "slices", "codemap_only"],
        "paths": "list", "name": "text", "strict": "flag", "slices": "list", "view": ["summary", "files", "content", "codemaps"],
    },
    "workspace_context": {"op": ["snapshot", "export"], "include": "list", "preset": "text", "response_type": "text", "git_diff_text": "string", "git_compare": "string"},
    "prompt": {"op": ["!", "get", "set", "append", "clear"], "text": "string"},
    "apply_edits": {
        "path": "text!", "search": "string", "replace": "string", "edits": "list", "rewrite": "string", "all": "flag", "on_missing": ["error", "create"], "verbose": "flag", "dry_run": "flag", "expected_sha256": "sha",
    },
    "file_actions": {
        "action": ["create", "delete", "move"], "op": ["create", "delete", "move"], "path": "text!", "content": "string", "new_path": "text", "destination": "text", "if_exists": ["error", "overwrite"], "expected_sha256": "sha",
    },
    "git": {
        "op": ["!", "status", "diff", "log", "show", "blame"], "compare": "string", "detail": ["summary", "files", "patches", "full"], "path": "text", "count": "+", "start_line": "+", "end_line": "+", "revspec": "text",
    },
}


def _fits(value: object, rule: str | list[str]) -> bool:
    if isinstance(rule, list):
        return value in rule and value != "!"
    whole = isinstance(value, int) and not isinstance(value, bool)
    return {
        "text": isinstance(value, str) and value != "", "string": isinstance(value, str), "flag": isinstance(value, bool), "list": isinstance(value, list), "map": isinstance(value, dict),
        "number": whole, "0": whole and value >= 0, "+": whole and value > 0, "sha": isinstance(value, str) and re.fullmatch("[a-f0-9]{64}", value) is not None,
    }[rule.rstrip("!")]


def checked(tool: str, arguments: dict) -> dict:
    """The arguments, or a ValueError that says which rule they break: names, types, choices, then what goes together."""
    def need(holds: bool, what: str) -> None:
        if not holds:
            raise ValueError(f"invalid_request: {what}")

    rules = ARGUMENTS[tool]
    for name, value in arguments.items():
        need(name == "root" or name in rules, f"{tool} has no argument {name}")
        need(_fits(value, "text" if name == "root" else rules[name]), f"{name} of {tool} must be {rules.get(name, 'text')}")
    for name, rule in rules.items():
        need("!" not in rule or name in arguments, f"{tool} needs {name}")
    if tool == "read_file":
        need(("path" in arguments) != ("paths" in arguments), "exactly one of path and paths")
        need("paths" not in arguments or 0 < len(arguments["paths"]) <= MAX_PATHS, f"from one to {MAX_PATHS} paths")
    if tool == "get_file_tree":
        need(arguments.get("max_tokens", 1) <= MAX_TREE_TOKENS, f"max_tokens up to {MAX_TREE_TOKENS}")
    if tool == "get_code_structure":
        need("paths" in arguments or "scope" in arguments, "paths, or the scope of the selection")
    if tool == "prompt":
        need(arguments["op"] not in ("set", "append") or "text" in arguments, "a text to set or append")
    if tool == "file_actions":
        need("action" in arguments or "op" in arguments, "an action")
    if tool == "git":
        need(arguments.get("count", 1) <= MAX_COMMITS, f"count up to {MAX_COMMITS}")
        need(arguments.get("end_line", 1) - arguments.get("start_line", 1) < MAX_BLAMED, f"up to {MAX_BLAMED} lines of a blame")
    if tool == "workspace_context":
        need(set(arguments.get("include", [])) <= set(SECTIONS), f"include takes {', '.join(SECTIONS)}")
    if tool == "apply_edits":
        ways = [("rewrite" in arguments), ("edits" in arguments), ("search" in arguments or "replace" in arguments)]
        need(sum(ways) == 1, "exactly one of rewrite, edits, and search with replace")
        need(("search" in arguments) == ("replace" in arguments), "search and replace come together")
        need(all(isinstance(e, dict) and e.get("search") and isinstance(e.get("replace"), str) for e in arguments.get("edits", [])), "edits that search for something and replace it")
    return arguments


def narrower(wanted: str, granted: str) -> str:
    """The profile of a root that is opened: never wider than the process's own."""
    return PROFILES[max(PROFILES.index(wanted), PROFILES.index(granted))]


def valid_root(root: str) -> str:
    """The real path of an absolute, existing folder."""
    path = Path(root)
    if not path.is_absolute():
        raise ValueError("invalid_root: not absolute")
    if not path.exists():
        raise ValueError("invalid_root: does not exist")
    if not path.is_dir():
        raise ValueError("invalid_root: not a directory")
    return str(path.resolve())


class Roots:
    """Contexts by root; the one used longest ago leaves when there are more than `most`."""

    def __init__(self, make: Callable[[str], object], most: int = 4, close: Callable[[object], None] = lambda _: None):
        self.make, self.most, self.close = make, most, close
        self.held: OrderedDict[str, object] = OrderedDict()

    def get(self, root: str) -> object:
        root = valid_root(root)
        if root not in self.held:
            self.held[root] = self.make(root)
        self.held.move_to_end(root)
        while len(self.held) > self.most:
            self.close(self.held.popitem(last=False)[1])
        return self.held[root]
