"""Command line of a workspace: `index`, and every tool by a short name or by its own with JSON arguments.

python -m lodestone.plans.cli search ROOT --pattern Key --regex --max-results 20
python -m lodestone.plans.cli tool ROOT apply_edits '{"path": "a.py", "search": "x", "replace": "y"}'
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.plans import policy, tools

#: Commands by the tool that they call and what they set beforehand.
COMMANDS = {
    "search": ("file_search", {}), "read": ("read_file", {}), "tree": ("get_file_tree", {}), "structure": ("get_code_structure", {}), "select": ("manage_selection", {}), "prompt": ("prompt", {}),
    "context": ("workspace_context", {"op": "snapshot"}), "export": ("workspace_context", {"op": "export"}), "edit": ("apply_edits", {}), "file": ("file_actions", {}), "git": ("git", {}),
}


def parser() -> argparse.ArgumentParser:
    found = argparse.ArgumentParser(prog="lodestone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = found.add_subparsers(dest="command", required=True)
    for name in ("index", "config", "tool", *COMMANDS):
        sub = commands.add_parser(name)
        sub.add_argument("root")
        sub.add_argument("--session", default="default")
        if name == "tool":
            sub.add_argument("name", choices=policy.TOOLS)
            sub.add_argument("arguments", nargs="?", default="{}")
        if name in COMMANDS:
            tool, fixed = COMMANDS[name]
            for argument, rule in policy.ARGUMENTS[tool].items():
                if argument in fixed:
                    continue
                option = f"--{argument.replace('_', '-')}"
                if rule == "flag":
                    sub.add_argument(option, dest=argument, action="store_true", default=None)
                elif rule == "list" and argument in ("paths", "include", "contextPaths"):
                    sub.add_argument(option, dest=argument, nargs="+")
                elif isinstance(rule, list):
                    sub.add_argument(option, dest=argument, choices=[c for c in rule if c != "!"])
                else:
                    sub.add_argument(option, dest=argument, type=int if rule in ("0", "+", "number") else json.loads if rule in ("list", "map") else str)
    return found


def run(spark: SparkSession, asked: argparse.Namespace) -> dict:
    space = tools.Workspace(spark, asked.root, session=asked.session)
    if asked.command == "config":
        return space.settings
    if asked.command == "index":
        return space.files().agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if("is_binary").alias("binary"), F.count_if("likely_generated").alias("generated")).first().asDict()
    if asked.command == "tool":
        return space.call(asked.name, json.loads(asked.arguments))
    tool, fixed = COMMANDS[asked.command]
    return space.call(tool, fixed | {k: v for k in policy.ARGUMENTS[tool] if (v := getattr(asked, k, None)) is not None})


def main(argv: list[str] | None = None) -> None:
    asked = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    print(json.dumps(run(spark, asked), ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
