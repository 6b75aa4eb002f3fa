"""Column builders over relative POSIX paths: filters, parts, languages, ignore rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import col

# Directories that are never entered, lock files, and the language of each extension.
HARD_IGNORED = [".git", ".hg", ".svn", ".lodestone", "node_modules", "__pycache__", ".gradle", ".idea", ".cargo", "dist", "build", ".DS_Store"]
LOCK_FILES = ["pnpm-lock.yaml", "package-lock.json", "yarn.lock", "bun.lockb", "Cargo.lock", "Gemfile.lock", "Pipfile.lock", "poetry.lock", "composer.lock"]
LANGUAGES = {
    "ts": "ts", "tsx": "tsx", "js": "js", "mjs": "js", "cjs": "js", "py": "py", "go": "go", "rs": "rust", "swift": "swift", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cs": "c_sharp", "rb": "ruby", "php": "php", "dart": "dart",
}
IOS_RULES = ["**/*.xcodeproj", "**/*.xcodeproj/**", "**/Info.plist", "**/*.storyboard", "**/*.xib", "**/*.xcassets/**"]


def any_of(tests: list[Column], otherwise: bool = False) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(otherwise)


def normalised(path: str) -> str:
    """Without one leading ./ or / and without trailing slashes."""
    return re.sub(r"^(\./|/)", "", path.replace("\\", "/")).rstrip("/")


def under(path: Column | str, roots: list[str]) -> Column:
    """Equal to one of the roots or below it. Both tests reach the scan as pushed filters."""
    return any_of([t for r in map(normalised, roots) for t in ((col(path) == r), col(path).startswith(r + "/"))], otherwise=True)


def with_extension(path: Column | str, extensions: list[str]) -> Column:
    return any_of([col(path).endswith(e) for e in extensions], otherwise=True)


def not_excluded(path: Column | str, excludes: list[str]) -> Column:
    """Holds none of the excludes as a substring; their stars count for nothing."""
    return ~any_of([F.contains(col(path), F.lit(e.replace("*", ""))) for e in excludes])


def parts(path: Column | str) -> Column:
    return F.split(col(path), "/")


def base_name(path: Column | str) -> Column:
    return F.element_at(parts(path), -1)


def extension(path: Column | str) -> Column:
    """What follows the last dot of the name, in lower case; empty for none and for a dot that leads the name."""
    return F.lower(F.regexp_extract(base_name(path), "^.+\\.([^.]*)$", 1))


def language(path: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(col(path).endswith("Package.swift"), F.lit("swift")).otherwise(F.try_element_at(known, extension(path)))


def fence(path: Column | str) -> Column:
    """The name that a fenced block of this file carries."""
    return F.coalesce(language(path), F.when(extension(path).isin("md", "markdown"), F.lit("markdown")), extension(path))


def hard_ignored(path: Column | str) -> Column:
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, HARD_IGNORED)))


def rule_to_regex(rule: str) -> tuple[bool, str] | None:
    """(ignores, regular expression over the whole path) of one ignore rule; None for blanks and comments.

    A rule with a slash inside is anchored at its folder, others hold at any depth; a match covers all below it.
    """
    rule = rule.strip()
    if not rule or rule.startswith("#"):
        return None
    ignores = not rule.startswith("!")
    body = rule if ignores else rule[1:]
    only_dirs = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    pattern, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            pattern, i = pattern + "(?:[^/]+/)*", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            pattern, i = pattern + "/.+", i + 3
        elif body[i] == "*":
            pattern, i = pattern + "[^/]*", i + 1
        elif body[i] == "?":
            pattern, i = pattern + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            inner = body[i + 1 : end]
            pattern, i = pattern + "[" + ("^" + inner[1:] if inner[:1] == "!" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            pattern, i = pattern + re.escape(body[i]), i + 1
    below = "/.+" if only_dirs else "(?:/.+)?"
    return ignores, f"^{'' if anchored else '(?:.*/)?'}{pattern}{below}$"


def rebased(folder: str, rule: str) -> list[str]:
    """A rule of an ignore file in `folder`, as rules of the root."""
    rule = rule.strip()
    if not rule or rule.startswith("#") or not folder:
        return [rule] if rule and not rule.startswith("#") else []
    sign, body = ("!", rule[1:]) if rule.startswith("!") else ("", rule)
    body = body.lstrip("/")
    if "/" in body.rstrip("/"):
        return [f"{sign}{folder}/{body}"]
    return [f"{sign}{folder}/{body}", f"{sign}{folder}/**/{body}"]


def ignored(path: Column | str, rules: list[str]) -> Column:
    """Whether the last rule that matches ignores. The rules become one chain of tests."""
    verdict = F.lit(False)
    for found in map(rule_to_regex, rules):
        if found is not None:
            verdict = F.when(col(path).rlike(found[1]), F.lit(found[0])).otherwise(verdict)
    return verdict


def shared_depth(path: Column, other: str) -> Column:
    """How many leading parts a path shares with another."""
    mine, theirs = parts(path), F.array(*map(F.lit, other.split("/")))
    return F.aggregate(
        F.zip_with(mine, theirs, lambda a, b: F.coalesce(a == b, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, same: F.struct((s["n"] + (s["on"] & same).cast("int")).alias("n"), (s["on"] & same).alias("on")), lambda s: s["n"],
    )
