"""Structure of source files: declarations by rules over statements, and what follows from them.

One pass over each file, in Arrow batches: its tokens are joined into whole statements (statements.py), blocks say in
which scope a statement stands, and the rules of its language say what it declares. Files need no shuffle; one task
holds one file's text at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.functions import text as T
from lodestone.operators import budget
from lodestone.operators.statements import Head, statements
from lodestone.sources.versions import Versioned

# Names that are never references, and the token caps of a file's text and of a structure query.
PRIMITIVES = ["String", "Number", "Boolean", "Object", "Array", "Promise", "React"]
FILE_TOKENS, QUERY_TOKENS, MAX_FILES = 2000, 6000, 10
CONTAINERS = ["class", "interface"]
TYPES = ["class", "interface", "alias", "enum"]

_MODS = r"(?:(?:public|private|protected|internal|open|fileprivate|static|final|abstract|sealed|partial|readonly|override|virtual|async|export|default|declare|inline|const|unsafe|extern|pub(?:\([^)]*\))?|mutating|lazy|weak|late|covariant|external|factory|required|native|synchronized|default|new|volatile|transient)\s+)*"
_ID = r"([A-Za-z_$][\w$]*)"
#: (languages, level, kind, expression with the name as its first group). Level 0 is the top (of the file, a namespace
#: or a module), 1 inside a container, -1 anywhere. The first rule that matches a statement decides; one without a kind
#: passes a nested type over with all that it holds.
RULES: list[tuple[str, int, str, str]] = [
    ("ts tsx js", 0, "import", r"^import\b.*?(['\"][^'\"]+['\"]).*$"),
    ("ts tsx js", 0, "export", r"^export\s+(\{[^}]*\}.*|\*.*)$"),
    ("ts tsx js", 0, "export", r"^export\s+(default\b(?!\s+(?:async\s+)?(?:abstract\s+)?(?:class|function|interface)\s*[\w*]).*)$"),
    ("ts tsx js", 0, "class", rf"^{_MODS}class\s+{_ID}"),
    ("ts tsx", 0, "interface", rf"^{_MODS}interface\s+{_ID}"),
    ("ts tsx", 0, "alias", rf"^{_MODS}type\s+{_ID}\s*(?:<[^=]*>)?\s*="),
    ("ts tsx", 0, "enum", rf"^{_MODS}enum\s+{_ID}"),
    ("ts tsx js", 0, "function", rf"^{_MODS}function\s*\*?\s*{_ID}"),
    ("ts tsx js", 0, "function", rf"^{_MODS}(?:const|let|var)?\s*{_ID}\s*(?::[^=]+)?=\s*(?:(?:async\s*)?(?:<[^>]*>\s*)?(?:\(.*?\)|[\w$]+)\s*(?::\s*[^=]+)?=>|(?:async\s+)?function\b)"),
    ("ts js", 0, "var", rf"^(?:export\s+)?(?:declare\s+)?(?:const|let|var)\s+{_ID}"),
    ("ts tsx js java cpp swift dart", 1, "", rf"^{_MODS}(?:class|interface|enum|struct|union|protocol|actor|record)\s+{_ID}"),
    ("ts tsx js", 1, "method", rf"^{_MODS}(?:get\s+|set\s+)?\*?#?{_ID}\??\s*(?:<[^>]*>)?\(.*[{{;,]?\s*$"),
    ("ts tsx js", 1, "property", rf"^{_MODS}#?{_ID}[?!]?\s*(?:[:=;,]|$)"),
    ("py", 0, "import", r"^((?:from\s+\S+\s+)?import\s+.+)$"),
    ("py", 0, "enum", rf"^class\s+{_ID}\s*\([^)]*Enum[^)]*\)\s*:"),
    ("py", 0, "class", rf"^class\s+{_ID}"),
    ("py", 0, "function", rf"^(?:async\s+)?def\s+{_ID}"),
    ("py", 0, "var", rf"^{_ID}\s*(?::[^=]+)?=[^=]"),
    ("py", 1, "method", rf"^(?:async\s+)?def\s+{_ID}"),
    ("py", 1, "property", rf"^{_ID}\s*(?::\s*\S|=[^=])"),
    ("go", 0, "import", r"^import\s+(?:[\w.]+\s+)?([\"`][\w./-]+[\"`])$"),
    ("go", 0, "class", rf"^type\s+{_ID}(?:\[[^\]]*\])?\s+struct\b"),
    ("go", 0, "interface", rf"^type\s+{_ID}(?:\[[^\]]*\])?\s+interface\b"),
    ("go", 0, "method", rf"^func\s*\([^)]*\)\s*{_ID}"),
    ("go", 0, "function", rf"^func\s+{_ID}"),
    ("go", 0, "alias", rf"^type\s+{_ID}\s+"),
    ("go", 0, "var", rf"^(?:var|const)\s+{_ID}"),
    ("go", 1, "method", rf"^{_ID}\("),
    ("go", 1, "property", rf"^{_ID}(?:,\s*\w+)*\s+[\w*\[\].(<]+"),
    ("rust", 0, "import", r"^(?:pub\s+)?(use\s+.+;)$"),
    ("rust", 0, "class", rf"^{_MODS}(?:struct|union)\s+{_ID}"),
    ("rust", 0, "enum", rf"^{_MODS}enum\s+{_ID}"),
    ("rust", 0, "impl", r"^impl\b(?:<[^>]*>)?\s*(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)"),
    ("rust", 0, "alias", rf"^{_MODS}type\s+{_ID}"),
    ("rust", 0, "function", rf"^{_MODS}fn\s+{_ID}"),
    ("rust", 0, "var", rf"^(?:pub(?:\([^)]*\))?\s+)?(?:const|static(?:\s+mut)?)\s+{_ID}"),
    ("rust", 0, "macro", rf"^macro_rules!\s*{_ID}"),
    ("rust", 1, "method", rf"^{_MODS}fn\s+{_ID}"),
    ("rust", 1, "property", rf"^(?:pub(?:\([^)]*\))?\s+)?{_ID}\s*:\s*\S"),
    ("swift", 0, "import", r"^(import\s+.+)$"),
    ("swift", -1, "preview", r"^(#Preview)\b"),
    ("swift", 0, "interface", rf"^{_MODS}protocol\s+{_ID}"),
    ("swift", 0, "enum", rf"^{_MODS}(?:indirect\s+)?enum\s+{_ID}"),
    ("swift", 0, "class", rf"^(?:@\w+\s+)*{_MODS}(?:class|struct|actor|extension)\s+{_ID}"),
    ("swift", 0, "alias", rf"^{_MODS}typealias\s+{_ID}"),
    ("swift", 0, "function", rf"^(?:@\w+\s+)*{_MODS}func\s+{_ID}"),
    ("swift", 0, "var", rf"^{_MODS}(?:let|var)\s+{_ID}"),
    ("swift", 1, "method", rf"^(?:@\w+\s+)*{_MODS}(?:func\s+{_ID}|init\b)"),
    ("swift", 1, "property", rf"^(?:@\w+(?:\([^)]*\))?\s+)*{_MODS}(?:let|var)\s+{_ID}"),
    ("java", 0, "import", r"^(import\s+.+;)$"),
    ("java c_sharp php dart", 0, "interface", rf"^{_MODS}(?:@)?interface\s+{_ID}"),
    ("java", 0, "enum", rf"^(?:@\w+(?:\([^)]*\))?\s+)*{_MODS}enum\s+{_ID}"),
    ("java", 0, "class", rf"^(?:@\w+(?:\([^)]*\))?\s+)*{_MODS}(?:class|record)\s+{_ID}"),
    ("java c_sharp", 1, "method", rf"^(?:@\w+(?:\([^)]*\))?\s+)*(?!return\b|new\b|throw\b|else\b){_MODS}(?:<[^>]+>\s*)?(?:[\w.?]+(?:<.*?>)?(?:\[\])*\??\s+)?{_ID}\s*(?:<[^>]*>\s*)?\([^;]*\)?(?:[^;=]*;?|[^;]*=>.*)\s*$"),
    ("java c_sharp", 1, "property", rf"^(?:@\w+(?:\([^)]*\))?\s+)*(?!return\b|throw\b){_MODS}[\w<>\[\].?]+(?:<.*>)?(?:\[\])*\s+{_ID}\s*(?:(?:=|,).*)?;?$"),
    ("c cpp", -1, "import", r"^#\s*include\s+([<\"][^>\"]+[>\"])"),
    ("c cpp", -1, "macro", rf"^#\s*define\s+{_ID}"),
    ("c cpp", 0, "enum", rf"^(?:typedef\s+)?enum\s+(?:class\s+)?{_ID}"),
    ("c cpp", 0, "class", rf"^(?:typedef\s+)?(?:template\s*<[^>]*>\s*)?(?:struct|class|union)\s+{_ID}\s*(?:final\s*)?(?::[^;]*)?(?:\{{.*)?$"),
    ("c cpp", 0, "alias", rf"^typedef\b.*?\b{_ID}\s*(?:\[[^\]]*\])*;"),
    ("cpp", 0, "alias", rf"^using\s+{_ID}\s*="),
    ("c cpp", 0, "function", rf"^(?!return\b|else\b)(?:[\w:*&<>,]+\s+)+[*&]?(?:\w+::)*{_ID}\s*\([^;]*\)?\s*(?:const)?\s*(?:noexcept)?\s*;?\s*$"),
    ("c", 0, "var", rf"^(?:static\s+|extern\s+|const\s+|unsigned\s+|struct\s+)*[\w*]+\s+\**{_ID}\s*(?:\[[^\]]*\])*\s*(?:(?:=|,).*)?;$"),
    ("cpp", 1, "method", rf"^(?!return\b){_MODS}(?:virtual\s+|explicit\s+)*(?:[\w:*&<>,]+\s+)*[*&~]?{_ID}\s*\([^;]*\)[^;]*[{{;]?\s*$"),
    ("c cpp", 1, "property", rf"^(?:static\s+|const\s+|mutable\s+|unsigned\s+|struct\s+)*[\w:]+(?:<.*>)?[\s*&]+{_ID}\s*(?:\[[^\]]*\])*\s*(?:(?:=|,|:).*)?;$"),
    ("c_sharp", 0, "import", r"^(using\s+[\w.=\s]+;)$"),
    ("c_sharp", -1, "enum", rf"^{_MODS}enum\s+{_ID}"),
    ("c_sharp", -1, "interface", rf"^{_MODS}interface\s+{_ID}"),
    ("c_sharp", -1, "class", rf"^{_MODS}(?:class|struct|record(?:\s+struct)?)\s+{_ID}"),
    ("ruby", -1, "import", r"^(require(?:_relative)?\s+.+)$"),
    ("ruby", -1, "class", rf"^(?:class|module)\s+{_ID}"),
    ("ruby", 0, "function", rf"^def\s+(?:self\.)?{_ID}[?!=]?"),
    ("ruby", 1, "method", rf"^def\s+(?:self\.)?{_ID}[?!=]?"),
    ("ruby", 0, "var", rf"^([A-Z]\w*|\$\w+)\s*="),
    ("ruby", 1, "property", r"^(?:attr_\w+[\s(]+:)([a-z]\w*)"),
    ("ruby", 1, "property", r"^([A-Z]\w*)\s*="),
    ("php", 0, "import", r"^(use\s+[\w\\]+.*;)$"),
    ("php", -1, "enum", rf"^{_MODS}enum\s+{_ID}"),
    ("php", -1, "class", rf"^{_MODS}(?:class|trait)\s+{_ID}"),
    ("php", 0, "function", rf"^{_MODS}function\s+&?{_ID}"),
    ("php", 1, "method", rf"^{_MODS}function\s+&?{_ID}"),
    ("php", 1, "property", rf"^(?!use\b|return\b|case\b){_MODS}(?:\??[\w\\|]+\s+)?\$?{_ID}\s*[=;,]"),
    ("dart", 0, "import", r"^((?:import|export|part)\s+.+;)$"),
    ("dart", 0, "enum", rf"^enum\s+{_ID}"),
    ("dart", 0, "class", rf"^(?:abstract\s+|base\s+|sealed\s+|final\s+)*(?:class|mixin|extension)\s+{_ID}"),
    ("dart", 0, "alias", rf"^typedef\s+{_ID}"),
    ("dart", 0, "function", rf"^(?:[\w<>?,\[\]]+\s+)?{_ID}\s*\([^;]*\)\s*(?:async\s*)?(?:=>.*)?$"),
    ("dart", 1, "method", rf"^{_MODS}(?:[\w<>?,\[\]]+\s+)?(?:get|set)\s+{_ID}\b"),
    ("dart", 1, "method", rf"^{_MODS}(?:[\w<>?,\[\]]+\s+)?{_ID}(?:\.\w+)?\s*\([^;]*\).*$"),
    ("dart", 1, "property", rf"^{_MODS}(?:[\w?]+(?:<.*>)?\??\s+)?{_ID}\s*(?:(?:=|,).*)?;$"),
]
CODEMAP = "path string, text string"
SYMBOL = "path string, line_no int, level int, kind string, name string, container string, signature string"

#: Scopes that hold declarations as the top of a file does.
_OPEN_SCOPE = re.compile(r"^(?:(?:pub(?:\([^)]*\))?|export|declare|inline)\s+)*(?:namespace|module|mod|global)\b|^extern\s+\"C\"")
_HAS_OPEN_SCOPES = ["ts", "tsx", "cpp", "c", "c_sharp", "php", "rust"]
_TOP, _TYPE, _BODY = "top", "type", "body"
#: Languages in which a type may be declared in any block.
_AT_ANY_DEPTH = ["c_sharp", "php", "ruby", "c", "cpp", "swift"]


@cache
def _rules(language: str) -> list[tuple[int, str, re.Pattern]]:
    return [(level, kind, re.compile(pattern)) for languages, level, kind, pattern in RULES if language in languages.split()]


def _hits(head: Head, where: str, language: str, code: str, bare: str) -> tuple[str, str] | None:
    for level, kind, pattern in _rules(language):
        if level == -1 or (level == 0 and where == _TOP) or (level == 1 and where == _TYPE):
            # only imports and exports are told by what literals hold
            if m := pattern.search(code if kind in ("import", "export", "preview") else bare):
                return kind, m.group(1) if m.lastindex else ""
    return None


def _others(bare: str, name: str, language: str) -> list[str]:
    """The further names that a statement declares beside its first one."""
    rest = bare[bare.index(name) + len(name) :]
    if language == "ruby":
        return re.findall(r",\s*:([a-z]\w*)", rest) if bare.startswith("attr_") else []
    if language == "go":
        rest = rest.split("=")[0]
    if language == "py":
        return []
    names, depth = [], 0
    plain = re.sub(r"<[^<>=;()]*>", "", re.sub(r"<[^<>=;()]*>", "", rest))
    for at, sign in enumerate(plain):
        depth += (sign in "([{") - (sign in ")]}")
        if sign == "," and not depth and (m := re.match(r"\s*[*&$]*([A-Za-z_$][\w$]*)\s*(?:[=;,:\[]|$|\s[\w*\[\].]+)", plain[at + 1 :])):
            names.append(m.group(1))
    return names


def declared(text: str, language: str) -> Iterator[tuple[int, int, str, str, str | None, str]]:
    """(line_no, level, kind, name, container, code) of the declarations of one file, in the order of their lines.

    code is the whole head of the declaration: all of it up to its body, with single spaces. A statement that declares
    several names gives a row for each.
    """
    blocks = [(iter(statements(text, language)), _TOP, None, "")]  # those that are open: statements to come, scope, container, what stands before each
    while blocks:
        heads, where, holder, before = blocks[-1]
        for head in heads:
            code, bare = before + head.code, before + head.bare
            if language == "go" and head.opened and where == _TOP and bare in ("import", "type", "var", "const"):
                blocks.append((iter(head.body), _TOP, None, f"{bare} "))
                break
            hit = _hits(head, where, language, code, bare)
            inside, held = _BODY, None
            if hit:
                kind, name = hit
                member = kind in ("method", "property")
                container = holder if member else None
                if language == "go" and kind == "method" and where == _TOP:
                    container = (re.search(r"^func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)", bare) or [None, None])[1]
                if kind:
                    yield head.line, int(where == _TYPE), kind, name, container, code
                if language in ("ts", "tsx", "js") and kind not in ("import", "export") and where == _TOP and bare.startswith("export "):
                    yield head.line, 0, "export", signature(code), None, code
                if kind in ("var", "property") or kind == "function" and language in ("ts", "tsx", "js") and re.match(r"^(?:export\s+)?(?:const|let|var)\b", bare):
                    for other in _others(bare, name, language):
                        yield head.line, int(where == _TYPE), "var" if kind == "function" else kind, other, container, code
                if kind in (*CONTAINERS, "impl"):
                    inside, held = _TYPE, name
            elif language in _HAS_OPEN_SCOPES and where == _TOP and _OPEN_SCOPE.search(bare):
                inside = _TOP
            if head.tail and (m := re.match(r"\**\s*([A-Za-z_]\w*)", head.tail)) and bare.startswith("typedef"):
                yield head.line, 0, "alias", m.group(1), None, f"{code} {head.tail}"
                inside, held = (_TYPE, held or m.group(1)) if re.match(r"typedef\s+(?:struct|union|class)\b", bare) else (inside, held)
            if head.body and (inside != _BODY or language in _AT_ANY_DEPTH):
                blocks.append((iter(head.body), inside, held, ""))
                break
        else:
            blocks.pop()


def symbols(files: DataFrame) -> DataFrame:
    """Declarations: path, line_no, level, kind, name, container (of members) and signature.

    Only files of a known language that are neither binary nor generated are read; oversized ones are. Null contents
    hold nothing.
    """
    for flag in ("is_binary", "likely_generated"):
        if flag in files.columns:
            files = files.where(~F.coalesce(F.col(flag), F.lit(False)))
    read = files.select("path", P.language("path").alias("language"), F.col("content").cast("string").alias("content")).where("language IS NOT NULL AND content IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64).to_pydict()
                rows = [(p, *d, signature(code)) for p, language, text in zip(part["path"], part["language"], part["content"], strict=True) for *d, code in declared(text.replace("\r\n", "\n"), language)]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, shape.types, strict=True)], schema=shape)

    shape = pa.schema([("path", pa.string()), ("line_no", pa.int32()), ("level", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("container", pa.string()), ("signature", pa.string())])
    return read.mapInArrow(run, SYMBOL)


def signature(code: str) -> str:
    """A declaration's head without what opens its body."""
    if (bare := code.rstrip()).endswith("{"):
        code = bare[:-1].rstrip()
    return f"{bare[:-1].rstrip()}:" if (bare := code.rstrip()).endswith(":") else code


def type_index(found: DataFrame) -> DataFrame:
    """(type_name, path) for every type that a file defines."""
    return found.where(F.col("kind").isin(TYPES)).select(F.col("name").alias("type_name"), "path").distinct()


def references(found: DataFrame) -> DataFrame:
    """(path, type_name): capitalised names in a file's declarations, less those it defines and the primitives."""
    named = found.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "name", "container", "signature"), F.lit(r"\b([A-Z]\w*)"), F.lit(1)))).alias("type_name")).distinct()
    return named.where(~F.col("type_name").isin(PRIMITIVES)).join(type_index(found), ["path", "type_name"], "left_anti")


def keep(files: DataFrame, table: Versioned) -> dict[str, int]:
    """Brings a table of declarations (SYMBOL) up to the files (with a stamp): only those that are new or changed are
    read, and what is gone takes its declarations with it, so codemaps, type index and references of the table are those
    of the files as they are. Returns how many paths were added, changed and removed."""
    return table.follow(files, symbols)


def index_table(index: DataFrame) -> DataFrame:
    """type_name with the sorted paths that define it."""
    return index.groupBy("type_name").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def _capped(items: list[str], indent: str, cap: int = FILE_TOKENS) -> list[str]:
    """Lines of a list, cut where their sum of tokens passes the cap, with how many are left out. The first one stays."""
    lines, used, kept = [f"{indent}- {item}" for item in items], 0, 0
    for line in lines:
        used += math.ceil(len(line.encode()) / 4.0 * 1.05)
        if kept and used > cap:
            break
        kept += 1
    return lines[:kept] + ([f"{indent}- ... (+{len(lines) - kept} more)"] if kept < len(lines) else [])


def rendered(path: str, found: list[dict]) -> str:
    """One file's declarations (kind, name, container, shown; in the order of their lines) as text, in a fixed order of
    sections."""
    def named(*kinds: str) -> list[str]:
        return [d["shown"] for d in found if d["kind"] in kinds]

    def listed(title: str, items: list[str], indent: str = "") -> list[str]:
        return [f"{indent}{title}:", *_capped(items, f"{indent}  ")] if items else []

    def section(title: str, kind: str) -> list[str]:
        return ["", *listed(title, named(kind))] if named(kind) else []

    def types(title: str, kind: str) -> list[str]:
        lines = ["", f"{title}:"] if named(kind) else []
        for holder in named(kind):
            own = [d for d in found if d["container"] == holder]
            lines.append(f"  - {holder}")
            for part, of in (("Methods", "method"), ("Properties", "property")):
                lines += listed(part, [d["shown"] for d in own if d["kind"] == of], "    ")
        return lines

    previews = len(named("preview"))
    return "\n".join([
        f"File: {path}", "Imports:", *[f"  - {x}" for x in named("import")], "---", *types("Classes", "class"), *types("Interfaces", "interface"), *section("Type-aliases", "alias"), *section("Functions", "function"),
        *section("Enums", "enum"), *section("Global vars", "var"), *(["", f"Previews: {previews}"] if previews else []), *section("Exports", "export"), *section("Macros", "macro"), "---\n",
    ])


def codemaps(found: DataFrame) -> DataFrame:
    """(path, text): each file's structure as text. A file's declarations meet in one row, never those of two files."""
    numbered = F.concat(F.lit("L"), F.col("line_no").cast("string"), F.lit(": "), F.col("signature"))
    shown = F.when(F.col("kind").isin("method", "function"), numbered).when(F.col("kind") == "property", F.col("signature")).otherwise(F.col("name"))
    rows = found.where("kind <> 'impl'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "kind", "name", "container", shown.alias("shown")))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64).to_pydict()
                texts = [rendered(path, held) for path, held in zip(part["path"], part["s"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part["path"], pa.string()), pa.array(texts, pa.string())], names=["path", "text"])

    return rows.mapInArrow(run, "path string, text string")


def structures(maps: DataFrame, paths: list[str], max_files: int = MAX_FILES, max_tokens: int = QUERY_TOKENS) -> DataFrame:
    """The structures of the first files below the paths, as far as the token cap goes; the first is always there."""
    rows = maps.where(P.under("path", paths)).withColumn("tokens", T.estimate_tokens("text"))
    return budget.choose(rows, ["path"], "tokens", max_tokens, max_files, first_free=True)


def package_manifest(files: DataFrame) -> DataFrame:
    """(path, name, products, dependencies, targets) of Swift package manifests, which a few expressions find."""
    all_of = lambda pattern: F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
    return files.where(F.col("path").endswith("Package.swift")).select(
        "path", F.regexp_extract("content", r"Package\(\s*name:\s*\"([^\"]+)\"", 1).alias("name"), all_of(r"\.(?:library|executable)\(\s*name:\s*\"([^\"]+)\"").alias("products"),
        all_of(r"\.package\([^)]*url:\s*\"([^\"]+)\"").alias("dependencies"), all_of(r"\.(?:target|testTarget|executableTarget)\(\s*name:\s*\"([^\"]+)\"").alias("targets"),
    )


def warm(files: DataFrame, cache_folder: str) -> DataFrame:
    """Brings a codemap table up to date by content hashes: unchanged files stay, changed and new ones are computed, and
    what is gone leaves the table, which so holds each path once.

    Returns one row: cached, computed, skipped. Versioned(spark, cache_folder, CODEMAP).read() gives the codemaps.
    """
    spark = files.sparkSession
    may = P.language("path").isNotNull()
    for flag in ("is_binary", "likely_generated"):
        if flag in files.columns:
            may = may & ~F.coalesce(F.col(flag), F.lit(False))
    total, eligible = files.select(F.count(F.lit(1)), F.count_if(may)).first()
    texts = lambda fresh: fresh.select("path").join(codemaps(symbols(fresh)), "path", "left").select("path", F.coalesce("text", F.lit("")).alias("text"))
    done = Versioned(spark, cache_folder, CODEMAP).follow(files.where(may).withColumn("stamp", F.sha2("content", 256)), texts)
    computed = done["added"] + done["changed"]
    return spark.createDataFrame([(eligible - computed, computed, total - eligible)], "cached long, computed long, skipped long")
