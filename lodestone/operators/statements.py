"""Statements of source code: the declarations' heads as wholes, however they are laid out over lines.

A file's tokens (words, signs, literals; comments are set aside) are joined into statements. A statement ends at its
semicolon, before the brace of its body, or, in languages whose lines end statements, at a line end outside of
brackets that nothing carries over. A bracketed head belongs to the statement; a body is a block of further statements.
Each statement is one Head: its code with single spaces, the lines it spans, and the block that follows it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache

_OF_C, _OF_SHELL = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"#[^\n]*"
_DOUBLE, _SINGLE, _BACKTICK = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?", r"`(?:\\.|[^`\\])*`?"
_TRIPLE = r'"""(?:\\.|.)*?(?:"""|\Z)'
#: What is not code in a language: (comments), (literals, which may span lines).
LITERALS = {
    "ts tsx js": (_OF_C, [r"(?<=[=(,:!&|?\[])[ \t]*/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/*\[\\\n])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\[\\\n])*/", _DOUBLE, _SINGLE, _BACKTICK]),
    "py": (_OF_SHELL, [_TRIPLE, r"\'\'\'(?:\\.|.)*?(?:\'\'\'|\Z)", _DOUBLE, _SINGLE]),
    "ruby": (_OF_SHELL + r"|^=begin\b.*?(?:^=end\b|\Z)", [_DOUBLE, _SINGLE]),
    "go": (_OF_C, [_DOUBLE, _SINGLE, r"`[^`]*`?"]),
    "rust": (_OF_C, [r'r#+".*?(?:"#+|\Z)', r'"(?:\\.|[^"\\])*"?', r"'(?:\\[^\n]+?|[^'\\\n])'"]),
    "c_sharp": (_OF_C, [_TRIPLE, r'\$?@\$?"(?:""|[^"])*"?', _DOUBLE, _SINGLE]),
    "php": (_OF_C + r"|#(?!\[)[^\n]*", [r'"(?:\\.|[^"\\])*"?', r"'(?:\\.|[^'\\])*'?"]),
    "swift": (_OF_C, [_TRIPLE, _DOUBLE]),
    "java dart c cpp": (_OF_C, [_TRIPLE, _DOUBLE, _SINGLE]),
}
#: Languages whose lines end a statement where nothing is open, and signs at a line's end or start that carry it over.
BY_LINE = ["ts", "tsx", "js", "go", "swift", "ruby", "py"]
_GOES_ON = re.compile(r"(?:[-=+*/%&|^<,.?:~(\[]|=>|->|\b(?:extends|implements|where|throws|throw|return|else|in|of|as|and|or|not|from|import))$")
_CARRIED = re.compile(r"^(?:[.?:=&|+*/%^<>)\],]|-(?!-)|=>|\{|(?:extends|implements|where|throws|from|as|else)\b)")
#: Languages whose blocks come from indentation or end words instead of braces.
INDENTED = ["py", "ruby"]


@dataclass
class Head:
    """A statement up to its body: its code, the same without literals' contents, its first line, and what its body holds."""

    code: str
    bare: str
    line: int
    opened: bool = False
    body: list[Head] = field(default_factory=list)
    tail: str = ""  # what follows the body up to the semicolon, where a type's body names something


@cache
def _tokens(language: str) -> re.Pattern:
    comments, literals = next(v for k, v in LITERALS.items() if language in k.split())
    directive = r"(?P<directive>^[ \t]*#[^\n\\]*(?:\\.[^\n\\]*)*)|" if language in ("c", "cpp") else ""
    return re.compile(rf"{directive}(?P<comment>{comments})|(?P<literal>{'|'.join(literals)})|(?P<line>\n)|(?P<sign>[][(){{}};,])|(?P<rest>[^][(){{}};,\n\"'`/#]+|.)", re.DOTALL | re.MULTILINE)


def spaced(code: str) -> str:
    return " ".join(code.split())


class _Open:
    """A block while it is read, and the statement that is open in it."""

    def __init__(self, head: Head | None, closer: str = "}"):
        self.head, self.closer = head, closer
        self.found: list[Head] = []
        self.typed: Head | None = None
        self.clear()

    def clear(self) -> None:
        self.code, self.bare, self.line, self.depth = [], [], 0, 0

    def add(self, code: str, bare: str, line: int) -> None:
        if not self.code and not code.strip():
            return
        if not self.code:
            self.line = line
        self.code.append(code)
        self.bare.append(bare)

    def close(self, opened: bool = False) -> Head | None:
        head = Head(spaced("".join(self.code)), spaced("".join(self.bare)), self.line, opened) if self.code else None
        self.clear()
        typed, self.typed = self.typed, None
        if head is not None and typed is not None and not opened:
            typed.tail = head.bare
            return None
        if head is not None and (head.code or opened):
            self.found.append(head)
            return head
        return None


def statements(text: str, language: str) -> list[Head]:
    """The statements of a file's top level, each with those of its body."""
    if language in INDENTED:
        return _indented(text, language)
    by_line = language in BY_LINE
    if language == "php":
        text = re.sub(r"<\?(?:php\b|=)|\?>", lambda m: " " * len(m.group()), text)
    top = _Open(None)
    stack, values, line = [top], [], 1  # values: depths of braces that belong to a statement (object literals, imports)
    tokens = list(_tokens(language).finditer(text))
    for at, m in enumerate(tokens):
        now, kind, raw = stack[-1], m.lastgroup, m.group()
        if kind == "comment":
            now.add(" ", " ", line)
        elif kind == "directive":
            now.close()
            now.add(raw.replace("\\\n", " "), raw.replace("\\\n", " "), line)
            now.close()
        elif kind == "literal":
            now.add(raw, raw[0] + raw[-1] if len(raw) > 1 else raw, line)
        elif kind == "line":
            if by_line and not now.depth and now.code and not _carried(now, tokens, at):
                now.close()
            else:
                now.add(" ", " ", line)
        elif raw == "(" and language == "go" and not now.depth and spaced("".join(now.bare)) in ("import", "type", "var", "const"):
            stack.append(_Open(now.close(opened=True), ")"))
        elif raw in ")" and kind == "sign" and len(stack) > 1 and now.closer == ")" and not now.depth:
            now.close()
            stack.pop().head.body = now.found
        elif raw in "([" and kind == "sign":
            now.depth += 1
            now.add(raw, raw, line)
        elif raw in ")]" and kind == "sign":
            now.depth = max(0, now.depth - 1)
            now.add(raw, raw, line)
            if raw == "]" and not now.depth and language in ("rust", "c_sharp") and re.match(r"\s*(?:#!?\s*)?\[", "".join(now.bare)):
                now.clear()  # an attribute
        elif kind == "sign" and raw == "{":
            if now.depth or _is_value(now, language):
                now.depth += 1
                values.append((len(stack), now.depth))
                now.add(raw, raw, line)
            else:
                head = now.close(opened=True) or Head("", "", line, True)
                if head not in now.found[-1:]:
                    now.found.append(head)
                stack.append(_Open(head))
        elif kind == "sign" and raw == "}":
            if values and values[-1] == (len(stack), now.depth):
                values.pop()
                now.depth -= 1
                now.add(raw, raw, line)
                if by_line and not now.depth and language == "swift" and not _carried(now, tokens, at):
                    now.close()
            elif len(stack) > 1:
                now.close()
                done = stack.pop()
                while values and values[-1][0] > len(stack):
                    values.pop()
                done.head.body = done.found
                if language in ("c", "cpp") and re.match(r"(?:typedef|static|const|extern|struct|union|enum|class)\b", done.head.bare) and "(" not in done.head.bare:
                    stack[-1].typed = done.head
        elif kind == "sign" and raw == ";":
            if now.depth:
                now.add(raw, raw, line)
            else:
                now.add(raw, raw, line)
                now.close()
        elif raw == "," and not now.depth and now.head is not None and _LISTS.match(now.head.bare) and not _in_angles("".join(now.bare)):
            now.add(raw, raw, line)
            now.close()
        else:
            now.add(raw, raw, line)
            if language in ("cpp", "swift", "java", "c_sharp", "dart", "php") and raw.rstrip().endswith(":") and re.fullmatch(r"\s*(?:public|private|protected)\s*:\s*", "".join(now.bare)):
                now.clear()
        line += raw.count("\n")
    while stack:
        done = stack.pop()
        done.close()
        if done.head is not None:
            done.head.body = done.found
    return top.found


#: Heads whose body parts its members by commas.
_LISTS = re.compile(r"(?:pub(?:\([^)]*\))?\s+|export\s+|default\s+|declare\s+)*(?:struct|union|interface)\b")


def _in_angles(bare: str) -> bool:
    plain = re.sub(r"[-=]>", "", bare)
    return plain.count("<") > plain.count(">")


def _carried(now: _Open, tokens: list[re.Match], at: int) -> bool:
    """Whether a statement goes on in the next line, by its last sign or the next line's first."""
    if _GOES_ON.search("".join(now.bare[-3:]).rstrip()):
        return True
    for m in tokens[at + 1 :]:
        if m.lastgroup in ("line", "comment") or not m.group().strip():
            continue
        return bool(_CARRIED.match(m.group().lstrip()))
    return False


def _is_value(now: _Open, language: str) -> bool:
    """Whether a brace opens a value or a list of names, and not a body."""
    bare = spaced("".join(now.bare))
    if language in ("ts", "tsx", "js"):
        if re.match(r"(?:import|export)\b(?: type)?$", bare) or re.match(r"(?:import|export)\s+(?:type\s+)?[\w$]+\s*,$", bare) or re.search(r"(?:^|\s)(?:const|let|var)$", bare):
            return True
        return bool(re.search(r"(?:[=:,?|&<]|\breturn)$", bare)) and not bare.endswith("=>")
    if language == "rust":
        return bool(re.match(r"(?:pub(?:\([^)]*\))?\s+)?use\b", bare))
    if language == "go":
        return bool(re.search(r"[=,]\s*(?:[\w.*&\[\]]+)?$", bare) or "=" in bare and re.search(r"\b(?:interface|struct)$", bare)) and not re.match(r"func\b", bare)
    if language == "php":
        return bool(re.match(r"use\b.*\\$", bare))
    if language in ("c", "cpp", "java", "c_sharp", "dart"):
        return bool(re.search(r"=(?:\s*new\b.*)?$|=>$", bare))
    return language == "swift" and bool(re.search(r"=$", bare))


_RUBY_OPENS = re.compile(r"^(?:class|module|def|if|unless|case|while|until|for|begin)\b|\bdo(?:\s*\|[^|]*\|)?$|=\s*(?:if|unless|case|begin)\b")
_RUBY_ONE_LINE = re.compile(r"^def\s+[^=]*?(?:\([^)]*\))?\s+=\s|;\s*end$|\bend$")


def _indented(text: str, language: str) -> list[Head]:
    """Statements of Python by their indentation, of Ruby by the words that open and end blocks."""
    lines: list[tuple[int, Head]] = []
    code, bare, first, depth, line = [], [], 0, 0, 1
    for m in _tokens(language).finditer(text + "\n"):
        kind, raw = m.lastgroup, m.group()
        if kind == "comment":
            pass
        elif kind == "line" and not depth and not "".join(bare).rstrip().endswith(("\\", ",") if language == "ruby" else "\\"):
            whole = "".join(code)
            if whole.strip():
                lines.append((len(whole) - len(whole.lstrip()), Head(spaced(whole.replace("\\\n", " ")), spaced("".join(bare).replace("\\\n", " ")), first)))
            code, bare, first = [], [], 0
        else:
            if kind == "sign":
                depth = max(0, depth + (raw in "([{") - (raw in ")]}"))
            if raw.strip() and not first:
                first = line
            code.append(raw)
            bare.append(raw[0] + raw[-1] if kind == "literal" and len(raw) > 1 else raw)
        line += raw.count("\n")
    if "".join(code).strip():
        lines.append((0, Head(spaced("".join(code)), spaced("".join(bare)), first)))
    return _by_indent(lines) if language == "py" else _by_end(lines)


def _by_indent(lines: list[tuple[int, Head]]) -> list[Head]:
    top: list[Head] = []
    held: list[tuple[int, Head]] = []
    for indent, head in lines:
        while held and held[-1][0] >= indent:
            held.pop()
        (held[-1][1].body if held else top).append(head)
        if m := re.match(r"((?:class|async def|def)\b[^:]*?(?:\(.*\))?[^:]*:)\s*(\S.*)$", head.bare):
            if "(" not in m.group(2) or m.group(2).count("(") == m.group(2).count(")"):  # the body is on the same line
                head.body.append(Head(m.group(2), m.group(2), head.line))
        head.opened = head.bare.endswith(":")
        if head.opened:
            held.append((indent, head))
    return top


def _by_end(lines: list[tuple[int, Head]]) -> list[Head]:
    top: list[Head] = []
    held: list[Head] = []
    for _, head in lines:
        if re.match(r"end\b", head.bare):
            held = held[:-1]
            continue
        (held[-1].body if held else top).append(head)
        if _RUBY_OPENS.search(head.bare) and not _RUBY_ONE_LINE.search(head.bare):
            head.opened = True
            held.append(head)
    return top
