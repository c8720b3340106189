"""TypeScript and JavaScript sources: imports, exports and top-level definitions.

Comments, literals and regular expressions are blanked, then statements at the top level are found by their
brackets. A line break ends a statement unless an operator stands before or after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_PLAIN = re.compile(r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*'""")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+*%~^]|\b(?:return|typeof|case))\s*\Z")
_OPEN_END = re.compile(r"(?:[=,+\-*/%&|?:<.(!~^]|\b(?:extends|implements|from|of|in|as|async|default|export|keyof|typeof|type|interface|class|function|const|let|var|new))\s*\Z")
_GOES_ON = re.compile(r"\s*(?:[=+*/%&|?:<>.,()\[{\-]|(?:extends|implements|from|as|instanceof|in)\b)")
_BODY_NEXT = re.compile(r"\s*[{|&\[]")
_DECLARED = re.compile(r"(?:async\s+)?(?P<what>function|class|interface|type)\s+(?P<name>[A-Za-z_$][\w$]*)")
_VARIABLE = re.compile(r"(?:const|let|var)\b(?!\s+enum\b)\s*")
_BOUND = re.compile(r"\s*([A-Za-z_$][\w$]*|\{[^=]*\}|\[[^=]*\])\s*(?=[:=!,;]|\Z)")
_QUOTED = re.compile(r"""["']([^"']*)["']""")
#: Kinds of declarations.
_KINDS = {"function": "Function", "class": "Class", "interface": "Interface", "type": "Type"}


def _template_end(source: str, at: int) -> int:
    """The end of the template literal that starts at ``at``; its ${...} parts may hold further ones."""
    k = at + 1
    while k < len(source):
        if source[k] == "\\":
            k += 2
        elif source[k] == "`":
            return k + 1
        elif source.startswith("${", k):
            k, depth = k + 2, 1
            while k < len(source) and depth:
                plain = _PLAIN.match(source, k)
                if plain or source[k] == "`":
                    k = plain.end() if plain else _template_end(source, k)
                    continue
                depth += (source[k] == "{") - (source[k] == "}")
                k += 1
        else:
            k += 1
    return len(source)


def blanked(source: str) -> str:
    """The text with comments as spaces and literals as underscores between quotes, line breaks kept."""
    out, k = [], 0
    special = re.compile("[\"'`/]")
    while found := special.search(source, k):
        a = found.start()
        out.append(source[k:a])
        plain = _PLAIN.match(source, a)
        if source[a] == "`":
            z = _template_end(source, a)
        elif plain:
            z = plain.end()
        elif source[a] == "/" and _BEFORE_REGEX.search("".join(out[-3:])[-40:]) and (m := _REGEX.match(source, a)):
            z = m.end()
        else:
            out.append(source[a])
            k = a + 1
            continue
        fill = " " if source[a] == "/" and source[a + 1 : a + 2] in ("/", "*") else "_"
        out.append(re.sub(r"[^\n]", fill, source[a:z]))
        k = z
    return "".join([*out, source[k:]])


def statements(code: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each top-level statement of a blanked text."""
    depth, start, k = 0, None, 0
    for k, c in enumerate(code):
        if start is None:
            if c.isspace() or c == ";":
                continue
            start = k
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth = max(0, depth - 1)
        if depth:
            continue
        if c == ";":
            yield start, k
            start = None
        elif c == "}":
            text = code[start : k + 1]
            bound = re.match(r"(?:export\s+)?(?:default\s+)?(?:const|let|var|type|import|export\s*\{)", text)
            if not bound and not _BODY_NEXT.match(code, k + 1):
                yield start, k + 1
                start = None
        elif c == "\n" and not _OPEN_END.search(code[max(start, k - 60) : k]) and not _GOES_ON.match(code, k):
            yield start, k
            start = None
    if start is not None:
        yield start, len(code)


def _parts(text: str) -> Iterator[str]:
    """The parts of a declaration list between commas outside of brackets."""
    depth = angle = at = 0
    for k, c in enumerate(text):
        depth += (c in "{([") - (c in "})]")
        if c == "<" and re.match(r"[\w$]", text[k - 1 : k]) and not re.match(r"[\s=]", text[k + 1 : k + 2]):
            angle += 1
        elif c == ">" and angle and text[k - 1] != "=":
            angle -= 1
        elif c == "," and not depth and not angle:
            yield text[at:k]
            at = k + 1
    yield text[at:]


def parse_script(source: str) -> tuple[list, list, list]:
    """Exported declarations are public; exported constants and lists give no definition."""
    imports, exports, definitions = [], [], []
    code = blanked(source)
    for a, z in statements(code):
        text, blank = source[a:z], code[a:z].rstrip()
        line = source.count("\n", 0, a) + 1
        if re.match(r"import\b(?!\s*[(.])", blank):
            if (path := _QUOTED.search(text)) and path[1]:
                imports.append(path[1])
            continue
        exported = re.match(r"export\s+(?:default\s+)?", blank)
        at = exported.end() if exported else 0
        if m := _DECLARED.match(blank, at):
            what, own = m["what"], text[at : len(blank)]
            if what == "type" and "=" not in blank or what != "type" and "{" not in blank:
                continue
            line = source.count("\n", 0, a + at) + 1
            signature = own.split("{", 1)[0].strip() if what == "function" else own
            definitions.append((m["name"], _KINDS[what], line, "Public" if exported else "Private", signature))
            if exported:
                exports.append(m["name"])
        elif not exported and (m := _VARIABLE.match(blank)):
            for part in _parts(blank[m.end() :]):
                if bound := _BOUND.match(part):
                    definitions.append((bound[1], "Constant", line, "Private", text[: len(blank)]))
    return imports, exports, definitions
