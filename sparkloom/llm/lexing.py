"""Lexical layer shared by the operators on source files.

A source is masked: comments become blanks and literals keep only their quotes, so that brackets, words and operators of
the code can be looked at with plain patterns. Offsets stay as they were; line ends within literals vanish.
"""

from __future__ import annotations

import re
from functools import partial

LANGUAGES = {"py": "python", "js": "typescript", "jsx": "typescript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rb": "ruby"}

_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*(?P<open1>["\n]|\Z)', r"'(?:\\.|[^'\\\n])*(?P<open2>['\n]|\Z)"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)"
_TEMPLATE = r"`(?:\\.|\$\{(?:[^{}`]|`(?:\\.|[^`\\])*`|\{[^{}]*\})*\}|[^`\\])*(?:`|\Z)"
_REGEX = r"(?<=[(,=:\[!&|?{};~])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*"

#: Behind the prefix of a formatted string: its quote. Its fields may hold literals with the same quotes.
_FORMATTED = r"(?:(?<=[fFtT])(?<!\w[fFtT])|(?<=[fFtT][rR])(?<!\w[fFtT][rR])|(?<=[rR][fFtT])(?<!\w[rR][fFtT]))"
_FIELD = r"""\{(?:[^{}"'\\]|"[^"\n]*"|'[^'\n]*'|\{[^{}\n]*\})*\}"""
_FSTRINGS = rf"""{_FORMATTED}(?:"(?!"")(?:\\.|\{{\{{|\}}\}}|{_FIELD}|[^"\\\n{{}}])*"|'(?!'')(?:\\.|\{{\{{|\}}\}}|{_FIELD}|[^'\\\n{{}}])*')"""

#: Comments and literals of each language, the longer forms first. The group ``c`` marks comments.
TOKENS = {
    "python": re.compile(
        r'''(?P<c>\#[^\n]*)|(?P<long>"""(?:\\.|[^\\"]|"(?!""))*(?:"""|\Z)|\'\'\'(?:\\.|[^\\']|'(?!\'\'))*(?:\'\'\'|\Z))|''' + _FSTRINGS + r'''|"(?:\\.|[^"\\\n])*(?P<open1>["\n]|\Z)|'(?:\\.|[^'\\\n])*(?P<open2>['\n]|\Z)''', re.S
    ),
    "typescript": re.compile(rf"(?P<c>//[^\n]*|(?P<block>{_BLOCK}))|{_DOUBLE}|{_SINGLE}|(?P<long>{_TEMPLATE})|(?P<rx>{_REGEX})", re.S),
    "go": re.compile(rf"(?P<c>//[^\n]*|(?P<block>{_BLOCK}))|{_DOUBLE}|{_SINGLE}|(?P<long>`[^`]*(?:`|\Z))", re.S),
    "java": re.compile(rf'(?P<c>//[^\n]*|(?P<block>{_BLOCK}))|(?P<long>"""(?:\\.|[^\\"]|"(?!""))*(?:"""|\Z))|{_DOUBLE}|{_SINGLE}', re.S),
    "ruby": re.compile(
        r"""(?P<c>(?<![\w"'#$])\#[^\n]*|(?P<block>^=begin\b.*?(?:^=end[^\n]*|\Z)))|(?P<long><<(?:[~-](?P<q>['"]?)(?=[A-Z_a-z])|(?=[A-Z]))(?P<tag>\w+)(?:(?<=\w)['"])?[^\n]*\n.*?(?:^[ \t]*(?P=tag)\b|\Z))"""
        r"""|"(?:\\.|\#\{(?:[^{}"]|"(?:\\.|[^"\\])*"|\{[^{}]*\})*\}|[^"\\])*(?P<open1>"|\Z)|'(?:\\.|[^'\\])*(?P<open2>'|\Z)|(?<=[(,=~|&!\[ ])/(?![ =])(?:\\.|[^/\\\n])+/[imx]*|%[wWiI](?:\[[^\]]*\]|\([^)]*\))|\$[!@&~`'+0-9"/]""",
        re.S | re.M,
    ),
}
#: Literals and comments that go on over line ends, by what begins and what ends them.
SPANNING = {
    "python": {'"""': '"""', "'''": "'''"}, "typescript": {"/*": "*/", "`": "`"}, "go": {"/*": "*/", "`": "`"}, "java": {"/*": "*/", '"""': '"""'}, "ruby": {"=begin": "\n=end", '"': '"', "'": "'"},
}


def heredocs(text: str) -> list[str]:
    """States ``<<TAG`` of the here-documents that a Ruby text may hold."""
    return sorted({"<<" + tag for tag in re.findall(r"<<(?:[~-]['\"]?(?=[A-Z_a-z])|(?=[A-Z]))(\w+)", text)})


def goes_on(language: str, fault: str) -> bool:
    """Whether an unended literal or comment may end on a later line."""
    return fault in SPANNING[language] or fault.startswith("<<")


#: What ends a literal or comment that a text begins in, with all that stands before.
_REST = {
    ("python", '"""'): r'(?:\\.|[^\\"]|"(?!""))*"""', ("python", "'''"): r"(?:\\.|[^\\']|'(?!''))*'''", ("java", '"""'): r'(?:\\.|[^\\"]|"(?!""))*"""',
    ("typescript", "`"): r"(?:\\.|\$\{(?:[^{}`]|`(?:\\.|[^`\\])*`|\{[^{}]*\})*\}|[^`\\])*`", ("go", "`"): r"[^`]*`", ("ruby", "'"): r"(?:\\.|[^'\\])*'",
    ("ruby", '"'): r'(?:\\.|\#\{(?:[^{}"]|"(?:\\.|[^"\\])*"|\{[^{}]*\})*\}|[^"\\])*"', ("ruby", "=begin"): r"(?:.*?\n)??=end[^\n]*",
} | {(language, "/*"): r".*?\*/" for language in ("typescript", "go", "java")}
_REST = {key: re.compile(pattern, re.S) for key, pattern in _REST.items()}


def end_of(language: str, state: str, text: str) -> int:
    """Where the literal or comment that a text begins in ends, -1 if it does not."""
    if state.startswith("<<"):
        m = re.search(rf"^[ \t]*{state[2:]}\b", text, re.M)
    else:
        m = _REST[language, state].match(text)
    return m.end() if m else -1


def decoded(source: bytes) -> str:
    """Text of a source: UTF-8 without byte order mark, line ends as line feeds."""
    return source.decode("utf-8", "replace").removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


def extension_of(path: str | None) -> str:
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def language_of(path: str | None) -> str | None:
    """The code language of a path's extension; null for anything else."""
    return LANGUAGES.get(extension_of(path))


def _blank(faults: list[str], m: re.Match) -> str:
    text = m[0]
    if m["c"] is not None:
        if text.startswith("/*") and (len(text) < 4 or not text.endswith("*/")):
            faults.append("/*")
        return re.sub(r"[^\n]", " ", text) if "\n" in text else " " * len(text)
    groups = m.re.groupindex
    if m["open1"] == "\n" or m["open2"] == "\n":
        faults.append("\n")
        return "s" * (len(text) - 1) + "\n"
    if m["open1"] == "" or m["open2"] == "":
        faults.append(text[0])
    elif "long" in groups and m["long"] is not None:
        if text.startswith("<<"):
            if not re.search(rf"\n[ \t]*{m['tag']}\Z", text):
                faults.append("<<" + m["tag"])
            return '"' + "s" * (len(text) - 2) + '"'
        for quote in ('"""', "'''", "`"):
            if text.startswith(quote) and (len(text) < 2 * len(quote) or not text.endswith(quote)):
                faults.append(quote)
    return '"' + "s" * (len(text) - 2) + '"' if len(text) > 1 else "s"


def masked(text: str, language: str) -> tuple[str, list[str]]:
    """The masked text (literals are ``"sss"``) and the unended literals: a line end for one that a line ends."""
    faults: list[str] = []
    return TOKENS[language].sub(partial(_blank, faults), text), faults
