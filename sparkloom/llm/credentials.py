"""Credentials embedded in source code and configuration (problem 1).

Literals are segmented into dictionary words by Viterbi; what no word explains is the literal's residual. A residual
beside a name (assignment, argument, default, header, remark) that speaks of a credential makes a secret; beside any
other name only a long one does, and known formats of hashes and identifiers are left out. The dictionary is the word list
of a public tokenizer: of fixed size, whatever the corpus.
"""

from __future__ import annotations

import base64
import functools
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.latest import latest_sources
from sparkloom.llm.lexing import TOKENS, extension_of, language_of

#: Word list of a public tokenizer, most frequent first; on every machine at this path.
DICTIONARY = "/opt/tokenizers/word_bpe_49k.json"
SPANS = "file_id bigint, line_no int, kind string, start int, end int"
MASK = "*"

# --- Viterbi --------------------------------------------------------------------------------------------------------

#: Words of this field that the list may lack.
_OWN_WORDS = "changeme redacted passwd pwd kennwort passwort todo tbd localhost apikey auth login hmac dummy placeholder example goes here env a i to of in is it on at by or an as no my we be do go me up us if so id db".split()
_UNKNOWN = 7.0  # cost of a letter that no word explains; a word of rank r costs log(r + 20)


@functools.cache
def dictionary(path: str) -> dict[str, float]:
    with open(path, encoding="utf-8") as f:
        ranks = json.load(f)["model"]["vocab"]
    whole = [w[:-4] for w, _ in sorted(ranks.items(), key=lambda x: x[1]) if w.endswith("</w>")]
    costs = {w: math.log(rank + 20) for rank, w in enumerate(dict.fromkeys(w for w in whole if w.isalpha() and len(w) >= 3))}
    return {w: math.log(2000) for w in _OWN_WORDS} | costs


@functools.cache
def _longest(path: str) -> int:
    return max(map(len, dictionary(path)))


@functools.lru_cache(1 << 16)
def unexplained(letters: str, path: str) -> int:
    """Letters of a lower-case run that its cheapest segmentation leaves outside of words."""
    words, n, longest = dictionary(path), len(letters), _longest(path)
    if letters in words:
        return 0
    cost, rest = [0.0] * (n + 1), [0] * (n + 1)
    for end in range(1, n + 1):
        cost[end], rest[end] = cost[end - 1] + _UNKNOWN, rest[end - 1] + 1
        for begin in range(max(0, end - longest), end - 2):
            c = words.get(letters[begin:end])
            # Three letters are a word by chance more often than not: they must save their cost twice.
            if c is not None and cost[begin] + c + (8 if end - begin == 3 else 0) < cost[end]:
                cost[end], rest[end] = cost[begin] + c + (8 if end - begin == 3 else 0), rest[begin]
    return rest[n]


_RUNS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")


def residual(value: str, path: str) -> int:
    """Letters outside of words, digits, and signs other than separators."""
    letters = sum(unexplained(run.lower(), path) for run in _RUNS.findall(value))
    return letters + len(re.findall(r"\d|[^\w\s.:/,;()-]", value))


# --- Values ---------------------------------------------------------------------------------------------------------

_HASH = re.compile(r"(?i)(?:(?:sha\d{1,3}|md5|blake\w*)[-:=])?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|(?:sha\d{1,3}|md5|h1)[-:=].*")
_PLACEHOLDER = re.compile(
    r"(?i)[$%#]?[{(<\[].*[})>\]]s?|\$\w+|%\w+%|(.)\1*|.*(.)\2{5,}.*|.*\$\{[^}]*\}.*|.*\{\{.*\}\}.*|(?:vault|env|file|ssm|kms|secretsmanager|secretref|keyring|op|arn|ref|aws|gcp|azure)[:+].*"
)
_DUMMY = re.compile(r"(?i)\b(?:your|my|example|sample|dummy|changeme|change|placeholder|insert|todo|tbd|redacted|fake|not.?a.?real|test.?only|xxx+)\b")
_TOKEN = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}|gh[pousr]_\w{30,}|xox[abprs]-[\w-]{10,}|[sr]k_(?:live|test)_\w{16,}|glpat-[\w-]{16,}|AIza[\w-]{35}|\w{2,5}_(?:live|prod)_\w{16,}")
_PLACE = re.compile(r"(?i)(?:[a-z][a-z0-9+.-]*:)?//\S*|data:.*|\.{0,2}/[\w./-]*|[\w.-]+\.(?:com|org|net|io|example|test|invalid|local|internal)(?:[:/].*)?|[\w.+-]+@[\w.-]+")

#: Last words of names that hold credentials, alone or after another word.
_HOLDS = frozenset("password passwords passwd pwd pass passphrase passcode secret secrets token credential credentials creds kennwort passwort pw apikey".split())
_KEYS = frozenset("api signing hmac private secret access deploy encryption auth master account service ssh shared client license".split())


@functools.lru_cache(1 << 14)
def holds_credential(name: str) -> bool:
    """Whether a name's last words (without numbering such as ``_b0``) name a credential."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    while words and (words[-1].isdigit() or len(words[-1]) == 1):
        words.pop()
    if not words:
        return False
    if words[-1] in ("key", "keys"):
        return len(words) > 1 and words[-2] in _KEYS
    return words[-1] in _HOLDS


@functools.lru_cache(1 << 14)
def names_digest(name: str) -> bool:
    words = {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)}
    return bool(words & set("digest checksum etag integrity hash sha md commit rev revision uuid guid fingerprint nonce public cert certificate verify pixel icon font image img logo svg payload blob data table".split()))


def is_secret(value: str, strong: bool, digest: bool, path: str) -> bool:
    """Whether a literal is a credential: beside a name that holds one (``strong``) or beside any other."""
    n = len(value)
    if not n or value.isspace():
        return False
    if _TOKEN.fullmatch(value):
        return not re.search(r"(.)\1{5,}", value)
    if re.search(r"\s", value) or _PLACEHOLDER.fullmatch(value) or _PLACE.fullmatch(value):
        return False
    if strong:
        if re.fullmatch(r"(?:sha\d+|md5)[-:].*", value):
            return False
        rest = residual(value, path)
        return rest > 0 and not (rest <= 3 and _DUMMY.search(value.replace("_", "-"))) and (rest > 1 or n >= 8)
    if digest or n < 16 or _HASH.fullmatch(value) or not re.search(r"\d", value) or not re.search(r"[A-Za-z]", value):
        return False
    if re.search(r"[^\w.:+/=~-]", value):
        return False
    return residual(value, path) >= max(10, n // 2)


# --- Contexts -------------------------------------------------------------------------------------------------------

#: Names bound to a literal, read backwards from its quote, so that what lies between may be of any length.
_NAMED = [
    re.compile(p)
    for p in (
        r"""[^\S\n]*(?:[:,]|>=)[^\S\n]*["']([\w.-]+)["']""",  # "name": or get("NAME",
        r"[^\S\n]*/\*[^\S\n]*[:=]?[^\S\n]*([\w-]+)[^\S\n]*\*/",  # /* pw */
        r"[^\S\n]*(?:\|\||\?\?|ro\b)[^\S\n]*[\"'\])]*([\w$-]+)",  # env.NAME ||
        r"[^\S\n]*(?:[brfuBRFU]{1,2}(?=[^\S\n]*[=:>])|\([\w.]*+|\(etyb\]\[|\(\w+ wen)?[^\S\n]*(?:=:|>=|=|:)[^\S\n]*(?:[\w<>\[\]?| ]+?[^\S\n]*:[^\S\n]*|gnirts[^\S\n]+)?[\"'\])]*([\w$-]+)",
    )
]
_LINE_BEGIN = re.compile(r"[ \t(+]*(?:\n|\Z)")
_BEFORE_BREAK = re.compile(r"\s*(?=[=(:])[( \t]*")
_REMARK = re.compile(
    r"(?i)(?<![\w-])(?:--?)?(?:[\w-]*(?:password|passwort|kennwort|passwd|passphrase|secret|token|credentials?)|pwd|pw|(?:\w+[ _-])?key|schlüssel)\b(?:\s*[:=]\s*|\s+(?:is|was|ist|war|lautet|als|as)\s*:?\s+|\s+)[\"'`]?([^\s\"'`<>]{8,})"
    r"|(?:密码|口令|密钥|令牌|凭据)\s*(?:[:：=]|是|为)?\s*[\"'`“]?([^\s\"'`<>，。；”]{8,})"
    r"|\b(?:login|zugang|account|logon|credentials|user)\b[^:\n]{0,40}:\s*[\w.@-]+\s*[/:|]\s*([^\s\"'`<>]{8,})"
    r"|(?<![\w-])(?:-u|--user)[ =][\"']?[\w.@-]+:([^\s\"'`<>]{6,})"
)
#: A remark holds a credential only with one of these in it.
_SPEAKING = re.compile(r"(?i)pass|key|token|secret|pwd|\bpw\b|credential|kennwort|schlüssel|login|zugang|account|user|-u |[密口令凭]|AKIA|eyJ")
_USERINFO = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@\"'`<>]*:([^\s/@\"'`<>]+)@[\w.\[-]")
_SCHEME = re.compile(r"(?i)(?:\bauthorization\s*[:=]\s*)?\b(bearer|basic|token|apikey)\s+([A-Za-z0-9+/=._~:!*%-]{8,})\s*$")
_HEADED = re.compile(r"(?:[Bb]earer|BEARER|[Bb]asic|BASIC|[Tt]oken|TOKEN|[Aa]pi[Kk]ey|APIKEY)\s+\S{8,}\s*$")
#: ``name=value`` pairs of a connection string.
_PAIRS = re.compile(r"(?:^|(?<=[;\s&?]))([A-Za-z][\w.-]*(?: [A-Za-z][\w.-]*)?)[ \t]*=[ \t]*([^\s;&\"'`<>]+)")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----((?:\\r|\\n|[\sA-Za-z0-9+/=:,*+\"'#;-])*?)(-----END|\Z)")
#: A digit, a sign of passwords, or upper case after lower: what any candidate has.
_MIXED = re.compile(r"[\d!?%*&#^+=@$~]|[a-z][A-Z]|[A-Z]{2}[a-z]|[A-Z]{12}")
_CONTINUED = re.compile(r"""\s*(?:\+|\.\.|\\)?\s*["'`]([^"'`\n]*)["'`]""")
_JOINED = re.compile(r"""\s*\+\s*["'`]([^"'`\n]*)["'`]""")
#: A setting wherever it stands, several on a line.
_QUOTED_SETTING = re.compile(r"""["']([A-Za-z_][\w.-]*)["'][ \t]*:[ \t]*["']([^"'\n]+)["']""")
_SETTING = re.compile(r"""^[ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]+)?["']?([A-Za-z_][\w.-]*)["']?[ \t]*[=:][ \t]*(?:"([^"\n]*)"|'([^'\n]*)'|([^\s"'\n][^\n]*?))[ \t]*,?[ \t]*\r?$""", re.M)


def _decoded(value: str) -> str:
    try:
        return base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("ascii")
    except ValueError:
        return ""


def _inside(text: str, at: int, path: str, remarks: bool, found: list) -> None:
    """Credentials within a literal or remark that starts at ``at``: connection strings, headers, keys, remarks."""
    if "://" in text:
        for m in _USERINFO.finditer(text):
            if not _PLACEHOLDER.fullmatch(m[1]) and residual(m[1], path) > 0:
                found.append(("url", at + m.start(1), at + m.end(1), at + m.start(1)))
    if "-----BEGIN" in text:
        for m in _PRIVATE.finditer(text):
            body = re.sub(r"\\[rn]|[^A-Za-z0-9+/=]", "", m[1])
            if len(body) >= 40 and not re.search(r"(.)\1{15,}", body):
                found.append(("private key", at + m.start(1), at + m.end(1), at + m.start()))
    scheme = _SCHEME.search(text) if _HEADED.search(text) else None
    if scheme:
        value = scheme[2]
        plain = _decoded(value) if scheme[1].lower() == "basic" else ""
        password = plain.partition(":")[2]
        if (password and not _PLACEHOLDER.fullmatch(password)) or (not plain and is_secret(value, True, False, path) and residual(value, path) > 5):
            found.append(("header", at + scheme.start(2), at + scheme.end(2), at + scheme.start(2)))
    if "=" in text and not remarks:
        for m in _PAIRS.finditer(text):
            if holds_credential(m[1].replace(" ", "_")) and is_secret(m[2], True, False, path) and residual(m[2], path) > 1:
                found.append(("pair", at + m.start(2), at + m.end(2), at + m.start(2)))
    if remarks and _SPEAKING.search(text):
        for m in _REMARK.finditer(text):
            value = m[m.lastindex].rstrip(".,;)")
            strong, begin = residual(value, path), at + m.start(m.lastindex)
            if is_secret(value, True, False, path) and strong >= 2 or strong == 1 and re.fullmatch(r"(?:[A-Z][a-z]+){2,}\d", value):
                found.append(("remark", begin, begin + len(value), begin))
        for m in _TOKEN.finditer(text):
            if not re.search(r"(.)\1{5,}", m[0]):
                found.append(("remark", at + m.start(), at + m.end(), at + m.start()))


def _name_before(backwards: str, at: int) -> str | None:
    """Name that the literal is bound to that begins where ``backwards[at:]`` does: from its line or, at a line's beginning,
    from the line before."""
    begins = _LINE_BEGIN.match(backwards, at)
    if begins:
        before = _BEFORE_BREAK.match(backwards, begins.end())
        if not before:
            return None
        at = before.end()
    for pattern in _NAMED:
        m = pattern.match(backwards, at)
        if m:
            return m[1][::-1]
    return None


def spans(text: str, path: str | None, words: str) -> list[tuple[str, int, int, int]]:
    """``(kind, start, end, begins)`` of the credentials in a source: what to mask, and where the literal begins."""
    found: list[tuple[str, int, int, int]] = []
    language, extension = language_of(path), extension_of(path)
    if language is None:
        remarks = re.compile(r"^[ \t]*(?:[#;!]|//)[^\n]*", re.M)
        for m in _SETTING.finditer(text):
            group = next((g for g in (2, 3, 4) if m[g] is not None), 4)
            value = m[group] or ""
            if group == 4 and extension in ("yaml", "yml", "toml"):
                value = re.sub(r"[ \t]+#.*", "", value)
            if value and is_secret(value, holds_credential(m[1]), names_digest(m[1]), words):
                found.append(("setting", m.start(group), m.start(group) + len(value), m.start(group)))
            elif value:
                _inside(value, m.start(group), words, False, found)
        for m in _QUOTED_SETTING.finditer(text):
            if is_secret(m[2], holds_credential(m[1]), names_digest(m[1]), words):
                found.append(("setting", m.start(2), m.end(2), m.start(2)))
        for m in remarks.finditer(text):
            _inside(m[0], m.start(), words, True, found)
        if "-----BEGIN" in text:
            _inside(text if "PRIVATE" in text else "", 0, words, False, found)
        for value in re.finditer(r"(?<![A-Za-z0-9+/])LS0tLS1CRUdJTi[A-Za-z0-9+/=]+", text):
            if "PRIVATE KEY" in _decoded(value[0]):
                found.append(("private key", value.start(), value.end(), value.start()))
        return _distinct(found)
    joined, backwards = 0, text[::-1]
    for m in TOKENS[language].finditer(text):
        token = m[0]
        if m["c"] is not None:
            _inside(token, m.start(), words, True, found)
            continue
        if m.start() < joined or len(token) < 3:
            continue
        quote = 3 if token[:3] in ('"""', "'''") else 1
        value, at = token[quote : -quote or None], m.start() + quote
        if "://" in value or "-----BEGIN" in value or " " in value or "\n" in value:
            _inside(value, at, words, "\n" in value or "--" in value, found)
            continue
        more = _CONTINUED.match(text, m.end())
        if not more and not _MIXED.search(value):
            continue
        name = _name_before(backwards, len(text) - m.start())
        end, whole = m.end(), value
        while more:
            whole, end = whole + more[1], more.end()
            more = _JOINED.match(text, end)
        if name is None:
            # No name tells what it is: only a token's own format does.
            if _TOKEN.fullmatch(whole) and is_secret(whole, False, False, words):
                found.append(("token", at, at + len(value), at))
                joined = end
            continue
        if is_secret(whole, holds_credential(name), names_digest(name), words):
            found.append(("literal", at, at + len(value), at))
            for piece in re.finditer(r"""["'`]([^"'`\n]*)["'`]""", text[m.end() : end]):
                found.append(("", m.end() + piece.start(1), m.end() + piece.end(1), -1))
            joined = end
        elif value.startswith("LS0tLS1CRUdJTi") and "PRIVATE KEY" in _decoded(whole):
            found.append(("private key", at, at + len(value), at))
    return _distinct(found)


def _distinct(found: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    kept, reach = [], -1
    for kind, start, end, begins in sorted(found, key=lambda x: (x[1], -x[2])):
        if end > reach:
            kept.append((kind, start, end, begins))
            reach = end
    return kept


# --- Spark ----------------------------------------------------------------------------------------------------------


def _text(source: bytes) -> str:
    return bytes(source).decode("utf-8", "surrogateescape")


def _located(words: str):
    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, path, source in zip(batch["file_id"], batch["path"], batch["source"]):
                text, line, last = _text(source), 1, 0
                for kind, start, end, begins in spans(text, path, words):
                    if begins >= 0:
                        line, last = line + text.count("\n", last, begins) if begins >= last else text.count("\n", 0, begins) + 1, begins
                        rows.append((file, line, kind, start, end))
            yield pd.DataFrame(rows, columns=["file_id", "line_no", "kind", "start", "end"])

    return locate


def mask(text: str, found: list[tuple[str, int, int, int]]) -> str:
    """The text with every value's characters replaced, except line ends, their escapes, and blanks."""
    parts, last = [], 0
    for _, start, end, _ in found:
        parts += [text[last:start], re.sub(r"(\\[rn])|(\s)|.", lambda m: m[0] if m[1] or m[2] else MASK, text[start:end])]
        last = end
    return "".join([*parts, text[last:]])


def _masked(words: str):
    def redact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sources, counts = [], []
            for path, source in zip(batch["path"], batch["source"]):
                text = _text(source)
                found = spans(text, path, words)
                sources.append(mask(text, found).encode("utf-8", "surrogateescape") if found else bytes(source))
                counts.append(sum(begins >= 0 for *_, begins in found))
            yield batch.assign(source=sources, n_masked=counts)[["file_id", "path", "source", "n_masked"]]

    return redact


def credentials(parsed: DataFrame, words: str = DICTIONARY) -> DataFrame:
    """``(file_id, line_no, kind, start, end)``: a row for each credential, by the line it begins on.

    Lines end at line feeds and count from 1; offsets are characters. Code is read by the language of its path's
    extension, all else (a missing path too) as ``name = value`` settings. A missing or empty source gives no row; of
    repeated parses the latest counts (all of equally late ones); an empty table gives no rows; further columns are ignored.
    """
    return latest_sources(parsed).mapInPandas(_located(words), SPANS)


def credential_lines(found: DataFrame) -> DataFrame:
    return found.select("file_id", "line_no").distinct()


def redacted(parsed: DataFrame, words: str = DICTIONARY) -> DataFrame:
    """``(file_id, path, source, n_masked)``: every source with its credentials' characters replaced by ``*``, all else,
    line ends and syntax included, as it was. Rows as in ``credentials``."""
    return latest_sources(parsed).mapInPandas(_masked(words), "file_id bigint, path string, source binary, n_masked int")
