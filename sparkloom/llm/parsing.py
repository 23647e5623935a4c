"""Source files that do not parse (problem 3).

Every file is cut into chunks at line ends. A chunk is summarised, for each lexer state it may be entered in (code, or
one of the literals and comments that go on over lines), by the state it is left in and its brackets that find no partner
within it. Summaries compose associatively; Spark reduces them over a file's chunks in runs of neighbours and hands down
the state and the open brackets that each chunk is entered with. With these each chunk finds its top-level statements and
parses them with local grammars; only statements that cross chunks are put together first. Python's grammar is the ``ast``
module, the others' are the words and operators that may stand next to each other and the heads of top-level statements.

Files of one chunk go through the same functions in the task that reads them; the chunks of longer ones are dealt out.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.latest import latest_sources
from sparkloom.llm.lexing import LANGUAGES, SPANNING, decoded, end_of, goes_on, heredocs, language_of, masked
from sparkloom.sources.shared import written

CODE = ""
#: Characters of a chunk. The verdicts do not depend on it.
CHUNK = 8192
#: A file's verdict if it is one chunk, else its chunks and the states that each may be entered in. ``file_id`` numbers rows,
#: ``of`` is the file's id.
CUT = "file_id bigint, of bigint, lang string, chunk int, n_chunks int, states array<string>, text string, broken boolean"
#: Of a chunk entered in ``enter``: the state it is left in, unpaired brackets, and whether it is broken whatever follows.
SUMMARY = "file_id bigint, lang string, chunk int, n_chunks int, enter string, leave string, closers string, openers string, broken boolean"
ENTRY = "file_id bigint, chunk int, enter string, open string"
#: Statements at a chunk's edges, ``at`` in order, with their masked code; ``begins``: not the rest of one begun before.
EDGE = "file_id bigint, lang string, chunk int, at int, begins boolean, text string, code string, broken boolean"

_PAIRS = ("()", "[]", "{}", "<>")
_OTHER = bytes(set(range(256)) - set(b"()[]{}"))
_RUBY_OPENS = r"(?:(?<=^)|(?<=[;=(|]))[ \t]*(?:class|module|def|if|unless|case|begin|while|until|for)\b(?![ \t]*:)|\bdo\b(?![ \t]*:)|(?<=[=(,|&][ ])(?:if|unless|case|begin|while|until)\b"
_RUBY = re.compile(rf"(?P<o>{_RUBY_OPENS})|(?P<e>(?<![\w.:@$])end\b(?![?!:=]))|(?P<b>[()\[\]{{}}])", re.M)
_RUBY_LOOP = re.compile(r"^([ \t]*(?:while|until|for)\b[^\n]*?)[ \t]do[ \t]*$", re.M)


def _brackets(code: str, language: str) -> str:
    """The code's brackets; Ruby's ``class`` .. ``end`` and the like count as ``<`` and ``>``."""
    if language != "ruby":
        return code.encode("utf-8", "replace").translate(None, _OTHER).decode()
    code = _RUBY_LOOP.sub(r"\1", code)
    return "".join("<" if m.lastgroup == "o" else ">" if m.lastgroup == "e" else m[0] for m in _RUBY.finditer(code))


def _unpaired(brackets: str) -> str:
    before = None
    while before != brackets:
        before = brackets
        for pair in _PAIRS:
            brackets = brackets.replace(pair, "")
    return brackets


def _split(brackets: str) -> tuple[str, str, bool]:
    """Closers, openers, and whether a bracket meets a partner of another kind."""
    rest = _unpaired(brackets)
    closers = re.match(r"[)\]}>]*", rest)[0]
    openers = rest[len(closers) :]
    return closers, openers, bool(re.search(r"[)\]}>]", openers))


def compose(a: tuple[str, str, bool], b: tuple[str, str, bool]) -> tuple[str, str, bool]:
    """Bracket summary of two neighbouring stretches from theirs; associative, with ``("", "", False)`` as unit."""
    closers, openers, broken = _split(a[1] + b[0])
    return a[0] + closers, openers + b[1], a[2] or b[2] or broken


def summary(text: str, language: str, enter: str) -> tuple[str, str, str, bool, str]:
    """``(leave, closers, openers, broken, code)`` of a chunk entered in the state ``enter``; ``code`` is masked."""
    lead = ""
    if enter != CODE:
        at = end_of(language, enter, text)
        if at < 0:
            return enter, "", "", False, ""
        lead, text = " " * at, text[at:]
    code, faults = masked(text, language)
    leave = faults[-1] if faults and goes_on(language, faults[-1]) else CODE
    broken = len(faults) > (leave != CODE)
    closers, openers, mixed = _split(_brackets(code, language))
    return leave, closers, openers, broken or mixed, lead + code


# --- Local grammars -------------------------------------------------------------------------------------------------

_CONFLICT = re.compile(r"^(?:<{7}|>{7}|={7}|\|{7})(?:[ \t].*)?$", re.M)
#: Two words side by side on a line.
_NEIGHBOURS = re.compile(r"\b(?<![$.])([A-Za-z_$][\w$]*+)[ \t]++([A-Za-z_$][\w$]*+|[\"`])")
#: Words that may stand before any other, and those that may stand after any other, on one line (JavaScript).
_BEFORE = frozenset(
    "async await break case catch class const continue default delete do else export extends finally for from function get if import in "
    "instanceof let new of return set static switch throw try typeof var void while with yield as using".split()
)
_AFTER = frozenset("in of instanceof as from extends".split())
#: What no valid program has in its masked code, by language; each pattern begins with what is rare.
_NEVER = {
    "typescript": [
        r":=", r"=[ \t\n]*+[;)\]}]", r"\"[ \t]++\"(?=s|\")", r"class[ \t]++\w++[ \t]*+[<(:;]", r"import[ \t]++(?:static\b|[\w$.]++[ \t]*+;?[ \t]*+$)",
        r"import[ \t]*+\{[^{}]*+\}[ \t]*+[;\n]", r"(?:return|throw|new)[ \t]*+[)\]]",
    ],
    "go": [r"=>", r"=[ \t\n]*+[;)\]}]", r"\"[ \t]++\"(?=s|\")", r"func[ \t]*+[{\[=]", r"\.[ \t]*+[;\]},]"],
    "java": [r":=", r"=>", r"=[ \t\n]*+[;)\]}]", r"\"[ \t]*+\"(?=s|\")", r"class[ \t]++\w++[ \t]*+[(:;]", r"return\b[^;{}]*+\}"],
    "ruby": [
        r":=", r":[ \t]*+$", r"=[ \t\n]*+[;)\]}]", r"\)[ \t]*+=>[ \t]*+\{", r"\}[ \t]*+from\b", r"class[ \t]++\w++[ \t]*+[{(:]", r"throw[ \t]++new\b", r"\"[ \t]*+\n\s*+\"",
        r"import[ \t]*+\(", r"def[ \t]*+$", r"(?<![\w.:@])(?:func|function|const|public|private|export|async)[ \t]++\w++[ \t]*+[\w(]", r"(?<![\w.:@])(?:let|var|const)[ \t]++\w++[ \t]*+=",
    ],
}
_NEVER = {language: [re.compile(p, re.M) for p in patterns] for language, patterns in _NEVER.items()}
#: Heads of top-level statements, and of a file's first one.
_HEADS = {
    "go": (re.compile(r"package\s+\w+\s*;?\s*(?=\n|\Z)"), re.compile(r"(?:import|func|type|var|const)\b")),
    "java": (None, re.compile(r"(?:package|import|public|protected|private|abstract|final|static|sealed|non-sealed|strictfp|class|interface|enum|record|module|open)\b|@|;|void\b|[A-Z]\w*[\w<>,\[\] ]*\s\w+\s*\(")),
}
_FIRST_COLUMN = re.compile(r"^(?=[^\s)\]}])", re.M)
_CLAUSE = re.compile(r"(?:else|elif|except|finally)\b")
_SEMICOLONS = re.compile(r"[()\[\]{}]|;")


def heads(code: str, language: str, depth: int = 0) -> list[int]:
    """Where top-level statements begin in masked code entered with ``depth`` open brackets: at the first column, outside of
    brackets, and in Python neither at a clause of the statement before nor after a backslash."""
    found, last = [], 0
    for m in _FIRST_COLUMN.finditer(code):
        at = m.start()
        if last < at:
            count = code.count
            depth += count("(", last, at) + count("[", last, at) + count("{", last, at) - count(")", last, at) - count("]", last, at) - count("}", last, at)
            last = at
        if depth <= 0 and not (language == "python" and (code[at - 2 : at] == "\\\n" or _CLAUSE.match(code, at))):
            found.append(at)
    return found


def split_units(text: str, code: str, language: str, depth: int = 0) -> list[tuple[bool, str, str]]:
    """``(begins, text, code)`` of the statements of a chunk, what belongs to a statement begun before first. Python's
    decorators are one with what they belong to."""
    cuts = heads(code, language, depth)
    spans = [(True, a, b) for a, b in zip(cuts, [*cuts[1:], len(text)])]
    if not cuts or cuts[0]:
        spans.insert(0, (False, 0, cuts[0] if cuts else len(text)))
    merged: list[tuple[bool, int, int]] = []
    for begins, a, b in spans:
        if language == "python" and merged and merged[-1][0] and code.startswith("@", last):
            merged[-1] = (True, merged[-1][1], b)
        else:
            merged.append((begins, a, b))
        last = a
    return [(begins, text[a:b], code[a:b]) for begins, a, b in merged]


def _is_python(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    return True


def _parts(code: str) -> list[str]:
    """Statements of a line, ended by semicolons outside of brackets."""
    depth, begun, found = 0, 0, []
    for m in _SEMICOLONS.finditer(code):
        c = m[0]
        depth += (c in "([{") - (c in ")]}")
        if c == ";" and depth <= 0:
            found.append(code[begun : m.end()])
            begun = m.end()
    found.append(code[begun:])
    return [x.strip() for x in found if x.strip()]


def grammatical(text: str, code: str, language: str, first: bool = False, last: bool = False) -> bool:
    """Whether the local grammar of its language knows a balanced top-level statement; ``first`` and ``last`` of its file."""
    if language == "python":
        return not text.strip() or _is_python(text)
    if ("<<<<<<<" in code or ">>>>>>>" in code or "=======" in code) and _CONFLICT.search(code):
        return False
    begin, end = code.lstrip()[:2], code.rstrip()[-1:]
    if first and begin[:1] == "<" or last and end and end in "=+*/%&|^,([{.?<-" and not code.rstrip().endswith(("++", "--")):
        return False
    if any(p.search(code) for p in _NEVER[language]):
        return False
    if language == "typescript":
        if first and begin[:1] == "{" and re.match(r"\s*\{\s*\"s*\"\s*:", code):
            return False
        return all(m[1] in _BEFORE or m[2] in _AFTER for m in _NEIGHBOURS.finditer(code))
    if language in _HEADS:
        opening, known = _HEADS[language]
        code = code.strip()
        if opening and first:
            m = opening.match(code)
            if not m:
                return False
            code = code[m.end() :].strip()
        return not code or bool(known.match(code)) or all(map(known.match, _parts(code)))
    return True


def _suspect(code: str, language: str) -> bool:
    """Whether a pattern that no valid statement has is met in the code of several."""
    if ("<<<<<<<" in code or ">>>>>>>" in code or "=======" in code) and _CONFLICT.search(code):
        return True
    if any(p.search(code) for p in _NEVER[language]):
        return True
    return language == "typescript" and not all(m[1] in _BEFORE or m[2] in _AFTER for m in _NEIGHBOURS.finditer(code))


def _sound(units: list[tuple[str, str]], language: str, whole: bool) -> bool:
    """Whether all statements are grammatical; ``whole``: they are a whole file's, so some are its first and its last."""
    stated = [(text, code) for text, code in units if code.strip() or language == "python"]
    n = len(stated) - 1
    if language != "python" and not _suspect("".join(code for _, code in stated), language):
        # No pattern is met anywhere: what depends on a statement's place is left to look at.
        if language not in _HEADS:
            stated = [stated[k] for k in sorted({0, n})] if whole and stated else []
            n = len(stated) - 1
    return all(grammatical(text, code, language, whole and not k, whole and k == n) for k, (text, code) in enumerate(stated))


# --- Spark ----------------------------------------------------------------------------------------------------------


def _chunks(text: str, size: int) -> list[str]:
    """Chunks of at least ``size`` characters, at line ends that no backslash takes back."""
    chunks, begun = [], 0
    while len(text) - begun > size:
        end = text.find("\n", begun + size - 1) + 1
        while end and text[end - 2 : end - 1] == "\\":
            end = text.find("\n", end) + 1
        if not end or end == len(text):
            break
        chunks.append(text[begun:end])
        begun = end
    return [*chunks, text[begun:]]


def _whole(text: str, language: str) -> bool:
    """Whether a file of one chunk is broken."""
    leave, closers, openers, broken, code = summary(text, language, CODE)
    sound = not (broken or leave or closers or openers) and _sound([u[1:] for u in split_units(text, code, language)], language, True)
    # What the masks misread, Python's own grammar knows.
    return not sound and not (language == "python" and _is_python(text))


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _cut(size: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, of, path, source in zip(batch["row"], batch["file_id"], batch["path"], batch["source"]):
                language, text = language_of(path), decoded(bytes(source))
                chunks = _chunks(text, size)
                if len(chunks) == 1:
                    rows.append((file, of, language, 0, 1, None, None, _whole(text, language)))
                    continue
                states = [CODE, *SPANNING[language], *(heredocs(text) if language == "ruby" else [])]
                rows += [(file, of, language, k, len(chunks), states if k else [CODE], chunk, None) for k, chunk in enumerate(chunks)]
            yield _frame(rows, CUT)

    return cut


def _summarised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            for enter in r.states:
                rows.append((r.file_id, r.lang, r.chunk, r.n_chunks, enter, *summary(r.text, r.lang, enter)[:4]))
        yield _frame(rows, SUMMARY)


def _by_group(rows: DataFrame, keys: list[str], order: list[str], work, schema: str) -> DataFrame:
    """``work(key, rows)`` of every group, over sorted partitions: groups are small, and a frame for each would cost more."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, done = None, [], []
        for batch in batches:
            for at, r in zip(zip(*(batch[k] for k in keys)), batch.itertuples(index=False)):
                if at != key and held:
                    done += work(key, held)
                    held = []
                key = at
                held.append(r)
            yield _frame(done, schema)
            done = []
        yield _frame(work(key, held) if held else [], schema)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(each, schema)


def _composed(key: tuple, rows: list) -> list[tuple]:
    """Summaries of a run of neighbouring chunks joined to one per entry state."""
    table = {(r.chunk, r.enter): r for r in rows}
    order = sorted({r.chunk for r in rows})
    done = []
    for enter in sorted(e for k, e in table if k == order[0]):
        state, brackets = enter, ("", "", False)
        for k in order:
            r = table[k, state]
            brackets = compose(brackets, (r.closers, r.openers, r.broken))
            state = r.leave
        done.append((key[0], rows[0].lang, key[1], rows[0].n_chunks, enter, state, *brackets))
    return done


def _handed_down(key: tuple, rows: list) -> list[tuple]:
    """State and open brackets that each chunk of a run is entered with, from those of the run (``state``, ``open``)."""
    table = {(r.chunk, r.enter): r for r in rows}
    state, open_, done = rows[0].state, rows[0].open, []
    for k in sorted({r.chunk for r in rows}):
        done.append((key[0], k, state, open_))
        r = table[k, state]
        open_ = _split(open_ + r.closers)[1] + r.openers
        state = r.leave
    return done


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Checks the statements within each chunk and passes on those at its edges."""
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            code = summary(r.text, r.lang, r.enter)[4].ljust(len(r.text))
            units = split_units(r.text, code, r.lang, len(r.open.replace("<", "")))
            first = next((k for k, u in enumerate(units) if u[0]), len(units))
            inner = units[first + 1 : -1]
            broken = not _sound([u[1:] for u in inner], r.lang, False)
            outer = [*units[: first + 1], *units[max(first + 1, len(units) - 1) :]]
            rows += [(r.file_id, r.lang, r.chunk, k, begins, text, part, broken) for k, (begins, text, part) in enumerate(outer)]
        yield _frame(rows, EDGE)


def _assembled(key: tuple, rows: list) -> list[tuple]:
    """Checks the statements of a file that cross chunks or lie at their edges."""
    language = rows[0].lang
    units: list[list[list[str]]] = []
    for r in rows:
        if units and (not r.begins or language == "python" and units[-1][1][0].startswith("@")):
            units[-1][0].append(r.text)
            units[-1][1].append(r.code)
        else:
            units.append([[r.text], [r.code]])
    broken = any(r.broken for r in rows) or not _sound([("".join(t), "".join(c)) for t, c in units], language, True)
    return [(key[0], language, broken)]


def _reparsed(key: tuple, rows: list) -> list[tuple]:
    return [(key[0], "python", not _is_python("".join(r.text for r in rows)))]


def _long_files(parts: DataFrame, run: int) -> DataFrame:
    """``(file_id, lang, broken)`` of the files cut into chunks: reduction, then statements."""
    verdict = "file_id bigint, lang string, broken boolean"
    spread = parts.select("file_id", "lang", "chunk", "n_chunks", "states", "text").repartition("file_id", "chunk")
    levels = [written(spread.mapInPandas(_summarised, SUMMARY), "chunk-summaries")]
    most = levels[0].agg(F.max("n_chunks")).first()[0] or 0
    while most > 1:
        rows = levels[-1].withColumn("run", F.floor(F.col("chunk") / run).cast("int"))
        levels.append(written(_by_group(rows, ["file_id", "run"], ["chunk"], _composed, SUMMARY), "chunk-runs"))
        most = -(-most // run)
    whole = levels[-1].where(F.col("enter") == CODE).select("file_id", "lang", (F.col("broken") | (F.concat("leave", "closers", "openers") != "")).alias("broken"))
    entries = whole.where("not broken").select("file_id", F.lit(0).alias("chunk"), F.lit(CODE).alias("enter"), F.lit("").alias("open"))
    for level in reversed(levels[:-1]):
        above = entries.select("file_id", F.col("chunk").alias("run"), F.col("enter").alias("state"), "open")
        rows = level.withColumn("run", F.floor(F.col("chunk") / run).cast("int")).join(above, ["file_id", "run"])
        entries = written(_by_group(rows.select("file_id", "run", "chunk", "enter", "leave", "closers", "openers", "state", "open"), ["file_id", "run"], ["chunk"], _handed_down, ENTRY), "chunk-entries")
    edges = spread.join(entries, ["file_id", "chunk"]).mapInPandas(_edges, EDGE)
    judged = whole.where("broken").unionByName(_by_group(edges, ["file_id"], ["chunk", "at"], _assembled, verdict))
    judged = written(judged, "chunk-verdicts")
    # What the masks misread, Python's own grammar knows: its few broken files are parsed whole.
    doubted = judged.where("broken and lang = 'python'").select("file_id")
    again = _by_group(parts.select("file_id", "chunk", "text").join(doubted, "file_id", "left_semi"), ["file_id"], ["chunk"], _reparsed, verdict)
    return judged.where("not (broken and lang = 'python')").unionByName(again)


def unparsable(parsed: DataFrame, chunk: int = CHUNK, run: int = 64) -> DataFrame:
    """``(file_id, lang, broken)`` for every file of a code language.

    A byte order mark and CRLF are valid, and so is an empty source, which gives no row; neither does a missing source, id
    or path, or another extension; of repeated parses the latest counts, all of equally late ones (broken if one is); undecodable
    bytes are replacement characters; further columns are ignored. Files beyond ``chunk`` characters are reduced over their
    chunks, ``run`` neighbours at a time. A statement is parsed as a whole, by one task; a file never is, but for Python files that
    are broken.
    """
    files = latest_sources(parsed, tuple(LANGUAGES))
    # Several rows of equally late parses are files of their own until the end.
    parts = written(files.withColumn("row", F.monotonically_increasing_id()).mapInPandas(_cut(chunk), CUT), "chunks")
    single = parts.where("n_chunks = 1").select("of", "lang", "broken")
    long = parts.where("n_chunks > 1")
    if not long.isEmpty():
        names = long.where("chunk = 0").select("file_id", "of")
        single = single.unionByName(_long_files(long, run).join(names, "file_id").select("of", "lang", "broken"))
    return single.groupBy(F.col("of").alias("file_id"), "lang").agg(F.max("broken").alias("broken"))


def broken_rates(verdicts: DataFrame, files: DataFrame) -> DataFrame:
    """Files, broken files and their share per ``repo_name`` and language."""
    names = files.select("file_id", "repo_name").where("file_id is not null").groupBy("file_id").agg(F.max("repo_name").alias("repo_name"))
    counted = verdicts.join(names, "file_id", "left").groupBy("repo_name", "lang")
    return counted.agg(F.count(F.lit(1)).alias("n_files"), F.count_if("broken").alias("n_broken"), (F.count_if("broken") / F.count(F.lit(1))).alias("broken_rate"))
