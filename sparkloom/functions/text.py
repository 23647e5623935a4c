"""Column functions on paths, code and prose; all of them Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Languages by file extension (fixed values).
LANGUAGE_OF = {"py": "python", "js": "typescript", "jsx": "typescript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rb": "ruby"}
#: Words that mark risky code; the strong ones count for themselves (fixed values).
STRONG_WORDS = "eval exec token secret permission acl authorize authorization innerhtml dangerouslysetinnerhtml".split()
RISKY_WORDS = (
    "auth permission acl scope role token secret csrf oauth jwt signature sql deserialize pickle subprocess shell cmd async await promise "
    "thread lock transaction retry queue task cron cache session cookie singleton global"
).split()
#: Further risky words: statements, which count with the blank and the word behind them, and what is no plain word (fixed values).
RISKY_STATEMENTS = "select insert update delete".split()
RISKY_FORMS = [r"yaml\.load", r"feature\s*flag"]
API_WORDS = "export public def class interface type".split()
#: Names by which data enters, acts and is made harmless, by language (fixed values).
TAINT_NAMES = {
    "source": {"python": ["input", "sys.stdin", "flask.request.args", "flask.request.form"], "typescript": ["window.location", "document.cookie", "process.env"], "java": ["System.in", "HttpServletRequest.getParameter"], "go": ["os.Args", "http.Request.Form", "http.Request.Body"], "ruby": ["ARGV", "STDIN", "params"]},
    "sink": {"python": ["subprocess.Popen", "os.system", "eval", "exec", "cursor.execute"], "typescript": ["eval", "Function", "document.write", "innerHTML"], "java": ["Runtime.exec", "ProcessBuilder.start", "Statement.execute"], "go": ["exec.Command", "db.Exec", "template.Execute"], "ruby": ["eval", "system", "exec", "Kernel.send"]},
    "sanitizer": {"python": ["html.escape", "markupsafe.escape"], "typescript": ["DOMPurify.sanitize"], "java": ["ESAPI.encoder().encodeForHTML"], "go": ["template.HTMLEscapeString"], "ruby": ["ERB::Util.html_escape"]},
}


#: Paths that reviews leave out: dependencies, build output, logs, binaries, media and documents (fixed values).
DEFAULT_EXCLUDES = [
    "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml", "**/bun.lockb", "**/Gemfile.lock", "**/Cargo.lock", "**/go.sum", "**/go.mod", "**/poetry.lock", "**/Pipfile.lock", "**/*.lock",
    "**/dist/**", "**/build/**", "**/out/**", "**/.next/**", "**/.nuxt/**", "**/.svelte-kit/**", "**/.cache/**", "**/coverage/**", "**/node_modules/**", "**/generated/**", "**/@generated/**",
    "**/__generated__/**", "**/__generated/**", "**/_generated/**", "**/gen/**", "**/@gen/**", "**/__gen__/**", "**/__gen/**", "**/_gen/**",
    "**/*.log",
    "**/*.exe", "**/*.dll", "**/*.so", "**/*.dylib", "**/*.class", "**/*.o", "**/*.a", "**/*.wasm", "**/*.jar", "**/*.war", "**/*.zip", "**/*.tar", "**/*.gz", "**/*.bz2", "**/*.xz", "**/*.7z", "**/*.rar",
    "**/*.png", "**/*.jpg", "**/*.jpeg", "**/*.gif", "**/*.bmp", "**/*.tiff", "**/*.webm", "**/*.svg", "**/*.pdf", "**/*.doc", "**/*.docx", "**/*.xls", "**/*.xlsx", "**/*.ppt", "**/*.pptx",
    "**/*.ttf", "**/*.otf", "**/*.woff", "**/*.woff2",
]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """Language of a path by its extension (S2); null if unknown."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.try_element_at(known, extension(path))


def plain_path(path: Column) -> Column:
    """Slashes only, without ``./``, ``a/``, ``b/`` and leading slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"^(?:\./+|[ab]/|/+)", "")


def two_levels(path: Column) -> Column:
    """The first two components of a path."""
    return F.substring_index(plain_path(path), "/", 2)


def type_weight(path: Column) -> Column:
    """Weight of a file by its kind: tests 0.4, prose 0.2, configuration 0.6, else 1."""
    p = F.lower(plain_path(path))
    return (
        F.when(p.rlike(r"/test|^tests/|_test\.py$|\.spec\.tsx?$"), 0.4)
        .when(p.rlike(r"\.(md|rst|txt)$"), 0.2)
        .when(p.rlike(r"\.(ya?ml|json|toml|ini|cfg)$"), 0.6)
        .otherwise(1.0)
    )


def words(text: Column, pattern: str = r"[A-Za-z0-9_]+") -> Column:
    """Distinct lower-case ASCII words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern.replace("A-Z", "")), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common among all elements of two sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def _any_word(listed: list[str]) -> str:
    return r"(?i)(?:^|[^A-Za-z0-9_])(?:" + "|".join(listed) + r")(?:[^A-Za-z0-9_]|$)"


def has_word(text: Column, listed: list[str]) -> Column:
    return text.rlike(_any_word(listed))


def count_words(text: Column, listed: list[str]) -> Column:
    """Occurrences of the listed words, each as a whole ASCII word."""
    all_words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.size(F.filter(all_words, lambda w: w.isin(*listed)))


def count_danger(text: Column) -> Column:
    """Occurrences of risky words, statements and forms (E4), by ASCII word bounds."""
    words_ = "|".join([*RISKY_WORDS, *RISKY_FORMS])
    statements = "|".join(RISKY_STATEMENTS)
    return F.regexp_count(text, F.lit(rf"(?i)(?<![A-Za-z0-9_])(?:(?:{words_})(?![A-Za-z0-9_])|(?:{statements})\s(?=[A-Za-z0-9_]))"))


def line_label(start: Column, end: Column) -> Column:
    """A range of lines as ``start:end``, a single line as its number."""
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws(":", start.cast("string"), end.cast("string")))


def asset_key(repo: Column, branch: Column, commit: Column, longest: int = 200) -> Column:
    """Key of a repository's map at a commit (E15); a long one has the start of its MD5 instead of branch and commit."""
    plain = lambda c, missing: F.translate(F.coalesce(F.nullif(c, F.lit("")), F.lit(missing)), "/\\", "__")
    name = F.regexp_replace(plain(repo, "unknown_repo"), r"\.\.", "")
    key = F.concat(F.lit("repo_map_"), name, F.lit("_"), plain(branch, "unknown_branch"), F.lit("_"), plain(commit, "unknown_commit"))
    return F.when(F.length(key) > longest, F.concat(F.lit("repo_map_"), name, F.lit("_"), F.left(F.md5(key), F.lit(12)))).otherwise(key)


def byte_range(node: Column) -> Column:
    """``struct(first, last)`` of a node id ``prefix:first-last``, zeros where it is none."""
    part = lambda k: F.coalesce(F.expr("1") * F.regexp_extract(node, r"^[^:]*:([0-9]+)-([0-9]+)$", k).try_cast("bigint"), F.lit(0))
    return F.struct(part(1).alias("first"), part(2).alias("last"))


def heuristic_summary(text: Column) -> list[Column]:
    """First line and what the code seems to do (E10), with the intended word bounds."""
    first = F.trim(F.substring_index(F.trim(text), "\n", 1))
    effects = "open write delete remove unlink exec eval http socket connect commit rollback".split()
    return [
        first.alias("first_line"),
        has_word(text, ["return"]).alias("has_return"),
        has_word(text, ["raise", "throw"]).alias("may_throw"),
        has_word(text, effects).alias("has_side_effects"),
    ]


def glob_regex(glob: str) -> str:
    """Regular expression of a glob: ``**`` is any depth, the root included, ``*`` stays within a component (Q18)."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + (glob[i] if glob[i].isalnum() or glob[i] in "/_-@" else "\\" + glob[i]), i + 1
    return f"^{out}$"


def any_glob(path: Column, globs: list[str]) -> Column:
    """Whether any glob matches the path: one pattern for all of them."""
    if not globs:
        return F.lit(False)
    return plain_path(path).rlike("|".join(map(glob_regex, globs)))


def excluded(path: Column, globs: list[str] = DEFAULT_EXCLUDES, included: list[str] = []) -> Column:
    """Whether a path is left out (F1): an exclude glob matches and no include glob does."""
    return any_glob(path, globs) & ~any_glob(path, included)


def severity_rank(severity: Column) -> Column:
    s = F.lower(F.trim(severity))
    return F.when(s == "error", 3).when(s == "warning", 2).otherwise(1)


def redacted(text: Column) -> Column:
    """Values behind ``api_key=``, ``token:`` and ``secret=`` replaced."""
    return F.regexp_replace(text, r"(?i)(api[_-]?key|token|secret)([\"']?\s*[:=]\s*[\"']?)[^\s\"',;]+", "$1$2***REDACTED***")


def shortened(text: Column, chars: int) -> Column:
    """At most ``chars`` characters, with the cut length told."""
    cut = F.concat(F.left(text, F.lit(chars)), F.lit("... ["), (F.length(text) - chars).cast("string"), F.lit(" more]"))
    return F.when(F.length(text) > chars, cut).otherwise(text)


def is_binary(source: Column) -> Column:
    """Whether the first 8192 bytes hold a zero byte or under 70 % printable ASCII."""
    head = F.decode(F.substring(source, 1, 8192), "ISO-8859-1")
    printable = F.length(F.regexp_replace(head, r"[^\x09\x0A\x0D\x20-\x7E]", ""))
    return F.instr(head, "\u0000").cast("boolean") | (printable < 0.7 * F.length(head))
