"""Source-code functions: scrubbing, token counts, lexing, comment stripping, tag normalising.

Syntax trees are replaced by per-language lexers behind LineAnalyzer, so that a
real parser can be put in its place. All are plain Python functions with Arrow
wrappers at the end.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql.functions import pandas_udf

#: Languages and their file suffixes.
LANGUAGES = {
    "asm": ["asm"],
    "c": ["c", "h"],
    "cpp": ["cpp", "hpp"],
    "c_sharp": ["cs"],
    "java": ["java"],
    "javascript": ["js", "jsx"],
    "typescript": ["ts"],
    "tsx": ["tsx"],
    "python": ["py"],
    "ruby": ["rb"],
    "go": ["go"],
    "php": ["php"],
    "perl": ["pl", "pm"],
    "cuda": ["cu", "cuh"],
    "html": ["html"],
    "pascal": ["pas", "pp"],
    "powershell": ["ps1"],
    "bash": ["sh", "bash"],
    "rust": ["rs"],
    "swift": ["swift"],
    "css": ["css"],
    "vb_dotnet": ["vb"],
}
SUFFIXES = {s.lower(): name for name, suffixes in LANGUAGES.items() for s in suffixes}

NOT_NEWLINE = re.compile(r"[^\n]")
#: Fixed value: what counts as an encoded blob.
BLOB = re.compile(r"""['"]([A-Za-z0-9+/=\s]{200,})['"]""")
LITERAL = re.compile(r"""(["'])((?:\\.|(?!\1)[^\\\n])*)\1""")


def scrub_blobs(text: str) -> str:
    """Long quoted runs of base64 characters become a note of their length and digest."""

    def note(m: re.Match) -> str:
        inner = m[1].replace("\n", "")
        return f"[ENCODED_BLOB len={len(inner)} sha256={hashlib.sha256(inner.encode()).hexdigest()[:12]}]"

    return BLOB.sub(note, text)


def ascii_literals(text: str) -> str:
    """Characters beyond ASCII go from quoted literals of one line."""
    return LITERAL.sub(lambda m: m[1] + m[2].encode("ascii", "ignore").decode() + m[1], text)


TOKEN = re.compile(r"[^\W\d_]+|\d{1,3}|[^\s\w]+|_+|\n+|\s(?=\s)")


def count_tokens(text: str) -> int:
    """An approximation of byte-pair counts: words count one for each started six characters."""
    return sum(-(-len(t) // 6) if t[0].isalpha() else 1 for t in TOKEN.findall(text))


@dataclass(frozen=True)
class LanguageSpec:
    """line, block: comment marks; strings: quotes; starts: what begins a definition; docstrings: whether lone strings are comments."""

    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    strings: tuple[str, ...] = ('"', "'")
    starts: str = r"(?!)"
    docstrings: bool = False
    calls: re.Pattern = field(default=re.compile(r"\b([A-Za-z_][\w.]*)\s*\("))


_C = r"^(?:[A-Za-z_][\w\s*&:<>,~]*\([^;{}]*\)\s*(?:const\s*)?\{|(?:typedef\s+)?(?:struct|union|enum|class|namespace)\b[^;]*\{|#\s*(?:include|if|ifdef|ifndef|define)\b|template\b)"
_JS = r"^\s*(?:import\b|export\b|(?:async\s+)?function\b|class\b|(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\(?[\w\s,]*\)?\s*=>)"
_JAVA = r"^\s*(?:package\b|import\b|using\b|namespace\b|(?:(?:public|private|protected|static|final|abstract|internal|sealed|override|async|virtual)\s+)*(?:class|interface|enum|struct|@interface)\b|(?:(?:public|private|protected|static|final|abstract|internal|override|async|virtual)\s+)+[\w<>\[\],\s]+\([^;{]*\)\s*(?:throws [\w,\s]+)?\{?)"
SPECS = {
    "asm": LanguageSpec((";", "#"), (), ('"',), r"^\s*[A-Za-z_.$][\w.$]*:"),
    "c": LanguageSpec(starts=_C),
    "cpp": LanguageSpec(starts=_C),
    "cuda": LanguageSpec(starts=_C),
    "c_sharp": LanguageSpec(starts=_JAVA),
    "java": LanguageSpec(starts=_JAVA),
    "javascript": LanguageSpec(strings=('"', "'", "`"), starts=_JS, docstrings=True),
    "typescript": LanguageSpec(strings=('"', "'", "`"), starts=_JS, docstrings=True),
    "tsx": LanguageSpec(strings=('"', "'", "`"), starts=_JS, docstrings=True),
    "python": LanguageSpec(("#",), (), ('"""', "'''", '"', "'"), r"^\s*(?:def|async\s+def|class|import|from)\b", True),
    "ruby": LanguageSpec(("#",), (("=begin", "=end"),), starts=r"^\s*(?:def|class|module|require)\b"),
    "go": LanguageSpec(strings=('"', "'", "`"), starts=r"^(?:package|import|func|type|var|const)\b"),
    "php": LanguageSpec(("//", "#"), starts=r"^\s*(?:namespace|use|(?:abstract\s+|final\s+)?class|interface|trait|(?:public\s+|private\s+|protected\s+|static\s+)*function)\b"),
    "perl": LanguageSpec(("#",), (("=pod", "=cut"),), starts=r"^\s*(?:sub|package|use)\b"),
    "html": LanguageSpec((), (("<!--", "-->"),), (), r"^\s*<(?:script|style|head|body|form|iframe)\b"),
    "pascal": LanguageSpec(("//",), (("{", "}"), ("(*", "*)")), ("'",), r"(?i)^\s*(?:program|unit|uses|procedure|function|type|begin)\b"),
    "powershell": LanguageSpec(("#",), (("<#", "#>"),), starts=r"(?i)^\s*(?:function|class|param|using)\b"),
    "bash": LanguageSpec(("#",), (), starts=r"^\s*(?:function\s+\w+|\w+\s*\(\s*\))"),
    "rust": LanguageSpec(strings=('"',), starts=r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:fn|struct|enum|trait|impl|mod|use|async\s+fn|unsafe\s+fn)\b"),
    "swift": LanguageSpec(strings=('"',), starts=r"^\s*(?:(?:public|private|internal|open|static|final)\s+)*(?:func|class|struct|enum|protocol|extension|import|init)\b"),
    "css": LanguageSpec((), starts=r"^[^\s{}][^{}]*\{|^@\w+"),
    "vb_dotnet": LanguageSpec(("'",), (), ('"',), r"(?i)^\s*(?:(?:public|private|friend|shared)\s+)*(?:imports|namespace|class|module|sub|function|structure|enum)\b"),
}


@lru_cache(maxsize=64)
def marks(spec: LanguageSpec) -> tuple[re.Pattern, dict[str, str], frozenset[str]]:
    """What opens a comment or a string (block comments first, then line comments, then quotes), the ends of block comments, and the line marks."""
    block = dict(spec.block)
    return re.compile("|".join(map(re.escape, [*block, *spec.line, *spec.strings])) or r"(?!)"), block, frozenset(spec.line)


@lru_cache(maxsize=64)
def inside(quote: str) -> re.Pattern:
    """What may stand between a string's quotes; strings of one quote end with their line, but for backticks."""
    stops = re.escape(quote[0]) + "\\\\" + ("\\n" if len(quote) == 1 and quote != "`" else "")
    more = f"(?!{re.escape(quote)}){re.escape(quote[0])}|" if len(quote) > 1 else ""
    return re.compile(f"(?:[^{stops}]+|{more}\\\\.)*+", re.S)


def comment_spans(code: str, language: str) -> list[tuple[int, int]]:
    """Character ranges of comments (and of strings that stand alone, where the language has those), in order."""
    spec = SPECS[language]
    opens, ends, line = marks(spec)
    out, n = [], len(code)
    i = max(1, code.find("\n")) if code.startswith("#!") else 0
    row = seen = 0  # where the line of the last string looked at begins
    while found := opens.search(code, i):
        i, mark = found.start(), found[0]
        if mark in ends:
            stop = code.find(ends[mark], i + len(mark))
            stop = n if stop < 0 else stop + len(ends[mark])
            out.append((i, stop))
        elif mark in line:
            stop = code.find("\n", i)
            stop = n if stop < 0 else stop
            out.append((i, stop))
        else:
            stop = min(n, inside(mark).match(code, i + len(mark)).end() + len(mark))
            if spec.docstrings:
                at = code.rfind("\n", seen, i)
                row, seen = at + 1 if at >= 0 else row, i
                if not code[row:i].strip():
                    after = code.find("\n", stop)
                    after = n if after < 0 else after
                    if code[stop:after].strip() in ("", ";") and last_character(code, row) not in tuple("([{,=+\\"):
                        out.append((i, after))
                        stop = after
        i = stop
    return out


def last_character(code: str, stop: int) -> str:
    """The last character before stop that isn't white space, or an empty string."""
    while stop and code[stop - 1].isspace():
        stop -= 1
    return code[stop - 1 : stop]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(spans: list[tuple[int, int]], start: int, stop: int) -> list[tuple[int, int]]:
    """The ranges without start..stop."""
    return [(a, b) for x, y in spans for a, b in ((x, min(y, start)), (max(x, stop), y)) if a < b]


def strip_comments(code: str, language: str, header_lines: int = 0) -> str:
    """code without its comments; the first header_lines lines and a shebang stay."""
    spans = merged(comment_spans(code, language))
    keep = 0
    for _ in range(header_lines):
        at = code.find("\n", keep)
        keep = len(code) if at < 0 else at + 1
    if keep:
        spans = without(spans, 0, keep)
    pieces, at = [], 0
    for a, b in spans:
        pieces.append(code[at:a])
        at = b
    return "".join([*pieces, code[at:]])


def important_lines(code: str, language: str) -> tuple[list[int], list[int]]:
    """(definition rows, comment rows), 0-based and sorted; definitions inside comments do not count."""
    spans = merged(comment_spans(code, language))
    newlines = [m.start() for m in re.finditer("\n", code)]
    comments: set[int] = set()
    bare, at = [], 0
    for a, b in spans:
        comments.update(range(bisect_left(newlines, a), bisect_left(newlines, max(a, b - 1)) + 1))
        bare += [code[at:a], NOT_NEWLINE.sub(" ", code[a:b])]
        at = b
    start = re.compile(SPECS[language].starts)
    rows = [i for i, line in enumerate("".join([*bare, code[at:]]).split("\n")) if line.strip() and start.search(line)]
    return rows, sorted(comments)


#: The kinds of control structure that a prompt names, and what opens them.
CONTROLS = {"for_statement": r"\b(?:for|foreach)\b", "if_statement": r"\b(?:if|elif)\b", "match_statement": r"\bmatch\b(?=[^=\n]*[:{]\s*$)", "switch_statement": r"\bswitch\b", "while_statement": r"\bwhile\b"}
NOT_CALLS = {"if", "for", "while", "switch", "match", "return", "catch", "elif", "foreach", "function", "sizeof", "def", "and", "or", "not", "in", "until", "unless"}


def syntax_elements(code: str, language: str) -> tuple[list[str], list[str], list[str]]:
    """(callees, control structures, string literals), each distinct and sorted."""
    bare = strip_comments(code, language)
    strings = sorted({m[0] for m in LITERAL.finditer(bare)})
    blank = LITERAL.sub('""', bare)
    calls = sorted({m for m in SPECS[language].calls.findall(re.sub(r"\b(?:def|func|function|fn|sub|class)\s+[\w.]+\s*\(", "(", blank)) if m not in NOT_CALLS})
    controls = sorted(k for k, p in CONTROLS.items() if re.search(p, blank, re.M))
    return calls, controls, strings


#: Words that carry no meaning in a tag.
STOP_WORDS = set("a about after all an and any are as at be been before being between both but by can could did do does each for from had has have he her his how if in into is it its more most no not of on once only or other our out over own per she should so some such than that the their them then there these they this those through to under up was we were what when where which while who why will with would you your".split())


def lemma(word: str) -> str:
    """A rule-based base form."""
    for suffix, put in (("ies", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x")):
        if word.endswith(suffix) and len(word) > len(suffix) + 1:
            return word[: -len(suffix)] + put
    if word.endswith("s") and not word.endswith(("ss", "us", "is")) and len(word) > 3:
        return word[:-1]
    return word


def normalize_tag(text: str) -> str:
    """Lower case, without stop words and punctuation, words in base form."""
    return " ".join(lemma(w) for w in re.findall(r"[^\W_]+", text.lower()) if w not in STOP_WORDS)


def mapped(function, result):
    """A vectorised column function of a function on one or more values; null gives null."""

    @pandas_udf(result)
    def run(first: pd.Series) -> pd.Series:
        return first.map(lambda x: None if x is None else function(x))

    return run
