"""Operator 1, quality rules: line-first cleaning.

Punctuation, navigation and boilerplate rules judge every line; lines that fail go, and a document that loses too much of
its text, or fails the document-level base rules, is rejected. One narrow pass: no shuffle, memory of one Arrow batch.

Defined cases: a null or blank text has no words, so it fails the base rule (fewer than ten words) and its cleaned text is
empty. Repeated rows are judged each on its own. An empty table gives an empty result. Other columns pass through untouched;
result columns are named after the fields of ``JUDGED`` and replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES

SYMBOLS = "#*$%&|<>"

JUDGED = T.StructType(
    [T.StructField(k, T.LongType()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField(k, T.LongType()) for k in ("n_lines", "n_removed_lines", "n_removed_words")]
    + [T.StructField("removed_by", T.StringType()), T.StructField("clean_text", T.StringType())]
)


@dataclass(frozen=True)
class LineRules:
    """Parameters of the line rules and of the document's verdict."""

    min_words: int = 10  # base rule: fewer words fail
    max_repeat_pct: int = 20  # base rule: more words in repeated five-word windows fail, in percent
    max_separator_share: float = 0.2  # navigation: separators among the words of a line
    max_symbol_share: float = 0.3  # punctuation: words of a line that carry symbols
    max_caps_share: float = 0.6  # punctuation: words in capitals, in lines of caps_from words or more
    caps_from: int = 6
    phrase_words: int = 25  # boilerplate: a line has at most so many words for each phrase of page furniture in it
    max_stutter_share: float = 0.3  # boilerplate: words of a line that repeat the word before them
    run_from: int = 60  # punctuation: a line of so many words must hold a sentence mark
    max_lost_share: float = 0.5  # a document that loses more of its words is rejected


SEPARATORS = {b"|", b"||", b"\xc2\xbb", b">", b">>", b"/", b"\xe2\x80\xa2", b"\xc2\xb7", b"<", b"\xe2\x80\xba", b"-", b"::"}
MARKED = re.compile(r"[#*$%&|<>{}\\^~=]{2,}|^[#*$%&|<>{}\\^~=]+$|[A-Za-zÀ-ɏ][#$%*|<>{}]+$")
SENTENCE = re.compile(r"[.!?…。！？؟।;:]")
#: Phrases of page furniture in the corpus's languages, in lower case.
PHRASES = (
    "cookie policy", "cookie settings", "cookie preferences", "accept cookies", "accept all cookies", "all rights reserved", "enable javascript", "terms of use",
    "terms of service", "privacy policy", "skip to content", "skip to main content", "sign in to", "sign in for", "sign up to", "sign up for", "log in to",
    "subscribe to our", "subscribe to the", "share this", "share on", "follow us on", "click here", "read more", "back to top", "lorem ipsum",
    "alle rechte vorbehalten", "cookie-richtlinie", "cookies akzeptieren", "nutzungsbedingungen", "zum inhalt springen", "newsletter abonnieren",
    "tous droits réservés", "accepter les cookies", "politique de confidentialité", "conditions d'utilisation", "aller au contenu",
    "todos los derechos reservados", "aceptar cookies", "aceptar las cookies", "política de privacidad", "política de cookies", "condiciones de uso", "ir al contenido",
)
NOT_SMALL = bytes([*range(65, 91), *range(128, 256)])  # A-Z, and what isn't ASCII
BOILERPLATE = re.compile("|".join(map(re.escape, PHRASES)))


def _searcher() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for p in PHRASES:
        out.add_word(p, p)
    out.make_automaton()
    return out


FINDER = _searcher()


def may_shout(line: str, n: int, rules: LineRules) -> bool:
    """False only if too few of the characters can be capitals for the capitals' rule: a quick test before the exact one."""
    data = line.encode(errors="replace")
    return len(data) - len(data.translate(None, NOT_SMALL)) > rules.max_caps_share * n


def line_fault(line: str, words: list[bytes], rules: LineRules, phrases: bool = True) -> str | None:
    """The rule that a line with words breaks, or None; phrases: whether it may hold any of PHRASES."""
    n = len(words)
    if sum(map(SEPARATORS.__contains__, words)) > rules.max_separator_share * n:
        return "navigation"
    if phrases and n <= rules.phrase_words * len(BOILERPLATE.findall(line.lower())):
        return "boilerplate"
    if n > 3 and sum(map(eq, words, words[1:])) > rules.max_stutter_share * n:
        return "boilerplate"
    if any(c in line for c in "#*$%&|<>{}\\^~="):
        if sum(MARKED.search(w.decode(errors="replace")) is not None for w in words) > rules.max_symbol_share * n:
            return "punctuation"
    if n >= rules.caps_from and may_shout(line, n, rules) and line.count("!") + sum(map(str.isupper, line)) > 20:
        caps = sum(1 for w in line.split() if len(w) > 1 and w.isupper())
        if caps > rules.max_caps_share * n:
            return "punctuation"
    if n >= rules.run_from and not SENTENCE.search(line):
        return "punctuation"
    return None


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window found twice or more in the text."""
    if len(words) < 6:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 5 - max(i, end)
            end = i + 5
    return covered


def judge(text: str | None, rules: LineRules) -> tuple:
    """One row of JUDGED."""
    text = text or ""
    n = len(words := text.encode(errors="replace").split())
    seen: set[str] = set()
    dup = lines = lost_lines = lost = 0
    kept_lines, by = [], Counter()
    phrases = next(FINDER.iter(text.lower()), None) is not None
    for line in text.split("\n"):
        own = line.encode(errors="replace").split()
        if not own:
            kept_lines.append(line)
            continue
        lines += 1
        if line in seen:
            dup += 1
        seen.add(line)
        if fault := line_fault(line, own, rules, phrases):
            by[fault] += 1
            lost_lines, lost = lost_lines + 1, lost + len(own)
        else:
            kept_lines.append(line)
    repeated = repeat_words(words)
    failed = n < rules.min_words or 100 * repeated > rules.max_repeat_pct * n
    kept = not failed and lost <= rules.max_lost_share * n
    chars = len(text) - sum(text.count(c) for c in SPACES)
    marks = sum(text.count(c) for c in SYMBOLS)
    reasons = ",".join(f"{k}:{v}" for k, v in sorted(by.items())) or None
    clean = "\n".join(kept_lines) if lost_lines else text
    return n, chars, marks, dup, repeated, failed, kept, lines, lost_lines, lost, reasons, clean


def judge_documents(docs: DataFrame, text: str = "text", rules: LineRules = LineRules(), prefix: str = "") -> DataFrame:
    """docs with the fields of JUDGED, their names after prefix; clean_text is the text without the lines that failed."""
    at = docs.columns.index(text)
    made_fields = [T.StructField(prefix + f.name, f.dataType) for f in JUDGED]
    names = {f.name.lower() for f in made_fields}
    rest = [c for c in docs.columns if c.lower() not in names]
    schema = T.StructType([docs.schema[c] for c in rest] + made_fields)
    place = [docs.columns.index(c) for c in rest]
    kinds = [pa.bool_() if f.dataType == T.BooleanType() else pa.string() if f.dataType == T.StringType() else pa.int64() for f in JUDGED]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in range(0, b.num_rows, 1000):
                part = b.slice(piece, 1000)
                rows = [judge(x, rules) for x in part.column(at).to_pylist()]
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in place), *made], schema.names)

    return docs.mapInArrow(work, schema)


def stage(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: kept documents, with their cleaned text and its length, in the columns of docs, whatever the names of the others."""
    prefix = "_judged_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    judged = judge_documents(docs, prefix=prefix).filter(F.col(f"{prefix}kept"))
    clean = F.col(f"{prefix}clean_text")
    made = {"text": clean, "n_chars": F.length(clean).cast("long")}
    return judged.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in docs.columns])
