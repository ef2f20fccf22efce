"""Text functions over columns. All of them are built-in expressions, so filters and pruning pass through and code is generated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Glosses that say nothing.
JUNK_GLOSSES = ("x", "xx", "0", "00", "1", "n", "c", "e", "i", "u", "s", "unmng", "cf")
#: Words left out of co-occurrence.
STOP_WORDS = (
    "the", "of", "and", "in", "to", "a", "is", "was", "for", "on", "with", "his", "her", "its", "their", "he", "she", "it", "they",
    "that", "this", "by", "from", "at", "an", "be", "has", "had", "not", "but", "who", "which", "as", "or", "if", "my", "your",
)
SPACE = r"(?U)\s+"


def subscripts(c: Column) -> Column:
    """Subscript digits as ASCII digits."""
    return F.translate(c, "₀₁₂₃₄₅₆₇₈₉", "0123456789")


def normalize_token(c: Column) -> Column:
    """One spelling of a transliterated token; null becomes the empty string; a second pass changes nothing."""
    x = F.regexp_replace(subscripts(c), r"\{([^}]*)\}", "$1")
    x = F.replace(F.lower(x), F.lit("š"), F.lit("sz"))
    x = F.replace(F.translate(x, "ŋḫṣṭʾ", "jhst"), F.lit("-"), F.lit(""))
    return F.coalesce(F.trim(x), F.lit(""))


def normalize_line(c: Column) -> Column:
    """Subscripts and case only."""
    return F.lower(subscripts(c))


def expand_hyphens(tokens: Column) -> Column:
    """A hyphenated token becomes the joined form followed by its parts."""
    both = lambda t: F.when(t.contains("-"), F.concat(F.array(F.replace(t, F.lit("-"), F.lit(""))), F.split(t, "-"))).otherwise(F.array(t))
    return F.flatten(F.transform(tokens, both))


def is_noise(t: Column) -> Column:
    """P5: empty, led by one of $ % & + ', or a single character that is no letter. (Capitals are no noise: text is lower case by then.)"""
    return (t == "") | F.substring(t, 1, 1).isin("$", "%", "&", "+", "'") | ((F.length(t) == 1) & ~t.rlike(r"^\p{L}$"))


def resolve_marks(line: Column) -> Column:
    """P3, first part: a line after its editorial marks are resolved, in this order; most lines have none and are only tested for them."""
    x = line
    steps = (
        (r"!\([^)]*\)", ""), (r"[\[\]]", ""), (r"<([^>]*)>", "$1"), (r"\|[^|]*\|", ""), (r"\|[A-Z0-9.x+]+", ""), (r"[A-Z0-9.x+]+\|", ""),
        (r"(?U)_[^_\s]*_", ""), (r"(?<!\p{Nd})\(([^)]*)\)", "$1"), (r"[#?!]", ""), (r"\{([^}]*)\}", " $1 "),
    )
    for what, by in steps:
        x = F.regexp_replace(x, what, by)
    return F.when(line.startswith("$"), F.lit("")).when(line.rlike(r"[!\[\]<|_(#?{]"), x).otherwise(line)


def spelled_tokens(x: Column, line: Column | None = None) -> Column:
    """P3-P5 of a line without marks: hyphens, dots that stand by no digit, then spelling and noise.

    None of this looks past white space, so the pieces between a line's blanks give the line's tokens. line, if x is what is left of
    it, is tested for hyphens and dots in its place, as a test of x would run what made it again.
    """
    line = x if line is None else line
    x = F.when(line.contains("-"), F.array_join(expand_hyphens(F.split(x, SPACE)), " ")).otherwise(x)
    x = F.when(line.contains("."), F.regexp_replace(x, r"(?<!\p{Nd})\.(?!\p{Nd})", " ")).otherwise(x)
    return F.coalesce(F.filter(F.split(normalize_line(x), SPACE), lambda t: ~is_noise(t)), F.array().cast("array<string>"))


def clean_tokens(line: Column) -> Column:
    """The tokens of an annotated transliteration line. Resolving marks adds no hyphen or dot."""
    return spelled_tokens(resolve_marks(line), line)


def clean_line(line: Column) -> Column:
    return F.array_join(clean_tokens(line), " ")


def clean_text(lines: Column) -> Column:
    """The cleaned, non-empty lines of a text joined by spaces."""
    return F.array_join(F.filter(F.transform(lines, clean_line), lambda x: x != ""), " ")


def is_junk_gloss(gloss: Column) -> Column:
    """P7."""
    g = F.lower(F.trim(gloss))
    return g.isin(*JUNK_GLOSSES) | (F.length(g) <= 2) | g.rlike(r"^\p{Nd}+$") | g.startswith("~")


def is_multiword(c: Column) -> Column:
    """P10."""
    return c.rlike(r"(?U)[\s_\-]")


def is_junk_token(c: Column) -> Column:
    """P9."""
    return F.length(F.trim(F.coalesce(c, F.lit("")))) <= 1


def morphemes(raw: Column) -> Column:
    """Normalised hyphen parts, none for an unhyphenated token."""
    parts = F.filter(F.transform(F.split(raw, "-"), normalize_token), lambda m: m != "")
    return F.when(raw.contains("-"), parts).otherwise(F.array().cast("array<string>"))


def ngrams(word: Column, low: int, high: int) -> Column:
    """Distinct character n-grams of <word>; lengths beyond it give none."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))
    sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: n <= F.length(marked))
    grams = F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.substring(marked, i, n)))
    return F.array_distinct(F.flatten(grams))


def gloss(word: Column, definition: Column) -> Column:
    """P13: 'word: definition', or the word alone."""
    return F.concat_ws(": ", word, F.nullif(definition, F.lit("")))


def neutralize_entities(xml: Column) -> Column:
    """Entities that XML doesn't define become _name_; default name spaces go."""
    x = F.regexp_replace(xml, r"&(?!amp;|lt;|gt;|quot;|apos;|#)(\w+);", "_$1_")
    return F.regexp_replace(x, r"\sxmlns=\"[^\"]*\"", "")


def source_words(line: Column) -> Column:
    """Distinct source-language words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(r"([a-zA-ZšŠḫḪṭṬṣṢĝĜ]+\d*)"), 1))


def target_words(line: Column) -> Column:
    """Distinct target-language words without stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit("([a-z]+)"), 1))
    return F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))


def escape_cell(c: Column) -> Column:
    """Text that is safe in a Markdown table."""
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def runs(words: Column, n: int) -> Column:
    """Each run of n of words, as an array; words must be a column of its own, as an expression would be evaluated for every place."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.slice(words, i, n))
