"""Text functions: Column in, Column out, all inside whole-stage code generation."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and their bare letters, by the decomposition rule of Unicode.
_MARKED = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]

#: Words at the end of a title that name a product variant, compounds of two words first.
TRAILING_QUALIFIERS = ("merlinedition", "vaultedition", "limitededition", "standardedition", "remake", "pinball", "gamekit", "deposit", "edition")
#: Words that carry no meaning in a suggestion query.
STOP_WORDS = ("a", "an", "and", "are", "at", "by", "can", "do", "does", "for", "from", "how", "i", "in", "is", "it", "my", "of", "on", "or", "the", "to", "what", "when", "where", "which", "why", "with")
#: Phrases and words by which a turn refers to the one before it.
FOLLOW_UP_PHRASES = ("what about", "how about", "and what", "tell me more", "the same", "that one")
FOLLOW_UP_WORDS = ("it", "its", "they", "them", "that", "this", "those", "these", "there")


def fold_marks(c: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(c, "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED))


def title_key(c: Column) -> Column:
    """The words of a title, joined by blanks: accents folded, words parted at case and digit borders, apostrophes dropped, & as and."""
    t = fold_marks(c)
    t = F.regexp_replace(t, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    t = F.regexp_replace(t, "['’]", "")
    t = F.regexp_replace(t, "&", " and ")
    return F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))


def title_tokens(c: Column) -> Column:
    k = title_key(c)
    return F.when(k == "", F.array().cast("array<string>")).otherwise(F.split(k, " "))


def separator_key(c: Column) -> Column:
    """The older normal form: separators to one blank, apostrophes dropped, other marks kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "['’]", ""), r"[ \t\n\r_\-./:]+", " "))


def word_contains(text: Column, part: Column) -> Column:
    """part occurs in text at word borders; both are normal forms."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), part, F.lit(" ")))


def compact_key(c: Column) -> Column:
    """Letters and digits only, one trailing decoration removed unless nothing would remain."""
    k = F.regexp_replace(F.lower(fold_marks(c)), "[^a-z0-9]", "")
    bare = F.regexp_replace(k, "(?:" + "|".join(TRAILING_QUALIFIERS) + ")$", "")
    return F.when(bare == "", k).otherwise(bare)


def franchise_key(c: Column) -> Column:
    """compact_key of a title without a trailing parenthesis."""
    return compact_key(F.regexp_replace(c, r"[ ]*\([^)]*\)[ ]*$", ""))


def franchise_head(c: Column) -> Column:
    """What stands before ': ' or ' - ' in a title."""
    return F.regexp_replace(c, "(?:: | - ).*$", "")


def strip_qualifiers(key: Column) -> Column:
    """A title key without its trailing qualifiers, at least one word kept."""
    words = ("merlin edition", "vault edition", "limited edition", "standard edition", "remake", "pinball", "game kit", "deposit", "edition")
    out = F.regexp_replace(key, "(?: (?:" + "|".join(words) + "))+$", "")
    return F.when(out == "", key).otherwise(out)


def query_words(c: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Words of a query: possessives cut, stop words dropped; all words where only stop words stand."""
    k = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "['’]s\\b", ""), "[^a-z0-9]+", " "))
    ws = F.split(k, " ")
    kept = F.filter(ws, lambda w: ~w.isin(*stop))
    return F.when(k == "", F.array().cast("array<string>")).when(F.size(kept) == 0, ws).otherwise(kept)


def title_matches(title_words: Column, query: Column) -> Column:
    """Any query word equals a title word or, of three letters or more, begins one."""
    return F.exists(query, lambda a: F.exists(title_words, lambda b: (a == b) | ((F.length(a) >= 3) & F.startswith(b, a))))


def overlap_score(title_words: Column, match_words: Column) -> Column:
    """Title words (repeats counted) among the words to match."""
    return F.size(F.filter(title_words, lambda t: F.array_contains(match_words, t)))


def and_variants(c: Column) -> Column:
    """A title with 'and' and '&' exchanged, both spellings."""
    return F.array_distinct(F.array(c, F.regexp_replace(c, r"(?i)\s+and\s+", " & "), F.regexp_replace(c, r"\s*&\s*", " and ")))


def last_parentheses(c: Column) -> Column:
    """The text in the last parentheses; null without any."""
    return F.nullif(F.regexp_extract(c, r".*\(([^)]*)\)", 1), F.lit(""))


def label_tokens(c: Column, noise: Iterable[str] = ("edition", "the", "of")) -> Column:
    """Distinct words of a label without noise words, in order."""
    ws = F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.filter(ws, lambda w: (w != "") & ~w.isin(*noise)))


def first_marker(c: Column, markers: list[tuple[str, str]]) -> Column:
    """The label of the first marker that the text contains, in the order given; null where none does."""
    low, out = F.lower(c), None
    for needle, label in markers:
        cond = F.contains(low, F.lit(needle))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def id_segments(c: Column, n: int, sep: str = "-") -> Column:
    """The first n segments of an id."""
    return F.substring_index(c, sep, n)


def url_slug(c: Column, after: str) -> Column:
    """The path segment that follows /after/; null without one."""
    return F.nullif(F.regexp_extract(c, f"/{after}/([^/?#]+)", 1), F.lit(""))


def url_filename(c: Column) -> Column:
    """The last path segment of a URL without query."""
    return F.regexp_extract(F.regexp_replace(c, "[?#].*$", ""), "([^/]*)$", 1)


def lookup_key(c: Column) -> Column:
    """Trimmed, lower case, characters that keys may not hold replaced."""
    return F.translate(F.lower(F.trim(c)), "/\\?#", "____")


def strip_markdown_links(c: Column) -> Column:
    return F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")


def strip_html(c: Column) -> Column:
    t = F.regexp_replace(c, "(?is)<(script|style)[^>]*>.*?</\\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"[ \t\n\r]+", " "))


def whole_word_any(text: Column, label: Column) -> Column:
    """One of the alternatives of an A/B label stands in the text as whole words."""
    parts = F.filter(F.transform(F.split(label, "/"), lambda p: F.trim(F.regexp_replace(F.lower(p), "[^a-z0-9]+", " "))), lambda p: p != "")
    t = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.exists(parts, lambda p: word_contains(t, p))


def strip_chrome(c: Column, words: Iterable[str]) -> Column:
    """A page title without trailing site names, however many."""
    return F.regexp_replace(c, r"(?i)(?:\s*[|\-–:]\s*(?:" + "|".join(words) + r"))+\s*$", "")


def edge_ngrams(c: Column, least: int = 2, most: int = 25) -> Column:
    """Front n-grams of a word."""
    n = F.least(F.lit(most), F.length(c))
    return F.when(n >= least, F.transform(F.sequence(F.lit(least), n), lambda k: F.substr(c, F.lit(1), k))).otherwise(F.array().cast("array<string>"))


def truncate(c: Column, cap: int) -> Column:
    return F.substr(c, F.lit(1), F.lit(cap))


def slug_title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))


def paragraphs(c: Column) -> Column:
    """Non-blank parts between blank lines."""
    return F.filter(F.split(c, "\n\n"), lambda p: F.trim(p) != "")


def drop_paragraphs(c: Column, needles: Iterable[str]) -> Column:
    """A text without the paragraphs that contain one of the needles."""
    return F.array_join(F.filter(F.split(c, "\n\n"), lambda p: ~F.exists(F.array(*map(F.lit, needles)), lambda n: F.contains(F.lower(p), n))), "\n\n")


def is_follow_up(c: Column) -> Column:
    """A question that leans on the turn before it: a phrase, or a bare pronoun."""
    t = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.trim(c)), "[?.!,;:]+", ""), F.lit(" "))
    needles = [f" {p} " for p in FOLLOW_UP_PHRASES + FOLLOW_UP_WORDS]
    return F.exists(F.array(*map(F.lit, needles)), lambda n: F.contains(t, n))


def first_non_blank(*cs: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cs))


def lenient_year(c: Column) -> Column:
    """The year of a date in ISO form, else of the first four digits; null without either."""
    return F.coalesce(F.year(F.try_to_timestamp(c)), F.regexp_extract(c, "([0-9]{4})", 1).try_cast("int"))
