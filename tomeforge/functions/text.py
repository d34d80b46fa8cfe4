"""Text functions: Column in, Column out. Java's ``\\w``, ``\\s`` and case folding are switched to Unicode by (?U) and (?iu)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import ACRONYM_CUTS, ACRONYM_STARTS, ACRONYMS

ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def substitute(text: Column, rules: list[tuple[str, str]], flags: str = "") -> Column:
    """Apply ordered (pattern, replacement) rules."""
    return reduce(lambda t, rule: F.regexp_replace(t, flags + rule[0], rule[1]), rules, text)


def clean_text(text: Column) -> Column:
    """Join words split by a hyphen at a line end, strip line ends, squeeze spaces and tabs, strip; line feeds stay."""
    text = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    text = F.regexp_replace(text, r"(?m)[ \t]+$", "")
    return strip(F.regexp_replace(text, r"[ \t]{2,}", " "))


def repair_ocr(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered OCR repairs, case-insensitive. The errors are those of a corpus: its rules come from a file (``sources.io.read_rules``)."""
    return substitute(text, rules, "(?iuU)")


def make_readable(text: Column) -> Column:
    """Mend broken hyphenation and the spacing around punctuation."""
    rules = [(r"(?U)(\w)-\s+", "$1"), (" +", " "), (r"([.!?,;:])([A-Za-zÀ-ÿ])", "$1 $2"), (r" +([.,;:!?])", "$1")]
    return strip(substitute(text, rules))


def has_acronyms(text: Column, rules: list[tuple[str, str]] = ACRONYMS, starts: str = ACRONYM_STARTS) -> Column:
    """Whether any rule matches, in one scan that tries the rules only where ``starts`` does.

    Each of the default rules adds a bracket and none takes one away, so they change just the texts they match.
    """
    return text.rlike(f"(?U){starts}(?:{'|'.join(f'(?:{pattern})' for pattern, _ in rules)})")


def expand_acronyms(text: Column, rules: list[tuple[str, str]] = ACRONYMS, starts: str = ACRONYM_STARTS, cuts: str = ACRONYM_CUTS) -> Column:
    """Write acronyms out, with the acronym in brackets; expanded text stays as it is.

    Only texts that a rule matches are taken apart, and of them only the pieces that one
    matches are rewritten, rule by rule. ``starts`` and ``cuts`` match the empty string:
    wherever a match of a rule begins, and where texts are cut, which no rule may match
    or look across. Rules of another kind take "" for both.
    """
    expanded = lambda t: F.when(has_acronyms(t, rules, starts), substitute(t, rules, "(?U)")).otherwise(t)
    if not cuts:
        return expanded(text)
    return F.when(has_acronyms(text, rules, starts), F.array_join(F.transform(F.split(text, cuts), expanded), "")).otherwise(text)


def sanitize(text: Column, rules: list[tuple[str, str]] = (), fixes: list[tuple[str, str]] = ()) -> Column:
    """For display: control characters out, OCR repaired, spaces squeezed; then ``fixes`` in order, for instance ``rules.DISPLAY_FIXES``."""
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    text = F.regexp_replace(repair_ocr(text, rules), r"[ \t]{2,}", " ")
    for pattern, replacement in fixes:
        text = F.regexp_replace(text, pattern, replacement)
    return strip(text)


def fold(text: Column) -> Column:
    """Lower case without accents, to compare by."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def slug(text: Column) -> Column:
    """Folded, with one hyphen for every run of other characters than a-z and 0-9, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def words_of(text: Column) -> Column:
    """Runs of letters, digits and underscores, as they are."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return words_of(F.lower(text))


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` occurs in the lower-cased text, without overlaps."""
    lowered = F.lower(text)
    return ((F.length(lowered) - F.length(F.replace(lowered, F.lit(term.lower()), F.lit("")))) / len(term)).cast("int")


def garbage_share(text: Column) -> Column:
    """Share of characters that are neither letters, digits, white space nor common punctuation."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s.,;:!?()'\"-]", ""))
    return F.when(F.length(text) > 0, (F.length(text) - kept) / F.length(text)).otherwise(F.lit(0.0))


def key_phrase(query: Column, prefixes: list[str]) -> Column:
    """What a question asks for: lower case, punctuation out, the first matching opening off."""
    text = strip(F.regexp_replace(F.regexp_replace(F.lower(query), r"[?.!,•·—()]", " "), r"(?U)\s+", " "))
    opening = "|".join(rf"\Q{p}\E" for p in prefixes)
    return strip(F.regexp_replace(text, f"^(?:{opening})", "")) if prefixes else text


def relevant_text(text: Column, patterns: str, sections: list[str], shortest: int = 20, most: int = 12_000) -> Column:
    """The parts of a description that matter: named sections, then sentences that match ``patterns``, each once, in order.

    White space is squeezed. A section goes from its header to the next one; a sentence
    has ``shortest`` characters or more. What is longer than ``most`` is cut after its
    last whole sentence.
    """
    line = F.regexp_replace(F.regexp_replace(strip(text), r"(?U)\s+", " "), r"\s*\.\s*", ". ")
    header = rf"(?:{'|'.join(sections)})\s*:"
    section = rf"(?iu)({header})\s*(.*?)\s*(?={header}|$)"
    heads, bodies = (F.regexp_extract_all(line, F.lit(section), F.lit(k)) for k in (1, 2))
    named = F.filter(F.zip_with(heads, bodies, lambda h, b: F.when(F.trim(b) != "", F.concat(h, F.lit(" "), F.trim(b)))), lambda x: x.isNotNull())
    rest = F.regexp_replace(line, section.replace("(.*?)", "(.+?)", 1), " ")
    sentences = F.filter(F.transform(F.split(rest, r"\.\s+"), lambda s: F.trim(s)), lambda s: (F.length(s) >= shortest) & s.rlike(f"(?iu){patterns}"))
    sentences = F.transform(sentences, lambda s: F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit("."))))
    whole = F.trim(F.array_join(F.array_distinct(F.transform(F.concat(named, sentences), lambda s: F.regexp_replace(s, r"\s+", " "))), " "))
    head = F.substring(whole, 1, most)
    tail = F.length(F.substring_index(head, ". ", -1))
    cut = F.when(F.contains(head, F.lit(". ")), F.concat(F.substring(head, F.lit(1), F.length(head) - tail - 2), F.lit("."))).otherwise(F.concat(head, F.lit(".")))
    return F.coalesce(F.when(F.length(whole) > most, cut).otherwise(whole), F.lit(""))


def normalize_fields(df: DataFrame, rules: list[tuple[str, str]], skip: tuple[str, ...] = ()) -> DataFrame:
    """OCR repair and readability for every text column and list of texts; blank texts become null, blank list items go."""

    def mend(text: Column) -> Column:
        return F.nullif(make_readable(repair_ocr(text, rules)), F.lit(""))

    kinds = {name: kind for name, kind in df.dtypes if name not in skip}
    texts = {name: mend(F.col(f"`{name}`")) for name, kind in kinds.items() if kind == "string"}
    lists = {name: F.filter(F.transform(F.col(f"`{name}`"), mend), lambda x: x.isNotNull()) for name, kind in kinds.items() if kind == "array<string>"}
    return df.withColumns(texts | lists) if texts or lists else df
