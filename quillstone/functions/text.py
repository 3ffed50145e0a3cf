"""Text expressions: normalisation, sentence splitting, filters, tokens, keywords, links.

Everything here is a Column expression that runs in the JVM. Patterns carry (?U) where word
characters, digits or blanks are meant in the Unicode sense.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------

#: Lines that carry no content (matched against the whole stripped line, any case).
DROP_LINES = (
    r"^\s*Seite\s+\d+(\s+von\s+\d+)?\s*$",
    r"^\s*www\.ris\.bka\.gv\.at\s*$",
    r"^\s*RIS\s*$",
)

#: Prefixes stripped from a line, in this order, any case.
NOISE_PREFIXES = (
    r"^\s*Bundesrecht\s+konsolidiert\s*:?\s*",
    r"^\s*Gesamte\s+Rechtsvorschrift(?:\s+für)?\s*:?\s*",
    r"^\s*RIS\s*-\s*Rechtsinformationssystem(?:\s+des\s+Bundes)?\s*:?\s*",
    r"^\s*Rechtsinformationssystem(?:\s+des\s+Bundes)?\s*:?\s*",
    r"^\s*CELEX-?Nr\.?\s*:?\s*",
    r"^\s*(?:Kundmachungsorgan|Gesetzesnummer|Dokumenttyp|Kurztitel|Langtitel|Abkürzung|Fassung\s+vom|Inkrafttretensdatum|Zuletzt\s+geändert\s+durch|Zuletzt\s+aktualisiert|Norm|Anmerkung|Schlagworte|Dokumentnummer|Stand)\s*:?\s*",
)

#: Footer and bare-address lines.
FOOTER = r"^\s*www\.ris\.bka\.gv\.at\s+Seite\s+\d+\s+von\s+\d+\s*$"
URL_LINE = r"^\s*https?://\S+\s*$"

#: What may follow a section number whose dot ends no sentence.
SUBREFERENCE = r"(?:Abs|Absatz|Z|Ziffer|Ziff|lit|Satz|Nr|iVm|i\.?V\.?m)\b"

#: Abbreviations with one dot at the end.
ABBREVIATIONS = ("Abs", "Art", "Z", "Nr", "Zl", "BGBl")
#: Abbreviations of several letters, each of which may have a dot; the last one has.
DOTTED = (("i", "V", "m"), ("z", "B"), ("u", "a"), ("u", "U"))

#: Words that are no keywords.
STOP_WORDS = (
    "welche welcher welches wann wie wo was ist sind ich mein meine mich mir wir uns ihr sie man "
    "der die das den dem des ein eine einen einem einer "
    "und oder für bei von in im auf nach gegen ohne österreich recht gesetz paragraph paragraf at"
).split()

#: Marks and letters of list items within a paragraph.
LIST_MARK = r"\b\d{1,3}\)|\(\d{1,3}\)|\b[A-Za-z]\)|•"

#: Links to the complete text in a result list, and to its PDF on the page of the complete text.
COMPLETE_LINKS = (
    r'<a\s+href="([^"]+)"[^>]*>\s*<img[^>]+CompleteNorm\.gif[^>]*>',
    r'<a\s+href="([^"]+)"[^>]*>\s*<img[^>]+CompleteNorm\.png[^>]*>',
    r'<a\s+href="([^"]+)"[^>]*>\s*<img[^>]+alt="Gesamte\s+geltende\s+Rechtsvorschrift"[^>]*>',
)
PDF_LINKS = (
    r'<a\s+href="([^"]+)"[^>]*>\s*<img[^>]+pdf\.gif[^>]*alt="PDF-Dokument"[^>]*>',
    r'<a\s+href="([^"]+)"[^>]*>\s*<img[^>]+alt="PDF-Dokument"[^>]*>',
    r'<a\s+href="([^"]+)"[^>]*>\s*PDF-Dokument\s*</a>',
    r'<a\s+href="([^"]+)"[^>]*>\s*<img[^>]+pdf\.gif[^>]*>',
)

# --------------------------------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]"  # a word character: any letter or number, and the underscore
DOT = "∯"  # stands for the dot of an abbreviation
CUT = "\u0001"  # marks a place to split


def _sub(c: Column, pattern: str, to: str, flags: str = "(?U)") -> Column:
    return F.regexp_replace(c, flags + pattern, to)


def strip(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return _sub(c, r"^\s+|\s+$", "")


def lexical(c: Column, number_mode: str = "replace", number_prefix: str = "num") -> Column:
    """Section signs spelt out, standalone numbers marked ("replace"), kept or removed, lower case, single blanks."""
    c = _sub(c, "§+", " paragraf ")
    mode = (number_mode or "replace").strip().lower()
    if mode == "replace":
        prefix = (number_prefix or "num").strip() or "num"
        c = _sub(c, r"\b(\d+)\b", f" {prefix}$1 ")
    elif mode == "remove":
        c = _sub(c, r"\b\d+\b", " ")
    elif mode != "keep":
        raise ValueError(f"unknown number mode {number_mode!r}")
    return strip(_sub(F.lower(c), r"\s+", " "))


def strip_noise(line: Column) -> Column:
    """A line without the prefixes that page headers leave."""
    for p in NOISE_PREFIXES:
        line = _sub(line, p, "", "(?iU)")
    return line


def matches_any(line: Column, patterns: Sequence[str]) -> Column:
    """Whether a pattern matches the whole stripped line, in any case."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | strip(line).rlike(f"(?iU)^(?:{p})$")
    return hit


def normalize(raw: Column, drop_lines: Sequence[str] = ()) -> Column:
    """Lines joined to a text: footers, addresses and noise prefixes go, words cut by a hyphen at a
    line end are joined (before a capital the hyphen stays), list marks take the form "n)"."""
    s = F.replace(raw, F.lit("­"), F.lit(""))
    s = _sub(_sub(s, FOOTER, "", "(?imU)"), URL_LINE, "", "(?imU)")
    lines = F.split(s, r"\R|[\x1c-\x1e]")
    if drop_lines:
        lines = F.filter(lines, lambda x: ~matches_any(x, drop_lines))
    s = F.array_join(F.transform(lines, strip_noise), "\n")
    s = _sub(s, r"([A-Za-zÄÖÜäöüß])-\s*\n\s*([a-zäöüß])", "$1$2")
    s = _sub(s, r"([A-Za-zÄÖÜäöüß])-\s*\n\s*([A-ZÄÖÜ])", "$1-$2")
    for mark in (r"([IVXLCDM]{1,8})\.", r"\((\d{1,3})\)", r"([A-Za-z])\.", r"(\d{1,3})\."):
        s = _sub(s, rf"^\s*{mark}\s+", "$1) ", "(?mU)")
    s = _sub(s, r"([:;])\s*(\d{1,3})\.\s+", "$1 $2) ")
    s = _sub(s, r"\s*\n\s*", " ")
    return strip(_sub(s, r"[ \t\r\f\x0B]+", " ", ""))


def protect(c: Column) -> Column:
    """Dots of abbreviations and section references replaced, so that they end no sentence."""
    c = _sub(c, rf"(§{{1,2}}\s*\d+[A-Za-z]?)\.(?=\s*{SUBREFERENCE})", f"$1{DOT}", "(?iU)")
    c = _sub(c, rf"(Art)\.(?=\s*\d+[A-Za-z]?\.\s*{SUBREFERENCE})", f"$1{DOT}", "(?iU)")
    c = _sub(c, rf"((?:Art[.{DOT}]?|Artikel)\s*\d+[A-Za-z]?)\.(?=\s*{SUBREFERENCE})", f"$1{DOT}", "(?iU)")
    for a in ABBREVIATIONS:
        c = _sub(c, rf"\b({a})\.", f"$1{DOT}", "(?iU)")
    for letters in DOTTED:
        for k in range(2 ** (len(letters) - 1)):
            dots = [(k >> i) & 1 for i in range(len(letters) - 1)] + [1]
            find = "".join(f"({x})" + (r"\." if d else "") for x, d in zip(letters, dots))
            c = _sub(c, rf"\b{find}", "".join(f"${i + 1}" + (DOT if d else "") for i, d in enumerate(dots)), "(?iU)")
    return c


def restore(c: Column) -> Column:
    return F.replace(c, F.lit(DOT), F.lit("."))


def merge_false_ends(sentences: Column) -> Column:
    """A sentence that ends in a section number is joined with the next one if that continues the
    reference; the joined sentence is not joined again."""
    dangling, goes_on = r"(?iU)§{1,2}\s*\d+[A-Za-z]?\.\s*$", rf"(?iU)^{SUBREFERENCE}"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("joined"))

    def step(acc: Column, x: Column) -> Column:
        x = strip(x)
        last = F.element_at(acc["out"], -1)
        join = (F.size(acc["out"]) > 0) & ~acc["joined"] & last.rlike(dangling) & x.rlike(goes_on)
        head = F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1)
        out = F.when(join, F.concat(head, F.array(F.concat_ws(" ", last, x)))).otherwise(F.concat(acc["out"], F.array(x)))
        return F.struct(out.alias("out"), F.coalesce(join, F.lit(False)).alias("joined"))

    return F.aggregate(sentences, start, step, lambda acc: acc["out"])


def split_list_marks(c: Column) -> Column:
    """Parts of a text that begin at its second, third, ... list mark; one part if there are fewer than two."""
    parts = F.split(F.regexp_replace(c, f"(?U)(?={LIST_MARK})", CUT), CUT)
    some = F.concat(F.array(F.concat(parts[0], parts[1])), F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))))
    return F.when(F.size(parts) < 3, F.array(c)).otherwise(F.filter(F.transform(some, strip), lambda x: x != ""))


def sentences(raw: Column, split_lists: bool = True, drop_lines: Sequence[str] = ()) -> Column:
    """The sentences of a text as array<string>; a null or blank text has none."""
    ends = F.split(protect(normalize(raw, drop_lines)), r"(?U)(?<=[.?!])\s+")
    s = F.filter(F.transform(ends, lambda x: strip(restore(x))), lambda x: x != "")
    s = merge_false_ends(s)
    if split_lists:
        s = F.filter(F.flatten(F.transform(s, split_list_marks)), lambda x: x != "")
    return F.coalesce(s, F.array().cast("array<string>"))


def is_meaningful(c: Column, min_chars: int = 10, min_words: int = 1, max_digit_share: float = 0.85, drop_lines: Sequence[str] = ()) -> Column:
    """Long enough, with enough words, not mostly digits, not only punctuation; false for null."""
    s = strip(c)
    ok = (F.length(s) >= min_chars) & (F.length(s) > 0) & ~s.rlike(r"(?U)^[\s\-–—.,;:/()\[\]{}]+$")
    ok = ok & (F.regexp_count(s, F.lit("[A-Za-zÄÖÜäöüß]+")) >= min_words)
    ok = ok & (F.regexp_count(s, F.lit(r"(?U)\d")) / F.greatest(F.length(s), F.lit(1)) <= max_digit_share)
    if drop_lines:
        ok = ok & ~matches_any(s, drop_lines)
    return F.coalesce(ok, F.lit(False))


def token_count(c: Column) -> Column:
    """Maximal runs of word characters; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(f"{WORD}+")), F.lit(0))


def line_key(line: Column) -> Column:
    """What repeated headers and footers have in common: no prefix, single blanks, lower case, numbers as <d>."""
    return _sub(F.lower(strip(_sub(strip_noise(line), r"\s+", " "))), r"\d+", "<d>")


def keywords(c: Column, most: int = 10) -> Column:
    """The first words that are numbers or longer than two letters and no stop words; if there are
    none, the first 50 characters in lower case."""
    w = F.transform(F.regexp_extract_all(F.replace(c, F.lit("-"), F.lit(" ")), F.lit("([A-Za-zÄÖÜäöüß0-9]+)"), F.lit(1)), lambda x: F.lower(x))
    stop = F.array(*[F.lit(x) for x in STOP_WORDS])
    w = F.filter(w, lambda x: ~F.array_contains(stop, x) & (x.rlike("^[0-9]+$") | (F.length(x) > 2)))
    return F.when(F.size(w) > 0, F.array_join(F.slice(w, 1, most), " ")).otherwise(F.lower(F.substring(c, 1, 50)))


def ui_tokens(c: Column) -> Column:
    """Runs of lower-case German letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(strip(c)), F.lit("([a-zäöüß0-9]+)"), F.lit(1))


def abbreviation(c: Column) -> Column:
    """Upper case without anything but letters A to Z and digits."""
    return F.regexp_replace(F.upper(c), "[^0-9A-Z]+", "")


def abbreviations_match(a: Column, b: Column, empty_matches: bool = True) -> Column:
    """Equal, or one begins with the other. An empty one begins every other, unless `empty_matches` is false."""
    x, y = abbreviation(a), abbreviation(b)
    hit = F.startswith(y, x) | F.startswith(x, y)
    return hit if empty_matches else hit & (x != "") & (y != "")


def unescape(c: Column) -> Column:
    """The entities that links carry."""
    for find, to in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(find), F.lit(to))
    return c


def complete_links(html: Column) -> Column:
    """Links to complete texts in a result list, in the order of the patterns, each once."""
    found = [F.regexp_extract_all(html, F.lit("(?is)" + p), F.lit(1)) for p in COMPLETE_LINKS]
    return F.array_distinct(F.transform(F.concat(*found), unescape))


def pdf_link(html: Column) -> Column:
    """The link to the PDF: after the words "andere Formate" first, else anywhere; null if there is none."""
    page = unescape(html)
    at = F.locate("andere formate", F.lower(page))
    windows = [F.when(at > 0, F.substr(page, at, F.lit(10000))), page]
    tries = [F.nullif(F.regexp_extract(w, "(?is)" + p, 1), F.lit("")) for w in windows for p in PDF_LINKS]
    return unescape(F.coalesce(*tries))


def query_parameter(url: Column, *names: str) -> Column:
    """The first value of the first of these parameters that the address has; null if it has none."""
    return F.coalesce(*[F.nullif(F.url_decode(F.regexp_extract(url, rf"[?&]{n}=([^&#]*)", 1)), F.lit("")) for n in names])


def label_pattern(label: Column) -> Column:
    """A pattern that finds the label in any case, not within a longer word."""
    return F.concat(F.lit(rf"(?iU)(?<!{WORD})\Q"), F.replace(label, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(rf"\E(?!{WORD})"))


def stable_hash(c: Column) -> Column:
    """A 32-bit hash: acc = (acc * 131 + codepoint * position) mod 2^32, positions from 1."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    at = F.transform(chars, lambda x, i: F.struct(F.ascii(x).cast("long").alias("c"), (i + 1).cast("long").alias("i")))
    return F.aggregate(at, F.lit(0).cast("long"), lambda acc, x: (acc * 131 + x["c"] * x["i"]).bitwiseAND(F.lit(4294967295).cast("long")))
