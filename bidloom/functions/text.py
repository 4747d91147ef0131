"""Column expressions for keyword, campaign and change-text cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode defines it, list separators, match types in display order.
SPACE = r"\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE_CHARS = (
    "".join(chr(i) for i in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680])
    + "".join(chr(i) for i in [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
KEYWORD_MARKS = "'\"+[]"
LIST_SEPARATOR = r"[;\n]"
LIST_JOINER = "; "
MATCH_TYPES = ("Broad", "Phrase", "Exact")
LIST_COLUMNS = {
    "Broad": "broad_keywords",
    "Phrase": "phrase_keywords",
    "Exact": "exact_keywords",
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Trim any white space at both ends."""
    return F.btrim(col(c), F.lit(SPACE_CHARS))


def squeeze(c: str | Column, drop: str = "") -> Column:
    """Remove the ``drop`` characters, collapse runs of white space to one blank and trim.

    One character map does the removal and turns every white space into a blank.
    """
    blanks = F.translate(col(c), SPACE_CHARS + drop, " " * len(SPACE_CHARS))
    return F.trim(F.regexp_replace(blanks, " {2,}", " "))


def clean_keyword(c: str | Column, strict: bool = False) -> Column:
    """Canonical keyword: no quotes, brackets or plus signs, single blanks, lower case.

    A missing value becomes ``''``; with ``strict`` an empty or non-alphanumeric
    keyword becomes NULL.
    """
    text = F.lower(squeeze(c, drop=KEYWORD_MARKS))
    if strict:
        return F.when(text.rlike(r"^[a-z0-9 ]+\z"), text)
    return F.coalesce(text, F.lit(""))


def clean_campaign(c: str | Column) -> Column:
    """Campaign name without ``[...]`` notes."""
    return strip(F.regexp_replace(col(c), r"\[.*?\]", ""))


def region_of_campaign(c: str | Column) -> Column:
    """Region named by the first dash-separated part that names one.

    A part holding ``US`` means USA; a part that is A, B or C, or starts with that letter
    followed by a blank, slash or bracket, means that letter. One leftmost regex match
    visits the parts in order; names without ``US`` take the shorter pattern.
    """
    name = col(c)
    letter = r"[ABC](?=[ /(]|\s*(?:-|\z))"
    either = F.regexp_extract(name, rf"(?:^|-)\s*([^-]*US[^-]*|{letter})", 1)
    short = F.regexp_extract(name, rf"(?:^|-)\s*({letter})", 1)
    hit = F.when(name.contains("US"), either).otherwise(short)
    return F.when(hit.contains("US"), F.lit("USA")).when(hit != "", hit)


def title_case(c: str | Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    pieces = F.split(F.lower(col(c)), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(pieces, lambda p: F.initcap(p)), "")


def clean_match_type(c: str | Column) -> Column:
    """``EXACT_MATCH`` style enum text to title case."""
    words = F.replace(col(c), F.lit("_"), F.lit(" "))
    # letters and blanks need no letter-by-letter casing
    return strip(F.when(words.rlike("^[A-Za-z ]*$"), F.initcap(words)).otherwise(title_case(words)))


def to_double(c: str | Column) -> Column:
    """Numeric text to double; anything else, and NaN, to NULL."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_long(c: str | Column) -> Column:
    return to_double(c).try_cast("bigint")


def half_even(c: str | Column, digits: int) -> Column:
    """Round half to even, as cents and panel values are rounded."""
    return F.bround(col(c), digits)


# --- keyword lists -------------------------------------------------------------------------


def split_list(c: str | Column) -> Column:
    """Text list to array: separators ``;`` and newline, trimmed, no empties, never NULL."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), LIST_SEPARATOR), strip)
    return F.filter(parts, lambda s: s != "")


def sorted_distinct(c: str | Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(col(c), lambda s: s.isNotNull() & (s != ""))))


def join_list(c: str | Column) -> Column:
    """Array to canonical list text: distinct, sorted, ``'; '`` between."""
    return F.array_join(sorted_distinct(c), LIST_JOINER)


def clean_list(c: str | Column) -> Column:
    """Clean every entry of a text list and write it back in canonical form."""
    return join_list(F.transform(split_list(c), lambda k: clean_keyword(k)))


def fingerprint(keywords: Column) -> Column:
    """Content key: equal for equal keyword sets; NULL for an empty set."""
    unique = sorted_distinct(keywords)
    return F.when(F.size(unique) > 0, F.sha2(F.array_join(unique, "\u0001"), 256))


# --- segments and match types --------------------------------------------------------------


def segment(region: str | Column = "region", match_types: str | Column = "match_types") -> Column:
    return F.concat_ws(" / ", col(region), col(match_types))


def region_of_segment(c: str | Column = "segment") -> Column:
    return strip(F.split_part(col(c), F.lit(" / "), F.lit(1)))


def match_part_of_segment(c: str | Column = "segment") -> Column:
    return strip(F.regexp_extract(col(c), r"^(?s:.*?) / (?s:(.*))\z", 1))


def parse_match_types(c: str | Column) -> Column:
    """``'Phrase; Exact'`` to its distinct titled tokens."""
    tokens = F.split(F.replace(F.coalesce(col(c), F.lit("")), F.lit(";"), F.lit(" ")), f"[{SPACE}]+")
    return F.array_distinct(F.transform(F.filter(tokens, lambda s: s != ""), title_case))


def is_broad_only(c: str | Column) -> Column:
    return (parse_match_types(c) == F.array(F.lit("Broad"))).cast("int")


def match_type_label(keywords_by_type: dict[str, Column]) -> Column:
    """Match types that hold a keyword, in Broad, Phrase, Exact order."""
    present = [F.when(keywords_by_type[mt], F.lit(mt)) for mt in MATCH_TYPES]
    return F.concat_ws(LIST_JOINER, *present)


# --- name construction ---------------------------------------------------------------------


def campaign_name(title: Column, region: Column, match_type: Column) -> Column:
    return F.concat_ws(" - ", title, region, match_type, F.lit("Experiment"))


def ad_group_name(title: Column, region: Column, match_type: Column) -> Column:
    return F.concat_ws(" - ", F.lit("Ad Group"), campaign_name(title, region, match_type))


def budget_name(title: Column, region: Column, match_type: Column) -> Column:
    return F.concat_ws(" - ", F.lit("Budget"), campaign_name(title, region, match_type))


def match_types_of_label(label: str | Column) -> Column:
    """``'Phrase; Exact'`` to ``['PHRASE', 'EXACT']``."""
    return F.transform(F.split(col(label), ";"), lambda s: F.upper(strip(s)))


def synthetic_id(prefix: str, segment_col: Column, suffix: Column, index: Column) -> Column:
    token = F.replace(segment_col, F.lit(" / "), F.lit("_"))
    return F.concat_ws("_", F.lit(prefix), token, suffix, index.cast("string"))


# --- change-log text -----------------------------------------------------------------------

# Patterns of amounts and of budget, keyword and campaign change texts.
AMOUNT = r"(?i)(?:US\$|\$|USD\s*)\s*([0-9][0-9,]*(?:\.[0-9]+)?)|([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:USD|dollars?)"
BUDGET_CHANGE = r"(?i)\bbudget amount\b.*\b(?:increased|decreased|changed|is)\b"
BUDGET_CAMPAIGN = r"(?i)(Course\s+-\s+.+?):\s+Budget amount\b"
CAMPAIGN_COUNT = r"(?i)^\d+\s+campaigns?$"
KEYWORD_WORD = r"(?i)\bkeyword\b"
KEYWORD_TEXT = r"^-?(\[[^\]]+\]|\"[^\"]+\"|[^:]+)"
RENAME = r"Campaign name changed from\s+(.+?)\s+to\s+(.+)$"
EDGE_MARKS = "[ ?\\x{FFFD}\"\'\\x{2018}\\x{2019}\\x{201C}\\x{201D}]+"
TREE_ICON = "expand_more "


def _amounts(c: Column) -> Column:
    """All currency amounts in reading order, thousands separators removed."""
    whole = F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(0))
    return F.transform(whole, lambda m: F.regexp_replace(m, r"[^0-9.]", ""))


def last_amount(c: str | Column) -> Column:
    """The final amount named in a budget text, or ''."""
    found = _amounts(col(c))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def previous_amount(c: str | Column) -> Column:
    """The first amount of a ``from X to Y`` text, or ''."""
    padded = F.concat(F.lit(" "), F.lower(col(c)), F.lit(" "))
    found = _amounts(col(c))
    ok = padded.contains(" from ") & padded.contains(" to ") & (F.size(found) >= 2)
    return F.when(ok, F.try_element_at(found, F.lit(1))).otherwise(F.lit(""))


def trim_campaign(c: str | Column) -> Column:
    """Drop white space, then stray quote and replacement marks, at both ends."""
    return F.regexp_replace(strip(c), f"^{EDGE_MARKS}|{EDGE_MARKS}$", "")


def drop_tree_icon(c: str | Column) -> Column:
    return F.regexp_replace(col(c), f"^{TREE_ICON}", "")


def budget_campaign(c: str | Column) -> Column:
    """Campaign named in front of ``: Budget amount``, or ''."""
    return trim_campaign(drop_tree_icon(F.regexp_extract(col(c), BUDGET_CAMPAIGN, 1)))


def change_date(c: str | Column) -> Column:
    """Date of ``'21 Apr 2026, 14:01:16'``; NULL when the text is not such a date."""
    return F.to_date(F.try_to_timestamp(col(c), F.lit("d MMM yyyy, HH:mm:ss")))


def is_aggregate_campaign(c: str | Column) -> Column:
    return strip(c).rlike(CAMPAIGN_COUNT)


def is_search_campaign(c: str | Column) -> Column:
    name = F.coalesce(col(c), F.lit(""))
    return (name != "") & ~is_aggregate_campaign(name) & name.contains("Search") & ~name.contains("Experiment")


def is_report_campaign(c: str | Column) -> Column:
    name = F.coalesce(col(c), F.lit(""))
    return (name != "") & ~is_aggregate_campaign(name)


def keyword_status(summary: str | Column, negative: bool = False) -> Column:
    """``add``/``remove`` from the words of a keyword change summary, else NULL."""
    s = col(summary)
    low = F.lower(s)
    wanted = low.contains("negative") if negative else ~low.contains("negative")
    adds = low.contains("added") | low.contains("enabled") | low.contains("active")
    drops = low.contains("removed") | low.contains("paused")
    return F.when(
        wanted & s.rlike(KEYWORD_WORD),
        F.when(adds, F.lit("add")).when(drops, F.lit("remove")),
    )


def summary_match_type(summary: str | Column) -> Column:
    low = F.lower(col(summary))
    out = F.when(low.contains("exact match keyword"), F.lit("Exact"))
    out = out.when(low.contains("phrase match keyword"), F.lit("Phrase"))
    return out.when(low.contains("broad match keyword"), F.lit("Broad"))


def keyword_detail(detail: str | Column) -> Column:
    """Struct (keyword, match_type, negative) of a detail line; NULL when it names no keyword.

    ``[x]`` is Exact, ``"x"`` is Phrase, bare text is Broad, a leading ``-`` marks a negative.
    """
    d = strip(drop_tree_icon(strip(detail)))
    low = F.lower(d)
    status_line = (
        low.contains(" keyword added")
        | low.contains(" keyword enabled")
        | low.contains(" keyword removed")
        | low.contains(" keyword paused")
    )
    raw = strip(F.regexp_extract(d, KEYWORD_TEXT, 1))
    bracketed = raw.startswith("[") & raw.endswith("]")
    quoted = raw.startswith('"') & raw.endswith('"')
    keyword = clean_keyword(raw)
    match_type = F.when(bracketed, F.lit("Exact")).when(quoted, F.lit("Phrase")).otherwise(F.lit("Broad"))
    return F.when(
        ~status_line & (keyword != ""),
        F.struct(
            keyword.alias("keyword"),
            match_type.alias("match_type"),
            d.startswith("-").alias("negative"),
        ),
    )
