"""Text functions over string columns. Lengths and budgets count code points; white space is Unicode White_Space."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.times import shown_date

ELLIPSIS = "…"
EXCERPT_CHARS = 160
TITLE_CHARS = 80


def trim_ws(text: Column) -> Column:
    """Without white space at either end (Spark's own ``trim`` removes U+0020 only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def trim_end_ws(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def collapse_ws(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim_ws(F.regexp_replace(text, r"(?U)\s+", " "))


def is_blank(text: Column) -> Column:
    return F.length(trim_ws(text)) == 0


def head_chars(text: Column, n: int | Column) -> Column:
    return F.substring(text, F.lit(1), F.greatest(F.lit(n) if isinstance(n, int) else n, F.lit(0)))


def tail_chars(text: Column, n: int) -> Column:
    """The last ``n`` code points."""
    return F.right(text, F.lit(n))


def clamp(text: Column, n: int | Column) -> Column:
    """Trimmed, cut to ``n`` code points, trimmed at the end."""
    return trim_end_ws(head_chars(trim_ws(text), n))


def strip_markers(text: Column) -> Column:
    """Without fence markers: ``<<<`` first, then ``>>>``."""
    return F.replace(F.replace(text, F.lit("<<<"), F.lit("")), F.lit(">>>"), F.lit(""))


def spread_markers(text: Column) -> Column:
    """Fence markers made harmless: spaces between their characters."""
    return F.replace(F.replace(text, F.lit("<<<"), F.lit("< < <")), F.lit(">>>"), F.lit("> > >"))


def _to_last_space(text: Column) -> Column:
    """What stands before the last space; null without one."""
    before = F.regexp_extract(text, r"(?s)^(.*) ", 1)
    return F.when(F.contains(text, F.lit(" ")), before)


def excerpt(text: Column, n: int = EXCERPT_CHARS) -> Column:
    """White space collapsed; a longer text is cut to ``n`` code points, then at the last space, and marked."""
    flat = collapse_ws(text)
    cut = head_chars(flat, n)
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.coalesce(_to_last_space(cut), cut), F.lit(ELLIPSIS)))


def cap_title(text: Column, n: int = TITLE_CHARS) -> Column:
    """A longer title is cut to ``n`` code points, and at the last space if that lies ``n / 2`` bytes in or more."""
    cut = head_chars(text, n)
    word = _to_last_space(cut)
    kept = F.when(F.octet_length(word) >= n // 2, word).otherwise(cut)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(trim_end_ws(kept), F.lit(ELLIPSIS)))


def clean_title(line: Column) -> Column:
    """Emphasis, quotes and heading marks off both ends, white space collapsed, capped."""
    bare = F.regexp_replace(line, r"^[*_`\"#]+|[*_`\"#]+$", "")
    return cap_title(collapse_ws(bare))


def first_title_line(markdown: Column) -> Column:
    """The first line with something besides heading marks, as a title; null if there is none."""
    lines = F.transform(F.split(markdown, r"\r?\n"), lambda line: trim_ws(F.regexp_replace(line, r"^#+", "")))
    return clean_title(F.try_element_at(F.filter(lines, lambda line: F.length(line) > 0), F.lit(1)))


def date_prefix(time: Column) -> Column:
    """The date of an RFC 3339 string: what stands before the T."""
    return F.substring_index(time, "T", 1)


def session_title(notes: Column, attendees: Column, ended_at: Column) -> Column:
    """First line of the notes, else the attendees with the date, else the date, else the end time as it is."""
    date = date_prefix(ended_at)
    people = F.array_join(attendees, ", ")
    with_date = F.when(F.length(date) > 0, F.concat(people, F.lit(" ("), date, F.lit(")"))).otherwise(people)
    return F.coalesce(first_title_line(notes), F.when(F.size(attendees) > 0, with_date), F.when(F.length(date) > 0, date), ended_at)


def display_title(title: Column, ended: Column) -> Column:
    """The trimmed title, or the day it ended."""
    own = trim_ws(title)
    return F.coalesce(F.when(F.length(own) > 0, own), shown_date(ended))


def speaker_name(label: Column, source: Column) -> Column:
    """The trimmed label, or You / Others by source."""
    own = trim_ws(label)
    return F.when(F.length(own) > 0, own).otherwise(F.when(source == "you", "You").otherwise("Others"))


def without_shard_suffix(name: Column) -> Column:
    """``weights-00001-of-00004`` as ``weights``."""
    return F.regexp_replace(name, r"-\d+-of-\d+$", "")


def is_safe_path(path: Column) -> Column:
    """Relative, with no colon and no empty, ``.`` or ``..`` part."""
    parts = F.split(path, "/")
    return ~F.rlike(path, F.lit(r"[:\\]")) & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def folder_name(repository: Column) -> Column:
    return F.regexp_replace(repository, r"[/\\]", "__")


def is_session_id(value: Column) -> Column:
    """Not empty, and unable to leave its folder."""
    return (F.length(value) > 0) & ~F.rlike(value, F.lit(r"[/\\]")) & ~F.contains(value, F.lit(".."))


def joined_url(base: Column, path: Column) -> Column:
    """Base and path with one slash between; null unless the scheme is http or https."""
    url = F.concat(F.regexp_replace(trim_ws(base), "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))
    return F.when(F.rlike(url, F.lit(r"^(?i)https?://[^/]")), url)


def locale_of(tag: Column, known: tuple[str, ...] = ("en", "pl")) -> Column:
    """The lowered primary subtag if it is known, else the first known one."""
    primary = F.lower(F.element_at(F.split(tag, "[-_]"), 1))
    return F.when(primary.isin(*known), primary).otherwise(known[0])


def detokenised(pieces: Column, blank: str = "<blk>") -> Column:
    """Word pieces joined, with the word mark as a space."""
    kept = F.filter(pieces, lambda p: p.isNotNull() & (p != blank))
    return F.regexp_replace(F.replace(F.array_join(kept, ""), F.lit("▁"), F.lit(" ")), r"(?U)^\s+", "")


def continuation(before: Column, part: Column) -> Column:
    """What a part adds to a text: nothing if equal, the rest if it goes on from it, else a new paragraph."""
    return (
        F.when(before == part, F.lit(""))
        .when(F.startswith(part, before), F.substring(part, F.length(before) + 1, F.length(part)))
        .otherwise(F.concat(F.lit("\n\n"), part))
    )


def words_and_gaps(text: Column) -> Column:
    """Runs of letters, digits and apostrophes, and the runs between them, in order."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}']+|[^\p{L}\p{N}']+"), F.lit(0))


def line_kind(line: Column) -> Column:
    """Markdown class of a line."""
    rules = ((r"^\s*[-*] \[[ xX]\] ", "checkbox"), (r"^\s*[-*] ", "bullet"), (r"^### ", "h3"), (r"^## ", "h2"), (r"^# ", "h1"), (r"^\s*$", "blank"))
    return reduce(lambda chain, rule: chain.when(F.rlike(line, F.lit(rule[0])), rule[1]), rules[1:], F.when(F.rlike(line, F.lit(rules[0][0])), rules[0][1])).otherwise("paragraph")


def marked_spans(line: Column) -> Column:
    """Bold and code spans of a line, marks included, in order."""
    return F.regexp_extract_all(line, F.lit(r"\*\*[^*]+\*\*|`[^`]+`"), F.lit(0))


def cased_like(word: Column, model: Column) -> Column:
    """``word`` in the casing of ``model``: all capitals, leading capital, or as it is."""
    letters = F.regexp_replace(model, r"[^\p{L}]", "")
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))
    first = F.substring(letters, 1, 1)
    return (
        F.when((F.length(letters) > 1) & (letters == F.upper(letters)) & (letters != F.lower(letters)), F.upper(word))
        .when((first == F.upper(first)) & (first != F.lower(first)), capital)
        .otherwise(word)
    )
