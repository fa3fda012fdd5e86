"""Text normalisation, cleaning and hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadmill.schema import DEDUPE_MODES

# --- fixed values: the 29 code points that count as white space ----------------
# Bare \s is ASCII-only here, so they are spelled out; LINE_ENDS belong to them.
_INLINE = (
    r"\t\x0B\f\x1C\x1D\x1E\x1F\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
LINE_ENDS = r"\n\r"
WHITESPACE = f"[{LINE_ENDS}{_INLINE}]"
INLINE_WHITESPACE = f"[{_INLINE}]"
# ------------------------------------------------------------------------------


def _collapse(text: Column, whitespace: str) -> Column:
    """Every run of `whitespace` becomes one space.

    Most runs are one space already.  The pattern passes over letters with a
    single range test, and over a space with such a letter behind it, and only
    then asks for the whole class: several times as fast as the plain class.
    """
    to_change = rf"[^!-~](?<! (?=[!-~]))(?<={whitespace}){whitespace}*+"
    return F.regexp_replace(text, to_change, " ")


def strip(text: Column) -> Column:
    """Remove white space, in the wide sense, from both ends."""
    return F.regexp_replace(text, rf"\A{WHITESPACE}+|{WHITESPACE}+\z", "")


def normalize_text(text: Column) -> Column:
    """One line: every run of white space becomes a space; NULL becomes ''."""
    return F.trim(_collapse(F.coalesce(text, F.lit("")), WHITESPACE))


def clean_text(text: Column) -> Column:
    """Keep the line structure: tidy each line, drop the empty ones.

    Written as replacements instead of split/transform/filter/join so that it
    stays in generated code.  After the first one, white space inside a line is
    single spaces, so a break is line ends with at most one space around each.
    """
    tidy = _collapse(text, INLINE_WHITESPACE)
    broken = F.regexp_replace(tidy, rf"[{LINE_ENDS}][ {LINE_ENDS}]*+", "\n")
    return F.trim(F.replace(broken, F.lit(" \n"), F.lit("\n")), F.lit(" \n"))


def hashtag_only(cleaned: Column) -> Column:
    """Whether every token of a *cleaned* text starts with '#' (and one exists).

    Cleaned text has only spaces and line feeds between tokens: look for a
    token that starts with anything else.
    """
    return (cleaned != "") & ~cleaned.rlike(r"(?:\A|[ \n])[^# \n]")


def iso_day(date: Column) -> Column:
    """Day of an ISO date, '' when unknown."""
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(""))


def dedupe_hash(
    text: Column,
    sender_id: Column,
    sender_username: Column,
    date: Column,
    mode: str = "text",
    null_sender: str = "",
) -> Column:
    """SHA-256 (hex) over the parts that `mode` names, joined by line feeds.

    `text` must already be normalised or cleaned.  A sender without a name
    counts by its id; `null_sender` stands for one with neither: '' when
    aggregating sources, 'None' in the exports.  Unlike in the original
    exporters an unknown mode is an error.
    """
    check_mode(mode)
    parts = [text]
    if mode != "text":
        named = F.when(sender_username != "", sender_username)
        parts.append(F.coalesce(named, sender_id.cast("string"), F.lit(null_sender)))
    if mode == "text+sender+day":
        parts.append(iso_day(date))
    return F.sha2(F.concat_ws("\n", *parts), 256)


def check_mode(mode: str) -> None:
    if mode not in DEDUPE_MODES:
        raise ValueError(f"dedupe mode must be one of {DEDUPE_MODES}, not {mode!r}")
