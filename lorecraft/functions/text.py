"""Cleaning, splitting and cutting of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that cleaning turns into spaces, and white space that it squeezes.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
BLANK = r"[ \t\n\r]+"
#: A name is a capitalised word of five letters or more.
NAME = "[A-Z][a-z]{4,}"
#: A capitalised word of any script and the word after it.
PHRASE = r"\p{Lu}[\p{L}\p{N}_]+,? [\p{L}\p{N}_]+"


def clean(text: Column, least: int = 10, most: int = 4000) -> Column:
    """One line without control characters; too short: empty; too long: cut and marked with dots. Null: empty."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, " "), BLANK, " "))
    return F.when(F.length(t) < least, "").when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def without_controls(text: Column) -> Column:
    """Control characters deleted, line ends and tabs kept."""
    return F.regexp_replace(text, CONTROL, "")


def without_nulls(text: Column) -> Column:
    """NUL characters deleted."""
    return F.translate(text, "\x00", "")


def tokens(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def windows(words: Column, size: int = 2048, overlap: int = 64) -> Column:
    """Windows of ``size`` tokens, each beginning ``size - overlap`` after the one before: array of (start, words).

    The last one may lie within the one before it. ``words`` is evaluated once, not for each window.
    """
    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(w, s + 1, F.lit(size)).alias("words")))

    return F.transform(F.array(words), cut)[0]


def sentences(text: Column) -> Column:
    """Sentences: cuts after a full stop, an exclamation or a question mark before white space."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t\n\r]+", "$1\x01"), "\x01")


def names(text: Column, pattern: str = NAME) -> Column:
    """Names in order of appearance, repeats included."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), 1)


def before_marker(text: Column, marker: str) -> Column:
    """What stands before ``marker``, right-trimmed, with a line end; the text itself without one."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.concat(F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"[ \t\n\r]+$", ""), F.lit("\n"))).otherwise(text)


def between_markers(text: Column, start: str, end: str) -> Column:
    """What stands between the first ``start`` and the ``end`` after it, trimmed; null if either lacks."""
    rest = F.when(F.instr(text, start) > 0, F.substring(text, F.instr(text, start) + len(start), F.length(text)))
    return F.when(F.instr(rest, end) > 0, F.trim(F.substring_index(rest, end, 1)))


def first_match(text: Column, patterns: list[str]) -> Column:
    """Group 1 of the first of ``patterns`` that matches, trimmed; null without a match."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


def question_of(prompt: Column) -> Column:
    """The question of a prompt: after its label, up to an empty line or the answer's label."""
    return first_match(prompt, [r"(?is)question:[ \t\n\r]*(.*?)(?:\n[ \t]*\n|answer:|$)", r"(?s)([^.?!\n]*\?)"])


def context_of(prompt: Column) -> Column:
    """The context of a prompt: between its label and that of the question."""
    return first_match(prompt, [r"(?is)context:[ \t\n\r]*(.*?)(?:question:|$)"])


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _without_first_word(text: Column) -> Column:
    """The words after the first, single spaces between them; a text of one word or none stays."""
    words = F.split(stripped(text), r"\s+")
    return F.when(F.size(words) > 1, F.array_join(F.slice(words, 2, F.size(words)), " ")).otherwise(stripped(text))


#: Phrases that begin the question of a made task, and those that end one.
QUESTION_BEGINS = ["based on that information", "based on the previous passage"]
CLAIM_BEGINS = "is it true that"
QUESTION_ENDS = ["? yes, no, or maybe?", "true, false, or inconclusive?"]


def _first_place(text: Column, phrases: list[str], after: str = "") -> Column:
    """The place, from 1, of the first of ``phrases`` (followed by ``after``) in a lower-cased text; null without one."""
    return F.least(*[F.nullif(F.locate(p + after, text), F.lit(0)) for p in phrases], F.lit(None).cast("int"))


def _set_off(text: Column, phrases: list[str]) -> Column:
    """The first place where one of ``phrases`` stands after white space; null without one."""
    spaced = F.regexp_replace(text, r"\s", " ")
    return _first_place(spaced, [f" {p}" for p in phrases])


def task_context(text: Column) -> Column:
    """The passage of a made task without its first word: what stands before the question.

    Without a known beginning of a question, the lines up to the first that is blank or
    begins one. A null text gives null.
    """
    lines = F.transform(F.split(text, "\n"), stripped)
    ends = F.array_position(F.transform(lines, lambda x: (x == "") | F.startswith(F.lower(x), F.lit("based on"))), True)
    head = F.array_join(F.when(ends > 0, F.slice(lines, F.lit(1), (ends - 1).cast("int"))).otherwise(lines), " ")
    low = F.lower(text)
    at = F.coalesce(_set_off(low, QUESTION_BEGINS), _set_off(low, [CLAIM_BEGINS]))
    return _without_first_word(F.when(at.isNotNull(), F.substring(text, F.lit(1), at - 1)).otherwise(head))


def task_question(text: Column) -> Column:
    """The question of a made task; empty if it looks like none.

    From the first known beginning to the end; else a claim up to its question mark; else the whole of a text that
    ends in known answers.
    """
    low = F.lower(text)
    begins = _first_place(low, QUESTION_BEGINS, ",")
    claim = F.nullif(F.locate(CLAIM_BEGINS, low), F.lit(0))
    mark = F.locate("?", F.substring(text, claim, F.length(text)))
    whole = F.regexp_replace(low, "\n$", "")
    ended = F.endswith(whole, F.lit(QUESTION_ENDS[0])) | F.endswith(whole, F.lit(QUESTION_ENDS[1]))
    found = F.when(begins.isNotNull(), F.substring(text, begins, F.length(text))).when(claim.isNotNull() & (mark > 0), F.substring(text, claim, mark)).when(ended, text).otherwise(F.lit(""))
    return F.when(text.isNotNull(), stripped(found))


def listed_pair(text: Column, start: str = "**Sources**", end: str = "**Question**") -> Column:
    """The first two strings of the quoted list between two markers; null if there aren't two."""
    inside = between_markers(text, start, end)
    listed = F.regexp_extract(inside, r"(?s)\[(.*)\]", 1)
    quoted = F.regexp_extract_all(listed, F.lit(r"""(?s)('[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+")"""), 1)

    def plain(x: Column) -> Column:
        """A quoted string without its quotes and escapes."""
        kept = F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit("\\\\"), F.lit("\x01"))
        return F.replace(F.regexp_replace(F.replace(kept, F.lit("\\n"), F.lit("\n")), r"\\(.)", "$1"), F.lit("\x01"), F.lit("\\"))

    return F.when(F.size(quoted) >= 2, F.transform(F.slice(quoted, 1, 2), plain))
