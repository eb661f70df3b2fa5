"""Typography of assembled text, and lines that are only a page number: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Marks, Arabic letters with presentation forms, their marks, direction marks, digits.
MARKS = r".،؛:؟!,;?"
LETTERS = r"\x{0621}-\x{063A}\x{0641}-\x{064A}\x{066E}\x{066F}\x{0671}-\x{06D3}\x{06D5}\x{06EE}\x{06EF}\x{06FA}-\x{06FC}\x{06FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFC}"
VOWELS = r"\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E8}\x{06EA}-\x{06ED}"
BIDI = r"[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
_D, _W = "0-9٠-٩۰-۹", rf"[{LETTERS}{VOWELS}]"
#: What a line of a page number holds beside digits; a number's digits at most; edge lines of marks alone.
AROUND_NUMBER = r"\s\-‐‑‒–—―ـ.·•…()\[\]{}﴾﴿<>«»"
MOST_DIGITS, EDGE_MARKS = 20, 2


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]+", " "), "^ | $", "")


def without_tatweel(text: Column) -> Column:
    """Tatweel inside or at the edge of a word goes; one that stands alone is a dash, and one after a prefix of one or two
    letters that is written apart stays."""
    letter = rf"[\p{{L}}{VOWELS}&&[^ـ]]"
    inside = F.regexp_replace(text, rf"ـ+(?={letter})", "")
    return F.regexp_replace(inside, rf"(?<=[\p{{L}}&&[^ـ]][{VOWELS}]{{0,4}}[\p{{L}}&&[^ـ]][{VOWELS}]{{0,4}}[\p{{L}}&&[^ـ]][{VOWELS}]{{0,4}})ـ+(?!{letter})", "")


def unglued(text: Column) -> Column:
    """A mark that begins a word ends the one before; marks between two words get a space after them.

    A full stop does so only between words of three letters or more, so abbreviations stay.
    """
    t = F.regexp_replace(text, rf"(\S)\s+([{MARKS}]+)(?=[{LETTERS}])", "$1$2 ")
    t = F.regexp_replace(t, rf"(?<={_W})([،؛؟!,;?:])(?=[{LETTERS}])", "$1 ")
    t = F.regexp_replace(t, rf"(?<={_W}{{3}})(\.)(?=[{LETTERS}]{_W}{{2}})", "$1 ")
    return F.regexp_replace(t, rf"(?<=[)\]»”])([{MARKS}])(?=[{LETTERS}])", "$1 ")


def quotes(text: Column) -> Column:
    """The text cut at its quotation marks: ``array<struct<text, quote, role>>``, each stretch with the mark after it.

    Opening marks open.  A closing mark closes one that is open; else it is read from what stands around it: before a mark,
    a closer, a note's number or the end it closes, and so it does where it adjoins the word before alone; else it
    opens.  One fold over the marks carries how many of either kind are open.
    """
    parts = F.split(F.regexp_replace(text, "([«»“”])", "\x01$1\x01"), "\x01")
    n = F.size(parts)
    at = lambda i: F.get(parts, i)

    def fold(state, i):
        mark, before, after = at(2 * i + 1), at(2 * i), at(2 * i + 2)
        beyond = F.coalesce(at(2 * i + 3), F.lit(""))
        rest = F.concat(F.regexp_replace(after, r"^\s+", ""), beyond)
        ends = (2 * i + 3) >= n
        starts_spaced = F.when(before == "", i == 0).otherwise(before.rlike(r"\s$"))
        ends_spaced = F.when(after == "", ends).otherwise(after.rlike(r"^\s"))
        number = rest.rlike(rf"^[{_D}]{{1,3}}(?=\s*(?:$|[{MARKS}]))")
        closes = (rest == "") | rest.rlike(rf"^[{MARKS})\]»”]") | (~starts_spaced & ends_spaced) | number
        kind = F.when(mark.isin("«", "»"), "g").otherwise("c")
        open_ = F.when(kind == "g", state["g"]).otherwise(state["c"])
        role = F.when(mark.isin("«", "“"), "open").when(open_ > 0, "close").when(closes, "close").otherwise("open")
        step = F.when(role == "open", 1).when(open_ > 0, -1).otherwise(0)
        return F.struct((state["g"] + F.when(kind == "g", step).otherwise(0)).alias("g"), (state["c"] + F.when(kind == "c", step).otherwise(0)).alias("c"), F.concat(state["roles"], F.array(role)).alias("roles"))

    start = F.struct(F.lit(0).alias("g"), F.lit(0).alias("c"), F.array().cast("array<string>").alias("roles"))
    count = F.floor((n - 1) / 2).cast("int")
    roles = F.when(count > 0, F.aggregate(F.sequence(F.lit(0), count - 1), start, fold)["roles"]).otherwise(F.array().cast("array<string>"))
    return F.transform(F.sequence(F.lit(0), count), lambda i: F.struct(at(2 * i).alias("text"), F.coalesce(at(2 * i + 1), F.lit("")).alias("quote"), F.get(roles, i).alias("role")))


def tightened(text: Column) -> Column:
    """No space before marks and closers and none after openers, quotation marks by their roles."""
    cut = quotes(text)

    def one(x, i):
        left = F.when(F.get(cut, i - 1)["role"] == "open", F.regexp_replace(x["text"], r"^\s+", "")).otherwise(x["text"])
        return F.concat(F.when(x["role"] == "close", F.regexp_replace(left, r"\s+$", "")).otherwise(left), x["quote"])

    t = F.when(text.rlike("[«»“”]"), F.array_join(F.transform(cut, one), "")).otherwise(text)
    return F.regexp_replace(F.regexp_replace(t, rf"\s+(?=[{MARKS})\]])", ""), r"(?<=[(\[])\s+", "")


def typeset(text: Column, tatweel: bool = True, arabic_digits: bool = False) -> Column:
    """A text as it is set: direction marks and stretched letters out, marks and spaces in place, digits of one kind.  Null stays null."""
    t = collapsed(F.regexp_replace(text, BIDI, ""))
    t = unglued(without_tatweel(t) if tatweel else t)
    t = T.to_western_digits(collapsed(tightened(t)))
    return F.translate(t, "0123456789", "٠١٢٣٤٥٦٧٨٩") if arabic_digits else t


def page_number(line: Column) -> Column:
    """Western digits of a line that is only a page number, else null."""
    t = F.trim(line)
    digits = F.substring(T.to_western_digits(F.regexp_replace(t, f"[^{_D}]", "")), 1, MOST_DIGITS)
    return F.when(t.rlike(rf"^[{AROUND_NUMBER}{_D}]*[{_D}][{AROUND_NUMBER}{_D}]*$"), digits)


def without_page_numbers(text: Column) -> Column:
    """``struct<text, number>``: the text less a first and a last line that is only a page number, and that number ('' if none).

    Lines of marks alone between such a line and the page's edge (two at most) go with it.  The last line's number counts
    before the first's; a page of one line keeps it.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    filled = F.filter(F.transform(lines, lambda s, i: F.when(F.trim(s) != "", i)), lambda i: i.isNotNull())
    plain = lambda i: (~F.get(lines, i).rlike(f"[{_D}]")) & F.trim(F.get(lines, i)).rlike(rf"^[{AROUND_NUMBER}]+$")

    def edge(run):
        """The lines of one edge up to the first that has a digit or a letter."""
        near = F.slice(run, 1, EDGE_MARKS + 1)
        stop = F.array_position(F.transform(near, lambda i: ~plain(i)), True).cast("int")
        return F.when(stop > 0, F.slice(near, 1, stop)).otherwise(near)

    head, tail = edge(filled), edge(F.reverse(filled))
    whole = F.size(F.array_union(head, tail)) >= F.size(filled)
    head, tail = F.when(whole, F.slice(filled, 1, 1)).otherwise(head), F.when(whole, F.slice(filled, -1, 1)).otherwise(tail)
    none = F.array().cast("array<int>")
    bound = F.struct(head.alias("head"), tail.alias("tail"))
    number = lambda run: page_number(F.get(lines, F.element_at(run, -1)))

    def decide(b):
        first, last = number(b["head"]), number(b["tail"])
        drop = F.concat(F.when(first.isNotNull(), b["head"]).otherwise(none), F.when(last.isNotNull(), b["tail"]).otherwise(none))
        kept = F.array_join(F.filter(lines, lambda s, i: ~F.array_contains(drop, i)), "\n")
        cut = F.regexp_replace(F.regexp_replace(kept, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
        return F.struct(F.when(F.size(drop) > 0, cut).otherwise(text).alias("text"), F.coalesce(last, first, F.lit("")).alias("number"))

    # A list of one binds both edges to a name, so they are worked out once.
    some = F.get(F.transform(F.array(bound), decide), F.lit(0))
    return F.when(F.size(filled) >= 2, some).otherwise(F.struct(text.alias("text"), F.lit("").alias("number")))
