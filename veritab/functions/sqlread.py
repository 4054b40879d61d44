"""One query text as several engines read it.

Engines differ in what quotes, comments and escapes are, so that a text can hide a statement from one reader
and show it to the next. A ``Reading`` is a set of such rules. A text is cut into literals, quoted names,
comments and the rest under each of them; what differs gives a view of its own, and screens look at all views.
A text without any mark that readings disagree on has one view and is cut once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of tables and columns keep their length when they are moved out of ASCII; marks that quote names stay.
_INNER = "".join(chr(c) for c in range(0x20, 0x7F) if chr(c) not in "\"`")
_INNER_HIDDEN = "".join(chr(0xE000 + ord(c)) for c in _INNER)


@dataclass(frozen=True)
class Reading:
    """What an engine takes for quotes and comments."""

    escapes: str = ""          # quotes in which a backslash escapes the next character
    hash_comments: bool = False   # from # to the end of the line
    spaced_dashes: bool = False   # two dashes are a comment only before white space
    returns: bool = False         # a carriage return ends a line
    dollars: bool = False         # $tag$ text $tag$
    marked: bool = False          # q'[text]'
    triple: bool = False          # three quotes on either side

    def quoted(self) -> str:
        """Literals and quoted names that are closed."""
        forms = []
        if self.dollars:
            forms.append(r"(?<![\w$])\$(?<tag>\w*)\$[\s\S]*?\$\k<tag>\$")
        if self.marked:
            forms += [rf"(?<![\w$])[nN]?[qQ]'{a}[\s\S]*?{b}'" for a, b in ((r"\[", r"\]"), (r"\{", r"\}"), (r"\(", r"\)"), ("<", ">"))]
            forms.append(r"(?<![\w$])[nN]?[qQ]'(?<mark>[^\[{(<\s])[\s\S]*?\k<mark>'")
        if self.triple:
            forms += [rf"{q}{q}{q}(?:[^{q}\\]++|\\[\s\S]|{q}(?!{q}{q}))*+{q}{q}{q}" for q in ("'", '"')]
        for q in "'\"`":
            forms.append(rf"{q}(?:[^{q}\\]++|\\[\s\S])*+{q}" if q in self.escapes else f"{q}[^{q}]*+{q}")
        return "|".join(forms)

    def comments(self) -> str:
        line = r"[^\r\n]*+" if self.returns else r"[^\n]*+"
        dashes = rf"--(?=\s|$){line}" if self.spaced_dashes else rf"--{line}"
        return "|".join([dashes, r"/\*[\s\S]*?\*/"] + ([rf"#{line}"] if self.hash_comments else []))

    def open_ends(self) -> str:
        """Quotes and comments that run to the end of the text."""
        forms = [r"['\"`][\s\S]++", r"['\"`]", r"/\*[\s\S]*+"]
        if self.dollars:
            forms.append(r"(?<![\w$])\$\w*\$[\s\S]*+")
        if self.marked:
            forms.append(r"(?<![\w$])[nN]?[qQ]'[\s\S]*+")
        return "|".join(forms)

    def lexer(self) -> str:
        stop = "'\"`/\\-" + ("#" if self.hash_comments else "") + ("$" if self.dollars else "")
        rest = rf"(?:(?![nN]?[qQ]')[^{stop}])++" if self.marked else rf"[^{stop}]++"
        return "|".join([self.quoted(), self.comments(), self.open_ends(), rest, r"[\s\S]"])


STANDARD = Reading()
#: As Spark reads a text.
SPARK = Reading(escapes="'\"")
READINGS = [
    STANDARD,
    SPARK,
    Reading(escapes="'"),
    Reading(escapes="'\"", hash_comments=True, spaced_dashes=True),
    Reading(escapes="'\"", hash_comments=True, triple=True),
    Reading(escapes="'\"`", hash_comments=True, dollars=True),
    Reading(dollars=True, returns=True),
    Reading(escapes="'", dollars=True, returns=True),
    Reading(hash_comments=True),
    Reading(marked=True),
]
#: Marks that readings disagree on.
_DOUBTFUL = r"[\\#$\r]|--(?!\s|$)|[qQ]'|'''|\"\"\""


def pieces(sql: Column, reading: Reading = STANDARD) -> Column:
    return F.regexp_extract_all(sql, F.lit(reading.lexer()), F.lit(0))


def _starts(piece: Column, pattern: str) -> Column:
    return piece.rlike(rf"^(?:{pattern})")


def is_comment(piece: Column, reading: Reading = STANDARD) -> Column:
    # No other piece begins with two dashes or with a slash and a star.
    return _starts(piece, r"--[\s\S]|--$|/\*" + ("|#" if reading.hash_comments else ""))


def view(sql: Column, reading: Reading = STANDARD) -> Column:
    """Struct <text, fault> of a text under one reading.

    ``text`` has '' for each literal, a space for each comment, and the contents of quoted names moved out of
    ASCII, so that no pattern for words, commas or parentheses finds anything in them. ``fault`` tells what no
    reader can be sure of: a quote or comment left open, a comment in a comment, a comment that some engines run.
    """
    literal = "'" + (r"|\$\w*\$" if reading.dollars else "") + ("|[nN]?[qQ]'" if reading.marked else "")

    def plain(p):
        return (
            F.when(_starts(p, literal), F.lit("''"))
            .when(is_comment(p, reading), F.lit(" "))
            .when(_starts(p, '["`]'), F.translate(p, _INNER, _INNER_HIDDEN))
            .otherwise(p))

    def fault(p):
        quoted = _starts(p, literal + '|["`]')
        return (
            F.when((quoted & ~p.rlike(rf"^(?:{reading.quoted()})\z")) | p.rlike(r"^/\*(?![\s\S]*\*/\z)|^/\*/\z"), "a quote or comment is left open")
            .when(p.rlike(r"^/\*[!+M]*!"), "executable comment")
            .when(p.rlike(r"^/\*[\s\S]*/\*"), "comment in a comment"))

    def told(ps):
        faults = F.filter(F.transform(ps, fault), lambda f: f.isNotNull())
        return F.struct(F.array_join(F.transform(ps, plain), "").alias("text"), F.coalesce(F.get(faults, F.lit(0)), F.lit("")).alias("fault"))

    return F.get(F.transform(F.array(pieces(sql, reading)), told), F.lit(0))


def views(sql: Column) -> Column:
    """The different views of a text, the standard one first."""
    every = F.array_distinct(F.array(*[view(sql, r) for r in READINGS]))
    return F.when(sql.rlike(_DOUBTFUL), every).when(sql.isNotNull(), F.array(view(sql)))


def over_views(sql: Column, found) -> Column:
    """Distinct entries that ``found`` gives for the texts of all views, in order."""
    return F.array_distinct(F.flatten(F.transform(views(sql), lambda v: found(v["text"]))))


def strip_comments(sql: Column, reading: Reading = STANDARD) -> Column:
    """The text with a space for each comment; marks inside literals and quoted names are no comments."""
    return F.array_join(F.transform(pieces(sql, reading), lambda p: F.when(is_comment(p, reading), F.lit(" ")).otherwise(p)), "")
