"""Text expressions: tokens, plain text of HTML, paragraphs, corpus lines."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed class: every character that separates words, including no-break and wide spaces.
WHITE_SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"

# A word this long or longer is dropped from comment sentences.
MAX_WORD_LENGTH = 50

# All named entities of HTML, by name without the semicolon, from the standard library's table.
NAMED_ENTITIES = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}

# Markup as a regular grammar of the HTML standard's tokenizer states. Loops inside tags are possessive and those up
# to an end mark lazy, so no long attribute or comment needs a deep stack. The end of the page closes whatever is open.
BLANK = r"[ \t\n\f\r]"
VALUE = rf"""{BLANK}*+=(?:{BLANK}*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|(?!["'])[^ \t\n\f\r>]*+))"""
ATTRIBUTES = rf"(?:[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:{VALUE})?+)*+(?:>|\z)"
NAME_END = r"(?=[ \t\n\f\r/>])"
COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))"
HIDDEN = rf"<(script|style){NAME_END}{ATTRIBUTES}.*?(?:</\1{NAME_END}{ATTRIBUTES}|\z)"
LITERAL = rf"<(title|textarea){NAME_END}{ATTRIBUTES}(.*?)(?:</\2{NAME_END}{ATTRIBUTES}|\z)"  # text in which nothing is a tag
PARAGRAPH_TAG = rf"<(p){NAME_END}{ATTRIBUTES}"
ANY_TAG = rf"</?[a-z][^ \t\n\f\r/>]*+{ATTRIBUTES}"
DECLARATION = r"<[!?][^>]*+(?:>|\z)|</[^a-z>][^>]*+(?:>|\z)|</>"
MARKUP = "(?is)" + "|".join([COMMENT, HIDDEN, LITERAL, PARAGRAPH_TAG, ANY_TAG, DECLARATION])
NUL = "\0"  # not allowed in HTML, so it can stand for a piece of markup

def tokenize(c: Column, lower: bool = True) -> Column:
    words = F.split(F.lower(c) if lower else c, WHITE_SPACE)
    return F.filter(words, lambda w: w != "")


def short_words(words: Column, limit: int = MAX_WORD_LENGTH) -> Column:
    return F.filter(words, lambda w: F.length(w) < limit)


def _entity(piece: Column) -> Column:
    """Decode one piece of text that followed an ampersand."""
    # One constant map, made when the plan is; a column a name would make the plan thousands of nodes wide.
    table = F.from_json(F.lit(json.dumps(NAMED_ENTITIES)), "map<string,string>")
    name = F.regexp_extract(piece, "^([a-zA-Z][a-zA-Z0-9]*);", 1)
    named = F.when(name != "", F.concat(F.try_element_at(table, name), F.substr(piece, F.length(name) + F.lit(2))))
    hexa = F.regexp_extract(piece, r"^#[xX]0*([0-9a-fA-F]{1,6});", 1)
    deci = F.regexp_extract(piece, r"^#0*([0-9]{1,7});", 1)
    code = F.when(hexa != "", F.conv(hexa, 16, 10)).when(deci != "", deci).cast("int")
    known = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    char = F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")
    rest = F.regexp_replace(piece, r"^#[xX]?[0-9a-fA-F]+;", "")
    return F.coalesce(named, F.when(known, F.concat(char, rest)), F.concat(F.lit("&"), piece))


def decode_entities(c: Column) -> Column:
    """One pass over the ampersands, so that decoded text is never decoded again."""
    pieces = F.transform(F.split(c, "&"), lambda p, i: F.when(i == 0, p).otherwise(_entity(p)))
    return F.when(c.contains("&"), F.array_join(pieces, "")).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Visible text; a paragraph tag starts a new line, other tags separate words.

    Quoted attributes may hold ``>``; comments, scripts and styles go whole; a title's or text area's content stays as it
    is; a tag, comment or script without an end reaches to the end of the page. NUL characters are dropped. A script
    inside a comment inside a script ends where the first one ends.
    """
    # Markup becomes NUL, paragraph's name, NUL, literal content: one pass, so that no text is read as markup again.
    text = F.regexp_replace(F.replace(c, F.lit(NUL), F.lit("")), MARKUP, f"{NUL}$4{NUL}$3 ")
    text = F.regexp_replace(text, f"{NUL}[pP]{NUL}", "\n")
    text = F.replace(text, F.lit(NUL), F.lit(" "))
    text = decode_entities(text)
    text = F.regexp_replace(text, "[ \\t\\r\\f\\x0B\\xA0]+", " ")
    text = F.regexp_replace(text, " ?\\n[ \\n]*", "\n")
    return F.regexp_replace(text, "^[ \\n]+|[ \\n]+$", "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda s: s != "")


def one_line(c: Column) -> Column:
    """Newlines and tabs become spaces, so the text fits one field of a tab-separated line."""
    return F.translate(c, "\n\t", "  ")


def title_tag(id_: Column) -> Column:
    return F.concat(F.lit("TITLE_"), id_.cast("string"))
