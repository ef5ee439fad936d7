"""Column functions on markup: tokens, names, entities, scripts, bodies, flat text. All run inside Catalyst.

A token is a comment, a tag (to its first ``>``) or the text between; joined, tokens give the markup. What depends on where
elements end is in :mod:`lorestack.operators.structure`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorestack.functions.text import SPACES, trim_unicode

#: Elements whose content is never text, elements without an end tag, elements that break a line.
OPAQUE = ("head", "style", "script", "title", "noscript")
VOID = ("br", "hr", "img", "input", "meta", "link", "source", "col", "area")
BREAKS = ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "blockquote", "section", "hr", "body")
#: Elements that may not stay, attributes that hold an address, schemes that run code.
REMOVED = ("script", "iframe", "object", "embed")
ADDRESSES = ("href", "src", "action", "formaction")
SCHEMES = ("javascript", "vbscript")
#: Named entities that are decoded; any other stays as it is.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…"}
#: Attributes of a body that stay, in this order.
BODY_ATTRIBUTES = ("class", "id", "lang", "dir", "style")

#: Patterns without look-around or back-references, so that other engines read them alike.
TOKEN = r"(?s)<!--.*?(?:-->|\z)|<[^>]*(?:>|\z)|[^<]+"
#: An element of a name, whatever its prefix, to the next end tag of the name; without one to the end.
_WHOLE = r"<[/\s]*(?:[^\s/>]*:)?{0}(?:[\s/][^>]*)?>.*?(?:</{0}[^>]*(?:>|\z)|\z)"
_CLOSED = r"<[/\s]*(?:[^\s/>]*:)?{0}(?:[\s/][^>]*)?/\s*>"
SCRIPT_TOKEN = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(_CLOSED.format(n) for n in REMOVED) + "|" + "|".join(_WHOLE.format(n) for n in REMOVED) + r"|<[^>]*(?:>|\z)|[^<]+"
FLAT_TOKEN = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(_WHOLE.format(n) for n in ("head", "style", "script")) + r"|<[^>]*(?:>|\z)|[^<]+"
DROPPED = r"(?is)^<(?:!--|[/\s]*(?:[^\s/>]*:)?(?:{})(?:[\s/>]))"
QUOTES = r"""^[\s"']+|[\s"']+$"""
SENTENCE_END = r"""(?U)([.!?…]["')\]»”’]*+)\s++(?![.!?…])"""
ATTRIBUTE = r"""[^\s=/]+(?:\s*=\s*(?:"[^"]*"?|'[^']*'?|[^\s"'][^\s]*))?"""
ENTITY_TOKEN = r"(?s)&(?:#[xX][0-9a-fA-F]{1,10}|#[0-9]{1,11}|[A-Za-z]{1,12});|[^&]+|&"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def tokens(markup: Column) -> Column:
    """The tokens of markup, in order."""
    return _all(markup, TOKEN)


def is_tag(token: Column) -> Column:
    """Start tags, end tags and declarations; no comments."""
    return token.startswith("<") & ~token.startswith("<!--")


def tag_body(token: Column) -> Column:
    return F.regexp_replace(token, r"(?s)^<|>$", "")


def tag_name(token: Column) -> Column:
    """The name of a tag in lower case, without slash and prefix."""
    return F.lower(F.regexp_extract(token, r"(?s)^<[/\s]*(?:[^ \t\n\r/>]*:)?([^ \t\n\r/>:]*)", 1))


def decode_entities(text: Column) -> Column:
    """Each entity once, in one pass; unknown names and impossible numbers stay."""
    named = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in (f"&{pair[0]};", pair[1])))

    def one(t: Column) -> Column:
        digits = F.regexp_extract(t, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
        code = F.when(t.rlike("^&#[xX]"), F.conv(digits, 16, 10).cast("long")).when(t.startswith("&#"), digits.cast("long"))
        possible = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        number = F.when(possible, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.when(t.startswith("&") & (F.length(t) > 2), F.coalesce(F.when(t.startswith("&#"), number).otherwise(F.try_element_at(named, t)), t)).otherwise(t)

    return F.when(text.contains("&"), F.array_join(F.transform(_all(text, ENTITY_TOKEN), one), "")).otherwise(text)


def escape_attribute(value: Column) -> Column:
    """For double quotes: & " < > as entities."""
    for mark, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(mark), F.lit(entity))
    return value


def _runs_code(attribute: Column) -> Column:
    """Whether a value's scheme, by its letters alone, runs code."""
    value = F.regexp_replace(F.regexp_extract(attribute, r"(?s)=(.*)$", 1), QUOTES, "")
    scheme = F.lower(F.regexp_replace(F.substring_index(value, ":", 1), "[^A-Za-z]", ""))
    rest = F.lower(F.ltrim(F.regexp_replace(value, r"(?s)^[^:]*:\s*", "")))
    return value.contains(":") & (scheme.isin(*SCHEMES) | ((scheme == "data") & rest.startswith("text/html")))


def _clean_tag(tag: Column) -> Column:
    """A tag without event attributes and addresses that run code; one without attributes as it is."""
    body = tag_body(tag)
    name, rest = F.regexp_extract(body, r"(?s)^[^ \t\n\r]*", 0), F.regexp_replace(body, r"(?s)^[^ \t\n\r]*", "")
    key = lambda a: F.lower(F.regexp_extract(a, r"^[^\s=/]+", 0))
    kept = F.filter(_all(rest, ATTRIBUTE), lambda a: ~(key(a).startswith("on") | (key(a).isin(*ADDRESSES) & _runs_code(a))))
    made = F.concat(F.lit("<"), name, F.array_join(F.transform(kept, lambda a: F.concat(F.lit(" "), a)), ""), F.when(body.rlike(r"/\s*$"), "/").otherwise(""), F.lit(">"))
    return F.when((F.regexp_replace(rest, r"\s", "") == "") | ~tag.endswith(">"), tag).otherwise(made)


def strip_scripts(markup: Column) -> Column:
    """Without elements that carry code or documents (whatever their prefix; unclosed ones to the end), comments, event
    attributes and addresses that run code. Attributes of tags that have any are set apart by single spaces."""
    dropped = DROPPED.format("|".join(REMOVED))
    each = F.transform(_all(markup, SCRIPT_TOKEN), lambda t: F.when(~t.startswith("<"), t).when(t.rlike(dropped) & (t.contains(">") | t.startswith("<!--")), "").otherwise(_clean_tag(t)))
    return F.when(markup.contains("<"), F.array_join(each, "")).otherwise(markup)


def body_tag(markup: Column) -> Column:
    """The body's start tag with the attributes that may stay, in a fixed order, quoted anew."""
    inside = F.regexp_replace(F.regexp_extract(markup, r"(?is)<body([^>]*)>", 1), "/+$", "")
    out = F.lit("<body")
    for name in BODY_ATTRIBUTES:
        quoted = F.regexp_extract(inside, rf"""(?s)\s{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
        value = escape_attribute(decode_entities(F.substring(quoted, F.lit(2), F.length(quoted) - 2)))
        out = F.concat(out, F.when(quoted != "", F.concat(F.lit(f' {name}="'), value, F.lit('"'))).otherwise(""))
    return F.concat(out, F.lit(">"))


def body_of(markup: Column) -> Column:
    """What the body holds, to the first end tag after it; a fragment without one is all of it."""
    return F.when(markup.rlike(r"(?is)<body[^>]*>"), F.regexp_extract(markup, r"(?is)<body[^>]*>(.*?)(?:</body>|\z)", 1)).otherwise(markup)


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""(?s)\s{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    return F.when(quoted != "", decode_entities(F.substring(quoted, F.lit(2), F.length(quoted) - 2)))


def xhtml_to_text(markup: Column, markers: Column | None = None) -> Column:
    """Paragraphs with a blank line between them. ``markers`` (a map from an image's address) gives marker lines."""
    skipped = DROPPED.format("head|style|script")

    def one(t: Column) -> Column:
        line = F.lit("")
        if markers is not None:
            source = F.coalesce(_attribute(t, "src"), _attribute(t, "xlink:href"))
            line = F.coalesce(F.concat(F.lit("\n"), F.try_element_at(markers, source), F.lit("\n")), F.lit(""))
        tag = F.when(t.rlike(skipped), "").when(tag_name(t).isin("img", "image"), line).when(tag_name(t).isin(*BREAKS), "\n").otherwise("")
        return F.when(~t.startswith("<"), decode_entities(t)).when(~t.endswith(">"), "").otherwise(tag)

    flat = F.array_join(F.transform(_all(markup, FLAT_TOKEN), one), "")
    lines = F.transform(F.split(flat, r"\r?\n"), lambda s: trim_unicode(F.regexp_replace(s, SPACES, " ")))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n\n")
