"""Text scalars: every function takes and returns a Column."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def _bases() -> dict[str, str]:
    """Latin letters with marks, in lower case, and the letters that they stand on, as Unicode decomposes them."""
    out = {}
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        base = unicodedata.normalize("NFD", c)[0].lower()
        if base != c.lower() and base.isascii() and len(c.lower()) == 1:
            out[c.lower()] = base
    return out


#: Made from Unicode's tables when the module is read.
BASES = _bases()

# The named entities that the feeds and pages use, beside the basic ones.
ENTITIES = {
    "eacute": "é", "egrave": "è", "ecirc": "ê", "euml": "ë", "agrave": "à", "acirc": "â", "auml": "ä", "aelig": "æ",
    "ccedil": "ç", "icirc": "î", "iuml": "ï", "ocirc": "ô", "ouml": "ö", "oelig": "œ", "ugrave": "ù", "ucirc": "û",
    "uuml": "ü", "Eacute": "É", "Egrave": "È", "Ecirc": "Ê", "Agrave": "À", "Acirc": "Â", "Ccedil": "Ç", "Icirc": "Î",
    "Ocirc": "Ô", "Ugrave": "Ù", "Ucirc": "Û", "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”", "laquo": "«",
    "raquo": "»", "hellip": "…", "ndash": "–", "mdash": "—", "deg": "°", "euro": "€", "times": "×", "middot": "·", "bull": "•",
}
BASIC_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " "}

# What counts as yes.
YES = ("true", "vrai", "oui", "yes", "1")


def let(c: Column, make) -> Column:
    """make(value), where the value is worked out once however often make() names it: without this, nested rules would repeat their input at each use."""
    return F.get(F.transform(F.array(c), make), F.lit(0))


def text(c: Column) -> Column:
    """The value as text, "" for null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def trimmed(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    """Null, or nothing but white space."""
    return c.isNull() | c.rlike(r"(?U)^\s*$")


def or_null(c: Column) -> Column:
    """Null where the text is blank, so that coalesce() goes on to the next."""
    return let(c, lambda x: F.when(~blank(x), x))


def truthy(c: Column) -> Column:
    """Yes in any of its usual spellings."""
    return F.coalesce(F.lower(trimmed(c.cast("string"))).isin(*YES), F.lit(False))


def normalize(c: Column) -> Column:
    """Lower case, letters without marks, one blank between runs of a-z and 0-9; "" for null."""
    low = F.lower(text(c))
    unmarked = F.regexp_replace(F.translate(low, "".join(BASES), "".join(BASES.values())), r"\p{InCombiningDiacriticalMarks}", "")
    bare = F.when(F.octet_length(low) == F.length(low), low).otherwise(unmarked)  # ASCII has no marks
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


def truncate(c: Column, most: int = 400) -> Column:
    """Collapsed, and cut at `most` characters with "..."; at the last blank before, unless that loses over two fifths."""

    def cut(whole: Column) -> Column:
        head = F.substring(whole, 1, most)
        last = F.length(head) - F.locate(" ", F.reverse(head))
        at_word = (F.locate(" ", head) > 0) & (last > 0.6 * most)
        return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.when(at_word, F.substring(head, F.lit(1), last.cast("int"))).otherwise(head), F.lit("...")))

    return let(collapse(text(c)), cut)


def has_words(c: Column, words: Column | str) -> Column:
    """The words stand in the text in a row, whole; both normalized."""
    other = F.lit(words) if isinstance(words, str) else words
    return F.concat(F.lit(" "), c, F.lit(" ")).contains(F.concat(F.lit(" "), other, F.lit(" ")))


def listed(values: str | None) -> list[str]:
    """A setting such as "Benin, Togo; Niger" as comparable words, known when the plan is made."""
    import re

    plain = lambda v: "".join(ch for ch in unicodedata.normalize("NFD", v) if not "̀" <= ch <= "ͯ").lower()
    return [n for v in re.split("[;,]", values or "") if (n := re.sub("[^a-z0-9]+", " ", plain(v)).strip())]


def matches_any(c: Column, values: list[str]) -> Column:
    """The normalized text holds one of the values as whole words, or is held by one. Blank text matches none."""
    return let(normalize(c), lambda n: (n != "") & reduce(lambda a, b: a | b, [has_words(n, v) | has_words(F.lit(v), n) for v in values], F.lit(False)))


def _point(hexed: Column) -> Column:
    return F.decode(F.unhex(F.lpad(hexed, 4, "0")), "UTF-16BE")


def _numbered(c: Column, pattern: str, to_hex) -> Column:
    """Each numeric entity of the text by its character, a different one at a time."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    return F.aggregate(found, c, lambda done, e: F.replace(done, e, _point(to_hex(F.regexp_extract(e, pattern, 1)))))


def decode_entities(c: Column) -> Column:
    """CDATA, numeric, basic and named entities by their characters; & itself last, so that what is escaped twice is decoded once."""

    def numbers(x: Column) -> Column:
        decimal = _numbered(x, r"&#(\d+);", lambda n: F.hex(n.cast("decimal(20)").cast("long") % 65536))
        return _numbered(decimal, r"&#x([0-9a-fA-F]+);", lambda h: F.right(F.lpad(h, 4, "0"), F.lit(4)))

    def named(x: Column) -> Column:
        return reduce(lambda done, e: F.replace(done, F.lit(e[0]), F.lit(e[1])), [*BASIC_ENTITIES.items(), *((f"&{k};", v) for k, v in ENTITIES.items()), ("&amp;", "&")], x)

    plain = F.regexp_replace(text(c), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return let(plain, lambda x: F.when(x.contains("&"), named(let(x, lambda y: F.when(y.contains("&#"), numbers(y)).otherwise(y)))).otherwise(x))


def repair(c: Column) -> Column:
    """Replacement characters: an apostrophe between letters, else nothing; a capital U acute after a small letter was an e acute."""
    out = F.regexp_replace(text(c), "([A-Za-zÀ-ÿ])�([A-Za-zÀ-ÿ])", "$1'$2")
    return F.regexp_replace(F.replace(out, F.lit("�"), F.lit("")), "([a-zà-ÿ])Ú", "$1é")


def strip_tags(c: Column) -> Column:
    """Readable text of a fragment of HTML or of a feed: no tags, entities decoded, characters repaired, collapsed."""
    return collapse(repair(decode_entities(F.regexp_replace(text(c), "<[^>]*>", " "))))


def visible_text(c: Column) -> Column:
    """Text of a whole page: scripts, styles and comments go with their content."""
    hidden = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
    return collapse(F.regexp_replace(F.regexp_replace(text(c), hidden, " "), "<[^>]*>", " "))


def tag_content(c: Column, tag: str) -> Column:
    """What the first such element holds, decoded; "" if there is none."""
    return trimmed(decode_entities(F.regexp_extract(c, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)))


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def joined(*parts: Column, by: str = " - ") -> Column:
    """The parts that are not blank, with a separator between them."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), by)


def labelled(label: str, c: Column) -> Column:
    """The value behind its label, "" if it is blank."""
    return let(c, lambda x: F.when(blank(x), "").otherwise(F.concat(F.lit(label), x)))


def canonical(c: Column, values: list[str]) -> Column:
    """The value of a closed list that equals the text but for case, or null."""
    return reduce(lambda e, v: e.when(F.lower(trimmed(c)) == v.lower(), v), values, F.when(F.lit(False), ""))


def page_changed(before: Column, now: Column) -> Column:
    """There was nothing before, or something else."""
    return blank(before) | ~before.eqNullSafe(now)


def first_url(c: Column) -> Column:
    return F.regexp_extract(text(c), r"https?://[^\s<>\"']+", 0)


def notice_label(reference: Column, title: Column) -> Column:
    """What a log calls a notice: its reference, else its title, cut at 80 characters."""
    return F.coalesce(or_null(reference), F.when(F.length(title) > 80, F.concat(F.substring(title, 1, 80), F.lit("..."))).otherwise(title))


def choice_phrase(values: list[str]) -> str:
    """"A, B ou C", for a sentence made when the plan is."""
    return values[0] if len(values) == 1 else f"{', '.join(values[:-1])} ou {values[-1]}" if values else ""
