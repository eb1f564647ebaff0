"""Links: cleaning, hosts and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let, tag_content, text, trimmed

# Query parameters that only track, and hosts that a source misspells.
TRACKING = r"(?i)^(utm_|fbclid$|gclid$|mc_|ref$|ref_src$|source$|spm$|igshid$|_ga$)"
MISSPELT = {r"(?i)^https?://(www\.)?marches-public\.bj(?=[/?#]|$)": "https://www.marches-publics.bj"}


def domain_of(c: Column) -> Column:
    """The host in lower case without www., "" if the text is no web address."""
    return F.lower(F.regexp_extract(trimmed(text(c)), r"(?i)^https?://(?:www\.)?([^/?#:\s]+)", 1))


def clean_link(c: Column) -> Column:
    """The link without parameters that track; a fragment goes only where there are parameters."""
    raw = trimmed(text(c))
    for wrong, right in MISSPELT.items():
        raw = F.regexp_replace(raw, wrong, right)

    def cleaned(x: Column) -> Column:
        base = F.substring_index(x, "?", 1)
        query = F.substring_index(F.substring(x, F.length(base) + 2, F.length(x)), "#", 1)
        kept = F.filter(F.split(query, "&"), lambda p: (F.substring_index(p, "=", 1) != "") & ~F.substring_index(p, "=", 1).rlike(TRACKING))
        return F.when(~x.contains("?"), x).otherwise(F.concat_ws("?", base, F.nullif(F.array_join(kept, "&"), F.lit(""))))

    return let(raw, cleaned)


def encode_path(c: Column) -> Column:
    """The path's segments percent-encoded, once however often it is done; host and query stay. "" if it is no web address."""
    raw = trimmed(text(c))
    found = r"(?is)^(https?://[^/?#]+)([^?#]*)(.*)$"

    def segment(s: Column) -> Column:
        plain = F.coalesce(F.call_function("try_url_decode", F.replace(s, F.lit("+"), F.lit("%2B"))), s)
        out = F.replace(F.url_encode(plain), F.lit("+"), F.lit("%20"))
        for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
            out = F.replace(out, F.lit(code), F.lit(char))
        return out

    path = F.array_join(F.transform(F.split(F.regexp_extract(raw, found, 2), "/"), segment), "/")
    return F.when(raw.rlike(found), F.concat(F.regexp_extract(raw, found, 1), path, F.regexp_extract(raw, found, 3))).otherwise("")  # raw is a plain trim


def entry_link(block: Column) -> Column:
    """The link of a feed's entry: an RSS link that is a web address; else, of Atom links, the alternate one, or the first that is neither self nor edit; else the RSS text."""
    tags = F.filter(F.regexp_extract_all(block, F.lit(r"""(?is)<link\b[^>]*href=["'][^"']+["'][^>]*>"""), F.lit(0)), lambda t: ~t.rlike(r"""(?i)rel=["'](self|edit)["']"""))
    href = lambda t: F.regexp_extract(t, r"""(?i)href=["']([^"']+)["']""", 1)
    atom = let(tags, lambda held: F.coalesce(href(F.get(F.filter(held, lambda t: t.rlike(r"""(?i)rel=["']alternate["']""")), F.lit(0))), href(F.get(held, F.lit(0)))))
    return let(tag_content(block, "link"), lambda rss: F.when(rss.rlike("^https?://"), rss).otherwise(F.coalesce(atom, rss)))
