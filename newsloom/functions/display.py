"""How items are shown: labels, badges, trimmed titles, escaped text, candidate addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import bound


def escape(text: Column) -> Column:
    """HTML-escaped; **bold** becomes b elements."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return F.regexp_replace(text, r"\*\*([^*]+)\*\*", "<b>$1</b>")


def headline(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def short_title(title: Column, fallback: Column, least: int = 15, limit: int = 60) -> Column:
    """The title, or the fallback cut at its last separator behind the first `least` characters, within the limit."""
    head = F.substring(fallback, 1, limit)
    cut = F.regexp_extract(head, rf"^(.{{{least},}})[,;:. -][^,;:. -]*$", 1)
    return F.when(
        F.length(F.coalesce(title, F.lit(""))) > 0, F.substring(title, 1, limit)
    ).when(F.length(fallback) <= limit, fallback).when(F.length(cut) > 0, cut).otherwise(head)


def days_running(first: Column, now: Column) -> Column:
    return F.datediff(now, first) + 1


def domain(
    stated: Column, leaf: Column, blob: Column, names: list[str], leaves: dict[str, str], words: list[tuple[str, list[str]]], default: str
) -> Column:
    """A topic domain for every item: the one stated, the leaf's, the first whose words occur, or the default."""
    out = F.when(stated.isin(names), stated)
    for name, of in leaves.items():
        out = out.when(leaf == name, of)
    for name, some in words:
        out = out.when(F.lower(blob).rlike("|".join(some)), name)
    return out.otherwise(default)


#: what is replaced in a readme, and by what: fences, images, links, tags, marks, white space
README = (
    (r"(?s)```.*?```", " "), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]*>", " "), (r"[#*`>_]+", ""),
    (r"[ \t\n\r\f\x0b]+", " ")
)


def plain_readme(text: Column, limit: int = 2000) -> Column:
    """Markdown without fences, images, links, marks and headings."""
    for pattern, by in README:
        text = F.regexp_replace(text, pattern, by)
    return F.substring(F.trim(text), 1, limit)


def candidate_urls(url: Column, limit: int = 6) -> Column:
    """Other addresses at which a dead feed may be: scheme and www swapped, then the usual feed paths; distinct, in order."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^https?://(www\.)?", ""), "/+$", "")
    host = F.regexp_extract(bare, r"^([^/?#]*)", 1)
    made = [F.concat(F.lit("https://"), bare), F.concat(F.lit("https://www."), bare), F.concat(F.lit("http://"), bare)]
    made += [F.concat(F.lit("https://"), host, F.lit(p)) for p in ("/feed", "/rss", "/rss.xml", "/atom.xml", "/feed.xml")]
    return F.slice(F.filter(F.array_distinct(F.array(*made)), lambda u: u != url), 1, limit)


def first_json_object(text: Column) -> Column:
    """The text from the first to the last brace, without code fences."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    return F.regexp_extract(bare, r"(?s)(\{.*\})", 1)


def relative_day(day: Column, today: Column) -> Column:
    """today, yesterday, n days ago up to a week, else month and day."""
    n = F.datediff(today, day)
    return F.when(n == 0, "today").when(n == 1, "yesterday").when(
        n.between(2, 7), F.concat(n.cast("string"), F.lit(" days ago"))
    ).otherwise(F.date_format(day, "MM-dd"))


def shift_of(stored: Column, at: Column) -> Column:
    """The stored shift, else pm from noon on."""
    return F.coalesce(F.nullif(stored, F.lit("")), F.when(F.hour(at) >= 12, "pm").otherwise("am"))


def signal_text(source: Column, title: Column, number: Column) -> Column:
    """How a signal reads: its service's name for the number, then the title."""
    unit = F.when(source == "hn", "points").when(source == "reddit", "upvotes").when(source == "hf", "likes").otherwise("stars")
    return F.concat(F.lit("["), F.upper(source), F.lit(" "), F.coalesce(number, F.lit(0)).cast("string"), F.lit(" "), unit, F.lit("] "), title)


def signal_id(source: Column, own_id: Column, url: Column) -> Column:
    """Identity of a signal: its service's own id, or a digest of the address where the service has none."""
    return F.concat(source, F.lit(":"), F.coalesce(own_id, F.substring(F.sha2(url, 256), 1, 16)))


def escaped_newlines(text: Column) -> Column:
    """JSON whose strings hold raw line ends or tabs, with these escaped; the space between values stays.

    The text is cut at quotes that no backslash escapes; every second piece is within a string.
    """
    pieces = F.split(text, r'(?<!\\)"')
    safe = F.transform(
        pieces,
        lambda p, i: F.when(
            i % 2 == 1, F.replace(F.replace(F.replace(p, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
        ).otherwise(p)
    )
    return F.array_join(safe, '"')


def closed_json(text: Column, tries: int = 4) -> Column:
    """Repairs of JSON that breaks off, best first: its last value, then one, two, ... members dropped, and what is open closed."""

    def close(part: Column) -> Column:
        missing = lambda k, a, b: F.greatest(F.lit(0), F.regexp_count(k, F.lit(a)) - F.regexp_count(k, F.lit(b)))
        return bound(
            F.regexp_replace(part, r"[,\s]+$", ""),
            lambda k: F.concat(k, F.repeat(F.lit("]"), missing(k, r"\[", r"\]")), F.repeat(F.lit("}"), missing(k, r"\{", r"\}"))),
        )

    cuts = F.array(text, *(F.regexp_replace(text, rf"(?s)(?:,[^,]*){{{i}}}$", "") for i in range(1, tries)))
    quoted = F.transform(cuts, lambda c: F.when(F.regexp_count(c, F.lit('"')) % 2 == 1, F.concat(c, F.lit('"'))).otherwise(c))
    return F.flatten(F.transform(quoted, lambda w: F.array(close(w), close(F.regexp_replace(w, r',\s*"[^"]*"\s*:?\s*$', "")))))


def tolerant_json(text: Column, schema: str, tries: int = 4) -> Column:
    """The object in a text by schema: without fences, with line ends in strings escaped, from brace to brace, or repaired where it breaks off.

    The first reading counts that has any field; null if none does. Later readings are not tried then: each costs a parse, and a failed one
    an exception. Who takes several fields should select the object first, or each field reads it again.
    """
    names = [f.strip().split()[0] for f in schema.split(",")]

    def read(form: Column) -> Column:
        some = lambda x: F.when(F.coalesce(*(F.when(x[n].isNotNull(), True) for n in names), F.lit(False)), x)
        return F.when(F.try_parse_json(form).isNotNull(), bound(F.from_json(form, schema, {"mode": "PERMISSIVE"}), some))

    def repaired(escaped: Column) -> Column:
        whole = bound(F.regexp_extract(escaped, r"(?s)(\{.*\})", 1), read)
        return F.coalesce(whole, bound(closed_json(escaped, tries), lambda forms: F.coalesce(*(bound(F.get(forms, F.lit(i)), read) for i in range(2 * tries)))))

    bare = F.trim(F.regexp_replace(text, r"```(?:json)?", ""))
    first = bound(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), read)
    return F.coalesce(first, bound(F.regexp_extract(escaped_newlines(bare), r"(?s)(\{.*)$", 1), repaired))
