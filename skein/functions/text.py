"""Text functions on columns: ids, links, sections, status markers, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the note format.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The characters that WS stands for, one by one: trimming by them reads the ends of a text only, where a pattern would be tried at each of its places.
SPACES = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NOT_WORD = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}-]"
LINK = r"\[\[([^\]]+)\]\]"
TAG_LINE = r"(?md)^Tags:(.*)$"
STATUS_LINE = r"(?md)^Status:(.*)$"
#: Words and line starts of sources that hold no knowledge.
KEYWORDS = ("todo", "to-do", "meeting", "journal", "daily note", "progress update", "changelog", "build log", "status update")
#: Fixed value: what the name of a collection starts with.
COLLECTION = "zettels__"
LIST_STARTS = ("- ", "* ", "1. ", "2. ", "3. ", "[ ]", "[x]")


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def sanitize(title: Column) -> Column:
    """A title as a file name without extension: word characters in lower case, joined by dashes."""
    bare = strip(F.regexp_replace(title, NOT_WORD, ""))
    dashed = F.regexp_replace(F.regexp_replace(bare, rf"(?:_|{WS})+", "-"), "-+", "-")
    return F.lower(F.substring(dashed, 1, 100))


def normalize_id(link: Column) -> Column:
    """The id that a link or title stands for; of ``target|alias`` the last part counts."""
    return sanitize(F.element_at(F.split(link, r"\|"), -1))


def section(content: Column, heading: str) -> Column:
    """Body of the first section with that heading, up to the next ``# `` line."""
    return F.regexp_extract(content, rf"(?msd)^# {heading}{WS}*\n(.*?)(?=^# |\z)", 1)


def links_in(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(LINK), F.lit(1))


def tag_links(content: Column) -> Column:
    return links_in(F.regexp_extract(content, TAG_LINE, 1))


def see_also_links(content: Column) -> Column:
    return links_in(section(content, "See Also"))


def reference_links(content: Column) -> Column:
    return links_in(section(content, "References"))


def ids_of(links: Column) -> Column:
    return F.transform(links, normalize_id)


def unique_ids(links: Column) -> Column:
    """Ids in order of first occurrence, empty ones dropped."""
    return F.array_distinct(F.filter(ids_of(links), lambda x: x != ""))


def without_see_also(content: Column) -> Column:
    return F.concat(strip(F.regexp_replace(content, rf"(?msd)\n*^# See Also{WS}*\n.*?(?=^# |\z)", "\n")), F.lit("\n"))


def with_tags(content: Column, ids: Column) -> Column:
    """Every ``Tags:`` line rewritten to the ids (plain ids, so no character needs escaping)."""
    line = rstrip(F.concat(F.lit("Tags: "), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("[["), i, F.lit("]]"))), " ")))
    return F.regexp_replace(content, F.lit(r"(?md)^Tags:.*$"), line)


def with_section(content: Column, heading: str, body: Column) -> Column:
    """Replaces all sections with that heading; else inserts before References, else appends."""
    text = F.when(strip(body) != "", rstrip(F.concat(F.lit(f"# {heading}\n\n"), strip(body)))).otherwise(F.lit(f"# {heading}"))
    # backslashes and dollars are not to be read as parts of a pattern's replacement
    quoted = F.regexp_replace(text, r"([\\$])", r"\\$1")
    pattern = rf"(?msd)^# {heading}{WS}*\n.*?(?=^# |\z)"
    replaced = rstrip(F.regexp_replace(content, F.lit(pattern), F.concat(quoted, F.lit("\n\n"))))
    before = rstrip(F.regexp_replace(content, F.lit(r"(?smd)\A(.*?)^# References\b"), F.concat(F.lit("$1"), quoted, F.lit("\n\n# References"))))
    out = F.when(content.rlike(pattern), replaced)
    if heading != "References":
        out = out.when(content.rlike(r"(?md)^# References\b"), before)
    return F.concat(out.otherwise(F.concat(rstrip(content), F.lit("\n\n"), text)), F.lit("\n"))


def _lines(content: Column) -> Column:
    return F.filter(F.transform(F.split(content, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x != "")


def is_processed(content: Column) -> Column:
    """A status line that says #processed as a word, or a last line that is #processed."""
    status = F.regexp_extract(content, STATUS_LINE, 1).rlike(rf"(^|{WS})#processed({WS}|\z)")
    last = F.coalesce(F.try_element_at(_lines(content), F.lit(-1)) == "#processed", F.lit(False))
    # lines are read only of texts that have the word
    word = content.contains("#processed")
    return F.when(word, status | last).otherwise(word)


def mark_processed(content: Column) -> Column:
    marked = F.regexp_replace(content, r"(?smd)\A(.*?)^(Status:[^\n]*)", "$1$2 #processed")
    added = F.concat(rstrip(content), F.lit("\n\nStatus: #processed\n"))
    return F.when(is_processed(content), content).when(content.rlike(STATUS_LINE), marked).otherwise(added)


def is_non_extractable(content: Column) -> Column:
    """At least two keywords, or at least 0.6 of the lines start as list items."""
    low = F.lower(content)
    hits = sum((low.contains(k).cast("int") for k in KEYWORDS), F.lit(0))

    def starts(line):
        out = F.lit(False)
        for s in LIST_STARTS:
            out = out | line.startswith(s)
        return out

    listed = F.transform(F.array(_lines(content)), lambda lines: (F.size(lines) > 0) & (F.size(F.filter(lines, starts)) >= F.size(lines) * 0.6))
    return F.when(hits >= 2, F.lit(True)).otherwise(F.get(listed, F.lit(0)))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def render_note(title: Column, body: Column, tags: Column, similar: Column, source: Column, template: str, at: Column) -> Column:
    """A note from the template; at is the time that it shows."""
    c = F.replace(F.replace(F.lit(template), F.lit("{{date}}"), F.date_format(at, "dd-MM-yyyy")), F.lit("{{time}}"), F.date_format(at, "HH:mm"))
    c = with_tags(c, unique_ids(tags))
    if "# {{Title}}" in template:
        c = F.replace(c, F.lit("# {{Title}}"), F.concat(F.lit("# "), title, F.lit("\n\n"), strip(body)))
    else:
        c = F.concat(rstrip(F.replace(c, F.lit("{{Title}}"), title)), F.lit("\n\n"), strip(body), F.lit("\n"))
    see = F.array_join(F.transform(unique_ids(similar), lambda i: F.concat(F.lit("- [["), i, F.lit("]]"))), "\n")
    c = with_section(c, "See Also", see)
    c = with_section(c, "References", F.concat(F.lit("1. [["), source, F.lit("]]")))
    return F.concat(rstrip(c), F.lit("\n"))


def collection_component(value: Column) -> Column:
    bare = F.lower(F.regexp_replace(F.regexp_replace(strip(value), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(bare == "", "default").otherwise(bare)


def collection_name(provider: Column, model: Column) -> Column:
    return F.concat(F.lit(COLLECTION), collection_component(provider), F.lit("__"), collection_component(model))


def json_from_reply(reply: Column) -> Column:
    """A model's reply without the fence around its JSON."""
    fence = "```"
    labelled = F.get(F.split(F.element_at(F.split(reply, fence + "json"), -1), fence), F.lit(0))
    return F.when(reply.contains(fence + "json"), labelled).when(reply.contains(fence), F.get(F.split(reply, fence), F.lit(1))).otherwise(reply)
