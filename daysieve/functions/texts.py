"""Text functions on columns. Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in ECMAScript, where ideographic and no-break spaces count.
SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


# Fixed values below: the patterns that tell titles, headings, statements and remotes are those of the wording they read.


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE + "+", " "))


def cut(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def to_title(c: Column, n: int = 32) -> Column:
    """The first sentence without leading punctuation, cut to n."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE + "+", " "), r"^[\s、，。：:,.\-—]+", ""))
    first = F.trim(F.element_at(F.split(t, r"[。！？\n?!]", 2), 1))
    return cut(F.when(first == "", t).otherwise(first), n)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.coalesce(path, F.lit("")), r"[/\\]+$", ""), r"[/\\]"), -1)


def dir_name(path: Column) -> Column:
    """The name of the directory that holds a path; empty if none."""
    parts = F.split(F.regexp_replace(F.coalesce(path, F.lit("")), r"[/\\]+$", ""), r"[/\\]")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")


def extension(name: Column) -> Column:
    """What follows the last point, lower-cased; empty if that point is the first sign or there is none."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9一-龥._/-]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", "unknown").otherwise(s)


def display_name(path: Column) -> Column:
    """A directory's name, with its parent's where it is too short or a number to tell."""
    base = F.coalesce(F.nullif(base_name(path), F.lit("")), F.lit("unknown"))
    parent = dir_name(path)
    short = (F.length(base) <= 2) | base.rlike(r"^\d+$")
    return cut(F.when(short & (parent != ""), F.concat_ws("/", parent, base)).otherwise(base), 40)


def estimate_tokens(c: Column) -> Column:
    """CJK signs at 1.3 to a token, others at 3.5."""
    t = F.coalesce(c, F.lit(""))
    other = F.length(F.regexp_replace(t, r"[㐀-鿿豈-﫿]", ""))
    return F.ceil((F.length(t) - other) / 1.3 + other / 3.5).cast("long")


def defuse_markdown(c: Column) -> Column:
    """Image links as plain text, on one line."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"!\[([^\]]*)\]\([^)]*\)", "$1"), r"[\r\n]+", " ")


def clean_reply(c: Column, n: int = 300) -> Column:
    """A reply without code blocks and markdown signs, cut."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)```.*?```", " [代码] ")
    t = F.regexp_replace(F.regexp_replace(t, r"`([^`]*)`", "$1"), r"(?m)^\s{0,3}#{1,6}\s+|^\s*[-*+]\s+|^\s*>\s?", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\*\*([^*]+)\*\*", "$1"), r"\[([^\]]+)\]\([^)]+\)", "$1")
    return cut(collapse(t), n)


def stay_words(secs: Column) -> Column:
    """How long a page was looked at, empty below a minute."""
    return F.when(secs >= 60, F.format_string("停留约 %d 分钟", F.floor(secs / 60 + 0.5).cast("int"))).otherwise("")


def distinct_lines(lines: Column, n: int = 10) -> Column:
    """Lines on one line each and cut, the first of equal ones, none that is empty."""
    return F.slice(F.array_distinct(F.filter(F.transform(lines, lambda x: cut(collapse(x), 60)), lambda x: x != "")), 1, n)


def first_line(c: Column, marks: str) -> Column:
    """The first line that has a letter or digit, without marks at its start, as an array."""
    lines = F.filter(F.split(c, r"\r?\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    return F.transform(F.slice(lines, 1, 1), lambda x: F.regexp_replace(x, marks, ""))


def markdown_headings(c: Column) -> Column:
    """Headings of levels 1 to 3, without emphasis and code marks."""
    heads = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?m)^ {0,3}#{1,3}\s+(.+?)\s*#*\s*$"), F.lit(1))
    return distinct_lines(F.transform(heads, lambda x: F.regexp_replace(x, r"[*_`]", "")))


def markdown_outline(c: Column, n: int = 10) -> Column:
    """Headings of levels 1 to 3, else the first line that has text."""
    heads = markdown_headings(c)
    return F.when(F.size(heads) > 0, F.slice(heads, 1, n)).otherwise(distinct_lines(first_line(c, r"^[#>\s*-]+")))


def csv_columns(c: Column, n: int = 8, separator: str = ",") -> Column:
    """The header's columns of a csv or, with another separator, tsv text."""
    head = F.element_at(F.split(c, r"\r?\n", 2), 1)
    parts = F.split(head, F.lit(separator))
    return F.slice(F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r'^\s*"|"\s*$', ""))), lambda x: x != ""), 1, n)


def sql_outline(c: Column, n: int = 10) -> Column:
    """The first comment of a SQL text and what it creates, alters or drops anywhere, else its first line."""
    comment = F.array_compact(F.array(F.nullif(F.regexp_extract(c, r"(?m)^\s*--+[ \t]*([^\r\n]+)", 1), F.lit(""))))
    made = F.regexp_extract_all(c, F.lit(r'(?i)\b((?:create|alter|drop)\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view|index|function|procedure|trigger)\s+(?:if\s+(?:not\s+)?exists\s+)?["`\[\w.]+)'), F.lit(1))
    found = distinct_lines(F.concat(comment, made), n)
    return F.when(F.size(found) > 0, found).otherwise(distinct_lines(first_line(c, r"^[\s-]+"), n))


def notebook_outline(c: Column, n: int = 10) -> Column:
    """Headings of a notebook's Markdown cells, whose source may be a string or lines; null if it isn't one."""
    cells = F.from_json(c, "cells array<struct<cell_type: string, source: string>>")["cells"]
    lines = lambda x: F.coalesce(F.array_join(F.from_json(x["source"], "array<string>"), ""), x["source"])
    return F.slice(markdown_headings(F.array_join(F.transform(F.filter(cells, lambda x: x["cell_type"] == "markdown"), lines), "\n")), 1, n)


def number_words(n: Column) -> Column:
    """A number, from ten thousand on in ten thousands."""
    return F.when(n >= 10_000, F.concat(F.format_string("%.1f", n / 10_000), F.lit(" 万"))).otherwise(F.coalesce(n, F.lit(0)).cast("string"))


def clean_remote(c: Column) -> Column:
    """A remote's address as host/path, without credentials, port and .git; null if empty."""
    s = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\.git/?$", "")
    url = F.regexp_replace(s, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:]+)(?::\d+)?", "$1")
    scp = F.regexp_replace(url, r"^(?:[^/@\s]+@)?([^/:\s]+):(?!//)", "$1/")
    return F.nullif(scp, F.lit(""))


def json_objects(text: Column) -> Column:
    """The outermost {...} of a text, in order, as they stand: braces balance, and those in strings don't count. Quotes outside of objects are no strings; an object that never closes ends the search.

    The text is cut into signs (a brace, a quote, a backslash with what follows) and what lies between, and one pass over
    these carries the depth, whether a string is open, and where the object began.
    """
    parts = F.regexp_extract_all(text, F.lit(r'(?s)\\.|["{}]|[^"{}\\]+|\\'), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("begin"), F.array().cast("array<struct<b:int,e:int>>").alias("found"))

    def step(s: Column, part: Column) -> Column:
        at = s["at"] + 1
        # a backslash only binds the next sign within a string
        sign = F.when(s["quoted"], part).otherwise(F.substring(part, -1, 1))
        quote = (sign == '"') & (s["depth"] > 0)
        quoted = s["quoted"] != quote
        opens, closes = (sign == "{") & ~s["quoted"], (sign == "}") & ~s["quoted"] & (s["depth"] > 0)
        depth = s["depth"] + opens.cast("int") - closes.cast("int")
        begin = F.when(opens & (s["depth"] == 0), at).otherwise(s["begin"])
        found = F.when(closes & (depth == 0), F.array_append(s["found"], F.struct(s["begin"].alias("b"), at.alias("e")))).otherwise(s["found"])
        return F.struct(at.alias("at"), depth.alias("depth"), quoted.alias("quoted"), begin.alias("begin"), found.alias("found"))

    spans = F.aggregate(parts, start, step, lambda s: s["found"])
    # an object that begins with the second sign of a pair leaves the backslash out
    whole = lambda s: F.array_join(F.slice(parts, s["b"], s["e"] - s["b"] + 1), "")
    return F.transform(spans, lambda s: F.regexp_replace(whole(s), r"^\\+", ""))
