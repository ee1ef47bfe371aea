"""Column functions on texts and paths, all built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeseek.functions import fixed

# White space as Python's str.strip sees it.
_WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def bound(value: Column, use) -> Column:
    """use(value) with ``value`` evaluated once, even where ``use`` has it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def text_key(header: Column, text: Column) -> Column:
    """Key of what is embedded of a chunk: the first 24 hex digits."""
    return F.substring(F.sha2(F.concat(F.coalesce(header, F.lit("")), text), 256), 1, 24)


def revision_id(path: Column, digest: Column) -> Column:
    return F.concat(path, F.lit("@"), F.substring(digest, 1, 12))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_WHITE}+|{_WHITE}+$", "")


def document_text(title: Column, text: Column) -> Column:
    """Title and text of a dataset's document as one text."""
    return F.when(F.coalesce(title, F.lit("")) != "", strip(F.concat(title, F.lit(" "), text))).otherwise(strip(text))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot, empty without one; a leading dot alone makes no suffix."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fixed.LANGUAGES.items() for x in pair])
    return F.try_element_at(table, suffix(path))


def file_kind(path: Column) -> Column:
    """test, docs or code."""

    def kind(parts: Column) -> Column:
        parents, name = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
        stem = F.substring_index(name, ".", 1)
        among = lambda values: F.exists(parents, lambda p: p.isin(*values))
        test = (
            F.exists(parents, lambda p: p.isin(*fixed.TEST_DIRS) | p.startswith("tests_"))
            | name.startswith("test_") | (name == "conftest.py") | stem.endswith("_test") | name.contains(".test.") | name.contains(".spec.")
        )
        docs = among(fixed.DOCS_DIRS) | suffix(name).isin(*fixed.DOCS_SUFFIXES) | stem.isin(*fixed.DOCS_STEMS)
        return F.when(test, "test").when(docs, "docs").otherwise("code")

    return bound(F.split(F.lower(path), "/"), kind)


def split_lines(text: Column, empty_line: bool = False) -> Column:
    """Lines with their newlines; only \\n splits, and joining the lines gives the text. An empty text has no line, or with ``empty_line`` an empty one; null has none."""

    def lines(parts: Column) -> Column:
        ended = F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit("\n"))).otherwise(x))
        closed = F.element_at(parts, -1) == ""
        return F.when(closed & (F.size(parts) > 1) if empty_line else closed, F.slice(ended, F.lit(1), F.size(parts) - 1)).otherwise(ended)

    return bound(F.split(text if empty_line else F.coalesce(text, F.lit("")), "\n", -1), lines)


def line_slice(lines: Column, first: Column, last: Column) -> Column:
    """Lines first..last, 1-based and inclusive, as one text."""
    return F.array_join(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), "")


def count_newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", ""))


def found_line(text: Column, part: Column) -> Column:
    """1-based line where ``part`` starts verbatim in ``text``; null if it doesn't occur."""
    at = F.instr(text, part)
    return F.when(at > 0, count_newlines(F.substring(text, F.lit(1), at - 1)) + 1)


def identifier_parts(text: Column) -> Column:
    """Parts of identifiers in order: camel case, capitals, digits."""
    spaced = F.regexp_replace(text, "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.regexp_extract_all(spaced, F.lit("[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), 0)


def term_list(text: Column) -> Column:
    """Search terms with repeats: lower-case parts of three letters or more, no stopwords, cut to five letters."""
    parts = F.transform(identifier_parts(text), F.lower)
    kept = F.filter(parts, lambda p: (F.length(p) >= fixed.TERM_MIN) & ~p.isin(*fixed.STOPWORDS))
    return F.transform(kept, lambda p: F.substring(p, 1, fixed.TERM_CHARS))


def terms(text: Column) -> Column:
    return F.array_distinct(term_list(text))


def is_definition(line: Column) -> Column:
    return line.rlike(fixed.DEFINITION)


def default_index_name(name: Column, path: Column) -> Column:
    """<folder name>-<8 hex digits of the path's hash>."""
    return F.concat(name, F.lit("-"), F.substring(F.sha2(path, 256), 1, 8))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), r"^[^A-Za-z0-9]+", "")


def version_label(tags: Column, short: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array_sort(tags), F.lit(1)), short)


def round_half_up(value: Column, places: int = 6) -> Column:
    return F.round(value, places)


# The same terms in plain Python, for code that already runs in Python.
_PARTS = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACED = re.compile("([A-Z])([A-Z][a-z])")
_STOP = frozenset(fixed.STOPWORDS)


def python_terms(text: str) -> list[str]:
    found = (p.lower() for p in _PARTS.findall(_SPACED.sub(r"\1 \2", text)))
    return [p[: fixed.TERM_CHARS] for p in found if len(p) >= fixed.TERM_MIN and p not in _STOP]
