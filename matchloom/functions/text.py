"""Text functions: white space, hashes, HTML, truncation, time stamps."""

from __future__ import annotations

import html as _html
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space in the Unicode sense; Spark's trim removes blanks only.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
PROFILE_CHARS, POSTING_CHARS, ERROR_CHARS = 40_000, 20_000, 2_000
# Elements whose text is not part of a page's prose.
NOISE = ("script", "style", "noscript", "template", "svg", "iframe", "nav", "footer", "header")


#: The characters of SPACE.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without leading and trailing white space."""
    return F.trim(text, F.lit(SPACES))


def lines(text: Column) -> Column:
    """Trimmed lines without blank ones."""
    return F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda line: line != "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the trimmed non-blank lines; layout changes do not alter it."""
    return F.sha2(F.array_join(lines(text), "\n"), 256)


def truncate(text: Column, most: int) -> Column:
    """Struct of the first ``most`` characters and whether anything was cut."""
    return F.struct(F.substring(text, 1, most).alias("text"), (F.length(text) > most).alias("truncated"))


def iso_timestamp(text: Column) -> Column:
    """UTC time of an ISO 8601 string: Z and offsets are honoured, no zone means UTC, anything else is null.  Session time zone: UTC."""
    looks = text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(looks, F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")))


def flatten_text(value: Column) -> Column:
    """Text of a JSON value that is a string or a (nested) list of strings: leaves joined by newlines, null if there are none."""
    leaves = F.filter(F.regexp_extract_all(value, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)), lambda s: s != "")
    decoded = F.transform(leaves, lambda s: F.get_json_object(F.concat(F.lit('{"v":"'), s, F.lit('"}')), "$.v"))
    joined = F.array_join(decoded, "\n")
    return F.when(value.isNull() | (value == "null"), None).when(strip(value).rlike(r'^[\["]'), F.nullif(joined, F.lit(""))).otherwise(F.nullif(value, F.lit("")))


class _Text(HTMLParser):
    """Text of a page's body, pieces between tags in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.noise: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.noise:
            if tag in NOISE:
                self.noise.append(tag)
        elif tag in NOISE or tag in ("head", "title"):
            self.noise.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        pass

    def handle_endtag(self, tag: str) -> None:
        if self.noise and tag in self.noise:
            while self.noise and self.noise.pop() != tag:
                pass
        elif self.noise and tag in ("body", "html"):
            self.noise.clear()

    def handle_data(self, data: str) -> None:
        if not self.noise:
            self.parts.append(data)


def plain_text(page: str | None) -> str | None:
    """Trimmed non-blank lines of a page's text, script, style and navigation left out."""
    if page is None:
        return None
    parser = _Text()
    parser.feed(page)
    parser.close()
    found = (line.strip() for line in "\n".join(parser.parts).splitlines())
    return "\n".join(line for line in found if line)


@F.arrow_udf(StringType())
def html_to_text(page: pa.Array) -> pa.Array:
    """Text of HTML; '' for a page without text.  One page of a batch is a Python string at a time."""
    return pa.array((plain_text(t.as_py()) for t in page), pa.string(), size=len(page))


@F.arrow_udf(StringType())
def html_unescape(text: pa.Array) -> pa.Array:
    """Character references decoded once."""
    return pa.array((None if not t.is_valid else _html.unescape(t.as_py()) for t in text), pa.string(), size=len(text))
