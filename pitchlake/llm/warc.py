"""WARC derivatives: each response record yields a linked ``metadata`` and a plain-text ``conversion`` record.

Both derivatives name the response in WARC-Refers-To, repeat its target URI and date (as WARC-Refers-To-Target-URI and
WARC-Refers-To-Date) and carry the digests and HTTP header it came with, so that they stay useful where the response is
not at hand. Record ids are UUIDs derived from the source's id and the record type: a rerun gives the same ids.

Everything is a projection of the response rows (no shuffle), so a row of any size costs its own task only.

Text is what lies outside tags, comments, scripts, styles and the title. Not supported: text that style sheets hide or scripts
make, attributes of ``base`` and ``meta``, character sets other than the text's own.

Defined results: null url or html counts as empty and still yields all its records; a repeated row is the same record again,
under the same ids; an empty table yields none; other columns of the input are ignored.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
HTTP_HEADER = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CRAWL_DATE = "2024-01-01T00:00:00Z"

# Named character references, but for accented letters, which are made from their letter and accent below.
ENTITIES = {
    "nbsp": " ",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "iexcl": "¡",
    "cent": "¢",
    "pound": "£",
    "yen": "¥",
    "sect": "§",
    "copy": "©",
    "laquo": "«",
    "shy": "",
    "reg": "®",
    "deg": "°",
    "plusmn": "±",
    "sup2": "²",
    "sup3": "³",
    "micro": "µ",
    "para": "¶",
    "middot": "·",
    "raquo": "»",
    "frac14": "¼",
    "frac12": "½",
    "frac34": "¾",
    "iquest": "¿",
    "times": "×",
    "divide": "÷",
    "szlig": "ß",
    "AElig": "Æ",
    "aelig": "æ",
    "Oslash": "Ø",
    "oslash": "ø",
    "OElig": "Œ",
    "oelig": "œ",
    "bull": "•",
    "hellip": "…",
    "ndash": "–",
    "mdash": "—",
    "lsquo": "‘",
    "rsquo": "’",
    "sbquo": "‚",
    "ldquo": "“",
    "rdquo": "”",
    "bdquo": "„",
    "lsaquo": "‹",
    "rsaquo": "›",
    "dagger": "†",
    "permil": "‰",
    "euro": "€",
    "trade": "™",
    "larr": "←",
    "rarr": "→",
    "minus": "−",
    "ensp": " ",
    "emsp": " ",
    "thinsp": " ",
    "zwnj": "",
    "zwj": "",
}
ACCENTS = {"grave": "\u0300", "acute": "\u0301", "circ": "\u0302", "tilde": "\u0303", "uml": "\u0308", "ring": "\u030a", "cedil": "\u0327", "caron": "\u030c"}


def references() -> dict[str, str]:
    """Every named reference that is resolved, but ``amp``: the listed ones and each letter that its accent composes with."""
    composed = {
        letter + name: unicodedata.normalize("NFC", letter + accent)
        for name, accent in ACCENTS.items()
        for letter in string.ascii_letters
    }
    return ENTITIES | {k: v for k, v in composed.items() if len(v) == 1}


# Patterns valid for Java and RE2 alike. BLANK parts attributes; REST is what a tag holds behind its name, where an attribute's
# quoted value may hold a ">"; a quote that does not follow "=" or is not closed is a character like any other.
BLANK = r"[ \t\n\r\f]"
REST = rf"(?:[^>=]|={BLANK}*(?:\"[^\"]*\"|'[^']*')?)*"
SILENT = (
    r"(?is)<(?:!--.*?(?:-->|\z)|title\b.*?(?:</title[ \t\n\r]*>|\z)"
    r"|script\b.*?(?:</script[ \t\n\r]*>|\z)|style\b.*?(?:</style[ \t\n\r]*>|\z))"
)
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b" + REST + ">"
TAG = r"<[!/?]?[A-Za-z]" + REST + ">"
REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
TITLE = r"(?is)<title" + REST + r">(.*?)</title"
# Attributes before the one that is asked for: names, and values in either kind of quotes or bare; a quote opens a value alone.
BEFORE = rf"(?:[^>=\"']|={BLANK}*(?:\"[^\"]*\"|'[^']*'|[^ \t\n\r\f\"'>][^ \t\n\r\f>]*)?)*?"
VALUE = rf"{BLANK}*={BLANK}*(\"[^\"]*\"|'[^']*'|[^ \t\n\r\f\"'>]+)"
LANG = rf"(?is)<html\b{BEFORE}{BLANK}lang{VALUE}"
LINK = rf"(?is)<a\b{BEFORE}{BLANK}href{VALUE}"
QUOTES = r"^[\"']|[\"']\z"


def in_java(pattern: str) -> str:
    """The same pattern without steps back that cannot help: a run of plain characters is taken whole."""
    return pattern.replace("[^>=]|", "[^>=]++|")


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def one_line(c: Column) -> Column:
    """A header value can hold no line break."""
    return F.regexp_replace(c, r"[\r\n]+", "")


def _character(reference: Column) -> Column:
    """What a reference, without its signs, stands for; null for an unknown name. A number that is no character gives U+FFFD."""
    number = F.conv(F.regexp_replace(reference, "^#[xX]?", ""), 10, 10)
    number = F.when(reference.rlike("^#[xX]"), F.conv(F.substring(reference, 3, 6), 16, 10)).otherwise(number).cast("long")
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    shown = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    names = F.create_map(*[F.lit(x) for pair in references().items() for x in pair])
    return F.when(reference.startswith("#"), shown).when(reference == "nbsp", " ").otherwise(names[reference])


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def decode_entities(text: Column) -> Column:
    """With its character references resolved, from left to right and each once: what a reference gives is not read again.
    Unknown names stay."""
    resolved = lambda r: F.when(r == "amp", "&").otherwise(F.coalesce(_character(r), F.concat(F.lit("&"), r, F.lit(";"))))

    def decoded(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(1)), resolved)
        pieces = F.zip_with(F.split(t, REFERENCE, -1), found, lambda plain, shown: F.concat(plain, F.coalesce(shown, F.lit(""))))
        return F.when(t.contains("&"), F.array_join(pieces, "")).otherwise(t)

    return _once(text, decoded)


def _unquoted(value: Column) -> Column:
    return decode_entities(F.regexp_replace(value, QUOTES, ""))


def plain_text(html: Column) -> Column:
    """Text of an HTML document: one line per block, white space collapsed, character references resolved."""
    out = F.regexp_replace(_or_empty(html), SILENT, "")
    out = F.regexp_replace(F.translate(out, "\t\n\r\f", "    "), in_java(BREAKS), "\n")
    out = decode_entities(F.regexp_replace(out, in_java(TAG), ""))
    out = F.regexp_replace(out, r" {2,}", " ")
    out = F.regexp_replace(out, r" ?\n[ \n]*", "\n")
    return F.trim(out, F.lit(" \n"))


def title(html: Column) -> Column:
    out = F.regexp_replace(F.regexp_extract(_or_empty(html), in_java(TITLE), 1), r"[ \t\n\r\f]+", " ")
    return F.trim(decode_entities(out))


def _base32(sha1_hex: Column) -> Column:
    """40 hex digits as 32 base-32 letters: five digits at a time are four letters."""
    groups = [F.lpad(F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def block_digest(block: Column) -> Column:
    return F.concat(F.lit("sha1:"), _base32(F.sha1(block)))


def record_id(kind: str, *parts: Column) -> Column:
    digest = F.md5(F.concat_ws("\n", F.lit(kind), *[_or_empty(p.cast("string")) for p in parts]))
    cuts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def responses(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a page table: (page_id, record_id, target_uri, warc_date, http_header, payload, payload_digest)."""
    payload = _or_empty(df[html_col])
    return df.select(
        df[id_col].alias("page_id"),
        record_id("response", df[id_col], df[url_col], df[html_col]).alias("record_id"),
        one_line(_or_empty(df[url_col])).alias("target_uri"),
        F.lit(CRAWL_DATE).alias("warc_date"),
        F.lit(HTTP_HEADER).alias("http_header"),
        payload.alias("payload"),
        block_digest(payload).alias("payload_digest"),
    )


def derive(resp: DataFrame) -> DataFrame:
    """Two records per response: metadata, then conversion."""
    html = F.col("payload")
    links = F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda x: F.concat(F.lit("outlink: "), one_line(_unquoted(x)), F.lit(CRLF)))
    fields = F.concat(
        F.concat(F.lit("title: "), title(html), F.lit(CRLF)),
        F.concat(F.lit("language: "), one_line(_unquoted(F.regexp_extract(html, LANG, 1))), F.lit(CRLF)),
        F.concat(F.lit("source-payload-digest: "), F.col("payload_digest"), F.lit(CRLF)),
        F.concat(F.lit("source-content-length: "), F.octet_length(F.concat("http_header", html)).cast("string"), F.lit(CRLF)),
        F.concat(F.lit("source-http-header: "), F.regexp_replace(F.regexp_replace("http_header", r"[\r\n]+", "; "), r"; \z", ""), F.lit(CRLF)),
        F.array_join(links, ""),
    )

    def record(kind: str, content_type: str, block: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("warc_type"),
            record_id(kind, F.col("record_id")).alias("record_id"),
            F.col("record_id").alias("refers_to"),
            F.lit(content_type).alias("content_type"),
            block.alias("block"),
        )

    pair = F.array(
        record("metadata", "application/warc-fields", fields),
        record("conversion", "text/plain; charset=utf-8", plain_text(html)),
    )
    rows = resp.select("page_id", "target_uri", "warc_date", "payload_digest", F.explode(pair).alias("r"))
    return rows.select(
        "page_id", "r.*", "target_uri", "warc_date", F.col("payload_digest").alias("source_digest")
    ).withColumns(
        {"block_digest": block_digest(F.col("block")), "content_length": F.octet_length("block").cast("long")}
    )


def serialize(records: DataFrame) -> DataFrame:
    """One column ``value``: each record as WARC/1.1 text without the CRLF that ends it (the writer adds that)."""
    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))

    return records.select(
        F.concat(
            F.lit("WARC/1.1" + CRLF),
            header("WARC-Type", F.col("warc_type")),
            header("WARC-Record-ID", F.col("record_id")),
            header("WARC-Date", F.col("warc_date")),
            header("WARC-Target-URI", F.col("target_uri")),
            header("WARC-Refers-To", F.col("refers_to")),
            header("WARC-Refers-To-Target-URI", F.col("target_uri")),
            header("WARC-Refers-To-Date", F.col("warc_date")),
            header("WARC-Source-Payload-Digest", F.col("source_digest")),
            header("WARC-Block-Digest", F.col("block_digest")),
            header("Content-Type", F.col("content_type")),
            header("Content-Length", F.col("content_length")),
            F.lit(CRLF),
            F.col("block"),
            F.lit(CRLF),
        ).alias("value")
    )


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """One WARC file per partition, by Spark's own text writer, so on any file system and safe against lost tasks."""
    serialize(records).write.option("lineSep", CRLF).option("compression", compression).text(path)
