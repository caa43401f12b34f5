"""Bodies that landed as bytes, decoded to text by the charset that they declare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: labels of charsets in lower case, and the charset that each stands for
LABELS = {
    "utf-8": "utf-8", "utf8": "utf-8", "utf_8": "utf-8",
    "iso-8859-1": "latin", "iso8859-1": "latin", "iso_8859-1": "latin", "latin-1": "latin", "latin1": "latin", "l1": "latin", "cp819": "latin",
    "windows-1252": "cp1252", "cp1252": "cp1252", "cp-1252": "cp1252",
    "us-ascii": "ascii", "ascii": "ascii",
    "utf-16": "utf-16", "utf16": "utf-16", "utf-16le": "utf-16le", "utf-16be": "utf-16be",
}
# fixed values: what windows-1252 has at 0x80 to 0x9F; U+FFFD stands where it has nothing
CP1252 = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"
CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
BAD = "�"
#: Bytes of a body in which a <meta> is looked for.
HEAD = 1024


def _known(label: Column) -> Column:
    """The charset behind a label, null if there is none of that name."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), F.lower(F.trim(label)))


def charset(body: Column, content_type: Column) -> Column:
    """That of the content type, else of a byte order mark, else of a <meta> in the first bytes, else UTF-8; unknown names count as none."""
    named = r"""(?i)charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)"""
    start = F.hex(F.substring(body, 1, 3))
    mark = F.when(start == "EFBBBF", "utf-8-mark").when(start.startswith("FFFE"), "utf-16le-mark").when(start.startswith("FEFF"), "utf-16be-mark")
    head = F.decode(F.substring(body, 1, HEAD), "ISO-8859-1")
    meta = F.regexp_extract(F.regexp_extract(head, r"(?is)<meta\b[^>]*charset\s*=[^>]*", 0), named, 1)
    declared = F.regexp_extract(F.coalesce(content_type, F.lit("")), named, 1)
    # a page whose <meta> could be read byte by byte isn't in UTF-16
    of_meta = F.when(_known(meta).startswith("utf-16"), "utf-8").otherwise(_known(meta))
    return F.coalesce(_known(declared), mark, of_meta, F.lit("utf-8"))


def decoded(body: Column, content_type: Column) -> Column:
    """Binary `body` as text. Bytes that the charset doesn't have become U+FFFD; a mark that told the charset isn't text.

    Needs the setting that `session.prepared` makes for malformed UTF-16.
    """
    name = charset(body, content_type)
    latin = F.decode(body, "ISO-8859-1")
    big = F.hex(F.substring(body, 1, 2)) == "FEFF"
    marked = F.hex(F.substring(body, 1, 2)).isin("FEFF", "FFFE")
    after = lambda n: F.substring(body, n + 1, 1 << 30)
    sixteen = lambda order, n: F.decode(after(n) if n else body, f"UTF-16{order}")
    return (
        F.when(name == "utf-8", F.make_valid_utf8(body.cast("string")))
        .when(name == "utf-8-mark", F.make_valid_utf8(after(3).cast("string")))
        .when(name == "latin", latin).when(name == "ascii", F.regexp_replace(latin, "[\\x80-\\xFF]", BAD))
        .when(name == "cp1252", F.translate(latin, CONTROLS, CP1252))
        .when(name == "utf-16le", sixteen("LE", 0)).when(name == "utf-16be", sixteen("BE", 0))
        .when(name == "utf-16le-mark", sixteen("LE", 2)).when(name == "utf-16be-mark", sixteen("BE", 2))
        .when(marked & big, sixteen("BE", 2)).when(marked, sixteen("LE", 2)).otherwise(sixteen("LE", 0))
    )
