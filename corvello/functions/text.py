"""Scalar functions on text, all built-in expressions: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Pieces of a page from left to right: comment, tag, unterminated tag, entity, text, lone ampersand.
LEXER = r"<!--(?:>|->|[\s\S]*?-->|[\s\S]*\z)|<[^>]*>|<[\s\S]*\z|&[^;]{0,9};|[^<&]+|&"
#: A word starts with a letter or digit; words that start with a digit keep full stops.
WORD = "[0-9][0-9a-z.']*|[a-z][0-9a-z']*"

# Fixed entity names of page text; all others count as a blank.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def ascii_lower(c: Column) -> Column:
    """A-Z only; lower() would also change letters such as the Kelvin sign."""
    return F.translate(c, UPPER, LOWER)


def slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def trimmed(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def dir_of(path: Column) -> Column:
    """Through the last slash."""
    return F.regexp_extract(path, "^(.*/)", 1)


def stem(path: Column) -> Column:
    """Last part of a path without its last extension."""
    return F.regexp_extract(slashes(path), r"([^/]*?)(?:\.[^./]*)?$", 1)


def is_yes(c: Column) -> Column:
    return F.coalesce(ascii_lower(trimmed(c)).isin("yes", "true", "1"), F.lit(False))


def parse_int(c: Column) -> Column:
    """Decimal, or hexadecimal after 0x; anything else is 0."""
    s = trimmed(c)
    hexadecimal = F.conv(F.regexp_extract(s, "^0[xX]([0-9A-Fa-f]+)$", 1), 16, 10).try_cast("long")
    return F.coalesce(F.when(s.rlike("^0[xX]"), hexadecimal).otherwise(s.try_cast("long")), F.lit(0).cast("long"))


def parse_lcid(c: Column) -> Column:
    """The first word's number; 1033 where there is none."""
    n = parse_int(F.regexp_extract(trimmed(c), r"^(\S*)", 1))
    return F.when(n == 0, F.lit(1033).cast("long")).otherwise(n)


def entity(name: Column) -> Column:
    """Text of an entity by the name between & and ;."""
    code = F.coalesce(
        F.when(name.rlike(r"^#[xX]\+?[0-9A-Fa-f]+$"), F.conv(F.regexp_extract(name, "([0-9A-Fa-f]+)$", 1), 16, 10).cast("long")),
        F.when(name.rlike(r"^#\+?[0-9]+$"), F.regexp_extract(name, "([0-9]+)$", 1).cast("long")),
    )
    known = F.create_map(*(F.lit(x) for kv in ENTITIES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, name), F.when(code.between(1, 255), F.char(code)), F.lit(" "))


def title(html: Column) -> Column:
    """The first title element's text with white space collapsed; entities stay."""
    raw = F.regexp_extract(html, r"(?s)<[tT][iI][tT][lL][eE][^>]*>(.*?)</[tT][iI][tT][lL][eE]", 1)
    return F.btrim(F.regexp_replace(raw, r"[ \t\r\n]+", " "), F.lit(" "))


def charset(html: Column) -> Column:
    """The charset named in the first 2048 characters, or an empty text."""
    return F.regexp_extract(ascii_lower(F.substring(html, 1, 2048)), r"charset\s*=\s*[\"']?([a-z0-9_-]+)", 1)


def references(html: Column, key: str) -> Column:
    """Values of all attributes href or src, quoted or bare, also in comments, scripts and text; without empty ones."""
    name = "".join(f"[{c}{c.upper()}]" for c in key)
    pattern = rf"(?<![A-Za-z0-9_-]){name}(?=\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s>\"'][^\s>]*)))"
    # One of the three groups takes part; matches end with the key, so references in values are found too.
    groups = [F.regexp_extract_all(html, F.lit(pattern), F.lit(g)) for g in (1, 2, 3)]
    return F.filter(F.transform(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, "abc", strict=True))), lambda x: F.concat(x["a"], x["b"], x["c"])), lambda v: v != "")


def percent_decode(c: Column) -> Column:
    """%XX only; a plus sign and a % without two digits stay."""
    return F.url_decode(F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))


def resolve(base_dir: Column, link: Column) -> Column:
    """The path that a link means, from the root; empty for anchors, other schemes and paths above the root."""
    s = trimmed(link)
    local = (s != "") & ~s.startswith("#") & ~s.rlike("^[^/:]*:")
    path = slashes(percent_decode(F.regexp_extract(s, r"^([^#?]*)", 1)))
    full = F.when(path.startswith("/"), F.substring(path, 2, 1 << 30)).otherwise(F.concat(base_dir, path))
    none = F.expr("cast(struct(true, array()) as struct<ok:boolean,parts:array<string>>)")

    def step(acc: Column, part: Column) -> Column:
        up = F.struct((acc["ok"] & (F.size(acc["parts"]) > 0)).alias("ok"), F.slice(acc["parts"], F.lit(1), F.greatest(F.size(acc["parts"]) - 1, F.lit(0))).alias("parts"))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.struct(acc["ok"].alias("ok"), F.concat(acc["parts"], F.array(part)).alias("parts")))

    folded = F.aggregate(F.split(full, "/", -1), none, step, lambda acc: F.when(acc["ok"], F.array_join(acc["parts"], "/")).otherwise(F.lit("")))
    return F.when(local & (path != ""), folded).otherwise(F.lit(""))


def code_bits(value: Column, root: int) -> Column:
    """Bits of a number in a scale-root code."""
    m = F.when(value == 0, 0).otherwise(F.length(F.bin(value)))
    return F.when(m <= root, F.lit(1 + root)).otherwise(2 * m - root).cast("long")


def varint_bytes(value: Column) -> Column:
    """Bytes of a number in groups of seven bits."""
    return F.when(value == 0, 1).otherwise(F.ceil(F.length(F.bin(value)) / 7)).cast("long")


def window_bits(size: Column) -> Column:
    """Bits that number the places of a window of a size."""
    return F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1))).cast("long")


def utf16le(c: Column) -> Column:
    return F.encode(c, "UTF-16LE")
