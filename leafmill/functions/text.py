"""String predicates and shaping, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(s: Column | str) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(_c(s), r"(?U)^\s+|\s+$", "")


def not_blank(s: Column | str) -> Column:
    return trimmed(s) != ""


def has_cjk(s: Column | str) -> Column:
    """Any CJK ideograph of the basic block, kana or Hangul syllable."""
    return _c(s).rlike("[\\u4E00-\\u9FFF\\u3040-\\u30FF\\uAC00-\\uD7AF]")


def high_count(s: Column | str) -> Column:
    """Characters above U+3000."""
    return F.regexp_count(_c(s), F.lit(r"[^\x{0}-\x{3000}]"))


def ascii_count(s: Column | str) -> Column:
    """Printable ASCII characters but the blank."""
    return F.regexp_count(_c(s), F.lit(r"[\x21-\x7E]"))


def quality_gate(s: Column | str, confidence: Column | str, least: float = 0.2, ascii_least: float = 0.5) -> Column:
    """Is a reading worth keeping? CJK needs `least` confidence; up to two ASCII characters are noise; ASCII needs `ascii_least`."""
    s, conf = _c(s), _c(confidence)
    all_ascii = ascii_count(s) == F.length(s)
    return (
        F.when(F.length(s) == 0, False).when(high_count(s) > 0, conf >= least).when((F.length(s) <= 2) & all_ascii, False)
        .when(all_ascii & (conf < ascii_least), False).otherwise(conf >= least)
    )


def strict_gate(s: Column | str, confidence: Column | str) -> Column:
    """The offline cleaner's gate: CJK at 0.2; else more than two characters at 0.4."""
    s, conf = _c(s), _c(confidence)
    return F.when(F.length(s) == 0, False).when(high_count(s) > 0, conf >= 0.2).when(F.length(s) <= 2, False).otherwise(conf >= 0.4)


def safe_filename(s: Column | str) -> Column:
    """Blanks become _, other characters but A-Z, a-z, 0-9, - and _ become -."""
    return F.regexp_replace(F.replace(_c(s), F.lit(" "), F.lit("_")), "[^A-Za-z0-9_-]", "-")


def css_font_url(css: Column | str) -> Column:
    """The first URL of a .woff2 or .ttf among the lines with `src:` and `url(`, without quotes and blanks around it; else null."""
    lines = F.filter(F.split(_c(css), "\r?\n"), lambda x: x.contains("src:") & x.contains("url("))
    urls = F.transform(lines, lambda x: F.regexp_replace(F.regexp_extract(x, r"url\(([^)]*)\)", 1), "^['\" ]+|['\" ]+$", ""))
    return F.get(F.filter(urls, lambda x: x.contains(".woff2") | x.contains(".ttf")), F.lit(0))


def key_list(s: Column | str) -> Column:
    """Comma-separated list, trimmed of any white space, without empty entries."""
    return F.filter(F.transform(F.split(_c(s), ","), lambda x: trimmed(x)), lambda x: x != "")


def enum_or(s: Column | str, allowed: tuple[str, ...], default: str, upper: bool = False) -> Column:
    """A known word whatever its case, else the default."""
    v = F.upper(_c(s)) if upper else F.lower(_c(s))
    return F.when(v.isin(*allowed), v).otherwise(F.lit(default))


def log_level(s: Column | str) -> Column:
    """trace, debug, info, warn or error, whatever the case; `warning` is warn, anything else info."""
    v = F.lower(_c(s))
    return enum_or(F.when(v == "warning", F.lit("warn")).otherwise(v), ("trace", "debug", "info", "warn", "error"), "info")


def text_align(s: Column | str) -> Column:
    return enum_or(s, ("left", "center", "right"), "center")


#: Families of built-in fonts, and generic families.
FONTS = {
    "anime-ace": "Anime Ace", "anime-ace-3": "Anime Ace 3", "arial": "Arial Unicode", "comic-sans": "Comic Sans", "ms-yahei": "Microsoft YaHei", "noto-sans-mono-cjk": "Noto Sans Mono CJK",
    "sans-serif-regular": "sans-serif", "sans-serif-bold": "sans-serif", "serif-regular": "serif", "serif-bold": "serif", "monospace-regular": "monospace", "monospace-bold": "monospace",
}


def font_family(s: Column | str) -> Column:
    """Built-in or generic family; the name itself if it has a capital or a blank; else sans-serif."""
    s = _c(s)
    known = F.create_map(*[F.lit(x) for pair in FONTS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, s), F.when(s.rlike(r"[\p{Lu} ]"), s), F.lit("sans-serif"))


def is_bold(s: Column | str) -> Column:
    return F.lower(_c(s)).contains("bold")


def stroke_colour(r: Column, g: Column, b: Column) -> Column:
    """White around dark text, black around light text."""
    return F.when(r + g + b < 382, F.lit("white")).otherwise(F.lit("black"))


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(_c(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def file_suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"[^/](\.[^./]*)$", 1))


def hex_key(k: Column | str) -> Column:
    """16 hexadecimal digits of a 64-bit key."""
    return F.lower(F.lpad(F.hex(_c(k)), 16, "0"))


def parse_hex_key(s: Column | str) -> Column:
    """Key of 1 to 16 hexadecimal digits as its 64-bit pattern; null for others."""
    s = _c(s)
    wide = F.conv(s, 16, -10).try_cast("bigint")
    return F.when(s.rlike("^[0-9A-Fa-f]{1,16}$"), wide)


def data_url(content: Column | str, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(_c(content)), r"\s", ""))


def from_data_url(url: Column | str) -> Column:
    return F.unbase64(F.substring_index(_c(url), ",", -1))


def retryable(message: Column | str) -> Column:
    """Does an error message speak of a quota or an overload?"""
    m = _c(message)
    return m.contains("429") | m.contains("quota") | m.contains("503") | m.contains("overload")


def retryable_status(status: Column | str) -> Column:
    s = _c(status)
    return (s >= 500) | (s == 429)


def prompt(template: str, *args: Column) -> Column:
    return F.format_string(template, *args)
