"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

FOREIGN = r"[\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}\p{IsArmenian}\p{IsArabic}\p{IsCyrillic}\p{IsGreek}\x{C0}-\x{D6}\x{D8}-\x{E8}\x{EA}-\x{F6}\x{F8}-\x{24F}]"
OTHER_SCRIPTS = r"[\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}\p{IsArmenian}\p{IsArabic}\p{IsCyrillic}\p{IsGreek}]"
_PAIRS = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250) if unicodedata.normalize("NFKD", chr(c))[0].isascii() and unicodedata.normalize("NFKD", chr(c)) != chr(c)]
ACCENTED, PLAIN = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)
IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"
IPV6 = r"^[0-9a-f:]*:[0-9a-f:]*:[0-9a-f:.]*$"
# Public suffixes of more than one label.
SUFFIXES = ["co.uk", "org.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in"]


def looks_english(c: Column) -> Column:
    """No letter of another script, nor an accented one but é (TXT-01)."""
    return ~c.rlike(FOREIGN)


def fold_ascii(c: Column) -> Column:
    """Accented Latin letters without their accents (TXT-02)."""
    return F.translate(c, ACCENTED, PLAIN)


def tokenizer_fixups(c: Column) -> Column:
    """Spellings that tokenizers split badly (TXT-03)."""
    for pattern, to in ((r"(?i)\be-mails?\b", "email"), (r"(?i)\bwi-fi\b", "WiFi"), (r"(?i)\bgeo-location\b", "geolocation"), (r"\bid\b", "ID"), (r"\b(\w+)\(s\)", "$1s")):
        c = F.regexp_replace(c, pattern, to)
    return c


def rebuild_text(tokens: Column, spaces: Column) -> Column:
    """Tokens with the spaces that followed them (TXT-05)."""
    return F.array_join(F.zip_with(tokens, spaces, lambda t, s: F.concat(t, F.when(s, " ").otherwise(""))), "")


def strip_punctuation(c: Column) -> Column:
    """Lower case without punctuation at the ends (TXT-07)."""
    return F.lower(F.regexp_replace(c, r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", ""))


def reverse_dotted(c: Column) -> Column:
    """a.b.c -> c.b.a (TXT-10)."""
    return F.array_join(F.reverse(F.split(c, r"\.")), ".")


def host_of_url(c: Column) -> Column:
    """Lower-case host of a URL, with or without scheme (TXT-13)."""
    return F.regexp_extract(F.lower(F.trim(c)), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]+)", 1)


def registered_domain(host: Column) -> Column:
    """The public suffix and the label before it (TXT-11)."""
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    return F.when(F.size(labels) < 2, host).when(two.isin(SUFFIXES) & (F.size(labels) > 2), F.array_join(F.slice(labels, -3, 3), ".")).otherwise(two)


def is_ip(c: Column) -> Column:
    """True for IPv4 and IPv6 literals (TXT-12)."""
    return c.rlike(IPV4) | F.lower(c).rlike(IPV6)


def collapse_space(c: Column) -> Column:
    """White space as single spaces, none at the ends (TXT-14)."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def split_sentences(c: Column) -> Column:
    """Sentences with their end marks (TXT-15)."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"[^.!?]+[.!?]*"), 0), lambda s: F.trim(s)), lambda s: s != "")


def parse_term(c: Column) -> tuple[Column, Column, Column]:
    """Term, subject and source of ``term @subject (seg, idx)``; '' where absent (TXT-16)."""
    p = r"^(.+?)(?: @(\S+))?(?: (\(\d+, \d+\)))?$"
    return F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2), F.regexp_extract(c, p, 3)


def edge_label(key: Column, entity: Column, data: Column) -> Column:
    """KEY(entity, data) (TXT-17)."""
    return F.concat(key, F.lit("("), entity, F.lit(", "), data, F.lit(")"))


def capitalise(c: Column) -> Column:
    """First letter upper case (TXT-18)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


# Elements of a page that hold no text of its own.
BOILERPLATE_TAGS = ["script", "style", "header", "footer", "nav"]


def strip_boilerplate(html: Column) -> Column:
    """HTML without its boilerplate elements, links and remaining tags (DOC-01)."""
    for tag in BOILERPLATE_TAGS:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", "")
    return collapse_space(F.regexp_replace(F.regexp_replace(html, r"(?i)<link\b[^>]*>", ""), r"<[^>]+>", " "))


def main_article(html: Column) -> Column:
    """The article or main element if there is one and it speaks of a policy, else the whole page (DOC-02)."""
    a = F.regexp_extract(html, r"(?is)<(?:article|main)\b[^>]*>(.*?)</(?:article|main)>", 1)
    return F.when((a != "") & a.rlike(r"(?i)(data|privacy|cookie)\s*(policy|notice)"), a).otherwise(html)


def is_policy(text: Column) -> Column:
    """Speaks of a privacy or data policy or notice (DOC-04)."""
    return text.rlike(r"(?i)(data|privacy)\s*(?:policy|notice)")
