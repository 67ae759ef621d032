"""Text normalisers as column expressions. Blank is the empty string; nulls read as blank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space when trimming, beyond the ASCII ones.
SPACES = "\t\n\x0b\x0c\r   " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
# What tidying makes blanks of, and what it drops.
BLANKS, CONTROLS = "\r\n\t　", "".join(map(chr, [*range(9), 11, 12, *range(14, 32)]))
FULL_ASCII, HALF_ASCII = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
# Half-width kana and their full-width forms, in the order of the half-width code points.
HALF_KANA = "ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝ"
FULL_KANA = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
# Kana that take a voiced or a half-voiced mark.
VOICED = dict(zip("ｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾊﾋﾌﾍﾎｳ", "ガギグゲゴザジズゼゾダヂヅデドバビブベボヴ"))
HALF_VOICED = dict(zip("ﾊﾋﾌﾍﾎ", "パピプペポ"))
# Abbreviations of legal forms, written out.
LEGAL_FORMS = (("株", "㈱", "株式会社"), ("有", "㈲", "有限会社"), ("同", None, "合同会社"), ("資", None, "合資会社"))
LEGAL_PREFIXES = "株式会社|有限会社|合同会社|合資会社|一般社団法人|一般財団法人|特定非営利活動法人|NPO法人"
LEGAL_SUFFIXES = "株式会社|有限会社|合同会社|合資会社"
STORE_SUFFIXES = "支店|本店|営業所|出張所|店舗|店"

_EDGE = "[" + SPACES + "]+"
# Letters that narrow or wide_kana change (and what stands for bytes that are no text), and text that normal_text
# surely leaves as it is: ASCII signs, kana, ideographs and the like, with single blanks between them.
_WIDE, _HALF = r"！-～�", r"ｦ-ﾟ�"
_PLAIN = r"^(?:[\x21-\x7E、-퟿]++(?: [\x21-\x7E、-퟿]++)*+)?+\z"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f uses it. Expressions nested without it grow by what each repeats, until
    the code generated for them no longer compiles."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.trim(text(c), F.lit(SPACES))


def blank(c: Column) -> Column:
    return ~text(c).rlike(f"[^{SPACES}]")


def first_nonblank(*columns: Column) -> Column:
    """The first value that is not blank, trimmed; blank if there is none."""
    if not columns:
        return F.lit("")
    filled = F.filter(F.transform(F.array(*[text(c) for c in columns]), trimmed), lambda v: v != "")
    return F.coalesce(F.get(filled, F.lit(0)), F.lit(""))


def narrow(c: Column) -> Column:
    """Full-width ASCII to ASCII. Letters are looked up one by one only in texts that have such."""
    return bound(text(c), lambda v: F.when(v.rlike(f"[{_WIDE}]"), F.translate(v, FULL_ASCII, HALF_ASCII)).otherwise(v))


def wide_kana(c: Column) -> Column:
    """Half-width kana to full-width, a following mark joined to the kana that take it."""

    def joined(v: Column) -> Column:
        out = v
        for marks, mark in ((VOICED, "ﾞ"), (HALF_VOICED, "ﾟ")):
            for half, full in marks.items():
                out = F.replace(out, F.lit(half + mark), F.lit(full))
        return F.translate(F.when(v.rlike("[ﾞﾟ]"), out).otherwise(v), HALF_KANA, FULL_KANA)

    return bound(c, lambda v: F.when(v.rlike(f"[{_HALF}]"), joined(v)).otherwise(v))


def tidy(c: Column) -> Column:
    """Line ends and tabs to blanks, control characters dropped, wide blanks to blanks, runs of blanks to one, ends trimmed."""
    return trimmed(F.regexp_replace(F.translate(text(c), BLANKS + CONTROLS, " " * len(BLANKS)), " {2,}", " "))


def normal_text(c: Column) -> Column:
    """Narrow, with wide kana and tidy. Most texts are so already, which one look tells."""
    return bound(text(c), normal_of_text)


def normal_of_text(c: Column) -> Column:
    """normal_text of a column that is never null. It names c several times, so c should be no more than a column."""
    return F.when(c.rlike(_PLAIN), c).otherwise(tidy(wide_kana(narrow(c))))


def company_name(c: Column) -> Column:
    return bound(normal_text(c), company_of_normal)


def company_of_normal(c: Column) -> Column:
    """company_name of what is normal text already, and no more than a column, since it is named several times."""
    short = "|".join([f"[(（](?:{'|'.join(s for s, _, _ in LEGAL_FORMS)})[)）]", *(sign for _, sign, _ in LEGAL_FORMS if sign)])

    def written_out(v: Column) -> Column:
        for short, sign, full in LEGAL_FORMS:
            for pattern in [rf"^[(（]{short}[)）]", rf"[(（]{short}[)）]\z", *([rf"^{sign}", rf"{sign}\z"] if sign else [])]:
                v = F.regexp_replace(v, pattern, full)
        return v

    # a text without a short form at either end is not looked through for each of them
    return trimmed(F.when(c.rlike(rf"^(?:{short})|(?:{short})\z"), written_out(c)).otherwise(c))


def company_key(c: Column) -> Column:
    c = F.regexp_replace(company_name(c), rf"^({LEGAL_PREFIXES})[{SPACES}]*", "")
    return trimmed(F.lower(F.regexp_replace(c, rf"[{SPACES}]*({LEGAL_SUFFIXES})\z", "")))


def address(c: Column) -> Column:
    return address_of_normal(normal_text(c))


def address_of_normal(c: Column) -> Column:
    """address of what is normal text already."""
    return trimmed(F.regexp_replace(c, rf"^[〒{SPACES}]*([0-9]{{3}})-?([0-9]{{4}})[{SPACES}]*", "$1-$2 "))


def address_key(c: Column) -> Column:
    c = F.regexp_replace(address(c), rf"^[0-9]{{3}}-?[0-9]{{4}}[{SPACES}]*", "")
    return F.lower(F.regexp_replace(c, _EDGE, ""))


def store_name(c: Column) -> Column:
    return normal_text(c)


def store_key(c: Column) -> Column:
    return trimmed(F.lower(F.regexp_replace(store_name(c), rf"({STORE_SUFFIXES})\z", "")))


def email(c: Column) -> Column:
    return email_of_normal(narrow(trimmed(c)))


def email_of_normal(c: Column) -> Column:
    """email of what is narrow and trimmed already."""
    return F.lower(c)


def email_fault(c: Column) -> Column:
    """Why a normalised address is not one, or null."""
    part = f"[^@{SPACES}]+"
    return F.when(~text(c).rlike(rf"^({part}@{part}\.{part})?\z"), F.lit("invalid email format"))


def phone(c: Column) -> Column:
    """Digits only; +81, or 81 before ten or more digits, becomes 0."""
    return phone_of_normal(narrow(trimmed(c)))


def phone_of_normal(c: Column) -> Column:
    """phone of what is narrow and trimmed already."""
    digits = F.regexp_replace(c, r"(?!^\+)[^0-9]", "")
    return F.regexp_replace(digits, r"^(\+81|81(?=[0-9]{10,}\z))", "0")


def phone_fault(c: Column) -> Column:
    """Why a normalised number is not one, or null."""

    def fault(c: Column) -> Column:
        n = F.length(c)
        counted = lambda what: F.concat(F.lit(f"too {what} ("), n.cast("string"), F.lit(" digits)"))
        return (
            F.when(c == "", F.lit(None).cast("string"))
            .when(~c.rlike(r"^[0-9]+\z"), F.lit("contains non-digit characters"))
            .when(n < 10, counted("short"))
            .when(n > 11, counted("long"))
            .when(~c.startswith("0"), F.lit("does not start with 0"))
        )

    return bound(text(c), fault)


def preview(c: Column, n: int = 200) -> Column:
    return F.left(text(c), F.lit(n))


def printable(c: Column) -> Column:
    """Without control characters, for reports."""
    return F.regexp_replace(text(c), r"[\x00-\x1F\x7F]", "")


def shortened(c: Column, n: int = 30) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c)


def repaired_name(c: Column) -> Column:
    """UTF-8 bytes that were read as Latin-1, read again; kept as they are where that gives no sound text."""
    again = F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string"))
    garbled = c.rlike("[\u0080-ÿ]") & ~c.rlike("[^\u0000-ÿ]")
    return F.when(garbled, F.coalesce(again, c)).otherwise(c)
