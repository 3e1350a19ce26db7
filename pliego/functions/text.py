"""Text keys: documents, names, departments, codes."""

from __future__ import annotations

import unicodedata
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from pliego.params import DEPARTMENT_ALIASES

#: Legal forms at the end of a company's name, as patterns.
LEGAL_FORMS = [
    r"S\.?\s*A\.?\s*S\.?",
    r"S\.?\s*A\.?",
    r"S\s+EN\s+C\.?\s*S?\.?",
    r"LTDA\.?",
    r"E\.?\s*U\.?",
    r"S\.?\s*C\.?\s*S?\.?",
    r"E\.?\s*S\.?\s*E\.?",
    r"E\.?\s*P\.?\s*S\.?",
    r"S\.?\s*P\.?\s*S\.?",
    r"I\.?\s*P\.?\s*S\.?",
]


def _base_letters() -> tuple[str, str]:
    """All letters of the Latin blocks that decompose into a plain one and marks, and these plain ones."""
    parts = {chr(i): unicodedata.normalize("NFD", chr(i)) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
    plain = {ch: d[0] for ch, d in parts.items() if len(d) > 1 and d[0].isascii()}
    return "".join(plain), "".join(plain.values())


_ACCENTED, _PLAIN = _base_letters()
_FORM = r"[\s,]+(" + "|".join(LEGAL_FORMS) + r")[\s.]*$"


def digits(text: Column) -> Column:
    """Only the digits; null and texts without any give an empty string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")


def unaccented(text: Column) -> Column:
    """Latin letters without their accents, written as one character or with combining marks."""
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{Mn}", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def name_key(text: Column) -> Column:
    """Upper-case letters, digits, spaces, commas and dots of a name, accents off; null gives an empty string."""
    return F.upper(F.regexp_replace(F.translate(F.trim(F.coalesce(text, F.lit(""))), "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN"), "[^A-Za-z0-9 ,.]", ""))


def strict_name_key(text: Column) -> Column:
    """The key that lets lower-case letters vanish, as names in official lists are upper-case throughout."""
    return F.upper(F.regexp_replace(F.translate(text, "ÁÉÍÓÚÜÑ", "AEIOUUN"), "[^A-Z0-9 ,.]", ""))


def company_name(text: Column) -> Column:
    """Upper case, no accents, single spaces, without a legal form at the end; null if nothing is left."""
    plain = collapsed(unaccented(F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))))
    return F.nullif(F.trim(F.regexp_replace(plain, _FORM, "")), F.lit(""))


def nit_base(number: Column) -> Column:
    """A ten-digit number that begins with 8 or 9 without its check digit; others as they are; empty gives null."""
    with_check = (F.length(number) == 10) & F.substring(number, 1, 1).isin("8", "9")
    return F.nullif(F.when(with_check, F.substring(number, 1, 9)).otherwise(number), F.lit(""))


def document(text: Column) -> Column:
    """struct(doc_raw, doc_norm, nit_base)."""
    number = F.nullif(digits(text), F.lit(""))
    return F.struct(text.alias("doc_raw"), number.alias("doc_norm"), nit_base(number).alias("nit_base"))


def natural_person(number: Column) -> Column:
    """Whether a document number is a person's: true, false, or null where it can't be told."""
    n, first = F.length(number), F.substring(number, 1, 1)
    return F.when(number == "", None).when(n <= 8, True).when(n.isin(9, 10) & first.isin("8", "9"), False).when((n == 10) & (first == "1"), True)


def department(text: Column) -> Column:
    """A department's name: upper case, no accents, single spaces, aliases resolved."""
    name = collapsed(unaccented(F.upper(text)))
    return F.coalesce(F.create_map(*map(F.lit, chain(*DEPARTMENT_ALIASES.items())))[name], name)


def object_key(text: Column) -> Column:
    """A contract's object for counting repeats: spaces collapsed, upper case."""
    return F.upper(collapsed(text))


def unspsc_segment(code: Column) -> Column:
    """The first two digits of a category code, its version prefix off."""
    return F.substring(F.regexp_replace(F.coalesce(code, F.lit("")), r"^V[0-9]+[.]", ""), 1, 2).try_cast("int")


def padded(code: Column, width: int) -> Column:
    """Zeros in front up to width; longer codes stay whole."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def humanised(identifier: Column) -> Column:
    """LICITACION_PUBLICA -> Licitacion Publica."""
    return F.initcap(F.replace(identifier, F.lit("_"), F.lit(" ")))


def decimals(number: Column, most: int, least: int = 0) -> Column:
    """A number with a comma before its decimals and dots between thousands; zeros beyond `least` decimals are left out."""
    text = F.translate(F.format_number(number, most), ".,", ",.")
    return F.regexp_replace(F.regexp_replace(text, rf"(,[0-9]{{{least}}}[0-9]*?)0+$", "$1"), ",$", "")


def percent(amount: Column, digits: int = 1) -> Column:
    return F.concat(decimals(amount, digits, digits), F.lit("%"))


def spanish_date(iso: Column) -> Column:
    """2023-05-01 -> 1 de mayo de 2023; what is no date stays as it is."""
    months = F.array(*[F.lit(m) for m in "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()])
    day = F.substring(iso, 1, 10).try_cast("date")
    return F.coalesce(F.concat(F.dayofmonth(day).cast("string"), F.lit(" de "), F.element_at(months, F.month(day)), F.lit(" de "), F.year(day).cast("string")), iso)


def pesos(amount: Column) -> Column:
    """An amount in the long scale: billones, miles de millones, millones, or whole pesos with dots."""
    size = F.abs(amount)
    short = lambda unit, name: F.concat(decimals(size / unit, 1, 1), F.lit(f" {name}"))
    text = F.when(size >= 1e12, short(1e12, "billones")).when(size >= 1e9, short(1e9, "mil millones")).when(size >= 1e6, short(1e6, "millones")).otherwise(decimals(size, 0))
    return F.concat(F.when(amount < 0, F.lit("-")).otherwise(""), F.lit("$"), text)


def file_name(url: Column) -> Column:
    """The last part of a URL's path, decoded, with anything but letters, digits, dots, dashes and underscores replaced."""
    last = F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)
    return F.regexp_replace(F.try_url_decode(last), r"[^A-Za-z0-9._-]+", "_")
