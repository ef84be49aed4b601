"""Phone numbers of regions: what looks like one is checked by its digits against the regions' numbering plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scan import Recognizer

# Calling code, prefix of calls within the country (a pattern), and the numbers behind it, by region.
PLANS = {
    "US": ("1", "1?", r"[2-9]\d\d[2-9]\d{6}"),
    "CA": ("1", "1?", r"[2-9]\d\d[2-9]\d{6}"),
    "GB": ("44", "0", r"1\d{8,9}|[235789]\d{9}"),
    "DE": ("49", "0", r"15\d{9}|1[67]\d{8,9}|[2-9]\d{5,10}"),
    "IL": ("972", "0", r"[23489]\d{7}|[57]\d{8}"),
    "IN": ("91", "0?", r"[1-9]\d{9}"),
    "BR": ("55", "0?", r"[1-9][1-9](?:[2-5]\d{7}|9\d{8})"),
    "JP": ("81", "0", r"[5789]0\d{8}|[1-9]\d{8}"),
    "CN": ("86", "0?", r"1[3-9]\d{9}|[1-9]\d{1,2}[2-8]\d{6,7}"),
    "FR": ("33", "0", r"[1-9]\d{8}"),
    "ES": ("34", "", r"[5-9]\d{8}"),
    "IT": ("39", "", r"0\d{5,10}|3\d{8,9}"),
    "AU": ("61", "0", r"[2-478]\d{8}"),
    "ZA": ("27", "0", r"[1-9]\d{8}"),
}
REGIONS = ("US", "GB", "DE", "FR", "IL", "IN", "CA", "BR")
# Calling codes of one and two digits; all others have three.
SHORT_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
LONG_CODES = r"2[1-9]\d|2[4-6]\d|29\d|35\d|37\d|38\d|42\d|5[09]\d|67\d|68\d|69\d|80\d|85\d|87\d|88\d|96\d|97\d|99\d"
#: A number in the manner of North America, which may stand next to another, and any number: seven to sixteen digits, up to two signs between.
NORTH = r"(?<![\w+])(?:\+?1[ .-]?)?(?:\([2-9]\d\d\)|[2-9]\d\d)[ .-]?[2-9]\d\d[ .-]?\d{4}(?![\w@])"
ANY = r"(?<![\w+])(?![12]\d{3}[-/]?[01]\d[-/]?[0-3]\d +[0-2]\d:)(?:\+|\(\+?)?\d(?:[ .\-/()]{0,2}\d){6,15}(?![\w@])"


def valid(t: Column, regions: tuple[str, ...]) -> Column:
    """Whether the digits are a number of a region, or, with a plus, of any country."""
    plans = [PLANS[r] for r in regions]
    digits = F.regexp_replace(t, "[^0-9]", "")
    abroad = "|".join(f"{code}(?:{own})" for code, _, own in PLANS.values())
    planned = "|".join(code for code, _, _ in PLANS.values())
    others = rf"(?!(?:{planned}))(?:{'|'.join(SHORT_CODES)}|{LONG_CODES})\d{{6,12}}"
    home = "|".join(f"(?:{prefix}|{code})(?:{own})" for code, prefix, own in plans)
    return F.when(t.contains("+"), digits.rlike(f"^(?:{abroad}|{others})$") & (F.length(digits) <= 15)).otherwise(digits.rlike(f"^(?:{home})$"))


def phone_recognizer(regions: tuple[str, ...] = REGIONS, name: str = "PhoneRecognizer", entity: str = "PHONE_NUMBER", score: float = 0.4, languages: tuple[str, ...] = ("en",)) -> Recognizer:
    """Numbers as they are written within the regions, or with a plus and a country's code. Unknown regions raise ValueError."""
    if unknown := sorted(set(regions) - set(PLANS)):
        raise ValueError(f"no numbering plan of {', '.join(unknown)}")
    words = ("phone", "number", "telephone", "cell", "cellphone", "mobile", "call")
    return Recognizer(name, entity, ((NORTH, score), (ANY, score)), words, lambda t: F.when(~valid(t, tuple(regions)), False), languages=languages, gate=r"\p{Nd}{2}")
