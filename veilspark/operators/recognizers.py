"""The catalogue of recognizers, and the choice of those that a request needs."""

from __future__ import annotations

import json
import re
import warnings
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checksums as C
from .countries import CRYPTO, MORE, kr_resident, national, surely, za_id
from .phones import phone_recognizer
from .scan import Recognizer, deny_list
from .suffixes import SUFFIXES

R = Recognizer
# What follows country code and check digits, by country (n digits, a capitals, c letters and digits, z zeros).
IBAN_FORMATS = {
    "AL": "8n16c", "AD": "8n12c", "AT": "16n", "AZ": "4c20n", "BH": "4a14c", "BY": "4c4n16c", "BE": "12n", "BA": "16n", "BR": "23n1a1c", "BG": "4a6n8c", "CR": "1z17n", "HR": "17n", "CY": "8n16c", "CZ": "20n", "DK": "14n", "DO": "4a20n",
    "TL": "19n", "EE": "16n", "FO": "14n", "FI": "14n", "FR": "10n11c2n", "GE": "2c16n", "DE": "18n", "GI": "4a15c", "GR": "7n16c", "GL": "14n", "GT": "24c", "HU": "24n", "IS": "22n", "IE": "4c14n", "IL": "19n", "IT": "1a10n12c", "JO": "4a22n",
    "KZ": "3n13c", "XK": "16n", "KW": "4a22c", "LV": "4a13c", "LB": "4n20c", "LI": "5n12c", "LT": "16n", "LU": "3n13c", "MT": "4a5n18c", "MR": "23n", "MU": "4a19n1a", "MD": "20c", "MC": "10n11c2n", "ME": "18n", "NL": "4a10n", "MK": "3n10c2n",
    "NO": "11n", "PK": "4c16n", "PS": "4c17n", "PL": "24n", "PT": "17n", "QA": "4a17c", "RO": "4a16c", "SM": "1a10n12c", "SA": "2n18c", "RS": "18n", "SK": "20n", "SI": "15n", "ES": "20n", "SE": "20n", "CH": "5n12c", "TN": "20n", "TR": "5n17c",
    "AE": "19n", "GB": "4a14n", "VA": "18n", "VG": "4c16n", "EG": "25n", "IQ": "4a15n", "LY": "21n", "LC": "4a24c", "SC": "4a20n3a", "UA": "6n19c",
}
SIGNS = {"n": "[0-9]", "a": "[A-Z]", "c": "[a-zA-Z0-9]", "z": "0"}
IBAN = r"(?<![A-Z0-9])([A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,6})((?:[ -]?[A-Z0-9]{4})?)((?:[ -]?[A-Z0-9]{1,3})?)(?![A-Z0-9])"
V4 = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
PREFIX6 = r"(?:/(?:12[0-8]|1[01]\d|[1-9]?\d))?"
URL = r"((www\d{0,3}[.])?[a-z0-9.\-]{1,253}[.](?:" + "|".join(SUFFIXES) + r")(?:/[^\s()<>\"']*)?)"
INSTANT, ZONE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T[0-2]\d:[0-5]\d", r"([+-][0-2]\d:[0-5]\d|Z)"
MONTH = "(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)"
DAY_, MONTH_ = "([1-9]|0[1-9]|[1-2][0-9]|3[0-1])", "([1-9]|0[1-9]|1[0-2])"


def email_domain(t: Column) -> Column:
    """A domain with a known-looking suffix: the public suffix list is not at hand, so any alphabetic suffix of two or more letters."""
    return F.regexp_extract(t, r"@(.*)$", 1).rlike(r"(?i)^[^.]+(\.[^.]+)*\.[a-z]{2,}$")


def ip_bad(t: Column) -> Column:
    """Not an address with or without prefix length: octets have no leading zeros, groups are eight, or fewer around one '::'."""
    dotted = t.rlike(rf"(^|[:.]){V4}(\.{V4}){{3}}(/\d+)?$") & ~t.rlike(r"(^|[:.])0\d+\.|\.0\d")
    six = F.regexp_replace(F.regexp_replace(t, r"[%/].*$", ""), r"\d+(\.\d+){3}$", "0:0")
    groups = F.size(F.array_remove(F.split(six, ":"), ""))
    whole = ~six.rlike(":::|::.*::|^:[^:]|[^:]:$") & F.when(six.contains("::"), groups <= 7).otherwise(groups == 8)
    return F.when(~t.contains(":"), ~dotted).otherwise(~whole | (t.contains(".") & ~dotted))


def german_tax_id(t: Column) -> Column:
    """The check digit, and no digit more than three times among the first ten."""
    digits = F.split(F.substring(t, 1, 10), "")
    often = F.array_max(F.transform(F.array_distinct(digits), lambda x: F.size(F.filter(digits, lambda y: y == x))))
    return C.iso7064_11_10(t) & (often <= 3)


def iban(t: Column) -> Column:
    """True with right check digits in the country's format, null if the format holds only for capitals, else false."""
    compact = F.regexp_replace(t, "[ -]", "")
    checks = C.mod97(F.upper(compact)) & F.substring(compact, 3, 2).between("02", "98")
    shape = "^(?:" + "|".join(country + r"\d{2}" + "".join(f"{SIGNS[sign]}{{{n}}}" for n, sign in re.findall(r"(\d+)([nacz])", form)) for country, form in IBAN_FORMATS.items()) + ")$"
    return F.when(checks & compact.rlike(shape), True).when(checks & F.upper(compact).rlike(shape), F.lit(None)).otherwise(False)


def iban_end(t: Column) -> Column:
    """Length of the longest of the match, the match without its last group and that without its last two that is an IBAN."""
    size = lambda k: F.length(F.regexp_extract(t, "(?i)" + IBAN, k))
    ends = F.array(*[sum((size(k) for k in range(2, last + 1)), size(1)) for last in (3, 2, 1)])
    return F.coalesce(F.get(F.filter(ends, lambda n: F.coalesce(iban(F.substring(t, F.lit(1), n)), F.lit(True))), 0), F.lit(0))


def mac(t: Column) -> Column:
    hexes = F.upper(C.only(t, "0-9A-Fa-f"))
    return (F.length(hexes) != 12) | hexes.isin("FFFFFFFFFFFF", "000000000000")


def uuid_bad(t: Column) -> Column:
    return ~t.rlike(r"(?i)^.{14}[1-8].{4}[89ab]")


def ssn_bad(t: Column) -> Column:
    d = C.only(t)
    mixed = t.contains("-").cast("int") + t.contains(".").cast("int") + t.contains(" ").cast("int") > 1
    same = d == F.repeat(F.substring(d, 1, 1), 9)
    return mixed | same | (F.substring(d, 4, 2) == "00") | (F.substring(d, 6, 4) == "0000") | d.rlike("^(000|666|123456789|98765432|078051120)")


def nhs(t: Column) -> Column:
    s = C.weighted(t, [10, 9, 8, 7, 6, 5, 4, 3, 2])
    return (11 - s % 11) % 11 == C.digit(t, 9)


def aba(t: Column) -> Column:
    return C.weighted(t, [3, 7, 1, 3, 7, 1, 3, 7, 1]) % 10 == 0


def abn(t: Column) -> Column:
    first = F.when(C.digit(t, 0) == 0, 9).otherwise(C.digit(t, 0) - 1)
    return (C.weighted(t, [0, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]) + first * 10) % 89 == 0


def nif(t: Column) -> Column:
    n, letter = C.only(t), F.upper(F.regexp_extract(t, "([A-Za-z])$", 1))
    return F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (n.cast("long") % 23 + 1).cast("int"), 1) == letter


def nie(t: Column) -> Column:
    lead = F.substring(F.upper(t), 1, 1)
    n = F.concat(F.translate(lead, "XYZ", "012"), C.only(F.substring(t, 2, 30)))
    return F.when(F.length(t).isin(8, 9, 10), F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (n.cast("long") % 23 + 1).cast("int"), 1) == F.upper(F.regexp_extract(t, "([A-Za-z])$", 1))).otherwise(False)


def tckn(t: Column) -> Column:
    d = [C.digit(t, i) for i in range(11)]
    odd, even = d[0] + d[2] + d[4] + d[6] + d[8], d[1] + d[3] + d[5] + d[7]
    return (F.pmod(odd * 7 - even, F.lit(10)) == d[9]) & (sum(d[1:10], d[0]) % 10 == d[10])


def pesel(t: Column) -> Column:
    return (C.weighted(t, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]) + C.digit(t, 10)) % 10 == 0


def thai(t: Column) -> Column:
    return (11 - C.weighted(t, [13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2]) % 11) % 10 == C.digit(t, 12)


def aadhaar(t: Column) -> Column:
    d = C.only(t)
    return (F.length(d) == 12) & (F.substring(d, 1, 1) >= "2") & (d != F.reverse(d)) & C.verhoeff(t)


def npi(t: Column) -> Column:
    """Luhn of the number after the prefix of health identifiers."""
    return C.luhn(F.concat(F.lit("80840"), C.only(t)))


def npi_bad(t: Column) -> Column:
    """Nothing but one digit before the last."""
    d = C.only(t)
    return F.substring(d, 1, 9) == F.repeat(F.substring(d, 1, 1), 9)


def german_vat(t: Column) -> Column:
    """True, or null: the check digit is only convention, so a wrong one says nothing."""
    return F.when(C.iso7064_11_10(t), True)


def finnish(t: Column) -> Column:
    n = F.concat(F.substring(t, 1, 6), F.substring(t, 8, 3)).cast("long")
    real = F.try_to_date(F.concat(F.substring(t, 1, 4), F.when(F.substring(t, 7, 1).isin("+"), "18").when(F.substring(t, 7, 1).isin("-", "Y", "X", "W", "V", "U"), "19").otherwise("20"), F.substring(t, 5, 2)), "ddMMyyyy").isNotNull()
    return real & (F.substring(F.lit("0123456789ABCDEFHJKLMNPRSTUVWXY"), (n % 31 + 1).cast("int"), 1) == F.upper(F.substring(t, 11, 1)))


# Patterns, scores and context words, which results depend on.
GENERIC = [
    CRYPTO,
    R("CreditCardRecognizer", "CREDIT_CARD", ((r"\b(?!1\d{12}(?!\d))((4\d{3})|(5[0-5]\d{2})|(6\d{3})|(1\d{3})|(3\d{3}))[- ]?(\d{3,4})[- ]?(\d{3,4})[- ]?(\d{3,5})\b", 0.3),), ("credit", "card", "visa", "mastercard", "cc ", "amex", "discover", "jcb", "diners", "maestro", "instapayment"), C.luhn, gate=r"\p{Nd}{3}"),
    R("DateRecognizer", "DATE_TIME", (
        (rf"\b(?:({INSTANT}:[0-5]\d\.\d+{ZONE})|({INSTANT}:[0-5]\d{ZONE})|({INSTANT}{ZONE}))\b", 0.8),
        (rf"\b({MONTH_}/{DAY_}/(\d{{4}}|\d{{2}}))\b", 0.6), (rf"\b({DAY_}/{MONTH_}/(\d{{4}}|\d{{2}}))\b", 0.6), (rf"\b(\d{{4}}/{MONTH_}/{DAY_})\b", 0.6),
        (rf"\b({MONTH_}-{DAY_}-\d{{4}})\b", 0.6), (rf"\b({DAY_}-{MONTH_}-\d{{4}})\b", 0.6), (rf"\b(\d{{4}}-{MONTH_}-{DAY_})\b", 0.6),
        (rf"\b({DAY_}\.{MONTH_}\.(\d{{4}}|\d{{2}}))\b", 0.6), (rf"\b({DAY_}-{MONTH}-(\d{{4}}|\d{{2}}))\b", 0.6), (rf"\b({MONTH}-(\d{{4}}|\d{{2}}))\b", 0.6),
        (rf"\b({DAY_}-{MONTH})\b", 0.6), (rf"\b({MONTH_}/\d{{4}})\b", 0.2), (rf"\b({MONTH_}/\d{{2}})\b", 0.1),
    ), ("date", "birthday"), gate=r"(?i)[-/.](?:(?<=\p{Nd}[-/])\p{Nd}|(?<=\p{Nd}\.)\p{Nd}{1,2}\.|(?<=" + MONTH + r"-)\p{Nd}|(?<=\p{Nd}-)" + MONTH + ")"),
    R("EmailRecognizer", "EMAIL_ADDRESS", ((r"\b((([!#$%&'*+\-/=?^_`{|}~\w])|([!#$%&'*+\-/=?^_`{|}~\w][!#$%&'*+\-/=?^_`{|}~\.\w]{0,}[!#$%&'*+\-/=?^_`{|}~\w]))[@]\w+(?:-+\w+)*(?:\.\w+(?:-+\w+)*)+)\b", 0.5),), ("email",), email_domain, gate="@"),
    R("IbanRecognizer", "IBAN_CODE", ((IBAN, 0.5),), ("iban", "bank", "transaction"), iban, gate=r"[A-Za-z]{2}[0-9]{2}", trim=iban_end),
    R("IpRecognizer", "IP_ADDRESS", (
        (rf"(?<![\w:])::(?:ffff(?::0{{1,4}})?:)?(?:{V4}\.){{3}}{V4}{PREFIX6}\b", 0.6),
        (rf"(?<![\w:])(?:(?:[0-9A-Fa-f]{{1,4}}:){{1,5}}:(?:[0-9A-Fa-f]{{1,4}}:){{0,4}}|(?:[0-9A-Fa-f]{{1,4}}:){{6}})(?:{V4}\.){{3}}{V4}{PREFIX6}\b", 0.6),
        (rf"\b{V4}\.{V4}\.{V4}\.{V4}(?:/(?:[0-2]?\d|3[0-2]))?\b", 0.6),
        (r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|:(?::[0-9A-Fa-f]{1,4}){1,7}|(?:[0-9A-Fa-f]{1,4}:){1,6}:[0-9A-Fa-f]{1,4}|" + "|".join(rf"(?:[0-9A-Fa-f]{{1,4}}:){{1,{k}}}(?::[0-9A-Fa-f]{{1,4}}){{1,{7 - k}}}" for k in (5, 4, 3, 2)) + r"|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){1,6}|:(?::[0-9A-Fa-f]{1,4}){1,6})(?:%[0-9a-zA-Z]+)?" + PREFIX6 + r"(?![\w:]|\.\d)", 0.6),
        (rf"(?<![\w:])::{PREFIX6}(?![\w:])", 0.1),
    ), ("ip", "ipv4", "ipv6"), None, ip_bad, gate=r"\p{Nd}\.\p{Nd}{1,3}\.\p{Nd}|:[0-9A-Fa-f]*:"),
    R("MacAddressRecognizer", "MAC_ADDRESS", ((r"\b[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}\b", 0.6), (r"\b[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\b", 0.6)), ("mac", "mac address", "hardware address", "physical address", "ethernet"), None, mac, gate=r"[0-9A-Fa-f]{2}[:.-][0-9A-Fa-f]{2}"),
    phone_recognizer(),
    R("UrlRecognizer", "URL", (("(?:https?://)" + URL, 0.6), (URL, 0.5), (r"[\"'](https?://" + URL + r")[\"']", 0.6), (r"[\"'](" + URL + r")[\"']", 0.5)), ("url", "website", "link"), gate=r"(?i)[a-z0-9.-]\.[a-z]"),
    R("UuidRecognizer", "UUID", ((r"\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\b", 0.5),), ("uuid", "guid", "unique identifier"), None, uuid_bad, gate=r"[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}"),
]


NATIONAL = [
    national("UsSsnRecognizer", "US_SSN", "us", [(r"\b([0-9]{5})-([0-9]{4})\b", 0.05), (r"\b([0-9]{3})-([0-9]{6})\b", 0.05), (r"\b(([0-9]{3})-([0-9]{2})-([0-9]{4}))\b", 0.05), (r"\b[0-9]{9}\b", 0.05), (r"\b([0-9]{3})[- .]([0-9]{2})[- .]([0-9]{4})\b", 0.5)], ["social", "security", "ssn", "ssns", "ssid"], None, ssn_bad, enabled=True),
    national("UsItinRecognizer", "US_ITIN", "us", [(r"\b9\d{2}[- ](5\d|6[0-5]|7\d|8[0-8]|9([0-2]|[4-9]))\d{4}\b|\b9\d{2}(5\d|6[0-5]|7\d|8[0-8]|9([0-2]|[4-9]))[- ]\d{4}\b", 0.05), (r"\b9\d{2}(5\d|6[0-5]|7\d|8[0-8]|9([0-2]|[4-9]))\d{4}\b", 0.3), (r"\b9\d{2}[- ](5\d|6[0-5]|7\d|8[0-8]|9([0-2]|[4-9]))[- ]\d{4}\b", 0.5)], ["individual", "taxpayer", "itin", "tax", "payer", "taxid", "tin"], enabled=True),
    national("UsPassportRecognizer", "US_PASSPORT", "us", [(r"(\b[0-9]{9}\b)", 0.05), (r"(\b[A-Z][0-9]{8}\b)", 0.1)], ["us", "united", "states", "passport", "passport#", "travel", "document"], enabled=True),
    national("UsBankRecognizer", "US_BANK_NUMBER", "us", [(r"\b[0-9]{8,17}\b", 0.05)], ["check", "account", "account#", "acct", "bank", "save", "debit"], enabled=True),
    national("AbaRoutingRecognizer", "ABA_ROUTING_NUMBER", "us", [(r"\b[0123678]\d{8}\b", 0.05), (r"\b[0123678]\d{3}-\d{4}-\d\b", 0.3)], ["aba", "routing", "abarouting", "association", "bankrouting"], aba),
    national("UsNpiRecognizer", "US_NPI", "us", [(r"\b[12]\d{9}\b", 0.1), (r"\b[12]\d{3}[ -]\d{3}[ -]\d{3}\b", 0.4)], ["npi", "national provider", "provider", "npi number", "provider id", "provider identifier", "taxonomy"], npi, npi_bad),
    national("NhsRecognizer", "UK_NHS", "uk", [(r"\b([0-9]{3})[- ]?([0-9]{3})[- ]?([0-9]{4})\b", 0.5)], ["national health service", "nhs", "health services authority", "health authority"], nhs, enabled=True),
    national("UkNinoRecognizer", "UK_NINO", "uk", [(r"\b(?!bg|gb|nk|kn|nt|tn|zz|BG|GB|NK|KN|NT|TN|ZZ)([a-ceghj-pr-tw-zA-CEGHJ-PR-TW-Z]{1}[a-ceghj-npr-tw-zA-CEGHJ-NPR-TW-Z]{1}) ?([0-9]{2}) ?([0-9]{2}) ?([0-9]{2}) ?([a-dA-D]{1})\b", 0.5)], ["national insurance", "ni number", "nino"]),
    national("UkPassportRecognizer", "UK_PASSPORT", "uk", [(r"\b[A-Z]{2}\d{7}\b", 0.1)], ["passport", "passport number", "travel document", "uk passport", "british passport", "her majesty", "his majesty", "hm passport", "hmpo"]),
    national("AuAbnRecognizer", "AU_ABN", "au", [(r"\b\d{2}\s\d{3}\s\d{3}\s\d{3}\b", 0.1), (r"\b\d{11}\b", 0.01)], ["australian business number", "abn"], abn),
    national("AuAcnRecognizer", "AU_ACN", "au", [(r"\b\d{3}\s\d{3}\s\d{3}\b", 0.1), (r"\b\d{9}\b", 0.01)], ["australian company number", "acn"], lambda t: (10 - C.weighted(t, [8, 7, 6, 5, 4, 3, 2, 1]) % 10) % 10 == C.digit(t, 8)),
    national("AuMedicareRecognizer", "AU_MEDICARE", "au", [(r"\b[2-6]\d{3}\s\d{5}\s\d\b", 0.1), (r"\b[2-6]\d{9}\b", 0.01)], ["medicare"], lambda t: C.weighted(t, [1, 3, 7, 9, 1, 3, 7, 9]) % 10 == C.digit(t, 8)),
    national("AuTfnRecognizer", "AU_TFN", "au", [(r"\b\d{3}\s\d{3}\s\d{3}\b", 0.1), (r"\b\d{9}\b", 0.01)], ["tax file number", "tfn"], lambda t: C.weighted(t, [1, 4, 3, 7, 5, 8, 6, 9, 10]) % 11 == 0),
    national("CaSinRecognizer", "CA_SIN", "ca", [(r"\b[1-79]\d{8}\b", 0.05), (r"\b[1-79]\d{2}([- ])\d{3}\1\d{3}\b", 0.5)], ["sin", "sin number", "social insurance", "social insurance number", "canada", "nas", "numéro nas", "numéro d'assurance sociale", "assurance sociale"], None, lambda t: ~C.luhn(t)),
    national("CaPostalCodeRecognizer", "CA_POSTAL_CODE", "ca", [(r"\b[ABCEGHJ-NPRSTVXY]\d[ABCEGHJ-NPRSTV-Z] \d[ABCEGHJ-NPRSTV-Z]\d\b", 0.3), (r"\b[ABCEGHJ-NPRSTVXY]\d[ABCEGHJ-NPRSTV-Z]\d[ABCEGHJ-NPRSTV-Z]\d\b", 0.1)], ["postal code", "postcode", "zip", "canada", "ontario", "quebec", "alberta", "british columbia", "code postal"]),
    national("FiPersonalIdentityCodeRecognizer", "FI_PERSONAL_IDENTITY_CODE", "fi", [(r"\b(\d{6})([-+ABCDEFYXWVU])(\d{3})([0123456789ABCDEFHJKLMNPRSTUVWXY])\b", 0.5), (r"(\d{6})([-+ABCDEFYXWVU])(\d{3})([0123456789ABCDEFHJKLMNPRSTUVWXY])", 0.1)], ["hetu", "henkilötunnus", "personbeteckningen", "personal identity code"], finnish, languages=("fi",)),
    national("DePassportRecognizer", "DE_PASSPORT", "de", [(r"\b[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{7}[0-9]\b", 0.4)], ["reisepass", "pass", "passnummer", "reisepassnummer", "passport", "passport number", "pass-nr", "dokumentennummer", "bundesrepublik deutschland", "ausweisdokument", "mrz"], C.icao, languages=("de",)),
    national("DeTaxIdRecognizer", "DE_TAX_ID", "de", [(r"\b[1-9]\d{10}\b", 0.5)], ["steueridentifikationsnummer", "steuer-id", "steuerid", "steuerliche identifikationsnummer", "steuerliche identifikation", "persönliche identifikationsnummer", "steueridentifikation", "idnr", "steuer-idnr", "steuernummer", "bzst"], german_tax_id, languages=("de",)),
    national("DeHandelsregisterRecognizer", "DE_HANDELSREGISTER", "de", [(r"\bHR[AB]\s*\d{1,6}\b", 0.5)], ["handelsregister", "handelsregisternummer", "amtsgericht", "registergericht", "hra", "hrb", "hr-nummer", "registerauszug", "handelsregistereintrag", "firma", "gesellschaft", "gmbh", "ag", "ug", "kg", "ohg", "einzelkaufmann", "einzelkauffrau", "handelsregisterblattnummer"], languages=("de",)),
    national("DeVatIdRecognizer", "DE_VAT_ID", "de", [(r"\bDE\d{9}\b", 0.5), (r"\bDE[\s.\-]?\d{3}[\s.\-]?\d{3}[\s.\-]?\d{3}\b", 0.4)], ["umsatzsteuer-identifikationsnummer", "umsatzsteuer identifikationsnummer", "ust-idnr", "ust-id", "ustidnr", "umsatzsteuer-id", "mehrwertsteuer", "vat", "vat-id", "vat id", "steueridentifikation", "bzst", "bundeszentralamt für steuern", "finanzamt", "invoice", "rechnung"], german_vat, languages=("de",)),
    national("InAadhaarRecognizer", "IN_AADHAAR", "in", [(r"\b[0-9]{12}\b", 0.01), (r"\b[0-9]{4}[- :][0-9]{4}[- :][0-9]{4}\b", 0.01)], ["aadhaar", "uidai"], aadhaar),
    national("InPanRecognizer", "IN_PAN", "in", [(r"\b([A-Za-z]{3}[AaBbCcFfGgHhJjLlPpTt]{1}[A-Za-z]{1}[0-9]{4}[A-Za-z]{1})\b", 0.5), (r"\b([A-Za-z]{5}[0-9]{4}[A-Za-z]{1})\b", 0.1), (r"\b(?=[\w@#$%^?~-]{10}\b)((?=.*?[a-zA-Z])(?=.*?[0-9]{4})[\w@#$%^?~-]{10})\b", 0.01)], ["permanent account number", "pan"]),
    national("InPassportRecognizer", "IN_PASSPORT", "in", [(r"\b[A-Z][1-9]\d\s?\d{4}[1-9]\b", 0.1)], ["passport", "indian passport", "passport number"]),
    national("InVoterRecognizer", "IN_VOTER", "in", [(r"\b([A-Za-z]{1}[ABCDGHJKMNPRSYabcdghjkmnprsy]{1}[A-Za-z]{1}([0-9]){7})\b", 0.4), (r"\b([A-Za-z]){3}([0-9]){7}\b", 0.3)], ["voter", "epic", "elector photo identity card"]),
    national("ItPassportRecognizer", "IT_PASSPORT", "it", [(r"(?i)\b[A-Z]{2}\d{7}\b", 0.01)], ["passaporto", "elettronico", "italiano", "viaggio", "viaggiare", "estero", "documento", "dogana"], languages=("it",), enabled=True),
    national("KrRrnRecognizer", "KR_RRN", "kr", [(r"(?<!\d)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(-?)[1-4]\d{6}(?!\d)", 0.5)], ["Korean RRN", "Korean Resident Registration Number", "Resident Registration Number", "RRN", "rrn", "rrn#"], lambda t: kr_resident(t, 11), languages=("ko", "kr")),
    national("NgVehicleRegistrationRecognizer", "NG_VEHICLE_REGISTRATION", "ng", [(r"\b[A-Z]{3}[- ]?\d{3}[A-Z]{2}\b", 0.5)], ["plate number", "vehicle registration", "license plate", "number plate", "plate", "vehicle", "registration"]),
    national("NgNinRecognizer", "NG_NIN", "ng", [(r"\b\d{11}\b", 0.01)], ["nin", "national identification number", "national identity number", "nimc", "national identity", "nigeria id", "nigerian identification"], C.verhoeff),
    national("PlPeselRecognizer", "PL_PESEL", "pl", [(r"[0-9]{2}([02468][1-9]|[13579][012])(0[1-9]|1[0-9]|2[0-9]|3[01])[0-9]{5}", 0.4)], ["pesel"], pesel, languages=("pl",), enabled=True),
    national("PhUmidRecognizer", "PH_UMID", "ph", [(r"\b\d{4}-\d{7}-\d\b", 0.5), (r"\b\d{12}\b", 0.3)], ["umid", "unified multi-purpose id", "crn", "common reference number", "sss", "gsis", "philhealth", "pag-ibig", "umid number", "umid card", "unified multipurpose id"]),
    national("SgFinRecognizer", "SG_NRIC_FIN", "sg", [(r"(?i)(\b[A-Z][0-9]{7}[A-Z]\b)", 0.3), (r"(?i)(\b[STFGM][0-9]{7}[A-Z]\b)", 0.5)], ["fin", "fin#", "nric", "nric#"]),
    national("EsNifRecognizer", "ES_NIF", "es", [(r"\b[0-9]?[0-9]{7}[-]?[A-Z]\b", 0.5)], ["documento nacional de identidad", "DNI", "NIF", "identificación"], nif, languages=("es",), enabled=True),
    national("EsNieRecognizer", "ES_NIE", "es", [(r"\b[X-Z]?[0-9]?[0-9]{7}[-]?[A-Z]\b", 0.5)], ["número de identificación de extranjero", "NIE"], nie, languages=("es",), enabled=True),
    national("SeOrganisationsnummerRecognizer", "SE_ORGANISATIONSNUMMER", "se", [(r"\b\d{6}[-]?\d{4}\b", 0.6), (r"\d{6}[-]?\d{4}", 0.2)], ["organisationsnummer", "org nr", "orgnr", "företagsnummer"], C.luhn, languages=("sv",)),
    national("ThTninRecognizer", "TH_TNIN", "th", [(r"\b[1-9](?:[134][0-9]|2[0-7]|5[0-8]|[67][01234567]|[89][0123456])\d{10}\b", 0.5)], ["Thai National ID", "Thai ID Number", "TNIN", "เลขประจำตัวประชาชน", "เลขบัตรประชาชน", "รหัสปชช"], thai, languages=("th",)),
    national("TrNationalIdRecognizer", "TR_NATIONAL_ID", "tr", [(r"\b[1-9][0-9]{10}\b", 0.3)], ["tc kimlik", "kimlik no", "kimlik numarası", "tckn", "tc no", "nüfus cüzdanı", "national id", "turkish id", "türk kimlik"], tckn, languages=("tr",)),
    national("ZaIdNumberRecognizer", "ZA_ID_NUMBER", "za", [(r"\b\d{10}[0-2][89]\d\b", 0.2)], ["id", "identity", "identity number", "id number", "south african id", "rsa id", "smart id", "national id"], za_id),
    national("ZaPassportRecognizer", "ZA_PASSPORT", "za", [(r"\b[ADMT]\d{8}\b", 0.2)], ["passport", "passport number", "travel document", "dha", "south african passport", "rsa passport"], surely),
    *MORE,
]

#: Runs of digits that every match of these recognizers has: fewer texts pass than with the usual gate.
RUNS = {"UsSsnRecognizer": 3, "UsItinRecognizer": 3, "UsPassportRecognizer": 8, "UsBankRecognizer": 8, "NhsRecognizer": 3, "AbaRoutingRecognizer": 4, "AuAcnRecognizer": 3, "AuTfnRecognizer": 3, "InPanRecognizer": 4, "InAadhaarRecognizer": 4, "PlPeselRecognizer": 11, "UkPassportRecognizer": 7, "UsPriorAuthorizationNumberRecognizer": 6, "UsClaimNumberRecognizer": 6, "UsPrescriptionNumberRecognizer": 6, "UsReferralNumberRecognizer": 6, "UsProviderTaxIdRecognizer": 7}
NATIONAL = [replace(r, gate=rf"\p{{Nd}}{{{RUNS[r.name]}}}") if r.name in RUNS else r for r in NATIONAL]


class Registry:
    """Recognizers to choose from; starts with the enabled ones of the catalogue for the languages and countries asked for."""

    def __init__(self, languages: tuple[str, ...] = ("en",), countries: tuple[str, ...] | None = None, all_of_them: bool = False):
        known = {r.country for r in NATIONAL}
        for c in countries or ():
            if c not in known:
                warnings.warn(f"no recognizer for country {c!r}", stacklevel=2)
        national_ = [r for r in NATIONAL if (r.enabled or all_of_them or countries) and (all_of_them or set(r.languages) & set(languages)) and (countries is None or r.country in countries)]
        self.recognizers: list[Recognizer] = [*GENERIC, *national_]

    def add(self, *recognizers: Recognizer) -> Registry:
        self.recognizers += recognizers
        return self

    def remove(self, name: str) -> Registry:
        self.recognizers = [r for r in self.recognizers if r.name != name]
        return self

    def load(self, entries: list[dict]) -> Registry:
        """Recognizers from plain dicts: name, supported_entity, patterns ({name, regex, score}) or deny_list, context."""
        for e in entries:
            languages = e.get("supported_languages") or [e.get("supported_language", "en")]
            if bad := [x for x in languages if not re.fullmatch("[a-z]{2,3}", x)]:
                raise ValueError(f"no language code: {bad[0]!r}")
            common = {"context": tuple(e.get("context", ())), "thresholds": dict(e.get("score_thresholds", {})), "languages": tuple(languages), "country": e.get("country_code")}
            if e.get("deny_list"):
                self.add(deny_list(e["name"], e["supported_entity"], e["deny_list"], e.get("deny_list_score", 1.0), **common))
            else:
                self.add(R(e["name"], e["supported_entity"], tuple((p["regex"], float(p["score"])) for p in e["patterns"]), gate="", **common))
        return self

    def load_file(self, path: str) -> Registry:
        """load() of the entries of a settings file on the driver, under `recognizers` or alone; YAML needs its library."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith(".json"):
            held = json.loads(text)
        else:
            import yaml

            held = yaml.safe_load(text)
        return self.load(held["recognizers"] if isinstance(held, dict) else held)

    def names(self) -> list[str]:
        return sorted({r.name for r in self.recognizers})

    def countries(self) -> list[str]:
        return sorted({r.country for r in self.recognizers if r.country})

    def entities(self) -> list[str]:
        return sorted({r.entity for r in self.recognizers})

    def chosen(self, entities: list[str] | None) -> list[Recognizer]:
        found = [r for r in self.recognizers if entities is None or r.entity in entities]
        if missing := sorted(set(entities or ()) - {r.entity for r in found}):
            warnings.warn(f"no recognizer for {', '.join(missing)}", stacklevel=2)
        if not found:
            raise ValueError("no matching recognizers")
        return found
