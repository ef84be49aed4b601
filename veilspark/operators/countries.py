"""Recognizers of addresses of coins and of identifiers that single countries issue, with their checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checksums as C
from .scan import Recognizer


def national(name: str, entity: str, country: str, patterns, context=(), validate=None, invalidate=None, languages=("en",), enabled=False) -> Recognizer:
    return Recognizer(name, entity, tuple(patterns), tuple(context), validate, invalidate, languages, country, enabled)


def plain(t: Column) -> Column:
    return F.upper(F.regexp_replace(t, "[ -]", ""))


def letter_of(alphabet: str, at: Column) -> Column:
    return F.substring(F.lit(alphabet), at.cast("int") + 1, 1)


def surely(t: Column) -> Column:
    """The pattern says all: whatever it finds is one."""
    return t.isNotNull()


def this_year() -> Column:
    return F.year(F.current_date())


def crypto(t: Column) -> Column:
    return F.when(t.startswith("bc1"), C.bech32(t)).otherwise(C.base58check(t))


def kr_resident(t: Column, base: int) -> Column:
    """True, or null: numbers given since October 2020 have no check digit."""
    s = C.weighted(t, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])
    good = (F.substring(C.only(t), 8, 2).cast("int") <= 95) & ((base - s % 11) % 10 == C.digit(t, 12))
    return F.when(good, True)


def kr_brn(t: Column) -> Column:
    last = C.digit(t, 8) * 5
    s = C.weighted(t, [1, 3, 7, 1, 3, 7, 1, 3]) + last + F.floor(last / 10)
    return (10 - s % 10) % 10 == C.digit(t, 9)


# Kinds of entity and check letters of Singapore's entity numbers.
UEN_KINDS = ["LP", "LL", "FC", "PF", "RF", "MQ", "MM", "NB", "CC", "CS", "MB", "FM", "GS", "DP", "CP", "NR", "CM", "CD", "MD", "HS", "VH", "CH", "MH", "CL", "XL", "CX", "HC", "RP", "TU", "TC", "FB", "FN", "PA", "PB", "SS", "MC", "SM", "GA", "GB"]
UEN_LETTERS = "ABCDEFGHJKLMNPQRSTUVWX0123456789"


def sg_uen(t: Column) -> Column:
    u = F.upper(t)
    last = F.substring(u, -1, 1)
    business = letter_of("XMKECAWLJDB", C.weighted(u, [10, 4, 9, 3, 8, 2, 7, 1]) % 11) == last
    company = (F.substring(u, 1, 4).cast("int") <= this_year()) & (letter_of("ZKCMDNERGWH", C.weighted(u, [10, 8, 6, 4, 9, 7, 5, 3, 1]) % 11) == last)
    places = sum(((F.instr(F.lit(UEN_LETTERS), F.substring(u, i + 1, 1)) - 1) * w for i, w in enumerate([4, 3, 5, 3, 10, 2, 2, 5, 7])), F.lit(0))
    other = F.substring(u, 4, 2).isin(UEN_KINDS) & (letter_of(UEN_LETTERS, F.pmod(places - 5, F.lit(11))) == last)
    return F.when(F.length(u) == 9, business).when(u.rlike("^[A-Z]"), other).otherwise(company)


def se_person(t: Column) -> Column:
    d = F.substring(C.only(t), -10, 10)
    day = F.substring(d, 5, 2).cast("int")
    return F.substring(d, 3, 2).cast("int").between(1, 12) & (day.between(1, 31) | day.between(61, 91)) & C.luhn(d)


def it_fiscal(t: Column) -> Column:
    # What 0-9 and then A-Z count at the 1st, 3rd, 5th ... place.
    odd = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]
    chars = F.filter(F.split(F.substring(F.upper(t), 1, 15), ""), lambda c: c != "")

    def worth(c: Column, i: Column) -> Column:
        rank = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(i % 2 == 0, F.element_at(F.lit(odd), rank + 1)).otherwise(F.when(rank > 9, rank - 10).otherwise(rank))

    return letter_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", C.total(F.transform(chars, worth)) % 26) == F.substring(F.upper(t), -1, 1)


def it_vat(t: Column) -> Column:
    return (C.only(t) != "00000000000") & C.luhn(t)


def ph_tin(t: Column) -> Column:
    """True where it fails."""
    return C.weighted(t, [9, 8, 7, 6, 5, 4, 3, 2]) % 11 != C.digit(t, 8)


def za_id(t: Column) -> Column:
    """Luhn, and a day of birth that is no later than today."""
    year = F.substring(t, 1, 2).cast("int")
    century = F.when(year > F.year(F.current_date()) % 100, "19").otherwise("20")
    born = F.try_to_date(F.concat(century, F.substring(t, 1, 6)), "yyyyMMdd")
    return C.luhn(t) & F.coalesce(born <= F.current_date(), F.lit(False))


def za_company(t: Column) -> Column:
    year = F.when(t.rlike("^[0-9]"), F.substring(t, 1, 4)).otherwise(F.regexp_extract(t, "([0-9]{4})/", 1)).cast("int")
    return year.between(F.lit(1800), this_year())


def za_driver(t: Column) -> Column:
    return F.length(t).between(10, 14) & t.rlike("(?i)[A-Z]")


def za_plate(t: Column) -> Column:
    return (F.length(plain(t)) >= 5) & plain(t).rlike("[A-Z].*(GP|ZN|WP|EC|NC|FS|LP|MP|NW)$")


def lettered(t: Column) -> Column:
    """The digits of a text with one letter, which counts as two: 01 for A to 26 for Z."""
    letter = F.regexp_extract(F.upper(t), "([A-Z])", 1)
    return F.concat(F.split_part(F.upper(t), letter, F.lit(1)), F.lpad((F.ascii(letter) - 64).cast("string"), 2, "0"), F.split_part(F.upper(t), letter, F.lit(2)))


def de_health(t: Column) -> Column:
    return C.cross_sums(lettered(t), [1, 2, 1, 2, 1, 2, 1, 2, 1, 2]) % 10 == C.digit(t, 8)


def de_social(t: Column) -> Column:
    day, month = F.substring(t, 3, 2).cast("int"), F.substring(t, 5, 2).cast("int")
    real = (day.between(1, 31) | day.between(51, 81)) & month.between(1, 12)
    return real & (C.cross_sums(lettered(t), [2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1]) % 10 == F.substring(t, -1, 1).cast("int"))


def de_id_card(t: Column) -> Column:
    return F.when(t.rlike("(?i)^T[0-9]{8}$"), F.lit(None).cast("boolean")).otherwise(C.icao(t))


def de_lanr(t: Column) -> Column:
    return (10 - C.weighted(t, [4, 9, 4, 9, 4, 9]) % 10) % 10 == C.digit(t, 6)


def in_gstin(t: Column) -> Column:
    return plain(t).rlike("^(0[1-9]|[12][0-9]|3[0-7])[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]$")


def uk_driving(t: Column) -> Column:
    """False where no surname can be, else null: the check digit's rule is not public."""
    return F.when(~t.rlike("(?i)^(?=.{5})[A-Z]+9*(?<=^.{5})"), False)


def uk_vehicle(t: Column) -> Column:
    age = F.substring(plain(t), 3, 2)
    current = (F.length(plain(t)) == 7) & plain(t).rlike("^[A-Z]{2}[0-9]{2}")
    return F.when(current, age.cast("int").between(2, 29) | age.cast("int").between(51, 79))


def dea(t: Column) -> Column:
    seven = F.substring(t, 3, 7)
    return C.weighted(seven, [1, 2, 1, 2, 1, 2]) % 10 == C.digit(seven, 6)


# Fixed values from here on: patterns, scores and context words, which results depend on. Words before a number
# may be 20 blanks apart at most, as look-behinds here have bounds.
LABEL = r"(?:\s{0,20}(?:#|no\.?|number|id)\s{0,20}:?\s{0,20}|\s{0,20}:\s{0,20}|\s{1,20})"
EIN = r"(?:0[1-6]|1[0-6]|2[0-7]|3[0-9]|4[0-8]|5[0-9]|6[0-8]|7[1-7]|8[0-8]|9[0-5]|9[89])"
MBI_L, MBI_X = "[ACDEFGHJKMNPQRTUVWXY]", "[0-9ACDEFGHJKMNPQRTUVWXY]"
ZA_PHONE = ["phone", "number", "telephone", "cell", "cellphone", "mobile", "call", "cellular", "handset", "contact number", "landline", "tel", "home number", "work number", "office number", "sms", "whatsapp"]
PROVINCE = "(?:GP|ZN|WP|EC|NC|FS|LP|MP|NW)"

CRYPTO = Recognizer("CryptoRecognizer", "CRYPTO", ((r"(bc1|[13])[a-zA-HJ-NP-Z0-9]{25,59}", 0.5),), ("wallet", "btc", "bitcoin", "crypto"), crypto, gate="[a-zA-Z0-9\u0130\u0131\u017f\u212a]{26}")

#: Lookbehinds of many words are tried only where the number follows, which lookaheads before them tell at once.
MORE = [
    national("UsLicenseRecognizer", "US_DRIVER_LICENSE", "us", [(r"\b([A-Z][0-9]{3,6}|[A-Z][0-9]{5,9}|[A-Z][0-9]{6,8}|[A-Z][0-9]{4,8}|[A-Z][0-9]{9,11}|[A-Z]{1,2}[0-9]{5,6}|H[0-9]{8}|V[0-9]{6}|X[0-9]{8}|A-Z]{2}[0-9]{2,5}|[A-Z]{2}[0-9]{3,7}|[0-9]{2}[A-Z]{3}[0-9]{5,6}|[A-Z][0-9]{13,14}|[A-Z][0-9]{18}|[A-Z][0-9]{6}R|[A-Z][0-9]{9}|[A-Z][0-9]{1,12}|[0-9]{9}[A-Z]|[A-Z]{2}[0-9]{6}[A-Z]|[0-9]{8}[A-Z]{2}|[0-9]{3}[A-Z]{2}[0-9]{4}|[A-Z][0-9][A-Z][0-9][A-Z]|[0-9]{7,8}[A-Z])\b", 0.3), (r"\b([0-9]{6,14}|[0-9]{16})\b", 0.01)], ["driver", "license", "permit", "lic", "identification", "dls", "cdls", "lic#", "driving"], enabled=True),
    national("MedicalLicenseRecognizer", "MEDICAL_LICENSE", "us", [(r"[abcdefghjklmprstuxABCDEFGHJKLMPRSTUX]{1}[a-zA-Z]{1}\d{7}|[abcdefghjklmprstuxABCDEFGHJKLMPRSTUX]{1}9\d{7}", 0.4)], ["medical", "certificate", "DEA"], dea, enabled=True),
    national("UsMbiRecognizer", "US_MBI", "us", [(rf"\b[0-9]{MBI_L}{MBI_X}[0-9]{MBI_L}{MBI_X}[0-9]{MBI_L}{MBI_L}[0-9][0-9]\b", 0.3), (rf"\b[0-9]{MBI_L}{MBI_X}[0-9]-{MBI_L}{MBI_X}[0-9]-{MBI_L}{MBI_L}[0-9][0-9]\b", 0.5)], ["medicare", "mbi", "beneficiary", "cms", "medicaid", "hic", "hicn"]),
    national("UsHealthInsuranceMemberIdRecognizer", "US_HEALTH_INSURANCE_MEMBER_ID", "us", [(r"\b(?=[A-Z0-9-]{6,20}\b)(?=[A-Z0-9-]*[A-Z])(?=[A-Z0-9-]*\d)[A-Z]{1,5}-?[A-Z0-9]{5,14}\b", 0.1)], ["member", "subscriber", "insurance", "policy"]),
    national("UsPriorAuthorizationNumberRecognizer", "US_PRIOR_AUTHORIZATION_NUMBER", "us", [(rf"(?=(?:PA-?)?\d{{6}})(?<=\b(?:prior\s{{1,20}}authorization|prior\s{{1,20}}auth|preauthorization|pre-auth|authorization){LABEL})(?:PA-?)?\d{{6,12}}\b", 0.35), (r"\bPA-?\d{6,12}\b", 0.1)], ["authorization", "auth", "preauthorization", "approval"]),
    national("UsClaimNumberRecognizer", "US_CLAIM_NUMBER", "us", [(rf"(?=(?:CLM-?)?\d{{6}})(?<=\b(?:claim|medical\s{{1,20}}claim|healthcare\s{{1,20}}claim){LABEL})(?:CLM-?)?\d{{6,15}}\b", 0.35), (r"\bCLM-?\d{6,15}\b", 0.1)], ["claim", "billing"]),
    national("UsPrescriptionNumberRecognizer", "US_PRESCRIPTION_NUMBER", "us", [(rf"(?=(?:RX-?)?\d{{6}})(?<=\brx{LABEL})(?:RX-?)?\d{{6,12}}\b", 0.6), (rf"(?=(?:RX-?)?\d{{6}})(?<=\bprescription{LABEL})(?:RX-?)?\d{{6,12}}\b", 0.35), (r"\bRX-?\d{6,12}\b", 0.1)], ["prescription", "pharmacy", "medication"]),
    national("UsReferralNumberRecognizer", "US_REFERRAL_NUMBER", "us", [(rf"(?=(?:(?:REF|INF)-?)?\d{{6}})(?<=\b(?:referral|infusion\s{{1,20}}referral){LABEL})(?:(?:REF|INF)-?)?\d{{6,12}}\b", 0.35), (r"\b(?:REF|INF)-?\d{6,12}\b", 0.1)], ["referral", "infusion", "specialty", "referring"]),
    national("UsProviderTaxIdRecognizer", "US_PROVIDER_TAX_ID", "us", [(rf"(?={EIN}-\d{{7}})(?<=\b(?:(?:(?:billing|rendering|healthcare)\s{{1,20}}provider|provider\s{{1,20}}organization|provider)\s{{1,20}}(?:tax\s{{0,20}}(?:id|number|identification\s{{1,20}}number)|tin|ein)|billing\s{{1,20}}provider){LABEL}){EIN}-\d{{7}}\b", 0.35), (rf"\b{EIN}-\d{{7}}\b", 0.1)], ["tax", "tin", "ein", "billing"]),
    national("UkDrivingLicenceRecognizer", "UK_DRIVING_LICENCE", "uk", [(r"\b[A-Z9]{5}[0-9](?:0[1-9]|1[0-2]|5[1-9]|6[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9][A-Z9]{2}[A-Z0-9][A-Z]{2}\b", 0.5)], ["driving licence", "driving license", "driver's licence", "driver's license", "dvla", "dl number", "licence number", "license number"], uk_driving),
    national("UkPostcodeRecognizer", "UK_POSTCODE", "uk", [(r"\b(GIR\s?0AA|[A-PR-UWYZ][0-9][ABCDEFGHJKPSTUW]?\s?[0-9][ABD-HJLNP-UW-Z]{2}|[A-PR-UWYZ][0-9]{2}\s?[0-9][ABD-HJLNP-UW-Z]{2}|[A-PR-UWYZ][A-HK-Y][0-9][ABEHMNPRVWXY]?\s?[0-9][ABD-HJLNP-UW-Z]{2}|[A-PR-UWYZ][A-HK-Y][0-9]{2}\s?[0-9][ABD-HJLNP-UW-Z]{2})\b", 0.1)], ["postcode", "post code", "postal code", "zip", "address", "delivery", "mailing", "shipping", "correspondence"]),
    national("UkVehicleRegistrationRecognizer", "UK_VEHICLE_REGISTRATION", "uk", [(r"\b[A-HJ-PR-Y][A-HJ-PR-Y](?:0[1-9]|[1-7][0-9])[- ]?[A-HJ-PR-Z]{3}\b", 0.3), (r"\b[A-HJ-NPR-TV-Y]\d{1,3}[- ]?[A-HJ-PR-Y][A-HJ-PR-Z]{2}\b", 0.2), (r"\b[A-HJ-PR-Z]{3}[- ]?\d{1,3}[- ]?[A-HJ-NPR-TV-Y]\b", 0.15)], ["vehicle", "registration", "number plate", "licence plate", "license plate", "reg", "vrn", "dvla", "v5c", "logbook", "mot", "car", "insured vehicle"], uk_vehicle),
    national("DeBsnrRecognizer", "DE_BSNR", "de", [(r"\b\d{9}\b", 0.2)], ["betriebsstättennummer", "betriebsstätten-nummer", "bsnr", "betriebsstätte", "praxisnummer", "arztpraxis", "praxis", "kassenärztliche vereinigung", "kv-nummer", "kv nummer", "praxisadresse", "praxisstandort", "nebenbetriebsstätte", "hauptbetriebsstätte", "behandlungsort", "vertragsarztpraxis"], None, lambda t: t == "000000000", languages=("de",)),
    national("DeFuehrerscheinRecognizer", "DE_FUEHRERSCHEIN", "de", [(r"\b[A-Z]{2}\d{8}[A-Z0-9]\b", 0.35)], ["führerscheinnummer", "führerschein", "fahrerlaubnis", "fahrerlaubnisnummer", "fahrerlaubnisklasse", "führerscheininhaber", "fev", "kba", "kraftfahrt-bundesamt", "driving licence", "driving license", "driver's license", "licence number", "license number", "dokument nr", "dokument-nr", "feld 5"], languages=("de",)),
    national("DeHealthInsuranceRecognizer", "DE_HEALTH_INSURANCE", "de", [(r"\b[A-Z]\d{9}\b", 0.3)], ["krankenversicherungsnummer", "krankenversichertennummer", "versichertennummer", "kvnr", "krankenkasse", "krankenversicherung", "gesundheitskarte", "egk", "elektronische gesundheitskarte", "gkv", "gesetzliche krankenversicherung", "krankenversicherungsausweis", "versichertenausweis", "versichertenkarte", "aok", "tkk", "barmer", "dak"], de_health, languages=("de",)),
    national("DeIdCardRecognizer", "DE_ID_CARD", "de", [(r"\b[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{7}[0-9]\b", 0.4), (r"\bT\d{8}\b", 0.5)], ["personalausweis", "ausweis", "personalausweisnummer", "ausweisnummer", "ausweisdokument", "dokumentennummer", "seriennummer", "npa", "neuer personalausweis", "personalausweisgesetz", "pauwsg", "bundespersonalausweis", "identity card", "national id"], de_id_card, languages=("de",)),
    national("DeKfzRecognizer", "DE_KFZ", "de", [(r"(?<![\w-])[A-ZÄÖÜ]{1,3}\s[A-Z]{1,2}\s\d{1,4}[EH]?(?!\w)", 0.3), (r"(?<![\w-])[A-ZÄÖÜ]{1,3}-[A-Z]{1,2}-\d{1,4}[EH]?(?!\w)", 0.3), (r"(?<![\w-])[A-ZÄÖÜ]{1,3}-[A-Z]{1,2}\s\d{1,4}[EH]?(?!\w)", 0.3), (r"(?<![\w-])[A-Z]{1,3}\s[A-Z]{1,2}\s\d{1,4}[EH]?(?!\w)", 0.2), (r"(?<![\w-])[A-Z]{1,3}-[A-Z]{1,2}\s\d{1,4}[EH]?(?!\w)", 0.2)], ["kennzeichen", "kfz-kennzeichen", "kraftfahrzeugkennzeichen", "nummernschild", "fahrzeugkennzeichen", "zulassung", "kfz", "fahrzeug", "auto", "pkw", "lkw", "fahrzeugschein", "fahrzeugbrief", "zulassungsbescheinigung", "amtliches kennzeichen"], languages=("de",)),
    national("DeLanrRecognizer", "DE_LANR", "de", [(r"\b\d{9}\b", 0.3)], ["arztnummer", "lanr", "lebenslange arztnummer", "arzt-nr", "arzt nr", "arzt-nummer", "vertragsarzt", "kassenarzt", "niedergelassener arzt", "kbv", "kassenärztliche vereinigung", "kv-nummer", "rezept", "verschreibung", "behandelnder arzt", "hausarzt", "facharzt"], de_lanr, languages=("de",)),
    national("DePlzRecognizer", "DE_PLZ", "de", [(r"\b(?!01000\b|99999\b)(0[1-9]\d{3}|[1-9]\d{4})\b", 0.05)], ["plz", "postleitzahl", "postanschrift", "adresse", "wohnort", "ort", "wohnanschrift", "lieferadresse", "rechnungsadresse", "straße", "strasse", "hausnummer", "postfach", "bundesland", "gemeinde", "stadt", "dorf"], languages=("de",)),
    national("DeSocialSecurityRecognizer", "DE_SOCIAL_SECURITY", "de", [(r"\b\d{2}(0[1-9]|[12]\d|3[01]|5[1-9]|[67]\d|8[01])(0[1-9]|1[0-2])\d{2}[A-Z]\d{2}[0-9]\b", 0.5), (r"\b\d{8}[A-Z]\d{3}\b", 0.3)], ["rentenversicherungsnummer", "sozialversicherungsnummer", "versicherungsnummer", "rvnr", "svnr", "sv-nummer", "rente", "rentenversicherung", "deutsche rentenversicherung", "drv", "sozialversicherung", "sozialversicherungsausweis", "rentenausweis"], de_social, languages=("de",)),
    national("DeTaxNumberRecognizer", "DE_TAX_NUMBER", "de", [(r"\b(0[1-9]|1[0-6])\d{11}\b", 0.5), (r"(?<!\w)\d{3}/\d{3}/\d{5}(?!\w)", 0.4), (r"(?<!\w)\d{2,3}/\d{3,4}/\d{4,5}(?!\w)", 0.2)], ["steuernummer", "steuer-nr", "steuer nr", "st.-nr", "st-nr", "finanzamt", "umsatzsteuer", "einkommensteuer", "körperschaftsteuer", "gewerbesteuer", "steuerveranlagung", "steuerbescheid"], languages=("de",)),
    national("InGstinRecognizer", "IN_GSTIN", "in", [(r"\b((?:0[1-9]|[1-3][0-7])[A-Za-z0-9]{10}[A-Za-z0-9]{1}Z[A-Za-z0-9]{1})\b", 0.8), (r"\b((?:0[1-9]|[1-3][0-7])[A-Za-z0-9]{11}Z[A-Za-z0-9]{1})\b", 0.4), (r"\b([0-9]{2}[A-Za-z0-9]{11}Z[A-Za-z0-9]{1})\b", 0.1)], ["gstin", "gst", "goods and services tax", "tax identification", "gst number", "gst registration"], in_gstin),
    # The tables of Indian districts are left out, so these keep their patterns' scores.
    national("InVehicleRegistrationRecognizer", "IN_VEHICLE_REGISTRATION", "in", [(r"\b[A-Z]{1}(?!0000)[0-9]{4}\b", 0.01), (r"\b[A-Z]{2}(?!0000)\d{4}\b", 0.01), (r"\b(I)(?!00000)\d{5}\b", 0.01), (r"\b[A-Z]{3}(?!0000)\d{4}\b", 0.2), (r"\b\d{1,3}(CD|CC|UN)[1-9]{1}[0-9]{1,3}\b", 0.4), (r"\b[A-Z]{2}\d{1}[A-Z]{1,3}(?!0000)\d{4}\b", 0.5), (r"\b[A-Z]{2}\d{2}[A-Z]{1,2}(?!0000)\d{4}\b", 0.5), (r"\b[2-9]{1}[1-9]{1}(BH)(?!0000)\d{4}[A-HJ-NP-Z]{2}\b", 0.85), (r"\b(?!00)\d{2}(A|B|C|D|E|F|H|K|P|R|X)\d{6}[A-Z]{1}\b", 0.85)], ["RTO", "vehicle", "plate", "registration"]),
    national("ItDriverLicenseRecognizer", "IT_DRIVER_LICENSE", "it", [(r"\b(?i)(([A-Z]{2}\d{7}[A-Z])|(U1[BCDEFGHLJKMNPRSTUWYXZ0-9]{7}[A-Z]))\b", 0.2)], ["patente", "patente di guida", "licenza", "licenza di guida"], languages=("it",), enabled=True),
    national("ItFiscalCodeRecognizer", "IT_FISCAL_CODE", "it", [(r"(?i)((?:[A-Z][AEIOU][AEIOUX]|[AEIOU]X{2}|[B-DF-HJ-NP-TV-Z]{2}[A-Z]){2}(?:[\dLMNP-V]{2}(?:[A-EHLMPR-T](?:[04LQ][1-9MNP-V]|[15MR][\dLMNP-V]|[26NS][0-8LMNP-U])|[DHPS][37PT][0L]|[ACELMRT][37PT][01LM]|[AC-EHLMPR-T][26NS][9V])|(?:[02468LNQSU][048LQU]|[13579MPRTV][26NS])B[26NS][9V])(?:[A-MZ][1-9MNP-V][\dLMNP-V]{2}|[A-M][0L](?:[1-9MNP-V][\dLMNP-V]|[0L][1-9MNP-V]))[A-Z])", 0.3)], ["codice fiscale", "cf"], it_fiscal, languages=("it",), enabled=True),
    national("ItIdentityCardRecognizer", "IT_IDENTITY_CARD", "it", [(r"(?i)\b[A-Z]{2}\s?\d{7}\b", 0.01), (r"(?i)\b\d{7}[A-Z]{2}\b", 0.01), (r"(?i)\b[A-Z]{2}\d{5}[A-Z]{2}\b", 0.01)], ["carta", "identità", "elettronica", "cie", "documento", "riconoscimento", "espatrio"], languages=("it",), enabled=True),
    national("ItVatCodeRecognizer", "IT_VAT_CODE", "it", [(r"\b([0-9][ _]?){11}\b", 0.1)], ["piva", "partita iva", "pi"], it_vat, languages=("it",), enabled=True),
    national("KrBrnRecognizer", "KR_BRN", "kr", [(r"(?<!\d)\d{3}-\d{2}-\d{5}(?!\d)", 0.1), (r"(?<!\d)\d{10}(?!\d)", 0.05)], ["사업자등록번호", "사업자번호", "사업자", "BRN", "Business Registration Number", "Korean BRN", "business number", "tax registration number"], kr_brn, languages=("ko", "kr")),
    national("KrDriverLicenseRecognizer", "KR_DRIVER_LICENSE", "kr", [(r"(?<!\d)(\d{2})[- ]?(\d{2})[- ]?(\d{6})[- ]?(\d{2})(?!\d)", 0.05)], ["운전면허", "운전면허번호", "면허번호", "Korean driver license", "Korean driver's license"], lambda t: F.substring(C.only(t), 1, 2).rlike("1[1-9]|2[0-68]"), languages=("ko", "kr")),
    national("KrFrnRecognizer", "KR_FRN", "kr", [(r"(?<!\d)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(-?)[5-8]\d{6}(?!\d)", 0.5)], ["외국인등록번호", "Korean FRN", "FRN", "Foreigner Registration Number", "Korean Foreigner Registration Number", "외국인번호"], lambda t: kr_resident(t, 13), languages=("ko", "kr")),
    national("KrPassportRecognizer", "KR_PASSPORT", "kr", [(r"(?<![A-Z0-9a-z])[MmSsRrOoDd]\d{3}[A-Za-z]\d{4}(?![0-9])", 0.1), (r"(?<![A-Z0-9a-z])[MmSsRrOoDd]\d{8}(?![0-9])", 0.05)], ["Korean passport", "Korean passport number", "대한민국 여권", "여권", "passport", "passport number"], languages=("ko", "kr")),
    national("PhPassportRecognizer", "PH_PASSPORT", "ph", [(r"\b(?:[A-Z]\d{7}[A-Z]|[A-Z]{2}\d{7})\b", 0.1)], ["passport", "passport number", "passport no", "passport no.", "passport#", "passport id", "travel document", "philippine passport", "philippines passport", "pasaporte", "pasaporte number", "dfa"]),
    national("PhTinRecognizer", "PH_TIN", "ph", [(r"\b(\d{3}-\d{3}-\d{3}(-\d{3})?)\b", 0.05), (r"\b(\d{9}|\d{12})\b", 0.01)], ["tin", "taxpayer identification number", "bir", "taxpayer id", "tax id", "rdo", "revenue district office"], None, ph_tin),
    national("SgUenRecognizer", "SG_UEN", "sg", [(r"\b\d{8}[A-Z]\b|\b\d{9}[A-Z]\b|\b[TSR]\d{2}[A-Z]{2}\d{4}[A-Z]\b", 0.3)], ["uen", "unique entity number", "business registration", "ACRA"], sg_uen),
    national("EsPassportRecognizer", "ES_PASSPORT", "es", [(r"\b[A-Z]{3}[0-9]{6}\b", 0.05)], ["pasaporte", "passport", "número de pasaporte", "passport number"], languages=("es",)),
    national("SePersonnummerRecognizer", "SE_PERSONNUMMER", "se", [(r"\b(\d{6,8})([-+]?)\d{4}\b", 0.5), (r"(\d{6,8})([-+]?)\d{4}", 0.1)], ["personnummer", "svenskt personnummer", "svensk id", "ssn", "personal identity number", "samordningsnummer"], se_person, languages=("sv",)),
    national("TrLicensePlateRecognizer", "TR_LICENSE_PLATE", "tr", [(r"\b(0[1-9]|[1-7][0-9]|8[0-1])\s?[A-PR-VY-Z]{1,3}\s?\d{2,4}\b", 0.3), (r"\b(0[1-9]|[1-7][0-9]|8[0-1])-[A-PR-VY-Z]{1,3}-\d{2,4}\b", 0.3)], ["plaka", "araç plakası", "plaka numarası", "kayıt plakası", "tr plaka", "license plate", "number plate", "plate", "taşıt plakası", "kayıt"], surely, languages=("tr",)),
    national("ZaCompanyRegistrationRecognizer", "ZA_COMPANY_REGISTRATION", "za", [(r"\b(?:19|20)\d{2}/\d{6}/\d{2}\b", 0.4), (r"\b(?:CK|K|T|W|B|M|N|NR)\d{4}/\d{6}\b", 0.3)], ["cipc", "company registration", "registration number", "close corporation", "company reg", "enterprise number"], za_company),
    national("ZaDriverLicenseRecognizer", "ZA_DRIVER_LICENSE", "za", [(r"\b\d{6,10}[A-Z0-9]{2,5}\b", 0.3)], ["licence", "license", "driving licence", "driving license", "driver's licence", "driver's license", "drivers licence", "drivers license", "enatis", "natis", "licence number", "license number"], za_driver),
    national("ZaIncomeTaxNumberRecognizer", "ZA_INCOME_TAX_NUMBER", "za", [(r"\b[01239]\d{9}\b", 0.05)], ["sars", "tax reference", "income tax", "tax number", "itr", "taxpayer", "tax registration"], surely),
    national("ZaLicensePlateRecognizer", "ZA_LICENSE_PLATE", "za", [(rf"\b[A-Z]{{2,4}}\d{{2,4}}[A-Z]{{0,4}}{PROVINCE}\b", 0.3), (rf"\b[A-Z]{{2}}\s?\d{{2}}\s?[A-Z]{{2}}\s?{PROVINCE}\b", 0.3), (rf"\b[A-Z]{{2,3}}\s?\d{{2,3}}\s?{PROVINCE}\b", 0.3), (r"\b\d{2,3}\s?[A-Z]{2,3}\s?EC\b", 0.3)], ["licence plate", "license plate", "number plate", "registration", "vehicle registration", "natis", "enatis", "plate number"], za_plate),
    national("ZaTrafficRegisterNumberRecognizer", "ZA_TRAFFIC_REGISTER_NUMBER", "za", [(r"\b\d{13}\b", 0.05)], ["traffic register", "traffic register number", "trn", "enatis", "natis", "vehicle register"], lambda t: ~(za_id(t) & t.rlike("[0-2][89][0-9]$"))),
    # A phone library's tables are not at hand; these patterns stand in for its South African ranges.
    national("ZaMobileNumberRecognizer", "ZA_MOBILE_NUMBER", "za", [(r"(?<![\w+])(?:\+27[ -]?|0)(?:[67]\d|8[1-5])[ -]?\d{3}[ -]?\d{4}(?!\w)", 0.4)], ZA_PHONE),
    national("ZaTelephoneNumberRecognizer", "ZA_TELEPHONE_NUMBER", "za", [(r"(?<![\w+])(?:\+27[ -]?|0)(?:[1-5]\d|8[067])[ -]?\d{3}[ -]?\d{4}(?!\w)", 0.4)], ZA_PHONE),
    national("ZaVatNumberRecognizer", "ZA_VAT_NUMBER", "za", [(r"\b4\d{9}\b", 0.3)], ["vat", "vat number", "vat registration", "tax invoice", "sars", "value added tax"], surely),
]
