"""Normalisers as column expressions: names, phones, e-mail addresses, websites, postal addresses, ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LEGAL_SUFFIXES = ("L L C", "LLC", "INCORPORATED", "INC", "CORPORATION", "CORP", "LIMITED", "LTD", "L P", "LP", "COMPANY", "CO")
PERSON_SUFFIXES = ("JR", "SR", "II", "III", "IV", "V")
PERSON_CREDENTIALS = ("MD", "DO", "DDS", "DMD", "PA", "NP", "RN", "ESQ", "CPA", "JD")
DIRECTIONS = {"NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW"}
STREETS = {
    "STREET": "ST", "ROAD": "RD", "AVENUE": "AVE", "BOULEVARD": "BLVD", "DRIVE": "DR", "LANE": "LN", "COURT": "CT", "PLACE": "PL",
    "TERRACE": "TER", "CIRCLE": "CIR", "HIGHWAY": "HWY", "PARKWAY": "PKWY",
}
UNIT_WORDS = {"APARTMENT": "APT", "SUITE": "STE"}
UNIT = r"(?:\b(?:APT|APARTMENT|UNIT|STE|SUITE)\b|#)\s*([A-Z0-9\-]+)"
#: What owners' names hold when they are businesses.
OWNER_FORMS = ("LLC", "INC", "CORP", "LTD", "LP", "CO")
TRUE_WORDS = ("true", "1", "yes", "y", "t")
MAILBOX_WORDS = ("PO BOX", "P O BOX", "PMB", "MAIL DROP", "UPS STORE", "BOX ")
CONTEXT_MAILBOX = ("PO BOX", "P O BOX", "PMB", "UPS STORE", "MAIL DROP")
CONTEXT_GOVERNMENT = ("COURTHOUSE", "CITY HALL", "COUNTY", "STATE OF", "DEPARTMENT OF")
CONTEXT_COMMERCIAL = ("PLAZA", "CENTER", "BLVD", "FLOOR", "TOWER")
CONTEXT_UNIT = r"(?i)\b(?:APT|APARTMENT|UNIT|STE|SUITE|#)\s*[A-Z0-9-]+\b"
SOURCE_KINDS = {
    "generated_dataset": "synthetic", "local_generator": "synthetic", "synthetic": "synthetic", "manual_import": "manual", "manual": "manual", "manual_csv": "manual",
    "connector": "connector", "local_registry_extract": "connector", "local_property_export": "connector", "local_clerk_export": "connector",
    "official_api_demo": "api", "official_api": "api", "official_authenticated_api": "api", "official_federal_registry": "api", "api": "api",
    "official_arcgis_demo": "arcgis", "official_arcgis_candidate": "arcgis", "official_arcgis_public_parcels": "arcgis", "arcgis_api": "arcgis", "arcgis": "arcgis", "unknown": "unknown",
}


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def clean_text(c: Column) -> Column:
    """Upper case; what is no word character, blank, #, /, @ or - becomes a blank; runs of blanks are one."""
    kept = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s#/@\-]", " ")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def phone_digits(c: Column) -> Column:
    """Ten digits, without a leading 1, followed by X and the extension if there is one; null for anything else."""
    text = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    extension = F.regexp_extract(text, r"(?:EXT|X|EXTENSION)\s*([0-9]+)$", 1)
    digits = F.regexp_replace(F.regexp_replace(text, r"(?:EXT|X|EXTENSION)\s*[0-9]+$", ""), r"\D", "")
    national = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(F.length(national) == 10, F.concat(national, F.when(extension != "", F.concat(F.lit("X"), extension)).otherwise(F.lit(""))))


def email_address(c: Column) -> Column:
    """Lower case without blanks; null unless it has the form of an address."""
    text = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""))
    return F.when(text.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"), text)


def email_domain(c: Column) -> Column:
    return F.substring_index(c, "@", -1)


def website_key(c: Column) -> Column:
    """Host (with a port, without www.) and path without final slashes, all in lower case; query and fragment go."""
    text = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    rest = F.regexp_replace(F.regexp_replace(text, r"^[a-z][a-z0-9+.-]*://", ""), r"[?#].*$", "")
    host = F.regexp_replace(F.substring_index(rest, "/", 1), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/]*", ""), r"/+$", "")
    return F.nullif(F.concat(host, path), F.lit(""))


def website_host(c: Column) -> Column:
    return F.substring_index(website_key(c), "/", 1)


def business_name(c: Column) -> Column:
    """Cleaned name without legal forms at its end."""
    text = F.trim(F.regexp_replace(F.regexp_replace(clean_text(c), "#", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), text), f"( ({'|'.join(LEGAL_SUFFIXES)}))+$", ""))


def person_name(c: Column) -> Column:
    """struct(first, middle, last, full, suffix, confidence): one suffix goes from the end, credentials from anywhere.

    ``full`` is the first and the last name, the same one twice where there is one alone.
    """
    words = F.filter(F.split(clean_text(c), " "), lambda x: x != "")
    last = F.try_element_at(words, F.lit(-1))
    suffix = F.when(last.isin(*PERSON_SUFFIXES), last)
    kept = F.when(suffix.isNotNull(), F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)
    kept = F.filter(kept, lambda x: ~x.isin(*PERSON_CREDENTIALS))
    first, end = F.try_element_at(kept, F.lit(1)), F.try_element_at(kept, F.lit(-1))
    middle = F.when(F.size(kept) > 2, F.try_element_at(kept, F.lit(2)))
    confidence = F.when(F.size(words) == 0, "none").when(middle.isNotNull(), "strong").when(first.isNotNull(), "medium").otherwise("weak")
    return F.struct(first.alias("first"), middle.alias("middle"), end.alias("last"), F.concat_ws(" ", first, end).alias("full"), suffix.alias("suffix"), confidence.alias("confidence"))


def _shorter(words: Column, *maps: dict) -> Column:
    """Words with their abbreviations, by one map after another."""

    def short(m: dict) -> Callable[[Column], Column]:
        known = F.create_map(*[F.lit(x) for pair in m.items() for x in pair])
        return lambda word: F.coalesce(F.try_element_at(known, word), word)

    return reduce(lambda out, m: F.transform(out, short(m)), maps, words)


def address_key(c: Column) -> Column:
    """struct(text, building, unit, house_number, zip): words abbreviated, the first unit set apart and put last.

    The zip is the first five digits of the last word that has five.
    """
    text = clean_text(F.regexp_replace(F.coalesce(c, F.lit("")), r"[.,]", " "))
    unit = F.nullif(F.regexp_extract(text, UNIT, 1), F.lit(""))
    at = F.regexp_instr(text, F.lit(UNIT))
    length = F.length(F.regexp_extract(text, UNIT, 0))
    bare = F.when(unit.isNotNull(), F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + length, F.length(text)))).otherwise(text)
    words = F.filter(F.split(bare, " "), lambda x: x != "")
    building = F.array_join(_shorter(words, DIRECTIONS, STREETS), " ")
    digits = F.filter(F.transform(words, lambda x: F.regexp_replace(x, r"\D", "")), lambda x: F.length(x) >= 5)
    zip5 = F.substring(F.try_element_at(digits, F.lit(-1)), 1, 5)
    first = F.try_element_at(words, F.lit(1))
    number = F.when(first.rlike(r"^\d+$"), first)
    whole = F.when(unit.isNotNull(), F.concat(building, F.lit(" UNIT "), unit)).otherwise(building)
    return F.struct(whole.alias("text"), building.alias("building"), unit.alias("unit"), number.alias("house_number"), zip5.alias("zip"))


def address_line(c: Column) -> Column:
    """A postal line that keeps its commas: routes, boxes, units and words abbreviated, zips of five digits."""
    text = F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), r"\.", " ")
    text = F.regexp_replace(text, r"\s*,\s*", ", ")
    for pattern, said in ((r"\bP\s*O\s+BOX\b", "PO BOX"), (r"\bRURAL ROUTE\b", "RR"), (r"\bCOUNTY ROAD\b", "CR"), (r"\bSTATE ROAD\b", "SR"), (r"\b([A-Z]+)\s+HIGHWAY\b", "$1 HWY"), (r"\b#\s*([A-Z0-9\-]+)\b", " UNIT $1"), (r"[^A-Z0-9,\-#/ ]", " ")):
        text = F.regexp_replace(text, pattern, said)
    # Words are what blanks and commas part; commas stay, each with a blank after it.
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(text, ",", " , "), r"\s+", " ")), " ")
    text = F.regexp_replace(F.array_join(_shorter(words, DIRECTIONS, STREETS, UNIT_WORDS), " "), r"\s*,\s*", ", ")
    text = F.regexp_replace(text, r"\b(\d{5})-\d{4}\b", "$1")
    return F.regexp_replace(text, r"^[ ,]+|[ ,]+$", "")


def property_key(c: Column) -> Column:
    """Letters and digits of what follows the first colon, or of all."""
    after = F.regexp_replace(F.coalesce(c, F.lit("")), r"^[^:]*:", "")
    return F.nullif(F.regexp_replace(F.upper(after), r"[^A-Z0-9]", ""), F.lit(""))


def is_mailbox(c: Column) -> Column:
    text = F.upper(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a | b, [text.contains(w) for w in MAILBOX_WORDS])


def building_and_unit(c: Column) -> Column:
    """struct(building, unit): the last unit of an address text, and the text without any."""
    text = F.trim(F.coalesce(c, F.lit("")))
    unit = F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(CONTEXT_UNIT), F.lit(0)), F.lit(-1)), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, CONTEXT_UNIT, ""), " ,", ","), "  ", " ")
    return F.struct(F.when(unit == "", text).otherwise(F.regexp_replace(bare, r"^[ ,]+|[ ,]+$", "")).alias("building"), F.trim(unit).alias("unit"))


def address_context(c: Column, property_hint: Column | None = None, among_properties: Column | None = None) -> Column:
    """struct(context, building, unit, confidence) of an address text, by the first rule that holds.

    ``property_hint`` says how the property is used, ``among_properties`` whether addresses and properties connect to it.
    """
    text = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    hint = F.upper(F.coalesce(property_hint, F.lit(""))) if property_hint is not None else F.lit("")
    among = F.coalesce(among_properties, F.lit(False)) if among_properties is not None else F.lit(False)
    has = lambda where, *words: reduce(lambda a, b: a | b, [where.contains(w) for w in words])
    parts = building_and_unit(text)
    unit, building = parts["unit"], F.coalesce(F.nullif(parts["building"], F.lit("")), text)
    row = lambda context, confidence, keeps=True: F.struct(F.lit(context).alias("context"), building.alias("building"), (unit if keeps else F.lit("")).alias("unit"), F.lit(confidence).alias("confidence"))
    return (
        F.when(text == "", row("UNKNOWN", 0.0))
        .when(has(text, *CONTEXT_MAILBOX), row("VIRTUAL_OFFICE_OR_MAILBOX", 0.95))
        .when(has(text, *CONTEXT_GOVERNMENT), row("GOVERNMENT_FACILITY", 0.8))
        .when(hint.contains("REGISTERED AGENT"), row("REGISTERED_AGENT_SERVICE_ADDRESS", 0.85))
        .when((unit != "") & has(hint, "SINGLE FAMILY", "RESIDENTIAL"), row("EXACT_APARTMENT_OR_UNIT", 0.9))
        .when(unit != "", row("EXACT_APARTMENT_OR_UNIT", 0.75))
        .when((has(hint, "MULTIFAMILY", "APARTMENT") | among) & has(text, "APARTMENT", "APTS"), row("APARTMENT_BUILDING", 0.8, False))
        .when(has(hint, "COMMERCIAL", "OFFICE", "RETAIL") | has(text, *CONTEXT_COMMERCIAL), row("COMMERCIAL_PROPERTY", 0.7, False))
        .when(has(hint, "SINGLE FAMILY", "RESIDENTIAL"), row("SINGLE_FAMILY_RESIDENTIAL", 0.8, False))
        .otherwise(row("UNKNOWN", 0.35))
    )


def normalized(kind: Column, display: Column, entity_id: Column) -> Column:
    """struct(value, basis, building, unit, zip, house_number, name_prefix, surname_prefix, domain, phone_prefix, parcel) by the kind of entity.

    Owners are businesses where their name holds a legal form, else persons. Blank values are null.
    """
    address, person = address_key(display), person_name(display)
    business, phone, email, website = business_name(display), phone_digits(display), email_address(display), website_key(display)
    parcel = F.when(entity_id.contains(":"), property_key(entity_id)).otherwise(F.nullif(F.regexp_replace(F.upper(F.coalesce(display, F.lit(""))), "[^A-Z0-9]", ""), F.lit("")))
    firm = (kind == "business") | ((kind == "owner") & F.arrays_overlap(F.split(clean_text(display), " "), F.array(*[F.lit(x) for x in OWNER_FORMS])))
    human = kind.isin("owner", "person", "registered_agent", "officer") & ~firm
    full = F.nullif(person["full"], F.lit(""))
    value = F.nullif(
        F.when(kind == "phone", phone).when(kind == "email", email).when(kind == "website", website).when(kind == "address", address["text"]).when(kind == "property", F.coalesce(parcel, clean_text(display))).when(firm, business).when(human, full).otherwise(clean_text(display)),
        F.lit(""),
    )
    only = lambda when, c: F.when(when, c)
    return F.struct(
        value.alias("value"),
        F.coalesce(only(kind == "property", parcel), value, F.upper(F.coalesce(display, F.lit("")))).alias("basis"),
        only(kind == "address", F.nullif(address["building"], F.lit(""))).alias("building"),
        only(kind == "address", address["unit"]).alias("unit"),
        only(kind == "address", address["zip"]).alias("zip"),
        only(kind == "address", address["house_number"]).alias("house_number"),
        only(firm, F.substring(value, 1, 8)).alias("name_prefix"),
        only(human, F.substring(person["last"], 1, 6)).alias("surname_prefix"),
        F.when(kind == "email", email_domain(value)).when(kind == "website", website_host(display)).alias("domain"),
        only(kind == "phone", F.substring(value, 1, 6)).alias("phone_prefix"),
        only(kind == "property", parcel).alias("parcel"),
    )


def stable_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """prefix:hash of the parts joined by bars."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, length))


def parse_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def to_number(c: Column) -> Column:
    """A number, 0 where there is none."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def source_kind(c: Column) -> Column:
    """The type of a source by its known names, else arcgis, api, manual, connector or synthetic by the first word it holds."""
    text = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    has = lambda *words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    by_word = (
        F.when(has("arcgis", "featureserver", "mapserver"), "arcgis")
        .when(has("api"), "api")
        .when(has("manual"), "manual")
        .when(has("local", "file", "connector"), "connector")
        .when(has("synthetic", "generated"), "synthetic")
        .otherwise("unknown")
    )
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SOURCE_KINDS.items() for x in pair]), text), by_word)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
