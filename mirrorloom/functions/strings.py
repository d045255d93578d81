"""String functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rng import choice, integer, uniform

# Own vocabularies of generated names and places.
FIRST_NAMES = "Ada Bruno Chloe Dario Esme Felix Greta Hugo Ines Jonas Keiko Lazlo Mina Nuno Orla Pavel".split()
LAST_NAMES = "Abbot Barlow Calder Dunmore Everly Farrow Gantry Holt Ingram Joyner Kessler Lund Marlow Nilsen Orton Pell".split()
STREETS = "Alder Beacon Cooper Dale Ember Foundry Garden Harbor Ivy Juniper".split()
CITIES = "Amberford Brackwell Coldharbor Dunvale Eastmere Foxbridge Glenholt Hazelton Ironmouth Kestrelby".split()
STATES = "AK CT HI ID KY ME NH OR UT VT".split()


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first: initials after apostrophes and hyphens too."""
    marked = F.regexp_replace(F.lower(c), r"([A-Za-z]+)", "\u0001$1")
    parts = F.split(marked, "\u0001")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.expr("''"), F.call_function("substr", p, F.lit(2))))), "")


def initials(c: Column) -> Column:
    """The first letter of each word in upper case, each with a full stop."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), "")


def salted_hash(c: Column, salt: str, length: int = 16) -> Column:
    """The first hexadecimal digits of SHA-256 of salt and value; null hashes as nan."""
    return F.substring(F.sha2(F.concat(F.lit(salt), F.coalesce(c.cast("string"), F.lit("nan"))), 256), 1, length)


def email_domain_preserved(c: Column, seed: int, *key: Column) -> Column:
    """A generated user at the value's domain; example.com where it has none."""
    domain = F.when(c.contains("@"), F.regexp_extract(c, "@(.*)$", 1)).otherwise(F.lit("example.com"))
    return F.when(c.isNotNull(), F.concat(F.lit("user"), integer(1000, 9999, seed, "email", *key).cast("string"), F.lit("@"), domain))


def format_preserved(c: Column, seed: int, *key: Column) -> Column:
    """Digits, capitals and small ASCII letters each replaced by a random one of their kind; other characters stay."""
    places = F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c))).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        ch = F.call_function("substr", c, i, F.lit(1))
        u = uniform(seed, "format", *key, i)
        pick = lambda letters: F.call_function("substr", F.lit(letters), F.floor(u * len(letters)).cast("int") + 1, F.lit(1))
        return F.when(ch.rlike("[0-9]"), pick("0123456789")).when(ch.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(ch.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).otherwise(ch)

    return F.array_join(F.transform(places, one), "")


def random_name(seed: int, *key: Column) -> Column:
    return F.concat_ws(" ", choice(FIRST_NAMES, seed, "first", *key), choice(LAST_NAMES, seed, "last", *key))


def random_phone(seed: int, *key: Column) -> Column:
    part = lambda name, low, high: integer(low, high, seed, name, *key).cast("string")
    return F.concat(F.lit("("), part("area", 200, 999), F.lit(")-"), part("exchange", 200, 999), F.lit("-"), part("line", 1000, 9999))


def random_address(seed: int, *key: Column) -> Column:
    number = integer(100, 9999, seed, "house", *key).cast("string")
    return F.concat(number, F.lit(" "), choice(STREETS, seed, "street", *key), F.lit(" St, "), choice(CITIES, seed, "city", *key), F.lit(", "), choice(STATES, seed, "state", *key), F.lit(" "), integer(10000, 99999, seed, "zip", *key).cast("string"))


# The patterns of the parts of an address.
HOUSE, ZIP, STATE = r"^(\d+)", r"\b(\d{5})(?:-\d{4})?\b", r"\b([A-Z]{2})\b"
STREET = r"^\d*\s*([A-Za-z][A-Za-z ]*?(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Boulevard|Blvd))\b"


def parse_address(c: Column) -> dict[str, Column]:
    """House number, ZIP code, state and street; missing parts are empty."""
    get = lambda pattern: F.coalesce(F.regexp_extract(c, pattern, 1), F.lit(""))
    return {"house": get(HOUSE), "zip": get(ZIP), "state": get(STATE), "street": get(STREET)}


def anonymize_address(c: Column, method: str) -> Column:
    """remove_house_number, street_only, state_only, zip_only or general_area."""
    p = parse_address(c)
    some = lambda x, other: F.when(x != "", x).otherwise(F.lit(other))
    if method == "remove_house_number":
        return F.trim(F.regexp_replace(c, r"^\d+\s*", ""))
    if method == "street_only":
        return some(p["street"], "Street Name Unknown")
    if method == "state_only":
        return some(p["state"], "Location Unknown")
    if method == "zip_only":
        return some(p["zip"], "Unknown")
    if method == "general_area":
        both = (p["state"] != "") & (p["zip"] != "")
        return F.when(both, F.concat_ws(", ", p["state"], p["zip"])).otherwise("General Area Unknown")
    raise ValueError(f"unknown method {method}")


def sanitized_filename(c: Column) -> Column:
    """Path separators, control characters and what shells read removed."""
    return F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f]", ""), r'[<>:"/\\|?*]', "_")


def decimal_places(c: Column) -> Column:
    """Digits after the point of a number written as text."""
    return F.length(F.regexp_extract(c.cast("string"), r"\.(\d+)$", 1))


def without_sql_marks(c: Column) -> Column:
    """Quotes, semicolons and comment marks of SQL removed."""
    return F.regexp_replace(F.regexp_replace(c, r"--|/\*|\*/", ""), "['\";\\\\\\\\]", "")


def html_escaped(c: Column) -> Column:
    """The characters that HTML reads as references, the ampersand first."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c
