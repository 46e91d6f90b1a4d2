"""Item names: cleaning, prefixes, canonical names, exclusions. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry.functions.text import to_ascii

# Prefixes, excluded terms, sizes, and canonical names in the order in which they apply.
BRAND_PREFIXES = ["great-value-", "gv-", "seg-", "se-grocers-", "marketside-", "sam-s-choice-", "equate-", "parent-s-choice-", "member-s-mark-", "kirkland-", "know-and-love-", "walmart-", "kgl-", "kand1", "kandl", "wr-"]
EXCLUDED_TERMS = ["shirt", "joggers", "underwear", "sandals", "socks", "toy", "doll", "game", "plush", "fleece", "cleaner", "shorts", "pants", "mens", "birthday", "christmas", "halloween", "greeting-cards", "greeting", "hallmark", "sleeves"]
SIZE = r"\b(\d+(\.\d+)?\s?(oz|ounce|fl|lb|lbs|ct|count|pk|pack|ml|g|kg|gallon|half-gallon|l))\b"
CANONICAL_RULES = [
    ("milk", ["prairie-farm-milk", "kleinpeter-milk", "kl-milk", "Milk, Fat Free,", "Fat-Free Milk"]),
    ("bread", ["Bunny Bread", "sandwich-bread", "White Sandwich Bread", "bunny-bread", "se-grocers-bread", "seg-sandwich-bread", "seg-white-bread"]),
    ("bread", ["white-bread"]),
    ("icecream", ["blue-bell", "ice-cream", "icescream"]),
    ("cheese", ["dandw-cheese", "kraft-cheese", "se-grocers-cheese", "know-and-love-cheese"]),
    ("mayo", ["blue-plate-mayo", "blue-plate-mynnase"]),
    ("gatorade-powerade-sports-drink", ["gatorade", "powerade", "sports-drink"]),
    ("chicken-thigh-leg-cutlet-tyson", ["tyson", "chicken-cutlet", "chicken-leg", "chicken-thigh", "chicken-thighs"]),
    ("steak-ribs-pork-ground-beef-cano", ["steak", "ribs", "pork", "ground-beef"]),
    ("frozen-breakfast-jimmy-dean-cano", ["jimmy-dean"]),
    ("shampoo-conditioner-cano", ["shampoo", "conditioner"]),
    ("soap", ["soap"]),
    ("yogurt", ["chobani-yogrt-flip", "chobani-yogurt", "yogurt"]),
    ("coke", ["coca-cola", "coca-cola-cola", "cocacola-soda", "coke", "cola"]),
    ("otcmeds", ["topcare", "top-care"]),
    ("junk-food", ["little-debbie", "hugbi-pies", "hubig", "-hugbi-pies", "candy", "tastykake"]),
    ("cereal-raisn-bran-apl-jck_cano", ["cereal", "kellogg-raisn-bran", "kellogg-raisin-bra", "apl-jck"]),
    ("minute-maid-drink", ["minute-maid-drink", "minute-maid-drinks", "minute-maid-lmnade"]),
    ("eggs", ["egglands-best-egg", "egglands-best-eggs", "eggs"]),
    ("sparkling-ice", ["sprklng-water", "sparkling-ice-wtr", "sparkling-ice", "sparkling-water"]),
    ("drinking-water", ["drinking-water", "purified-drinking"]),
    ("ground-beef", ["ground-beef"]),
    ("monster-energy", ["monster-energy", "monster-enrgy", "monster"]),
    ("jelly", ["smuckers", "jelly"]),
    ("cat-litter", ["cat-litter", "cats-litter"]),
    ("pizza", ["pizza"]),
    ("pringles", ["pringles"]),
    ("dr-pepper", ["dr-pepper"]),
    ("aluminum-foil", ["aluminum-foil", "foil"]),
    ("sour-cream", ["sour-cream"]),
]


def clean_item_name(c: Column) -> Column:
    """Lower case, in plain ASCII letters, no punctuation, sizes or numbers, words joined by '-'; null becomes ''."""
    s = to_ascii(F.lower(F.coalesce(c, F.lit(""))))
    for pattern, new in (("&", " and "), (r"[^\w\s]", " "), ("[_/]", " "), (SIZE, " "), (r"\b\d+\b", " "), (r"\s+", " ")):
        s = F.regexp_replace(s, pattern, new)
    return F.replace(F.trim(s), F.lit(" "), F.lit("-"))


def strip_prefixes(c: Column, prefixes: list[str] = BRAND_PREFIXES) -> Column:
    """The longest matching prefix goes once, whatever its case; then leading '-'."""
    import re

    longest_first = sorted(prefixes, key=len, reverse=True)
    return F.regexp_replace(F.trim(F.regexp_replace(c, "(?i)^(" + "|".join(map(re.escape, longest_first)) + ")", "")), "^-+", "")


def canonicalize(c: Column, rules=CANONICAL_RULES) -> Column:
    """Rules in order; each sees what the ones before made. One fold over a literal array, linear in the rules."""
    steps = F.array(*(F.struct(F.array(*(F.lit(p.lower()) for p in patterns)).alias("p"), F.lit(name).alias("n")) for name, patterns in rules))
    return F.aggregate(steps, c, lambda now, r: F.when(F.exists(r["p"], lambda p: F.contains(F.lower(now), p)), r["n"]).otherwise(now))


def contains_any(c: Column, terms: list[str] = EXCLUDED_TERMS) -> Column:
    lower = F.lower(c)
    return F.exists(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(lower, t))


def lacks_all(c: Column, literals: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> Column:
    """True where no literal and no pattern occurs, whatever the case; null texts are kept."""
    found = F.lit(False)
    for x in literals:
        found = found | F.contains(F.lower(c), F.lit(x.lower()))
    for x in patterns:
        found = found | c.rlike(f"(?i){x}")
    return ~F.coalesce(found, F.lit(False))


def canonicalize_by_pattern(c: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Like canonicalize, but a rule's terms are regular expressions; case doesn't count."""
    for name, patterns in rules:
        c = F.when(c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(name)).otherwise(c)
    return c


def cache_key(c: Column) -> Column:
    """Lower case, only letters, digits and single spaces; null becomes ''."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9\\s]", ""), "\\s+", " "))
