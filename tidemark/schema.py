"""Fixed values of the domain: enumerations, thresholds, the registry of origins, schedules, and the tables' types."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values, to equal the system whose decisions these jobs reproduce.
REGIONS = ["GLOBAL", "NA", "EU", "APAC", "JP", "OTHER"]
EVENT_TYPES = ["SHELF", "PRERELEASE", "PROMO", "SPECIAL"]
STATUSES = ["RUMORED", "ANNOUNCED", "CONFIRMED", "RELEASED", "CANCELLED"]
TIER_WEIGHT = {"OFFICIAL": 1.0, "RETAILER": 0.7, "COMMUNITY": 0.45, "SPECULATIVE": 0.2}
TIER_RANK = {"OFFICIAL": 0, "RETAILER": 1, "COMMUNITY": 2, "SPECULATIVE": 3}
RULE_PRIORITY = {"G1": 0, "G2": 1, "G8": 2, "G3": 3}
CONTRADICTION_FACTOR = 0.7
CONFIRMED_AT, ANNOUNCED_AT = 0.6, 0.3
DEFAULT_WEIGHT = 0.8
AGREEMENT_DAYS, RETAILER_RUNS, LARGE_SHIFT_DAYS, ABSENCE_DAYS = 3, 7, 14, 14
MAX_LEAD_DAYS = 21
FORWARD_WINDOW_DAYS, RETENTION_FLOOR_DAYS, NEWS_DAYS = 90, 90, 90
STALE_HOURS, REPEAT_HOURS = 48, 24
SIMILARITY_AT, MIN_NAME = 0.75, 3
STOP_WORDS = [
    "the", "a", "an", "of", "and", "&", "set", "booster", "box", "pack", "packs", "collection", "expansion",
    "edition", "series", "deck", "starter", "bundle", "case", "tin", "blister", "trading", "card", "cards", "game",
]
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
#: Origin, tier, and the origin that it derives from.
ORIGINS = [
    ("pokemon", "OFFICIAL", None), ("wizards", "OFFICIAL", None), ("konami", "OFFICIAL", None), ("ravensburger", "OFFICIAL", None),
    ("bandai", "OFFICIAL", None), ("riot", "OFFICIAL", None), ("scryfall", "COMMUNITY", "wizards"), ("ygoprodeck", "COMMUNITY", "konami"),
    ("bulbapedia", "COMMUNITY", "pokemon"), ("tcgplayer", "RETAILER", None), ("wikipedia", "COMMUNITY", None), ("rumourmill", "SPECULATIVE", None),
]
#: Game, slot, weekday (0 Sunday to 6 Saturday), how many such weekdays before the shelf date.
SLOTS = [
    ("magic-the-gathering", "friday-1", 5, 1), ("disney-lorcana", "friday-1", 5, 1), ("one-piece-tcg", "friday-1", 5, 1),
    ("pokemon-tcg", "saturday-1", 6, 1), ("pokemon-tcg", "saturday-2", 6, 2), ("yugioh-tcg", "sunday-1", 0, 1),
]
GAMES = ["magic-the-gathering", "pokemon-tcg", "yugioh-tcg", "one-piece-tcg", "disney-lorcana"]

# What sources list that is no product of its own.
COMPANION_TYPES = ["token", "memorabilia", "minigame", "alchemy", "treasure_chest", "vanguard"]
CARD_POOL_GAMES = ["flesh-and-blood", "digimon-card-game", "one-piece-tcg", "union-arena-tcg"]
CARD_GENRES = ["pack", "deck"]
PARENTED_GAME = "magic-the-gathering"
EVENT_TABS = ["calendar", "list", "upcoming", "unconfirmed"]
NAMESPACES = ["file", "image", "media", "category", "template", "help", "special", "talk", "user", "portal", "project", "mediawiki", "module"]
REGION_LABELS = {"NA": "NA", "EU": "EU", "APAC": "APAC", "JP": "JP", "OTHER": "Regional"}
TYPE_LABELS = {"PRERELEASE": "Prerelease", "PROMO": "Promo", "SPECIAL": "Special"}

# Patterns of names, in Java's syntax.
CARD_POOL_NAME = r"(?i)\b(?:release event|pre-?release) cards$"
NUMBERED_SET = r"^\d{1,2}$"
PARENTED_NAME = r"(?i)^Art Series:\s*(.+)$"
LEADING_CODE = r"^([A-Z]{2,4}-?\d{1,3}[A-Z]{0,3})(?:[:\s]|$)"
CODED_HEAD = r"^[A-Z]{2,4}-?\d{0,3}[A-Z]{0,3}\s*(?:[:—–]|-\s)|^[A-Z]{2,4}-?\d{1,3}[A-Z]{0,3}\s|[\[(][A-Z]{2,4}-?\d{1,3}[\])]\s*$"
TAIL = r"(?:[:—–]|\s-\s)\s*([^:—–]+)$"
TRAILING_BRACKET = r"[\[(]([A-Z]{2,4}-?\d{1,3})[\])]\s*$"
NO_CODE = r"(?i)^(?:[—–\-?]+|n/?a|tba|tbd|tbc|unknown|none)$"
SEQUENCE_LABEL = r"(?i)^(?:set|series|volume|vol|chapter|part)\s*#?(\d+)\s*[:\-–—]\s*"
TRAILING_CODE = r"\s+(?=[A-Z0-9]*[A-Z])[A-Z0-9]{2,5}$"
MAIN_EXPANSION = r"(?i)^(?:[A-Z]{2,3}\d{0,2}:\s*)?(?:mega evolution|scarlet\s*(?:&|and)\s*violet|sword\s*(?:&|and)\s*shield|sun\s*(?:&|and)\s*moon|xy)\s*[—–:-]"
NOT_A_BOOSTER = r"(?i)\b(?:decks?|packs?|tins?|collections?|collaborations?|starter|structure|duelist|battle|tournament|winner'?s|celebration|promo)\b"

#: A date is a day, a range, a window (month, quarter, year) or unknown; these columns hold it flat.
DATE_COLUMNS = ["kind", "date_exact", "date_start", "date_end", "granularity", "window_start", "window_end"]

PAYLOAD = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("sha256", T.StringType()),
    ]
)
CANDIDATE = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("game", T.StringType()),
        T.StructField("external_ids", T.MapType(T.StringType(), T.StringType())),
        T.StructField("name", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("date_text", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("product_kind", T.StringType()),
    ]
)
