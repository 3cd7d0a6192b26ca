"""String and tag functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stem import stemmed

# Fixed values.
INTENT_KEYWORDS = [("date_night", ["date night"]), ("out_of_town_guests", ["out-of-town", "visiting", "guests"]), ("bar_crawl", ["bar crawl"])]
GEOGRAPHIES = ["oakland", "san francisco", "sf", "berkeley", "mission", "soma", "south bay", "san jose"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
ONBOARDING_STOP_WORDS = ["with", "from", "that", "this", "there", "about", "would"]
STATUS_SEVERITY = {"scheduled": 0, "postponed": 1, "cancelled": 2, "past": 3}
SOURCE_STATUS = {"onsale": "scheduled", "rescheduled": "scheduled", "postponed": "scheduled", "offsale": "cancelled", "canceled": "cancelled", "cancelled": "cancelled"}


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_text(*columns: Column) -> Column:
    """The first that is not blank, trimmed."""
    return F.coalesce(*map(blank_to_null, columns))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_tags(c: Column) -> Column:
    """Markup to spaces, white space collapsed; null to empty."""
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))


def currency(c: Column) -> Column:
    return F.substring(F.upper(blank_to_null(c)), 1, 3)


def venue_key(c: Column) -> Column:
    """What stands before the first parenthesis, in lower case; empty for none."""
    return F.lower(F.trim(F.substring_index(F.coalesce(c, F.lit("")), "(", 1)))


def url_key(c: Column) -> Column:
    """A URL without trailing slashes; null when nothing is left."""
    return F.nullif(F.regexp_replace(F.trim(c), "/+$", ""), F.lit(""))


def drop_query(c: Column) -> Column:
    return F.substring_index(c, "?", 1)


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)


def ordered_distinct(items: Column) -> Column:
    """Trimmed, blanks out, first-seen order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def ordered_union(left: Column, right: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(F.coalesce(left, empty), F.coalesce(right, empty)), lambda x: x.isNotNull() & (x != "")))


def profile_tags(tags: Column) -> Column:
    """Trimmed, with one leading #, without inner white space, distinct in order."""

    def one(t: Column) -> Column:
        body = F.when(F.trim(t).startswith("#"), F.substring(F.trim(t), 2, 1 << 30)).otherwise(F.trim(t))
        return F.concat(F.lit("#"), F.regexp_replace(body, r"\s+", ""))

    return F.array_distinct(F.filter(F.transform(F.filter(tags, lambda t: t.isNotNull() & (F.trim(t) != "")), one), lambda t: F.length(t) > 1))


def model_tags(raw: Column, cap: int = 5) -> Column:
    """Tags from a model's text: split on commas, bars and line breaks, bullets off, at most ``cap``."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), "[,|\n]"), lambda t: F.regexp_replace(F.trim(t), r"^[-*•\s]+", ""))
    named = F.transform(F.filter(parts, lambda t: F.regexp_replace(t, "[#\\s]", "") != ""), lambda t: F.concat(F.lit("#"), F.regexp_replace(F.regexp_replace(t, "^#+", ""), r"\s+", "")))
    return F.slice(F.array_distinct(named), 1, cap)


def tag_key(t: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.regexp_replace(F.trim(t), "^#+", "")))


#: Words of a text that mostly hold enough tags; the rest is looked at only where they do not.
FIRST_WORDS = 64


def onboarding_tags(text: Column, cap: int = 5) -> Column:
    """Words of four letters or more, not in the stop list, each followed by its pair with the next word, title-cased: the
    first ``cap`` distinct ones."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z][A-Za-z0-9']+)"), 1)

    def title(w: Column) -> Column:
        # a letter behind a digit or an apostrophe is a capital too
        return F.regexp_replace(F.initcap(F.regexp_replace(w, "([0-9'])", "$1 ")), "[^A-Za-z0-9]", "")

    def tags(ws: Column, upto: Column) -> Column:
        def of(i: Column) -> Column:
            w, nxt = F.get(ws, i), F.get(ws, i + 1)
            one = F.concat(F.lit("#"), title(w))
            ok = (F.length(w) >= 4) & ~F.lower(w).isin(ONBOARDING_STOP_WORDS) & (F.length(one) > 2)
            pair = F.when(nxt.isNotNull(), F.array(one, F.concat(one, title(nxt)))).otherwise(F.array(one))
            return F.when(ok, pair).otherwise(F.array().cast("array<string>"))

        spots = F.when(upto > 0, F.sequence(F.lit(0), upto - 1)).otherwise(F.array().cast("array<int>"))
        return F.slice(F.array_distinct(F.flatten(F.transform(spots, of))), 1, cap)

    def found(ws: Column) -> Column:
        some = lambda few: F.when(F.size(few) >= cap, few).otherwise(tags(ws, F.size(ws)))
        return F.get(F.transform(F.array(tags(ws, F.least(F.size(ws), F.lit(FIRST_WORDS)))), some), F.lit(0))

    return F.get(F.transform(F.array(words), found), F.lit(0))


def intent(prompt: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(prompt, F.lit(""))))
    out = F.lit("general_night_out")
    for name, keywords in reversed(INTENT_KEYWORDS):
        hit = F.lit(False)
        for k in keywords:
            hit = hit | text.contains(k)
        out = F.when(hit, name).otherwise(out)
    return out


def geography(prompt: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(prompt, F.lit(""))))
    return F.coalesce(*[F.when(text.contains(g), g) for g in GEOGRAPHIES])


def timeframe_label(prompt: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(prompt, F.lit(""))))
    weekday = F.coalesce(*[F.when(text.contains(d), f"this_{d}") for d in WEEKDAYS])
    return F.when(text.contains("tonight"), "tonight").when(text.contains("tomorrow"), "tomorrow").when(weekday.isNotNull(), weekday).when(text.contains("this weekend"), "this_weekend").otherwise("upcoming_week")


def normal_status(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SOURCE_STATUS.items() for x in kv])
    return F.coalesce(F.element_at(known, F.lower(F.trim(c))), F.lit("scheduled"))


def severity(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in STATUS_SEVERITY.items() for x in kv])
    return F.coalesce(F.element_at(known, c), F.lit(0))


def location_label(venue: Column, address: Column) -> Column:
    return F.nullif(F.concat_ws(" — ", blank_to_null(venue), blank_to_null(address)), F.lit(""))


def join_address(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *map(blank_to_null, parts)), F.lit(""))


def city_in_parentheses(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(F.coalesce(c, F.lit("")), r"\(([^)]+)\)", 1))


def event_at_venue(c: Column) -> tuple[Column, Column]:
    """Title and venue of ``title @ venue``."""
    parts = F.split(c, " @ ", 2)
    return F.trim(F.get(parts, F.lit(0))), blank_to_null(F.get(parts, F.lit(1)))


def quote_query(c: Column) -> Column:
    """Percent-encoded, blanks as %20, slashes and tildes kept."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def json_object(text: Column) -> Column:
    """The part of a text from the first brace to the last, when it parses; else null."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def price_label(is_free: Column, price: Column) -> Column:
    """Free, $X, $X.YY or price TBA; only what is marked free is."""
    whole = price == F.floor(price)
    return F.when(F.coalesce(is_free, F.lit(False)), "Free").when(price.isNull(), "price TBA").when(whole, F.format_string("$%d", price.cast("long"))).otherwise(F.format_string("$%.2f", price.cast("double")))


def label_of(code: Column, known: dict[str, str]) -> Column:
    """The label of a code; an unknown one in words, with a capital."""
    words = F.replace(code, F.lit("_"), F.lit(" "))
    spelled = F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, 2, 1 << 30)))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), code), spelled)


# English function words that a search leaves out.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


def terms(text: Column) -> Column:
    """Distinct lower-case words without stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(STOP_WORDS)))


def stems(text: Column) -> Column:
    """Distinct English stems of a text's terms: the tokens of a text search."""
    return stemmed(terms(text))


def street_address(detail: Column) -> Column:
    """'12 Main Street, Town, CA 94100' out of a block of parts between bars; null without one."""
    return blank_to_null(F.regexp_extract(F.coalesce(detail, F.lit("")), r"(\d{1,6}\s+[^|]*?,\s*[A-Za-z .]+,\s*[A-Z]{2}(?:\s+\d{5})?)", 1))


# Fixed value: what follows the first dash, up to a full stop, a price or the end of the line.
AFTER_DASH = r"[—–-]\s*([^.$\n]+)"


def venue_after_dash(blurb: Column) -> tuple[Column, Column]:
    """Venue and address of '… — The Room, 12 Main St'."""
    tail = F.trim(F.regexp_replace(F.trim(F.regexp_extract(F.coalesce(blurb, F.lit("")), AFTER_DASH, 1)), ",+$", ""))
    return blank_to_null(F.substring_index(tail, ",", 1)), blank_to_null(F.when(tail.contains(","), F.regexp_replace(tail, "^[^,]*,", "")))


def snippet(c: Column, limit: int = 280) -> Column:
    """What a source's retention policy lets one keep of a text."""
    return F.substring(F.trim(c), 1, limit)
