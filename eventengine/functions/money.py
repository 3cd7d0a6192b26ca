"""Numbers: prices, counts, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SIGNAL_WEIGHTS = {"click": 1.0, "save": 5.0, "external_ticket_click": 10.0, "onboarding": 6.0, "like": 4.0}
HALF_LIFE_DAYS = 30.0


def parse_price(text: Column) -> tuple[Column, Column]:
    """Price and whether it is free: 'free' without a dollar sign is 0, else the first dollar amount."""
    t = F.coalesce(text, F.lit(""))
    free = F.lower(t).contains("free") & ~t.contains("$")
    amount = F.nullif(F.regexp_extract(t, r"\$\s*(\d+(?:\.\d{2})?)", 1), F.lit("")).try_cast("double")
    return F.when(free, F.lit(0.0)).otherwise(amount), free


def safe_count(c: Column) -> Column:
    return F.greatest(F.coalesce(c.try_cast("int"), F.lit(0)), F.lit(0))


def confidence(c: Column) -> Column:
    return F.coalesce(F.least(F.greatest(c.try_cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(1.0))


def popularity_share(count: Column, full: float) -> Column:
    """Votes (full = 100) or attendees (500) on 0 to 1."""
    return F.least(count / F.lit(full), F.lit(1.0))


def popularity_score(users: Column) -> Column:
    return F.least(users * F.lit(10.0), F.lit(100.0))


def decay(created_at: Column, as_of: Column) -> Column:
    """Half the weight every ``HALF_LIFE_DAYS``; the future counts as now."""
    days = F.greatest((F.unix_micros(as_of) - F.unix_micros(created_at)) / F.lit(86_400e6), F.lit(0.0))
    return F.pow(F.lit(0.5), days / F.lit(HALF_LIFE_DAYS))


def signal_weight(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SIGNAL_WEIGHTS.items() for x in kv])
    return F.coalesce(F.element_at(known, kind), F.lit(0.0))


def vote_sign(v: Column) -> Column:
    return F.when(v >= 1, 1).otherwise(-1)


def freshness(created_at: Column, as_of: Column) -> Column:
    age = F.unix_micros(as_of) - F.unix_micros(created_at)
    hour = 3_600_000_000
    return F.when(age <= 24 * hour, 100.0).when(age <= 48 * hour, 75.0).when(age <= 168 * hour, 50.0).otherwise(25.0)


def cost_fields(*texts: Column) -> Column:
    """Struct of price, currency, is_free from the first text that says something; 'Cost:' narrows a text to its label."""

    def one(t: Column) -> Column:
        label = F.regexp_extract(t, r"(?i)cost:\s*([^|\n]*)", 1)
        scope = F.when(t.rlike(r"(?i)cost:"), label).otherwise(t)
        free = scope.rlike(r"(?i)\bfree\b") & ~scope.contains("$")
        amount = F.nullif(F.regexp_extract(scope, r"\$\s*(\d+(?:\.\d{2})?)", 1), F.lit("")).try_cast("double")
        price = F.when(free, F.lit(0.0)).otherwise(amount)
        return F.when(price.isNotNull(), F.struct(price.alias("price"), F.lit("USD").alias("currency"), (price == 0).alias("is_free")))

    none = F.struct(F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("currency"), F.lit(False).alias("is_free"))
    return F.coalesce(*map(one, texts), none)
