"""Scoring and ranking events for users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, text
from .profile import profiles
from .scratch import written
from .search import people_interested

# Fixed values.
VIBE, POPULARITY, FRESHNESS, DIVERSITY, PENALTY = 0.50, 0.25, 0.15, 0.10, 10.0


def tag_scores(events: DataFrame, preferred: DataFrame, profile: DataFrame, by: str = "user_id", capped: bool = True) -> DataFrame:
    """by, id, vibe_score, matched_tags for pairs that share a tag: equi-joins on the normalised tag, then one regrouping.

    preferred(by, tag), profile(by, tag, score). 100 for each preferred tag and ten times the profile's weights, at most
    100 where ``capped``. Matched tags: the preferred ones by key, then those with profile weight in the event's order.
    """
    tags = events.select("id", F.posexplode("tags").alias("p", "t")).where(F.regexp_replace("t", "[# ]", "") != "").select("id", "p", "t", text.tag_key(F.col("t")).alias("key"))
    # a key counts once, under its last spelling and at its first place
    tags = tags.groupBy("id", "key").agg(F.min("p").alias("p"), F.max_by("t", "p").alias("t"))
    wants = preferred.select(by, text.tag_key(F.col("tag")).alias("key")).distinct().select(by, "key", F.lit(1).alias("liked"), F.lit(0.0).alias("score"))
    weights = profile.groupBy(by, text.tag_key(F.col("tag")).alias("key")).agg(F.sum("score").alias("score")).select(by, "key", F.lit(0).alias("liked"), "score")
    both = wants.unionByName(weights).groupBy(by, "key").agg(F.max("liked").alias("liked"), F.sum("score").alias("score"))
    hits = tags.join(both, "key")
    grouped = hits.groupBy(by, "id").agg(F.sum("liked").alias("n"), F.sum("score").alias("w"), F.collect_list(F.struct("liked", "key", "p", "t", "score")).alias("m"))
    raw = F.col("n") * 100.0 + F.col("w") * 10.0
    liked = F.transform(F.array_sort(F.transform(F.filter("m", lambda x: x["liked"] == 1), lambda x: F.struct(x["key"].alias("key"), x["t"].alias("t")))), lambda x: x["t"])
    felt = F.transform(F.array_sort(F.transform(F.filter("m", lambda x: x["score"] > 0), lambda x: F.struct(x["p"].alias("p"), x["t"].alias("t")))), lambda x: x["t"])
    none = (F.col("n") == 0) & (F.col("w") <= 0)
    score = F.least(raw, F.lit(100.0)) if capped else raw
    return grouped.where(~none).select(by, "id", score.alias("vibe_score"), F.array_union(liked, felt).alias("matched_tags"))


def penalised(scored: DataFrame, by: list[str]) -> DataFrame:
    """total_score less the penalty where the primary category repeats that of the row before, in score order; and repeat."""
    order = Window.partitionBy(*by).orderBy(F.desc("total_score"), "start_at", "id")
    first = F.get("categories", F.lit(0))
    marked = scored.withColumn("repeat", F.coalesce(first == F.lag(first).over(order), F.lit(False)))
    return marked.withColumn("total_score", F.col("total_score") - F.when(F.col("repeat"), PENALTY).otherwise(0.0))


def components(pairs: DataFrame, counts: DataFrame, as_of: Column) -> DataFrame:
    """pairs with vibe_score -> popularity, freshness and total before the penalty."""
    joined = pairs.join(counts.withColumnRenamed("event_id", "id"), "id", "left").withColumn("people_interested", F.coalesce("people_interested", F.lit(0)))
    return joined.withColumn("popularity_score", money.popularity_score(F.col("people_interested"))).withColumn("freshness_score", money.freshness(F.col("created_at"), as_of)).withColumn(
        "total_score", F.col("vibe_score") * VIBE + F.col("popularity_score") * POPULARITY + F.col("freshness_score") * FRESHNESS + F.lit(100.0 * DIVERSITY)
    )


def score_events(events: DataFrame, preferred: DataFrame, profile: DataFrame, counts: DataFrame, as_of: Column, least: int) -> DataFrame:
    """The ``least`` best events for one user, matching or not, with their scores after the penalty.

    preferred(user_id, tag) and profile(user_id, tag, score) are that user's. The head of the order is taken deeper until
    its ``least`` best final scores reach the total at its end: a penalty only lowers a score, so nothing behind that end can
    come before them. Where all events are of one category, all behind it are penalised, and the bound is lower by that.
    """
    vibe = tag_scores(events, preferred, profile).drop("user_id")
    joined = events.join(vibe, "id", "left").withColumn("vibe_score", F.coalesce("vibe_score", F.lit(0.0))).withColumn("matched_tags", F.coalesce("matched_tags", F.array().cast("array<string>")))
    scored, depth = written(components(joined, counts, as_of), "scored"), 2 * least + 16
    spared = PENALTY if _of_one_category(scored.select(F.get("categories", F.lit(0)).alias("category"))) else 0.0
    order = [F.desc("total_score"), F.asc("start_at"), F.asc("id")]
    while True:
        # at most ``depth`` rows in one window
        head = written(penalised(scored.orderBy(*order).limit(depth).withColumn("before", _key("total_score", spared)), []).drop("repeat"), "head")
        best = written(head.orderBy(*order).limit(least), "best")
        n, end = head.agg(F.count("*"), F.max("before")).collect()[0]
        # the least key comes first
        got, worst = best.agg(F.count("*"), F.max(_key("total_score"))).collect()[0]
        if n < depth or (got == least and worst <= end):
            return best.drop("before").orderBy(*order)
        depth *= 4


def _key(total: str, less: float = 0.0) -> Column:
    """What rows are ordered by, ascending; with a total that is so much less."""
    return F.struct((F.lit(less) - F.col(total)).alias("t"), F.col("start_at").alias("s"), F.col("id").alias("i"))


def _doubling(place: str) -> Column:
    """Whether a place is 1, 2, 4, 8, …"""
    return F.col(place).bitwiseAND(F.col(place) - 1) == 0


def _of_one_category(rows: DataFrame) -> bool:
    found = rows.agg(F.min("category").alias("lo"), F.max("category").alias("hi"), F.count_if(F.col("category").isNull()).alias("none")).first()
    return found["none"] == 0 and found["lo"] == found["hi"]


def best_matches(events: DataFrame, preferred: DataFrame, profile: DataFrame, counts: DataFrame, as_of: Column, least: int, by: str = "user_id") -> DataFrame:
    """by, id, vibe_score, matched_tags, the other scores, total_score and rank of the ``least`` best matching events of each.

    The penalty looks at the event before in a user's order of *all* events, but no pair of a user and an event is made
    beyond a depth. Events with the same tags have the same vibe for a user, so that tags are matched with users once for
    each distinct list of tags, and within a list all users share one order. The first ``depth`` matches of a user are among
    the heads of the lists, and the unmatched ones come from the common order of all events. How far each is read is told by
    marks at the places 1, 2, 4, 8, … of the lists: in a user's order of marks, those up to the one with which they stand for
    ``depth`` matches have all of these before them, and no list is read to twice its last such mark, so that a user meets at
    most three times ``depth`` matches, whatever the number of lists. Down to there the order is
    whole. A penalty only lowers a score, so nothing behind that end can come before a final score that reaches the total
    there (or that less the penalty, where all events are of one category and so all behind are penalised): once the ``least``
    best matches do, they are the result. Users for whom they don't are taken up again, four times as deep. Totals are rounded at nine digits, so that equal ones tie.
    """
    few = events.select("id", "start_at", "created_at", "tags", F.get("categories", F.lit(0)).alias("category"))
    plain = components(few.withColumn("vibe_score", F.lit(0.0)), counts, as_of)
    lists = plain.where("size(tags) > 0").groupBy("tags").agg(F.min("id").alias("list"), F.count("*").alias("size"))
    listed = plain.join(lists, "tags", "left").select("id", "start_at", "category", "list", "size", "popularity_score", "freshness_score", F.round("total_score", 9).alias("base"))
    listed = written(listed, "scored")
    vibes = tag_scores(lists.select(F.col("list").alias("id"), "tags"), preferred, profile, by).withColumnRenamed("id", "list")
    heads = listed.groupBy("list").agg(F.min(F.struct((-F.col("base")).alias("b"), "start_at", "id")).alias("head"), F.max("size").alias("size"))
    first = F.struct((F.col("head.b") - VIBE * F.col("vibe_score")).alias("t"), "head.start_at", "head.id")
    vibes = written(vibes.join(heads, "list").select(by, "list", "size", "vibe_score", "matched_tags", first.alias("first")), "vibes")
    n_events, open_users, depth, found = listed.count(), vibes.select(by).distinct(), least + 16, None
    order, spared = [F.desc("total"), F.asc("start_at"), F.asc("id")], PENALTY if _of_one_category(listed) else 0.0
    while True:
        liked = vibes.join(open_users, by, "left_semi")
        liked = liked.withColumn("all", F.sum("size").over(Window.partitionBy(by))).withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("first"))).where(F.col("r") <= depth)
        place = Window.partitionBy("list").orderBy(F.desc("base"), "start_at", "id")
        tops = written(listed.where("list is not null").withColumn("n", F.row_number().over(place)).where(F.col("n") <= depth).drop("size"), "tops")
        # before the heads of r - 1 lists there is no room for more than depth - r + 1 of the next
        total = F.round(VIBE * F.col("vibe_score") + F.col("base"), 9)
        marks = liked.join(tops.where(_doubling("n")), "list").where(F.col("n") + F.col("r") <= depth + 1)
        # a mark tells of as many matches as there are behind the mark before it in its list
        marks = marks.withColumn("total", total).withColumn("key", _key("total")).withColumn("gain", F.floor((F.col("n") + 1) / 2))
        marks = marks.withColumn("sure", F.sum("gain").over(Window.partitionBy(by).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)))
        marks = written(marks.where(F.col("sure") - F.col("gain") < depth).select(by, "list", "size", "vibe_score", "all", "r", "n", "key", "sure"), "marks")
        reach = marks.groupBy(by, "list", "size", "vibe_score", "all", "r").agg(F.max("n").alias("n"))
        take = F.least(2 * F.col("n") - 1, depth + 1 - F.col("r"), F.col("size")).cast("int")
        hits = reach.withColumn("n", F.explode(F.sequence(F.lit(1), take))).join(tops, ["list", "n"]).select(by, "list", "id", "start_at", "category", total.alias("total"), F.lit(1).alias("hit"), "all")
        wide = 4 * depth
        common = listed.orderBy(F.desc("base"), "start_at", "id").limit(wide).select("id", "start_at", "category", "list", F.col("base").alias("total"))
        common = written(common.withColumn("g", F.row_number().over(Window.orderBy(*order))), "common")  # at most ``wide`` rows
        # of the common order, what comes before a user's last mark; all, where the marks tell of fewer than ``depth`` matches
        upto = marks.groupBy(by).agg(F.when(F.max("sure") >= depth, F.max("key")).alias("upto"))
        upto = upto.crossJoin(F.broadcast(common.where(_doubling("g")).select("g", _key("total").alias("key")))).where(F.col("upto").isNull() | (F.col("key") <= F.col("upto")))
        upto = upto.groupBy(by).agg(F.least(2 * F.max("g") - 1, F.lit(wide)).alias("g"))
        each = upto.select(by, F.explode(F.sequence(F.lit(1), F.col("g"))).alias("g"))
        others = each.join(common, "g").join(vibes.select(by, "list"), [by, "list"], "left_anti").select(by, "list", "id", "start_at", "category", "total", F.lit(0).alias("hit"), F.lit(None).cast("long").alias("all"))
        end = common.where(F.col("g") == wide).collect() if n_events > wide else []
        merged = Window.partitionBy(by).orderBy(*order)
        rows = hits.unionByName(others).withColumn("seen", F.sum("hit").over(merged)).withColumn("before", F.lag("category").over(merged))
        rows = rows.where(F.col("seen") <= depth)
        if end:
            last = F.struct(F.lit(-end[0]["total"]).alias("t"), F.lit(end[0]["start_at"]).alias("s"), F.lit(end[0]["id"]).alias("i"))
            rows = rows.where(F.struct((-F.col("total")).alias("t"), F.col("start_at").alias("s"), F.col("id").alias("i")) <= last)
        repeat = F.coalesce(F.col("category") == F.col("before"), F.lit(False))
        # the last row down to which the order is whole: behind the last of ``depth`` matches, others may lack
        mine = Window.partitionBy(by)
        rows = rows.withColumn("end", F.when(F.max("seen").over(mine) >= depth, F.max(F.when(F.col("hit") == 1, _key("total", spared))).over(mine)).otherwise(F.max(_key("total", spared)).over(mine)))
        rows = rows.where("hit = 1").select(by, "list", "id", "start_at", "all", "end", F.round(F.col("total") - F.when(repeat, PENALTY).otherwise(0.0), 9).alias("total"))
        # whole when no list was cut
        whole = F.lit(False) if end else F.col("all") <= depth
        rows = rows.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= least).withColumn("key", _key("total"))
        rows = written(rows.withColumn("done", whole | ((F.count("*").over(mine) == least) & (F.max("key").over(mine) <= F.col("end")))).drop("key", "end"), "ranked")
        done = rows.where("done").drop("done", "all")
        found = done if found is None else found.unionByName(done)
        open_users = written(open_users.join(rows.where("done").select(by).distinct(), by, "left_anti"), "open")
        if open_users.isEmpty():
            break
        depth *= 4
    scores = listed.select("id", "popularity_score", "freshness_score")
    felt = vibes.select(by, "list", "vibe_score", "matched_tags")
    return found.withColumnRenamed("total", "total_score").join(felt, [by, "list"]).join(scores, "id").drop("list")


def recommend(events: DataFrame, users: DataFrame, signals: DataFrame, as_of: Column, limit: int = 25, offset: int = 0) -> DataFrame:
    """users(user_id, preferred_vibes) -> the page of each user's recommendations, with rank and the whole-numbered match score.

    Users without preferences and profile get none, nor does an event without a match.
    """
    upcoming = events.where(F.col("start_at") >= as_of)
    preferred = users.select("user_id", F.explode("preferred_vibes").alias("tag"))
    profile = profiles(signals, events, as_of).join(users.select("user_id"), "user_id", "left_semi")
    best = best_matches(upcoming, preferred, profile, people_interested(signals), as_of, limit + offset)
    page = best.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).drop("start_at")
    return page.withColumn("match_score", F.bround("total_score").cast("int")).join(upcoming.select("id", "title", "start_at", "categories"), "id")


def rank_without_user(events: DataFrame, counts: DataFrame, as_of: Column) -> DataFrame:
    """Popularity and freshness alone, of equal weight; start and id break ties."""
    joined = events.join(counts.withColumnRenamed("event_id", "id"), "id", "left")
    scored = joined.withColumn("popularity_score", money.popularity_score(F.coalesce("people_interested", F.lit(0)))).withColumn("freshness_score", money.freshness(F.col("created_at"), as_of))
    return scored.withColumn("total_score", F.col("popularity_score") + F.col("freshness_score")).orderBy(F.desc("total_score"), "start_at", "id")
