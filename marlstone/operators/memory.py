"""The episode store: search over time, hybrid ranking, decay, retention, roll-ups.

Episodes carry times as RFC 3339 text of any zone; they are compared as instants (nanoseconds). ``now`` is always a
parameter, in nanoseconds, so that a result can be made again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.incremental import instant
from marlstone.operators.text_search import bm25, query_words

DAY = 86_400_000_000_000
# Weights of the hybrid rank, its half-life in days, and what holds a memory for ever.
WEIGHTS = {"lexical": 0.35, "cosine": 0.6, "centrality": 0.4, "pinned": 0.35, "faded": 0.8, "invented": 0.2}
RECENCY_DAYS, EDGE_HALF_LIFE, EDGE_LEAST, STALE = 21.0, 90.0, 0.05, 0.5
KEPT_KINDS = ("teaching", "pin")
# What tells that a text gives orders to a model, was put in by a tool, or tags nothing.
INJECTED = ("ignore previous instructions", "ignore previous", "you are now", "from now on you", "disregard previous", "new instructions:", "system: you")
ENVELOPES = ("system-reminder", "command-message", "command-name", "task-notification")
SKILL_NOTE, INTERRUPTED = "Base directory for this skill:", "[Request interrupted by user]"
UNTAGGED = ("the", "and", "for", "that", "this", "with", "from", "have", "been", "were", "will", "when", "what", "which")


def episodes(df: DataFrame) -> DataFrame:
    """One row per id: of repeated rows the last updated, then the greatest."""
    order = F.struct(instant(F.col("updated_at")).alias("at"), F.struct(*[c for c in df.columns if c != "id"]).alias("row"))
    return df.where("id is not null").groupBy("id").agg(F.max(order).alias("r")).select("id", "r.row.*")


def valid_at(df: DataFrame, at: int) -> DataFrame:
    """The episodes valid at an instant: an empty start or end is open."""
    start, end = instant(F.col("valid_from")), instant(F.col("valid_to"))
    return df.where((start.isNull() | (start <= at)) & (end.isNull() | (end >= at)))


def lexical(df: DataFrame, query: str, each: int = 80, words: int = 7) -> DataFrame:
    """``(id, lexical)``: the greatest of 1 / (1 + bm25) over the query and its words of three letters or more, of the best
    ``each`` rows of each. A better match thus gives less; the rank is built on that."""
    parts = [query, *[w for w in query_words(query) if len(w) >= 3][:words]]
    found = None
    for part in dict.fromkeys(parts):
        hits = bm25(df.select("id", "title", "text", "topic"), {"title": 1.0, "text": 1.0, "topic": 1.0}, part).orderBy(F.desc("bm25"), "id").limit(each).select("id", (1 / (1 + F.abs("bm25"))).alias("lexical"))
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("id").agg(F.max("lexical").alias("lexical"))


def hybrid_search(df: DataFrame, query: str, now: int, window: int = 800, limit: int = 40, stale: DataFrame | None = None, cosines: DataFrame | None = None) -> DataFrame:
    """``(id, title, score)`` of the best ``limit`` of the newest ``window`` episodes (pinned first).

    The score adds what the text, ``cosines(id, cosine)``, centrality, pinning, recency and fading give; rows that
    tell of learning without an agent count a fifth, and stale or expired ones half. Tools' rows are left out, and
    without cosines rows the query does not occur in.
    """
    recent = episodes(df).withColumn("_at", instant(F.col("created_at"))).orderBy(F.desc("pinned"), F.desc("_at"), F.desc("id")).limit(window)
    rows = recent.where("kind <> 'tool'")
    rows = rows.join(lexical(episodes(df), query), "id", "left") if query else rows.withColumn("lexical", F.lit(None).cast("double"))
    if query and cosines is None:
        rows = rows.where(F.col("lexical").isNotNull() | F.contains(F.lower(F.concat_ws(" ", "title", "text", "topic")), F.lit(query.lower())))
    rows = rows.join(cosines, "id", "left") if cosines is not None else rows.withColumn("cosine", F.lit(0.0))
    top = F.greatest(F.max("centrality").over(Window.partitionBy()), F.lit(1.0))  # at most ``window`` rows
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    w = WEIGHTS
    score = w["lexical"] * zero("lexical") + w["cosine"] * zero("cosine") + w["centrality"] * zero("centrality") / top + F.when(F.col("pinned") != 0, w["pinned"]).otherwise(0.0)
    score += F.coalesce(F.exp(-(F.lit(now) - F.col("_at")) / F.lit(DAY) / RECENCY_DAYS), F.lit(0.0)) - F.when(F.col("faded") != 0, w["faded"]).otherwise(0.0)
    if not query:
        score += 0.01 * F.col("id")
    invented = (F.col("source") != "agent") & F.lower("text").startswith("learned:")
    score *= F.when(invented, w["invented"]).otherwise(1.0)
    rows = rows.withColumn("score", score)
    old = instant(F.col("valid_to")) < now
    if stale is not None:
        rows = rows.join(stale.select("id").distinct().withColumn("_stale", F.lit(True)), "id", "left")
        old = old | F.col("_stale")
    rows = rows.withColumn("score", F.col("score") * F.when(old, STALE).otherwise(1.0))
    return rows.orderBy(F.desc("score"), F.desc("id")).limit(limit).select("id", "title", "score")


def supersede_cap(scores: dict[int, float], outgoing: dict[int, list[int]], window: int = 10, step: float = 1e-4) -> dict[int, float]:
    """Hold each superseded hit below the best of its successors among the top ``window``, until nothing changes."""
    scores = dict(scores)
    for _ in range(len(scores)):
        top = set(sorted(scores, key=lambda i: (-scores[i], -i))[:window])
        moved = False
        for old, new in outgoing.items():
            best = max((scores[n] for n in new if n in top and n in scores), default=None)
            if old in scores and best is not None and scores[old] >= best:
                scores[old], moved = best - step, True
        if not moved:
            break
    return scores


def timeline_around(df: DataFrame, anchor: int, before: int = 5, after: int = 5) -> DataFrame:
    """``(id, offset)`` of the episodes next to ``anchor`` by time of creation and id."""
    rows = episodes(df).select("id", instant(F.col("created_at")).alias("at")).where("at is not null")
    middle = rows.where(F.col("id") == anchor).select(F.col("at").alias("_at"), F.col("id").alias("_id"))
    around = rows.join(F.broadcast(middle))  # one row
    later = around.where((F.col("at") > F.col("_at")) | ((F.col("at") == F.col("_at")) & (F.col("id") > F.col("_id")))).orderBy("at", "id").limit(after)
    sooner = around.where((F.col("at") < F.col("_at")) | ((F.col("at") == F.col("_at")) & (F.col("id") < F.col("_id")))).orderBy(F.desc("at"), F.desc("id")).limit(before)
    place = lambda rows, order, sign: rows.select("id", (F.row_number().over(Window.orderBy(*order)) * sign).alias("offset"))  # noqa: E731  (a few rows)
    return place(sooner, [F.desc("at"), F.desc("id")], -1).unionByName(middle.select(F.col("_id").alias("id"), F.lit(0).alias("offset"))).unionByName(place(later, ["at", "id"], 1))


def time_bucket(at: Column, now: int) -> Column:
    """today, yesterday, this week (the six days before), or the month."""
    day = F.to_date(F.timestamp_micros((at / 1000).cast("bigint")))
    ago = F.datediff(F.to_date(F.timestamp_micros(F.lit(now // 1000))), day)
    return F.when(ago <= 0, "today").when(ago == 1, "yesterday").when(ago < 7, "this week").otherwise(F.date_format(day, "yyyy-MM"))


def status(df: DataFrame, now: int, days: int = 14) -> DataFrame:
    """One row of counts: by kind and state, of recent days, and shares."""
    rows = episodes(df).withColumn("_at", instant(F.col("created_at")))
    kinds = ("prompt", "tool", "working", "session", "pin", "teaching", "observation")
    n = F.count("*")
    return rows.agg(
        n.alias("episodes"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.count_if(F.col("pinned") != 0).alias("pinned"), F.count_if(F.col("faded") != 0).alias("faded"),
        F.count_if(F.col("embedding_pending") != 0).alias("pending"), F.count_distinct(F.when(F.col("session_id") != "", F.col("session_id"))).alias("sessions"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.count_if(F.col("_at") >= now - days * DAY).alias("recent"), F.coalesce(F.try_divide(F.count_if(F.col("topic") != ""), n), F.lit(0.0)).alias("topic_share"),
    )


def activity(df: DataFrame) -> DataFrame:
    """``(day, episodes)`` by day of creation, UTC."""
    day = F.to_date(F.timestamp_micros((instant(F.col("created_at")) / 1000).cast("bigint")))
    return episodes(df).groupBy(F.date_format(day, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("episodes"))


def retained(df: DataFrame, now: int, days: float) -> DataFrame:
    """The episodes not older than ``days``, and those pinned, taught, or never to decay."""
    held = (F.col("pinned") != 0) | F.col("kind").isin(*KEPT_KINDS) | (F.col("never_decay") != 0)
    return episodes(df).where(F.coalesce(held, F.lit(False)) | (instant(F.col("created_at")) >= F.lit(int(now - days * DAY))))


def merged_edges(edges: DataFrame) -> DataFrame:
    """``(source_id, target_id, type, weight, updated_at)``: weights of repeated edges add up, the last update counts."""
    return edges.groupBy("source_id", "target_id", "type").agg(F.sum("weight").alias("weight"), F.max("updated_at").alias("updated_at"))


def decayed_edges(edges: DataFrame, df: DataFrame, now: int, half_life: float = EDGE_HALF_LIFE) -> DataFrame:
    """Edges with their weight halved for each ``half_life`` days since their update; those that fall below
    ``EDGE_LEAST`` are gone, those of an episode never to decay stay as they are."""
    held = episodes(df).where("never_decay <> 0").select("id")
    age = (F.lit(now) - instant(F.col("updated_at"))) / F.lit(DAY)
    ends = edges.join(held.select(F.col("id").alias("source_id")).withColumn("_a", F.lit(True)), "source_id", "left").join(held.select(F.col("id").alias("target_id")).withColumn("_b", F.lit(True)), "target_id", "left")
    fades = F.col("_a").isNull() & F.col("_b").isNull() & F.coalesce(age > 0, F.lit(False))
    out = ends.withColumn("_w", F.when(fades, F.col("weight") * F.pow(F.lit(0.5), age / half_life)).otherwise(F.col("weight")))
    return out.where(~fades | (F.col("_w") >= EDGE_LEAST)).select("source_id", "target_id", "type", F.col("_w").alias("weight"), "updated_at")


def session_edges(df: DataFrame, reach: int = 7) -> DataFrame:
    """``(source_id, target_id, type)``: a prompt to the next of its session, and same_session to the ``reach`` after it."""
    rows = episodes(df).where("kind = 'prompt' and session_id <> ''").select("session_id", "id", instant(F.col("created_at")).alias("at"))
    order = Window.partitionBy("session_id").orderBy("at", "id")
    ahead = rows.select("id", *[F.lead("id", k).over(order).alias(f"n{k}") for k in range(1, reach + 1)])
    kinds = [F.struct(F.col("n1").alias("target_id"), F.lit("next").alias("type"))] + [F.struct(F.col(f"n{k}").alias("target_id"), F.lit("same_session").alias("type")) for k in range(1, reach + 1)]
    return ahead.select(F.col("id").alias("source_id"), F.explode(F.array(*kinds)).alias("e")).select("source_id", "e.target_id", "e.type").where("target_id is not null")


def topic_labels(df: DataFrame) -> DataFrame:
    """``(community_id, label, episodes)``: the commonest directory of a topic's files, if two episodes share it, else the
    first four words of its most central title."""
    rows = episodes(df).where("community_id <> ''")
    files = rows.select("community_id", "id", F.explode(F.from_json("files", "array<string>")).alias("f")).where(F.contains("f", F.lit("/")))
    dirs = files.select("community_id", "id", F.regexp_replace("f", "/[^/]*$", "").alias("dir")).groupBy("community_id", "dir").agg(F.count_distinct("id").alias("n")).where("n >= 2")
    best = dirs.groupBy("community_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "dir"))["dir"].alias("dir"))
    titles = rows.groupBy("community_id").agg(F.min(F.struct((-F.coalesce("centrality", F.lit(0.0))).alias("c"), "id", "title"))["title"].alias("title"), F.count("*").alias("episodes"))
    four = F.array_join(F.slice(F.split(F.trim("title"), r"\s+"), 1, 4), " ")
    return titles.join(best, "community_id", "left").select("community_id", F.coalesce("dir", four).alias("label"), "episodes")


def patterns(df: DataFrame) -> DataFrame:
    """``(topic, episodes, sessions)`` of the topics that occur."""
    return episodes(df).where("topic <> ''").groupBy("topic").agg(F.count("*").alias("episodes"), F.count_distinct(F.when(F.col("session_id") != "", F.col("session_id"))).alias("sessions"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for null."""
    return F.coalesce(F.floor((F.length(text) + 3) / 4), F.lit(0))


def chunks(df: DataFrame, key: str, text: str, size: int = 256, overlap: int = 48, least: int = 12) -> DataFrame:
    """``(id, chunk, words, text)``: texts of more than ``size`` estimated tokens in overlapping pieces of ``size`` words, shorter ones whole.

    Of a text in pieces those under ``least`` characters are left out; blank texts have none.
    """
    bare = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    words = F.filter(F.split(bare, " "), lambda w: w != "")
    rows = df.select(F.col(key).alias("id"), words.alias("w"), (token_estimate(F.trim(F.col(text))) <= size).alias("whole")).where(F.size("w") > 0)
    step = size - overlap
    count = F.when(F.col("whole"), 1).otherwise(F.greatest(F.ceil((F.size("w") - overlap) / step), F.lit(1))).cast("int")
    cut = rows.select("id", "w", "whole", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk")).select("id", "chunk", "whole", F.when(F.col("whole"), F.col("w")).otherwise(F.slice("w", F.col("chunk") * step + 1, size)).alias("w"))
    return cut.select("id", "chunk", F.size("w").alias("words"), F.array_join("w", " ").alias("text"), "whole").where(F.col("whole") | (F.length("text") >= least)).drop("whole")


def unwrapped(text: Column, most: int = 8) -> Column:
    """The text without up to ``most`` envelopes that tools put before it; an envelope that does not end takes the text up to a
    blank line, or all of it."""
    tags = "|".join(ENVELOPES)

    def step(s: Column) -> Column:
        closed = rf"(?s)^<({tags})>.*?(?i:</\1>)"
        rest = F.when(F.contains(s, F.lit("\n\n")), F.regexp_replace(s, r"(?s)^.*?\n\n", ""))
        bare = F.when(s.rlike(closed), F.regexp_replace(s, closed, "")).when(s.rlike(rf"^<({tags})>"), F.coalesce(rest, F.lit("")))
        note = F.when(F.startswith(s, F.lit(SKILL_NOTE)), F.coalesce(rest, F.when(F.contains(s, F.lit("\n")), F.regexp_replace(s, r"(?s)^.*?\n", "")), F.lit("")))
        return _bare(F.coalesce(bare, note, s))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), _bare(text), lambda s, _: step(s))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def entity_tags(text: Column, looked_at: int = 24, most: int = 12) -> Column:
    """Up to ``most`` names in the text, joined by commas: of the first ``looked_at`` words of three characters or more, those
    that are no common word, not longer than 48 characters, and have a capital or five characters."""
    words = F.slice(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9_\-./]{2,}"), F.lit(0)), 1, looked_at)
    good = F.filter(words, lambda w: (F.length(w) <= 48) & ~F.lower(w).isin(*UNTAGGED) & (w.rlike("[A-Z]") | (F.length(w) >= 5)))
    return F.array_join(F.slice(F.array_distinct(good), 1, most), ",")


def content_hash(*parts: Column) -> Column:
    """The digest a record is known by, whatever its id."""
    return F.sha2(F.concat_ws("|", F.lit("idem:sha256"), *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def foreign_share(text: Column) -> Column:
    """The share of letters that are Han, Hiragana, Katakana, Hangul or Cyrillic."""
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsCyrillic}]")), F.regexp_count(text, F.lit(r"\p{L}"))), F.lit(0.0))


def injected(text: Column) -> Column:
    """Whether a text gives orders to a model."""
    low = F.lower(text)
    return F.coalesce(F.exists(F.array(*map(F.lit, INJECTED)), lambda p: F.contains(low, p)), F.lit(False))


def noise(text: Column) -> Column:
    """Whether a text was put in by a tool, is a fenced block, or a dump of graph rows."""
    bare = _bare(text)
    lines = F.concat(F.lit("\n"), F.regexp_replace(bare, "^[\u200b\ufeff]+\\s*", ""))
    starts = F.exists(F.array(*[F.lit(f"<{e}>") for e in ENVELOPES], F.lit(SKILL_NOTE)), lambda p: F.startswith(bare, p))
    dump = F.startswith(lines, F.lit("\n```")) | (F.regexp_count(lines, F.lit("\nNODE ")) >= 3) | (F.regexp_count(lines, F.lit("\nEDGE ")) >= 3)
    return F.coalesce((bare == "") | (bare == INTERRUPTED) | starts | dump, F.lit(True))


def admissible(df: DataFrame, least: int = 12, foreign: float = 0.25, clip: int | None = None) -> DataFrame:
    """Texts worth keeping: long enough, not mostly of other scripts, no orders to a model, no noise; whole unless ``clip`` gives a length."""
    good = df.where((F.length(_bare(F.col("text"))) >= least) & (foreign_share(F.col("text")) < foreign) & ~injected(F.col("text")) & ~noise(F.col("text")))
    return good if clip is None else good.withColumn("text", F.left(_bare(F.col("text")), F.lit(clip)))


def contradictions(df: DataFrame, closed: DataFrame) -> DataFrame:
    """Episodes with ``valid_to`` closed where ``closed(id, at)`` says that another took their place; a sooner end stays."""
    ends = closed.groupBy("id").agg(F.min("at").alias("_end"))
    out = episodes(df).join(ends, "id", "left")
    sooner = instant(F.col("valid_to")) <= instant(F.col("_end"))
    return out.withColumn("valid_to", F.when(F.col("_end").isNotNull() & ~F.coalesce(sooner, F.lit(False)), F.col("_end")).otherwise(F.col("valid_to"))).drop("_end")


def within_budget(df: DataFrame, order: list, tokens: Column, budget: int) -> DataFrame:
    """The first rows of a short ranked list whose tokens add up to at most ``budget``; the first always stays."""
    rows = df.withColumn("_sum", F.sum(tokens).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return rows.where((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_sum", "_n")


def recall(df: DataFrame, query: str, now: int, stale: DataFrame | None = None, budget: int = 1500, most_stale: int = 3) -> DataFrame:
    """``(id, score, stale)``: what a search finds within a budget of tokens, and at most ``most_stale`` hits that no longer hold."""
    hits = hybrid_search(df, query, now, limit=40, stale=stale)
    rows = hits.join(episodes(df).select("id", F.coalesce("tokens", F.lit(0)).alias("tokens"), (instant(F.col("valid_to")) < now).alias("_old")), "id")
    if stale is not None:
        rows = rows.join(stale.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left").withColumn("_old", F.coalesce("_old", F.lit(False)) | F.coalesce("_gone", F.lit(False))).drop("_gone")
    rows = rows.withColumn("stale", F.coalesce("_old", F.lit(False)))
    order = [F.desc("score"), F.desc("id")]
    fresh = within_budget(rows.where("not stale"), order, F.col("tokens"), budget)
    return fresh.unionByName(rows.where("stale").orderBy(*order).limit(most_stale)).select("id", "score", "stale")


def observations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(observations, edges)``: prompts that are no questions as observations, and the edges to what they came from."""
    question = F.trim("text").rlike(r"(?i)\?\s*$|^\s*(?:who|what|when|where|why|how|which|can|could|should|would|is|are|does|do|did)\b")
    rows = episodes(df).where((F.col("kind") == "prompt") & (F.trim("text") != "") & ~question)
    uid = F.concat(F.lit("obs-"), F.substring(content_hash(F.col("uid"), F.col("text")), 1, 16))
    made = rows.select(uid.alias("uid"), F.lit("observation").alias("kind"), F.lit("observer").alias("source"), "session_id", "title", "text", "created_at", "id")
    return made.drop("id"), made.select(F.col("uid").alias("source_uid"), F.col("id").alias("target_id"), F.lit("rolled_up_from").alias("type"))


def session_rollups(df: DataFrame) -> DataFrame:
    """``(session_id, text)``: ``request:`` the last of a session's first prompts (at most 8), ``learned:`` its first telling observation."""
    line = lambda c, n: F.left(F.split_part(F.trim(c), F.lit("\n"), F.lit(1)), F.lit(n))
    rows = episodes(df).where("session_id <> ''").withColumn("_at", instant(F.col("created_at")))
    order = Window.partitionBy("session_id", "kind").orderBy("_at", "id")
    ranked = rows.where("kind in ('prompt', 'observation')").withColumn("_n", F.row_number().over(order))
    asked = ranked.where("kind = 'prompt' and _n <= 8").groupBy("session_id").agg(F.max_by(F.coalesce(F.nullif(line("text", 240), F.lit("")), line("title", 80)), "_n").alias("request"))
    told = ranked.where("kind = 'observation' and _n <= 16 and topic in ('decision', 'bugfix', 'feature', 'refactor', 'discovery')").groupBy("session_id").agg(F.min_by(line(F.concat_ws(" ", "title", "text"), 200), "_n").alias("learned"))
    both = asked.join(told, "session_id", "full")
    text = F.concat_ws("\n", F.when(F.col("request") != "", F.concat(F.lit("request: "), "request")), F.when(F.col("learned") != "", F.concat(F.lit("learned: "), "learned")))
    return both.select("session_id", F.when(text == "", "request:").otherwise(text).alias("text"))


def reinforced(df: DataFrame, ids: list[int], step: float = 0.05) -> DataFrame:
    """Episodes with the centrality of ``ids`` raised by ``step``, at most to 1."""
    return episodes(df).withColumn("centrality", F.when(F.col("id").isin(ids), F.least(F.coalesce("centrality", F.lit(0.0)) + step, F.lit(1.0))).otherwise(F.col("centrality")))


def topic_edges(edges: DataFrame, vectors: DataFrame, newest: int = 80, least: float = 0.72) -> DataFrame:
    """``(a, b, w)`` of what topics are clustered from: edges summed both ways, and each of the ``newest`` vectors'
    most similar other of a cosine above ``least`` (compared within that bounded set only)."""
    from marlstone.operators.vectors import cosine

    linked = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), F.col("weight").alias("w")).where("a <> b")
    recent = vectors.select("episode_id", "vector").orderBy(F.desc("episode_id")).limit(newest)
    pairs = recent.toDF("a", "va").join(recent.toDF("b", "vb"), F.col("a") != F.col("b")).withColumn("w", cosine("va", "vb")).where(F.col("w") > least)
    best = pairs.groupBy("a").agg(F.max(F.struct("w", "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b"), "m.w")
    return linked.unionByName(best.distinct()).groupBy("a", "b").agg(F.sum("w").alias("w"))


def stable_labels(found: DataFrame, before: DataFrame) -> DataFrame:
    """``(id, community)`` with the labels of an earlier run where communities overlap: the greatest overlap first, each label once.

    The overlaps are a row per pair of communities that share a member, so as many as there are communities, not members.
    """
    overlap = found.join(before.toDF("id", "old"), "id").groupBy("community", "old").agg(F.count("*").alias("n"))
    mine = overlap.withColumn("_r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "old"))).where("_r = 1")
    taken = mine.withColumn("_r", F.row_number().over(Window.partitionBy("old").orderBy(F.desc("n"), "community"))).where("_r = 1").select("community", "old")
    return found.join(taken, "community", "left").select("id", F.coalesce("old", "community").alias("community"))


def pack(df: DataFrame, now: int, budget: int = 800) -> DataFrame:
    """``(place, id, line)``: the lines of a session's opening pack, best first, within a budget of tokens."""
    hits = hybrid_search(df, "", now, limit=60)
    lines = hits.join(episodes(df).select("id", "kind", F.left(F.split_part(F.trim("text"), F.lit("\n"), F.lit(1)), F.lit(140)).alias("first")), "id")
    lines = lines.withColumn("line", F.concat(F.lit("- ["), "kind", F.lit("] "), F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("first", F.lit(""))))
    kept = within_budget(lines, [F.desc("score"), F.desc("id")], F.ceil(F.length("line") / 4), budget)
    return kept.select(F.row_number().over(Window.orderBy(F.desc("score"), F.desc("id"))).alias("place"), "id", "line")
