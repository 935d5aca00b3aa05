"""Sessions from spans: resolving ids, dropping repeats, rolling up, merging, searching."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Attribute keys in order of trust, and ids that name no session.
SESSION_KEYS = ("gen_ai.conversation.id", "coding_agent.session.id", "coding_agent.session_id", "session.id", "session_id")
PLACEHOLDERS = ("", "unknown", "null", "undefined", "nil", "none")
FILE_KEY, TOKENS_KEY, TOOL_KEY, COST_KEYS = "coding_agent.file_path", "gen_ai.usage.total_tokens", "gen_ai.tool.name", ("gen_ai.usage.cost", "gen_ai.usage.cost_usd", "coding_agent.session.cost_usd")
PARENT_KEYS = ("coding_agent.agent.parent_id", "coding_agent.parent_conversation.id", "gen_ai.conversation.parent_id")
EARLIEST = 946_684_800_000_000_000  # the year 2000


def known(value: Column) -> Column:
    """The trimmed value, or null if it is a placeholder."""
    bare = F.trim(value)
    return F.when(~F.lower(bare).isin(*PLACEHOLDERS), bare)


def resolved(spans: DataFrame) -> DataFrame:
    """Spans once per id, the last end counting, with ``session`` from the first attribute that names one, else ``session_id``."""
    session = F.coalesce(*[known(F.col("attributes")[k]) for k in SESSION_KEYS], known(F.col("session_id")))
    keep = ["trace_id", "parent_span_id", "name", "start_time_unix_nano", "status"]
    rows = spans.where(F.col("span_id").isNotNull()).select("span_id", F.struct(F.col("end_time_unix_nano").alias("end"), *keep, session.alias("session"), F.map_entries("attributes").alias("entries")).alias("r"))
    return rows.groupBy("span_id").agg(F.max("r").alias("r")).select("span_id", *[F.col(f"r.{c}").alias(c) for c in keep], F.col("r.end").alias("end_time_unix_nano"), F.col("r.session").alias("session"), F.map_from_entries("r.entries").alias("attributes"))


def adopted(spans: DataFrame) -> DataFrame:
    """Resolved spans in which those without a session take that of their trace, if the trace has just one."""
    traces = spans.where("session is not null").groupBy("trace_id").agg(F.min("session").alias("_a"), F.max("session").alias("_b")).where("_a = _b").select("trace_id", "_a")
    return spans.join(traces, "trace_id", "left").withColumn("session", F.coalesce("session", "_a")).drop("_a")


def usage(spans: DataFrame, root: str = "coding_agent.session", stop: str = "coding_agent.session.loop.stop") -> DataFrame:
    """``(session, tokens, cost)``: taken once, from the last span called ``root`` that tells of tokens, else from the last ``stop`` that does."""
    rows = spans.where(F.col("session").isNotNull() & F.col("name").isin(root, stop) & (F.trim(F.col("attributes")[TOKENS_KEY]) != ""))
    cost = F.coalesce(*[F.col("attributes")[k].try_cast("double") for k in COST_KEYS], F.lit(0.0))
    best = rows.groupBy("session").agg(F.max(F.struct((F.col("name") == root).alias("root"), "start_time_unix_nano", "span_id", F.col("attributes")[TOKENS_KEY].alias("t"), cost.alias("c"))).alias("r"))
    return best.select("session", F.coalesce(F.col("r.t").try_cast("bigint"), F.lit(0)).alias("tokens"), F.col("r.c").alias("cost"))


def parent_of(attributes: Column, session: Column) -> Column:
    """The session that a span's attributes name as the parent of its own; null if there is none or it is itself."""
    up = F.coalesce(*[F.nullif(attributes[k], F.lit("")) for k in PARENT_KEYS])
    return F.when(~up.eqNullSafe(session), up)


def parents(spans: DataFrame) -> DataFrame:
    """``(session, parent_id, is_subagent)`` of each session: the greatest parent any span names; a session with one, or
    that any span marks so, is a subagent's."""
    own = spans.where("session is not null").select("session", parent_of(F.col("attributes"), F.col("session")).alias("up"), "attributes")
    marked = F.col("attributes")["coding_agent.session.is_subagent"].isin("true", "1") | (F.col("attributes")["coding_agent.agent.type"] == "subagent") | F.col("up").isNotNull()
    return own.groupBy("session").agg(F.max("up").alias("parent_id"), F.max(F.coalesce(marked, F.lit(False))).alias("is_subagent"))


def turn_counts(spans: DataFrame, turn: str = "coding_agent.llm.turn") -> DataFrame:
    """``(session, turns)``: the spans of a session that carry a user's prompt, else those called ``turn`` or that complete one."""
    name, attr = F.lower("name"), lambda k: F.coalesce(F.col("attributes")[k], F.lit(""))
    said = F.lower(attr("gen_ai.input.messages"))
    asks = name.rlike(r"user[_.]prompt") | (attr("gen_ai.prompt") != "") | (attr("gen_ai.content.prompt") != "") | said.rlike(r'"role": ?"user"|"role":"user_prompt"')
    done = (name == turn) | name.contains("completion")
    sums = spans.where("session is not null").groupBy("session").agg(F.count_if(asks).alias("asked"), F.count_if(done).alias("done"))
    return sums.select("session", F.when(F.col("asked") > 0, F.col("asked")).otherwise(F.col("done")).alias("turns"))


def footprint(spans: DataFrame) -> DataFrame:
    """``(session, path, touches, state)``: how often and at most how a session touched a file: edited, read or seen."""
    rows = spans.where(F.col("session").isNotNull()).select("session", F.col("attributes")[FILE_KEY].alias("path"), "name", F.col("attributes")[TOOL_KEY].alias("tool")).where("path <> ''")
    edit = F.coalesce(F.col("tool").rlike("(?i)write|edit|patch"), F.lit(False)) | (F.col("name") == "edit")
    read = F.coalesce(F.col("tool").rlike("(?i)read"), F.lit(False))
    level = F.when(edit, 3).when(read, 2).otherwise(1)
    sums = rows.groupBy("session", "path").agg(F.count("*").alias("touches"), F.max(level).alias("level"))
    return sums.select("session", "path", "touches", F.element_at(F.array(*map(F.lit, ("seen", "read", "edited"))), F.col("level")).alias("state"))


def materialised(spans: DataFrame, now: int) -> DataFrame:
    """``(session, spans, traces, started, ended, errors)``: the least start that makes sense and the greatest end."""
    sane = F.when(F.col("start_time_unix_nano").between(EARLIEST, now + 86_400_000_000_000), F.col("start_time_unix_nano"))
    return spans.where("session is not null").groupBy("session").agg(
        F.count("*").alias("spans"), F.count_distinct("trace_id").alias("traces"), F.min(sane).alias("started"), F.max(F.greatest("start_time_unix_nano", "end_time_unix_nano")).alias("ended"), F.count_if(F.lower("status") == "error").alias("errors")
    )


def latest(spans: DataFrame, top: int = 1) -> DataFrame:
    """The sessions that ended last (a top list)."""
    return materialised(spans, 2**62).orderBy(F.desc("ended"), "session").limit(top).select("session", "ended")


def without_repeats(spans: DataFrame) -> DataFrame:
    """Spans less repeats within a session (without one, within a trace): of equal thoughts the first stays, and a
    ``read_file`` span goes if a read of the same path is there already.

    Thoughts and paths are reduced before they are exchanged, so a session of most of the spans is no burden.
    """
    attr = lambda k: F.nullif(F.trim(F.col("attributes")[k]), F.lit(""))
    name, tool = F.lower("name"), F.coalesce(F.lower(attr(TOOL_KEY)), F.lit(""))
    rows = spans.withColumns({
        "_group": F.coalesce("session", F.concat(F.lit("\0"), "trace_id")), "_path": F.coalesce(attr(FILE_KEY), attr("code.file.path")),
        "_thought": F.when(name.contains("thought"), attr("coding_agent.llm.thought.text")),
        "_read": (tool == "read") | (name == "coding_agent.read"), "_again": (tool == "read_file") | name.contains("read_file"),
    })
    first = rows.where("_thought is not null").groupBy("_group", "_thought").agg(F.min(F.struct("start_time_unix_nano", "span_id"))["span_id"].alias("_first"))
    read = rows.where("_read and _path is not null").select(F.col("_group").alias("_g"), F.col("_path").alias("_p")).distinct()
    thoughts = rows.where("_thought is not null").join(first, ["_group", "_thought"]).where("span_id = _first")
    rest = rows.where("_thought is null").unionByName(thoughts.select(rows.columns))
    other = rest.where("not coalesce(_again and _path is not null, false)")
    again = rest.where("_again and _path is not null").join(read, (F.col("_group") == F.col("_g")) & (F.col("_path") == F.col("_p")), "left_anti")
    return other.unionByName(again).select(spans.columns)


def newest_meta(meta: DataFrame) -> DataFrame:
    """One row per session id: the last started, then the greatest."""
    rows = meta.where(F.col("id").isNotNull()).select("id", F.struct("started_at", *[c for c in meta.columns if c not in ("id", "started_at")]).alias("r"))
    return rows.groupBy("id").agg(F.max("r").alias("r")).select("id", "r.*")


def sticky(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Both tables merged by ``key``: a value of ``new`` wins unless it is null or an empty text."""
    columns = [c for c in old.columns if c != key]
    filled = lambda t, c: F.nullif(F.col(f"{t}.{c}"), F.lit("")) if dict(old.dtypes)[c] == "string" else F.col(f"{t}.{c}")
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[F.coalesce(filled("n", c), F.col(f"o.{c}")).alias(c) for c in columns])


def children(meta: DataFrame) -> DataFrame:
    """``(id, children, subagents)`` of sessions that have child sessions."""
    rows = newest_meta(meta)
    linked = rows.where((F.col("parent_id") != "") & (F.col("parent_id") != F.col("id"))).groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"), F.count_if("is_subagent").alias("subagents"))
    return linked.join(rows.select("id"), "id", "left_semi")


def facets(meta: DataFrame) -> DataFrame:
    """``(facet, value, sessions)`` of vendors, models and projects."""
    rows = newest_meta(meta)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in (("vendor", "vendor"), ("model", "model"), ("project", "project_id"))]))
    return rows.select(pairs.alias("p")).select("p.*").where("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("sessions"))


_TERM = re.compile(r"(\w+):(\"[^\"]*\"|\S+)|\"([^\"]*)\"|(\S+)")


def parse_query(text: str) -> tuple[dict[str, list[str]], list[str]]:
    """``(filters, words)`` of a session query such as ``vendor:codex model:heron "two words" word``."""
    filters: dict[str, list[str]] = {}
    words = []
    for m in _TERM.finditer(text):
        if m[1] and m[1].lower() in ("vendor", "model", "project", "status", "branch"):
            filters.setdefault(m[1].lower(), []).append(m[2].strip('"').lower())
        else:
            words.append((m[3] or m[0]).lower())
    return filters, words


def search(meta: DataFrame, text: str) -> DataFrame:
    """``(id, matched)``: sessions that meet every filter and word; ``matched`` is the first field a word was found in."""
    filters, words = parse_query(text)
    rows = newest_meta(meta)
    columns = {"vendor": "vendor", "model": "model", "project": "project_id", "status": "status", "branch": "branch"}
    for name, values in filters.items():
        tests = [F.contains(F.lower(columns[name]), F.lit(v)) for v in values]
        rows = rows.where(F.exists(F.array(*tests), lambda t: F.coalesce(t, F.lit(False))))
    matched = F.lit(None).cast("string")
    for word in words:
        where = F.coalesce(*[F.when(F.contains(F.lower(c), F.lit(word)), c) for c in ("title", "prompt_preview", "id", "vendor", "model")])
        rows = rows.where(where.isNotNull())
        matched = where
    return rows.select("id", matched.alias("matched"))


def expired(meta: DataFrame, cutoff: str) -> DataFrame:
    """The ids of sessions whose last time is before ``cutoff``."""
    return newest_meta(meta).where(F.greatest("started_at", "ended_at") < F.lit(cutoff).cast("timestamp_ntz")).select("id")


def version_control(spans: DataFrame) -> DataFrame:
    """``(session, branch, head, commits, pull_requests)``: the first branch and head named, commits by digest and requests by url or
    number, the last word on each counting."""
    a = lambda k: F.nullif(F.col("attributes")[k], F.lit(""))
    rows = spans.where("session is not null").select("session", "start_time_unix_nano", "span_id", a("vcs.ref.head.name").alias("branch"), a("vcs.ref.head.revision").alias("head"), a("coding_agent.git.commit.sha").alias("sha"), a("coding_agent.git.commit.message").alias("message"), F.coalesce(a("coding_agent.git.pull_request.url"), a("coding_agent.git.pull_request.number")).alias("pr"))
    order = F.struct("start_time_unix_nano", "span_id")
    commits = rows.where("sha is not null").groupBy("session", "sha").agg(F.max_by("message", order).alias("message")).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("sha", "message"))).alias("commits"))
    requests = rows.where("pr is not null").groupBy("session").agg(F.array_sort(F.collect_set("pr")).alias("pull_requests"))
    heads = rows.groupBy("session").agg(F.min_by("branch", F.when(F.col("branch").isNotNull(), order)).alias("branch"), F.min_by("head", F.when(F.col("head").isNotNull(), order)).alias("head"))
    return heads.join(commits, "session", "left").join(requests, "session", "left")


def replay(spans: DataFrame) -> DataFrame:
    """``(session, ms, path, state, visit)``: file touches in order, with the time since the session's start and the file's visit number."""
    path, tool = F.col("attributes")[FILE_KEY], F.col("attributes")[TOOL_KEY]
    edit = F.coalesce(tool.rlike("(?i)write|edit|patch"), F.lit(False)) | (F.col("name") == "edit")
    rows = spans.where(F.col("session").isNotNull() & (path != "")).select("session", "span_id", "start_time_unix_nano", path.alias("path"), F.when(edit, "edited").when(F.coalesce(tool.rlike("(?i)read"), F.lit(False)), "read").otherwise("seen").alias("state"))
    starts = spans.where("session is not null").groupBy("session").agg(F.min("start_time_unix_nano").alias("_start"))
    visits = Window.partitionBy("session", "path").orderBy("start_time_unix_nano", "span_id")
    return rows.join(starts, "session").select("session", F.floor((F.col("start_time_unix_nano") - F.col("_start")) / 1_000_000).alias("ms"), "path", "state", F.row_number().over(visits).alias("visit"), "span_id")


def claims(spawns: DataFrame, starts: DataFrame, patience: int = 180_000_000_000) -> DataFrame:
    """``(child, parent)``: each started session takes the first spawn of its vendor no other took and that is not older than ``patience``.

    ``spawns(vendor, parent, at)``, ``starts(vendor, child, at)``, times in nanoseconds. A vendor's queue is cut where no spawn
    can still wait, so a busy vendor is many small groups. The cuts are found between spans of time as long as ``patience``,
    of which a vendor has a bounded number however many its events are.
    """
    events = spawns.select("vendor", "at", F.lit(0).alias("kind"), F.col("parent").alias("who")).unionByName(starts.select("vendor", "at", F.lit(1).alias("kind"), F.col("child").alias("who")))
    events = events.withColumn("_span", F.floor(F.col("at") / patience))
    spans = events.groupBy("vendor", "_span").agg(F.min("at").alias("_from"), F.max("at").alias("_to"))
    order = Window.partitionBy("vendor").orderBy("_span")
    cut = F.coalesce(F.col("_from") - F.lag("_to").over(order) > patience, F.lit(True)).cast("int")
    groups = spans.withColumn("_cut", cut).select("vendor", "_span", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_group"))
    grouped = events.join(groups, ["vendor", "_span"])

    def follow(frame):
        import pandas as pd

        waiting, out = [], []
        for r in frame.sort_values(["at", "kind", "who"]).itertuples(index=False):
            if r.kind == 0:
                waiting.append((r.at, r.who))
            else:
                waiting = [w for w in waiting if r.at - w[0] <= patience]
                if waiting:
                    out.append((r.who, waiting.pop(0)[1]))
        return pd.DataFrame(out, columns=["child", "parent"])

    return grouped.groupBy("vendor", "_group").applyInPandas(follow, "child string, parent string")
