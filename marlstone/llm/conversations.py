"""Rebuilding conversations from message rows.

Messages come in several versions, from several senders' clocks, late and out of order. The last received version
of each message counts. Messages of a user and an assistant form turns; that a turn's first words must be said
before its last answer is a constraint between the two senders' clocks, and so is that the tools of a turn work between
the two, which bounds their clock from both sides. All constraints of a session are differences of two clocks, so
that they shrink to the greatest per pair of senders before anything is exchanged, a few numbers however long the
session is. Of all offsets that meet them the least squares are taken, the times corrected by them, and the turns
merged in the corrected order. A session whose constraints can't be met by offsets of at most ``max_skew`` seconds,
that has no turn, or a turn without a message of words followed by an answer of words, is broken.

Verdicts need no text: a message is reduced to its speaker, times and whether it has words before it is exchanged,
and only the messages of kept sessions get their words back, by their ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.running import running_sums

# Spellings of the speakers.
SPEAKERS = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "model": "assistant", "system": "system", "tool": "tool"}
#: A character that shows: no space, control, format, or unassigned character, and no filler that looks like none.
VISIBLE = r"[^\s\p{Z}\p{C}⠀ㅤᅟᅠﾠ]"


#: The senders whose clocks may be off.
SENDERS = ("user", "assistant", "tool")
#: Sweeps of the solver; each brings the offsets nearer by a constant factor.
SWEEPS = 400


def visible(text: Column) -> Column:
    return F.coalesce(text.rlike(VISIBLE), F.lit(False))


def _newest(df: DataFrame, *fields: Column) -> DataFrame:
    """``message_id`` and ``fields`` of the last received version of each non-null ``message_id``; of equal ones one that a hash picks."""
    times = {c: F.col(c).cast("timestamp") for c in ("sent_at", "received_at")}
    pick = F.xxhash64("session_id", "role", "text", "prompt", "generation_id", "sent_at")
    rows = df.where(F.col("message_id").isNotNull()).withColumns(times)
    newest = rows.groupBy("message_id").agg(F.max(F.struct("received_at", pick.alias("_pick"), *fields)).alias("v"))
    return newest.select("message_id", "v.*").drop("_pick")


def spoken(df: DataFrame) -> DataFrame:
    """``session_id, message_id, speaker, worded, generation_id, sent_at, received_at``: newest versions that belong to a session. Blank session ids are none."""
    said = F.lower(F.regexp_replace("role", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    speaker = F.coalesce(*[F.when(said == k, v) for k, v in SPEAKERS.items()], F.when(F.col("role").isNull() & visible(F.col("prompt")), "user"))
    rows = _newest(
        df, "session_id", speaker.alias("speaker"), (visible(F.col("text")) | visible(F.col("prompt"))).alias("worded"),
        F.when(F.col("generation_id") != "", F.col("generation_id")).alias("generation_id"), "sent_at",
    )
    return rows.where(F.col("session_id").isNotNull() & (F.trim("session_id") != ""))


def with_turns(rows: DataFrame) -> DataFrame:
    """The user's and assistant's rows with ``key``, which tells the turns of a session apart."""
    talk = rows.where(F.col("speaker").isin("user", "assistant"))
    counted = running_sums(talk.where("generation_id is null"), ["session_id"], ["sent_at", "received_at", "message_id"], {"n": (F.col("speaker") == "user").cast("int")})
    named = talk.where("generation_id is not null").withColumn("key", F.concat(F.lit("g"), "generation_id"))
    return named.unionByName(counted.withColumn("key", F.concat(F.lit("n"), F.col("n").cast("string"))).drop("n"))


def least_squares(need: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The smallest offsets that meet difference constraints, a row per session.

    ``need[:, i, j]`` is the least that clock j must be put forward against clock i (``-inf`` if nothing is asked),
    ``most`` the most by which any may be moved. Returns the offsets and whether the constraints can be met: they can unless some loop of them asks for more
    than nothing. Offsets are projections onto the constraints in turn, each corrected by what it moved before.
    """
    n, k = need.shape[:2]
    # Node k is the true time, which stays: that a clock moves by at most so much are constraints to and from it.
    graph = np.full((n, k + 1, k + 1), -np.inf)
    graph[:, :k, :k] = need
    graph[:, :k, k] = graph[:, k, :k] = -most
    graph[:, range(k + 1), range(k + 1)] = 0  # nothing is asked of a clock against itself
    closed = graph.copy()
    for m in range(k + 1):
        closed = np.maximum(closed, closed[:, :, m : m + 1] + closed[:, m : m + 1, :])
    feasible = (np.diagonal(closed, axis1=1, axis2=2) <= 0).all(axis=1)
    offsets = np.zeros((n, k + 1))
    asked = np.flatnonzero(feasible & (graph > 0).any(axis=(1, 2)))  # the others are best left alone
    x, edges = np.zeros((len(asked), k + 1)), graph[asked]
    price = np.zeros_like(edges)
    for _ in range(SWEEPS):
        for i in range(k + 1):
            for j in range(k + 1):
                if i == j:
                    continue
                moves = np.array([-1.0 * (i < k), 1.0 * (j < k)])  # true time stays
                short = edges[:, i, j] - (x[:, j] - x[:, i])
                step = np.maximum(price[:, i, j] + np.where(np.isfinite(short), short, -np.inf) / np.abs(moves).sum(), 0) - price[:, i, j]
                price[:, i, j] += step
                x[:, i] += moves[0] * step
                x[:, j] += moves[1] * step
    offsets[asked] = x
    return offsets[:, :k], feasible


def _clocks(turns: DataFrame, max_skew: float, senders: tuple[str, ...]) -> DataFrame:
    """``session_id, feasible`` and an offset in seconds per sender, of every session with a turn."""
    micros = lambda c: F.unix_micros(f"{c}.sent_at")
    after = lambda one, two: F.when(F.col(one).isNotNull() & F.col(two).isNotNull(), F.coalesce(micros(one) - micros(two), F.lit(0)) + (F.col(one) >= F.col(two)).cast("bigint"))
    asks = {("user", "assistant"): F.max(after("ask", "answer"))}
    if "tool" in senders:
        asks |= {("user", "tool"): F.max(after("ask", "tool_end")), ("tool", "assistant"): F.max(after("tool_start", "answer"))}
    per_turn = turns.groupBy("session_id").agg(*[v.alias(f"{a}_{b}") for (a, b), v in asks.items()])
    links = list(asks)
    names = [f"{s}_offset" for s in senders]

    def solve(batches):
        for batch in batches:
            need = np.full((batch.num_rows, len(senders), len(senders)), -np.inf)
            for a, b in links:
                micros = batch.column(f"{a}_{b}").to_numpy(zero_copy_only=False).astype(np.float64)
                need[:, senders.index(a), senders.index(b)] = np.where(np.isnan(micros), -np.inf, micros / 1e6)
            offsets, feasible = least_squares(need, max_skew)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(feasible), *[pa.array(np.where(feasible, o, np.nan), from_pandas=True) for o in offsets.T]], ["session_id", "feasible", *names])

    return per_turn.mapInArrow(solve, "session_id string, feasible boolean, " + ", ".join(f"{n} double" for n in names))


class Conversations:
    """``sessions``: a verdict per session; ``messages``: the turns' messages in order, planned when asked for."""

    def __init__(self, df: DataFrame, sessions: DataFrame, rows: DataFrame, keyed: DataFrame, senders: tuple[str, ...]):
        self.sessions, self._df, self._rows, self._keyed, self._senders = sessions, df, rows, keyed, senders

    @property
    def messages(self) -> DataFrame:
        good = self.sessions.where("ok").select("session_id", *[f"{s}_offset" for s in self._senders])
        rest = self._rows.where("speaker is null or speaker not in ('user', 'assistant')").withColumn("key", F.lit(None).cast("string"))
        offset = F.coalesce(*[F.when(F.col("speaker") == s, F.col(f"{s}_offset")) for s in self._senders], F.lit(0.0))
        timed = self._keyed.unionByName(rest).join(good, "session_id").withColumn("at", F.timestamp_micros(F.unix_micros("sent_at") + F.round(offset * 1e6).cast("bigint")))
        timed = timed.select("session_id", "message_id", "speaker", "key", "at", "received_at")
        opened = timed.where("key is not null").groupBy("session_id", "key").agg(F.min(F.struct("at", "received_at", "message_id"))["message_id"].alias("opener"))
        marked = timed.join(opened, ["session_id", "key"], "left").withColumn("opens", (F.col("opener") == F.col("message_id")).cast("int")).drop("opener")
        placed = running_sums(marked, ["session_id"], ["at", "received_at", "message_id"], {"position": F.lit(1), "opened": F.coalesce("opens", F.lit(0))})
        numbers = placed.where("opens = 1").select("session_id", "key", F.col("opened").alias("turn"))
        words = _newest(self._df, F.when(visible(F.col("text")), F.col("text")).when(visible(F.col("prompt")), F.col("prompt")).alias("words")).select("message_id", "words")
        full = placed.join(numbers, ["session_id", "key"], "left").join(words, "message_id")
        return full.select("session_id", "turn", "position", "speaker", "words", "at", "message_id")


def rebuild(df: DataFrame, max_skew: float = 0.0, senders: tuple[str, ...] = SENDERS) -> Conversations:
    """Conversations of message rows with the columns of ``payload`` (others are ignored).

    ``sessions``: ``session_id, turns, whole_turns``, an offset in seconds for each of ``senders`` (null if the
    constraints can't be met or there is no turn) and ``ok``; every session with a message has a row.
    ``whole_turns`` are those that are whole by the times as sent. ``messages``: of the sessions that are ok,
    ``session_id, turn, position, speaker, words, at, message_id``; ``turn`` numbers the turns by
    their first message, ``position`` the messages of the session. Messages of equal time are ordered by the time
    received and id; a message without a time comes first. System and tool messages and those of unknown speakers
    are in no turn and keep a null ``turn``. Only clocks of ``senders`` are corrected. Empty input gives empty results.
    """
    rows = spoken(df)
    keyed = with_turns(rows)
    when = F.struct("sent_at", "received_at", "message_id")
    said = lambda who: F.when((F.col("speaker") == who) & F.col("worded"), when)
    heads = keyed
    if "tool" in senders:
        tools = rows.where("speaker = 'tool' and generation_id is not null").withColumn("key", F.concat(F.lit("g"), "generation_id"))
        heads = keyed.unionByName(tools)
    turns = heads.groupBy("session_id", "key").agg(
        F.min(said("user")).alias("ask"), F.max(said("assistant")).alias("answer"), F.min(said("tool")).alias("tool_start"), F.max(said("tool")).alias("tool_end"), F.count_if(F.col("speaker") != "tool").alias("talk"),
    ).where("talk > 0")
    both = F.col("ask").isNotNull() & F.col("answer").isNotNull()
    sums = turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.count_if(both).alias("answered"), F.count_if(both & (F.col("ask") < F.col("answer"))).alias("whole_turns"))
    everyone = rows.groupBy("session_id").agg(F.lit(1).alias("_one")).drop("_one")
    clocks = _clocks(turns, max_skew, senders)
    ok = F.coalesce((F.col("turns") > 0) & (F.col("answered") == F.col("turns")) & F.col("feasible"), F.lit(False))
    sessions = everyone.join(sums, "session_id", "left").join(clocks, "session_id", "left").select(
        "session_id", F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("whole_turns", F.lit(0)).alias("whole_turns"), *[f"{s}_offset" for s in senders], ok.alias("ok"),
    )
    return Conversations(df, sessions, rows, keyed, senders)
