"""Transcript parsing: a hidden Markov model recovers speaker roles line by line.

A state is a role together with "first line of a turn" or "later line". A line shows a speaker marker (or
none), whether it asks, how long it is and whether it is blank. Start, transition and emission
probabilities are counted over all labelled conversations that are not held out. Viterbi gives the best
states; every first line opens a turn, and turns are rendered in one canonical form.

A conversation may hold a large part of all lines, so it is decoded in blocks. A block's best scores from
each state before it to each state at its end form a matrix; folding the matrices (one small row per
block) fixes the states between blocks, and then all blocks are decoded on their own. This is the same
path as one pass over the conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.words import text_or_empty
from stockloom.operators.running import ranks
from stockloom.session import staged

ROLES = ("system", "user", "assistant")
BLOCK_TURNS = 512
LENGTHS = (20, 80, 200)

# Names of speakers in transcripts, by role.
SPEAKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "question", "q", "prompter", "instruction", "customer", "me"),
    "assistant": ("assistant", "answer", "a", "bot", "ai", "response", "model", "agent"),
}
_MARKER = r"^[ \t]*(?:#{1,6}[ \t]*|\*\*|<\||\[)?(NAMES)(?:\|>|\]|:\*\*|\*\*:|\*\*|[ \t]*[:>])[ \t]*"
STATES = [(role, first) for role in ROLES for first in (True, False)]
_N = len(STATES)


def _marker(names: tuple[str, ...]) -> str:
    return "(?i)" + _MARKER.replace("NAMES", "|".join(sorted(names, key=len, reverse=True)))


ANY_MARKER = _marker(tuple(n for names in SPEAKERS.values() for n in names))


def features(line: Column) -> Column:
    """Struct of small numbers: marker (0 none, then one per role), asks, length class, blank."""
    marker = F.lit(0)
    for k, role in enumerate(ROLES):
        marker = F.when(F.rlike(line, F.lit(_marker(SPEAKERS[role]))), k + 1).otherwise(marker)
    length = sum((F.length(line) > n).cast("int") for n in LENGTHS)
    asks = F.rlike(line, F.lit(r"\?[\s\"')»]*$")).cast("int")
    blank = F.rlike(line, F.lit(r"^\s*$")).cast("int")
    return F.struct(marker.cast("int").alias("marker"), asks.alias("asks"), length.cast("int").alias("length"), blank.alias("blank"))


SIZES = {"marker": len(ROLES) + 1, "asks": 2, "length": len(LENGTHS) + 1, "blank": 2}


@dataclass
class Model:
    """Log probabilities: start (by state), move (state to state), and one table (state, value) per feature."""

    start: np.ndarray
    move: np.ndarray
    emit: dict[str, np.ndarray]

    def scores(self, seen: pd.DataFrame) -> np.ndarray:
        """Log probability of each line in each state."""
        return sum(self.emit[name][:, seen[name].to_numpy()].T for name in SIZES)


def fit(lines: DataFrame) -> Model:
    """Count the model over labelled lines (conv, block, turn, at, role, seen); held-out conversations and unknown roles count nothing.

    Counts are sums per state, a few dozen rows. Steps between blocks are left out of the transitions.
    """
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")) - 1
    known = lines.filter(F.col("role").isin(*ROLES) & ~held_out("conv"))
    known = known.withColumn("state", (role * 2 + (F.col("at") > 0).cast("int")).cast("int"))
    order = Window.partitionBy("conv", "block").orderBy("turn", "turn_key", "at")
    known = known.withColumn("before", F.when(F.col("block") > 0, F.lag("state").over(order)).otherwise(F.coalesce(F.lag("state").over(order), F.lit(-1))))
    columns = [F.lit(1), *[F.col(f"seen.{name}") for name in SIZES]]
    counted = known.select("state", "before", *[c.alias(n) for c, n in zip(columns, ["one", *SIZES])])
    rows = counted.groupBy("state", "before", *SIZES).count().collect()  # at most states * (states + 1) * feature values
    start, move = np.ones(_N), np.ones((_N, _N))
    emit = {name: np.full((_N, size), 0.5) for name, size in SIZES.items()}
    for r in rows:
        n = r["count"]
        if r["before"] == -1:
            start[r["state"]] += n
        elif r["before"] is not None:
            move[r["before"], r["state"]] += n
        for name in SIZES:
            emit[name][r["state"], r[name]] += n
    start[1::2] = 1e-9
    for k, (role_k, _) in enumerate(STATES):  # a later line follows a line of its own role
        for j, (role_j, first_j) in enumerate(STATES):
            if not first_j and role_j != role_k:
                move[k, j] = 1e-9
    share = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Model(share(start), share(move), {name: share(t) for name, t in emit.items()})


def held_out(conv: str) -> Column:
    """True for the conversations (by their key, see ``as_turns``) the model must not learn from; false for that without an id."""
    named = F.col(conv).startswith("=")
    return named & (F.crc32(F.substr(F.col(conv), F.lit(2)).cast("binary")) % 4 == 2)


def _forward(model: Model, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best scores at the last line and back pointers, from the scores ``first`` of the states at line 0."""
    best, back = first, np.zeros((len(scores), _N), dtype=np.int8)
    for t in range(1, len(scores)):
        step = best[:, None] + model.move
        back[t] = step.argmax(axis=0)
        best = step.max(axis=0) + scores[t]
    return best, back


def viterbi(model: Model, scores: np.ndarray, enter: int | None = None, leave: int | None = None) -> np.ndarray:
    """Best states of a block, given the state before it and the state at its end where they are known."""
    first = (model.start if enter is None else model.move[enter]) + scores[0]
    best, back = _forward(model, scores, first)
    path = np.empty(len(scores), dtype=np.int64)
    path[-1] = best.argmax() if leave is None else leave
    for t in range(len(scores) - 1, 0, -1):
        path[t - 1] = back[t][path[t]]
    return path


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole (conv, block) groups of batches sorted by them."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        both = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if both.empty:
            continue
        key = pd.factorize(both["conv"])[0] * (1 << 32) + both["block"].to_numpy()
        edges = np.flatnonzero(key[1:] != key[:-1]) + 1
        begin = 0
        for end in edges:
            yield both.iloc[begin:end]
            begin = end
        rest = both.iloc[begin:]
    if rest is not None and len(rest):
        yield rest


def _block_matrices(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches):
            scores = model.scores(g)
            ends = [_forward(model, scores, model.move[k] + scores[0])[0] for k in range(_N)]
            begin = _forward(model, scores, model.start + scores[0])[0]
            yield pd.DataFrame({"conv": [g["conv"].iloc[0]], "block": [g["block"].iloc[0]], "ends": [np.concatenate(ends).tolist()], "begin": [begin.tolist()]})

    return run


def _fold(group: pd.DataFrame) -> pd.DataFrame:
    """States before and at the end of each block of one conversation."""
    group = group.sort_values("block")
    matrices = [np.array(e).reshape(_N, _N) for e in group["ends"]]
    best = [np.array(group["begin"].iloc[0])]
    for m in matrices[1:]:
        best.append((best[-1][:, None] + m).max(axis=0))
    leave = [int(best[-1].argmax())]
    for k in range(len(matrices) - 1, 0, -1):
        leave.append(int((best[k - 1] + matrices[k][:, leave[-1]]).argmax()))
    leave.reverse()
    return pd.DataFrame({"conv": group["conv"].to_numpy(), "block": group["block"].to_numpy(), "enter": [-1, *leave[:-1]], "leave": leave})


def _decode(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches):
            enter, leave = g["enter"].iloc[0], g["leave"].iloc[0]
            path = viterbi(model, model.scores(g), None if pd.isna(enter) or enter < 0 else int(enter), None if pd.isna(leave) else int(leave))
            opened = np.where((path % 2 == 0) | (np.arange(len(path)) + (0 if pd.isna(enter) or enter < 0 else 1) == 0), np.arange(len(path)), -1)
            opened = np.maximum.accumulate(opened)
            yield pd.DataFrame({
                "conv": g["conv"].to_numpy(), "block": g["block"].to_numpy(), "line": g["line"].to_numpy(), "state": path,
                "opened": np.where(opened < 0, "", g["line"].to_numpy()[opened]),
            })

    return run


def lines_of(turns: DataFrame) -> DataFrame:
    """One row per line of (conv, turn, turn_key, role, text): its place, block and features.

    A line's place ``line`` sorts as text in reading order: turn, digest of the turn, line number. A block holds
    ``BLOCK_TURNS`` turns, whatever their numbers are.
    """
    rows = turns.select("*", F.posexplode(F.split(text_or_empty("text"), "\r\n|\r|\n")).alias("at", "content"))
    place = F.format_string("%020d/%s/%010d", F.col("turn"), F.col("turn_key"), F.col("at"))
    block = F.floor((F.col("turn") - 1) / BLOCK_TURNS).cast("long")
    return rows.select("conv", "turn", "turn_key", "role", "at", "content", place.alias("line"), block.alias("block"), features(F.col("content")).alias("seen"))


def recovered(lines: DataFrame, model: Model) -> DataFrame:
    """Lines with the recovered ``state`` and the place ``opened`` of the line that opened their turn."""
    first = lines.groupBy("conv").agg(F.min("block").alias("_low"), F.max("block").alias("_high")).filter("_low < _high")
    long_ones = first.select(F.col("conv").alias("_conv"))
    seen = lines.select("conv", "block", "line", "seen.*")
    many = seen.join(long_ones, F.col("conv") == F.col("_conv"), "left_semi")
    kind = dict(lines.dtypes)["conv"]
    by_block = lambda df: df.repartition("conv", "block").sortWithinPartitions("conv", "block", "line")
    matrices = by_block(many).mapInPandas(_block_matrices(model), f"conv {kind}, block long, ends array<double>, begin array<double>")
    between = staged(matrices.groupBy("conv").applyInPandas(_fold, f"conv {kind}, block long, enter int, leave int"), "chat-blocks")
    b = between.select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), "enter", "leave")
    placed = seen.join(b, (F.col("conv") == F.col("_conv")) & (F.col("block") == F.col("_block")), "left").drop("_conv", "_block")
    states = staged(by_block(placed).mapInPandas(_decode(model), f"conv {kind}, block long, line string, state int, opened string"), "chat-states")
    # A block that begins inside a turn takes the last turn opened before it.
    last = states.filter("opened <> ''").groupBy("conv", "block").agg(F.max("opened").alias("_last"))
    starts = states.groupBy("conv", "block").agg(F.min("opened").alias("_first")).filter("_first = ''").select("conv", "block")
    l = last.select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), "_last")
    open_before = starts.join(l, (F.col("conv") == F.col("_conv")) & (F.col("_block") < F.col("block"))).groupBy("conv", "block").agg(F.max("_last").alias("_open"))
    o = open_before.select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), "_open")
    states = states.join(o, (F.col("conv") == F.col("_conv")) & (F.col("block") == F.col("_block")), "left")
    states = states.select("conv", "line", "state", F.when(F.col("opened") == "", F.coalesce("_open", "line")).otherwise(F.col("opened")).alias("opened"))
    s = states.select(F.col("conv").alias("_conv"), F.col("line").alias("_line"), "state", "opened")
    return lines.join(s, (F.col("conv") == F.col("_conv")) & (F.col("line") == F.col("_line"))).drop("_conv", "_line")


def rendered(lines: DataFrame) -> DataFrame:
    """One row per recovered turn: conv, opened, role, text (without marker), rendered, n_lines."""
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.floor(F.col("state") / 2) + 1).cast("int"))
    content = F.when(F.col("line") == F.col("opened"), F.regexp_replace("content", ANY_MARKER, "")).otherwise(F.col("content"))
    rows = lines.select("conv", "opened", role.alias("_role"), F.struct("line", content.alias("content")).alias("_part"))
    turns = rows.groupBy("conv", "opened").agg(F.first("_role").alias("role"), F.sort_array(F.collect_list("_part")).alias("_parts"))
    text = F.trim(F.array_join(F.transform("_parts", lambda p: p["content"]), "\n"))
    turns = turns.select("conv", "opened", "role", text.alias("text"), F.size("_parts").cast("long").alias("n_lines"))
    return turns.withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n")))


def as_turns(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns in reading order: conv (key of the conversation), turn (from 1), turn_key, role and text.

    Null turns come last; turns of one number are ordered by a digest of role and text, and each repeated row is
    a turn of its own. The key of a conversation is "=" and its id as text; rows without a conversation are one
    conversation with the key "~". Null texts are empty. A long conversation is numbered in slices.
    """
    conv = F.col(conv_col).cast("string")
    role, text = F.col(role_col), text_or_empty(text_col)
    rows = conversations.select(
        F.when(conv.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), conv)).alias("conv"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit((1 << 63) - 1)).alias("given"),
        F.substring(F.md5(F.concat_ws("/", role, text)), 1, 16).alias("turn_key"),
        role.alias("role"),
        text.alias("text"),
    )
    return ranks(rows, ["conv"], ["given", "turn_key"], "turn").drop("given")


def conversation_id(key: str, kind: str) -> Column:
    """The id of a conversation from its key."""
    return F.when(F.col(key).startswith("="), F.substr(F.col(key), F.lit(2))).cast(kind)


# Marker styles of the transcripts that with_markers writes.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### System:\n", "user": "### Instruction:\n", "assistant": "### Response:\n"},
    {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"},
    {"system": "[Context] ", "user": "Q: ", "assistant": "A: "},
)


def with_markers(turns: DataFrame, *, unmarked: int = 4) -> DataFrame:
    """Turns as a raw transcript shows them: a speaker marker in the conversation's style, one turn in ``unmarked`` without one.

    Turns of other or null roles have no marker.
    """
    style = F.pmod(F.xxhash64("conv"), F.lit(len(STYLES))).cast("int")
    marks = F.array(*[F.create_map(*[F.lit(x) for kv in s.items() for x in kv]) for s in STYLES])
    mark = F.when(F.col("role").isin(*ROLES), F.element_at(F.element_at(marks, style + 1), F.col("role"))).otherwise("")
    silent = F.pmod(F.xxhash64("conv", "turn", "turn_key"), F.lit(unmarked)) == 0
    return turns.withColumn("text", F.concat(F.when(silent, "").otherwise(mark), F.col("text")))


def parse_conversations(conversations: DataFrame, **columns) -> DataFrame:
    """Recover and render the turns of conversations written as raw transcripts.

    One row per recovered turn: conv_id (null for rows without one, which are one conversation), opened (place
    of its first line), role, text, rendered, n_lines, n_right (lines whose role is the true one) and
    held_out. No turn is lost, repeated rows included. An empty table gives an empty result.
    """
    kind = dict(conversations.dtypes)[columns.get("conv_col", "conv_id")]
    lines = staged(lines_of(with_markers(as_turns(conversations, **columns))), "chat-lines")
    model = fit(lines)
    found = staged(recovered(lines, model), "chat-recovered")
    true = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.floor(F.col("state") / 2) + 1).cast("int")) == F.col("role")
    right = found.groupBy(F.col("conv").alias("_conv"), F.col("opened").alias("_opened")).agg(F.sum(F.coalesce(true, F.lit(False)).cast("long")).alias("n_right"))
    turns = rendered(found).join(right, (F.col("conv") == F.col("_conv")) & (F.col("opened") == F.col("_opened")))
    return turns.select(conversation_id("conv", kind).alias("conv_id"), "opened", "role", "text", "rendered", "n_lines", "n_right", held_out("conv").alias("held_out"))
