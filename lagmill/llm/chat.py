"""Chat formatting by a finite-state machine over roles. DataFrame functions only.

A template declares how a turn of each role is written, whether its text is learned, and the machine that validates the order
of turns. Turns come out as segments: marker, text, marker, each with a loss flag. Inside texts every control string is
broken by an escape character after its first character, so that markers are found only where the formatter wrote them.

A conversation of any length is worked on in blocks of ``BLOCK`` turn numbers. What a block does to the machine is a list with
the end state for each start state; lists of consecutive blocks compose, so no task holds a whole conversation.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagmill.llm.columns import let
from lagmill.session import scratch_folder

#: Turn numbers per block.
BLOCK = 1024
ESCAPE = "\\"
_NO_TURN = -(1 << 62)


@dataclass(frozen=True)
class Part:
    """How a turn is written: markers around its text, and whether the text is under the loss mask. Markers must end, or
    start, with white space where they meet a text, and hold none else, so that no control string reaches across."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``moves`` maps (state, role) to the next state. A turn without a move is misplaced: it is written all the same and the
    machine goes on from ``after[role]`` (a role without one changes nothing). ``other`` writes roles without a part of their
    own: its opening, the role, ``between``, the text, its closing."""

    parts: Mapping[str, Part]
    moves: Mapping[tuple[str, str], str]
    after: Mapping[str, str]
    start: str
    complete: frozenset[str]
    other: Part = Part("<<ROLE>>\n", "\n<</TEXT>>\n")
    between: str = "\n<<TEXT>>\n"
    states: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "states", tuple(dict.fromkeys([self.start, *(s for s, _ in self.moves), *self.moves.values(), *self.after.values()])))
        for p in (*self.parts.values(), self.other):
            if not (p.opening[-1:].isspace() and p.closing[:1].isspace()):
                raise ValueError("markers must be parted from texts by white space")
        if any(re.search(r"\s", c) or ESCAPE in c or len(c) < 2 for c in self.controls):
            raise ValueError("control strings hold neither white space nor the escape character, and two characters at least")

    @property
    def controls(self) -> tuple[str, ...]:
        parts = (*self.parts.values(), self.other)
        return tuple(dict.fromkeys(m.strip() for p in parts for m in (p.opening, p.closing) if m.strip())) + (self.between.strip(),)


#: System, then users and assistants in turn; only what assistants say is learned.
INSTRUCTIONS = Template(
    parts={"system": Part("<<SYS>>\n", "\n<</SYS>>\n"), "user": Part("[INST] ", " [/INST]\n"), "assistant": Part("<s> ", " </s>\n", loss=True)},
    moves={("start", "system"): "primed", ("start", "user"): "asked", ("primed", "user"): "asked", ("asked", "assistant"): "answered",
           ("answered", "user"): "asked"},
    after={"system": "primed", "user": "asked", "assistant": "answered"},
    start="start", complete=frozenset({"answered"}))


def _quoted(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def escape(text: Column, template: Template) -> Column:
    """Doubles escape characters, then sets one after the first character of each control string."""
    starts: dict[str, list[str]] = {}
    for c in template.controls:
        starts.setdefault(c[0], []).append(_quoted(c[1:]))
    pattern = "|".join(f"{_quoted(head)}(?={'|'.join(rests)})" for head, rests in starts.items())
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), pattern, r"$0\\")


def unescape(text: Column) -> Column:
    """Each escape character goes; one that follows it stays."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _step(template: Template):
    """Next state of (state, role), as numbers, and whether the turn is misplaced."""
    number = {s: i for i, s in enumerate(template.states)}
    roles = list(dict.fromkeys([r for _, r in template.moves] + list(template.after)))
    rows = [[number[template.moves.get((s, r), template.after.get(r, s))] for s in template.states] for r in roles]
    table = F.create_map(*[x for r, row in zip(roles, rows) for x in (F.lit(r), F.array(*map(F.lit, row)))])
    known = F.create_map(*[x for r in roles for x in (F.lit(r), F.array(*[F.lit((s, r) in template.moves) for s in template.states]))])

    def move(state: Column, role: Column) -> Column:
        return F.coalesce(F.get(table[role], state), state)

    def misplaced(state: Column, role: Column) -> Column:
        return ~F.coalesce(F.get(known[role], state), F.lit(False))

    return move, misplaced


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(_NO_TURN)).alias("block"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def block_starts(turns: DataFrame, template: Template) -> DataFrame:
    """(conv_id, block, blocks, state) of conversations with several blocks: the state in which each block begins.

    Roles only are read. A block becomes one short list, a conversation a row of lists."""
    move, _ = _step(template)
    states = F.array(*[F.lit(i) for i in range(len(template.states))])
    roles = F.sort_array(F.collect_list(F.struct("turn", "role")))
    lists = turns.groupBy("conv_id", "block").agg(roles.alias("r")).select(
        "conv_id", "block", F.transform(states, lambda s: F.aggregate("r", s, lambda at, t: move(at, t["role"]))).alias("ends"))
    several = lists.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "ends"))).alias("b")).where(F.size("b") > 1)
    begun = F.aggregate("b", F.array(F.lit(template.states.index(template.start))), lambda acc, b: F.concat(acc, F.array(F.get(b["ends"], F.element_at(acc, -1)))))
    placed = several.select("conv_id", F.size("b").alias("blocks"), F.arrays_zip(F.col("b.block").alias("block"), F.slice(begun, 1, F.size("b")).alias("state")).alias("z"))
    return placed.select("conv_id", "blocks", F.inline("z"))


def format_conversations(conversations: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """One row per conversation and block of turns: ``conv_id, block, blocks, n_turns, n_misplaced, complete, segments``.

    ``segments`` is an array of (text, loss) in order; their texts joined are the formatted text. Turns are ordered by (turn,
    role, text), null turns first in a block of their own; repeated rows are turns of their own. Null texts and roles are
    empty; rows of a null ``conv_id`` are one conversation. ``complete`` tells whether the machine stands in a state where a
    conversation may end. Turns that share one turn number stay in one block. Other columns are not read.

    Texts are shuffled once, by (conversation, block). States at block starts are a table that has rows for conversations of
    several blocks only; Spark broadcasts it if its files are small.
    """
    spark = conversations.sparkSession
    turns = _turns(conversations)
    path = scratch_folder(spark, "block-starts")
    block_starts(turns, template).write.parquet(path)
    starts = spark.read.parquet(path).select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "blocks", "state")
    first = template.states.index(template.start)
    known = turns.join(starts, turns["conv_id"].eqNullSafe(F.col("_c")) & (turns["block"] == F.col("_b")), "left")
    grouped = known.groupBy("conv_id", "block", F.coalesce("blocks", F.lit(1)).alias("blocks"), F.coalesce("state", F.lit(first)).alias("state")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    move, misplaced = _step(template)
    states = F.aggregate("turns", F.array("state"), lambda acc, t: F.concat(acc, F.array(move(F.element_at(acc, -1), t["role"]))))

    def segment(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def written(t: Column) -> Column:
        text = lambda p: segment(escape(t["text"], template), p.loss)
        other = template.other
        out = F.array(segment(F.concat(F.lit(other.opening), escape(t["role"], template), F.lit(template.between)), False), text(other), segment(F.lit(other.closing), False))
        for role, p in template.parts.items():
            out = F.when(t["role"] == role, F.array(segment(F.lit(p.opening), False), text(p), segment(F.lit(p.closing), False))).otherwise(out)
        return out

    ends = F.array(*[F.lit(s in template.complete) for s in template.states])
    return grouped.withColumn("states", states).select(
        "conv_id", "block", "blocks", F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t, i: misplaced(F.get("states", i), t["role"]))).cast("long").alias("n_misplaced"),
        F.get(ends, F.element_at("states", -1)).alias("complete"), F.flatten(F.transform("turns", written)).alias("segments"))


def read_back(formatted: Column, template: Template = INSTRUCTIONS) -> Column:
    """Array of (role, text) of a formatted text."""
    shapes = [f"{_quoted(p.opening)}.*?{_quoted(p.closing)}" for p in (*template.parts.values(), template.other)]
    found = F.regexp_extract_all(formatted, F.lit(f"(?s){'|'.join(shapes)}"), F.lit(0))

    def inner(turn: Column, p: Part) -> Column:
        return F.substring(turn, F.lit(len(p.opening) + 1), F.length(turn) - len(p.opening) - len(p.closing))

    def parsed(turn: Column) -> Column:
        whole = inner(turn, template.other)
        role = F.substring_index(whole, template.between, 1)
        out = F.struct(unescape(role).alias("role"), unescape(F.substring(whole, F.length(role) + len(template.between) + 1, F.length(whole))).alias("text"))
        for name, p in template.parts.items():
            out = F.when(F.startswith(turn, F.lit(p.opening)), F.struct(F.lit(name).alias("role"), unescape(inner(turn, p)).alias("text"))).otherwise(out)
        return out

    return F.transform(found, parsed)


def conversation_digests(formatted: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """Per conversation: counts, and digests of what is read back from the formatted text and from the loss mask.

    The digest of a conversation needs its text in one place: those of one block are digested where they stand, and only
    texts of longer ones move once more."""
    joined = formatted.withColumn("_f", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    parts = joined.select(
        "conv_id", "block", "blocks", "n_misplaced", "complete", F.length("_f").cast("long").alias("formatted_chars"), read_back(F.col("_f"), template).alias("turns"),
        F.array_join(learned, "").alias("loss"))
    parts = parts.withColumns({
        "n_turns": F.size("turns").cast("long"), "loss_chars": F.length("loss").cast("long"),
        "told": F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")})
    one = F.col("blocks") == 1
    digest = lambda c: F.when(one, F.sha2(c, 256)).otherwise(F.col(c)).alias(c)
    rows = parts.select("conv_id", "block", "blocks", "n_turns", "n_misplaced", "complete", "loss_chars", "formatted_chars", digest("told"), digest("loss"))
    whole = rows.groupBy("conv_id").agg(
        F.max("blocks").alias("blocks"), *[F.sum(c).alias(c) for c in ("n_turns", "n_misplaced", "loss_chars", "formatted_chars")],
        F.max_by("complete", "block").alias("complete"), F.sort_array(F.collect_list(F.struct("block", "told", "loss"))).alias("b"))
    final = lambda c: let(F.array_join(F.col(f"b.{c}"), ""), lambda x: F.when(F.col("blocks") == 1, x).otherwise(F.sha2(x, 256)))
    return whole.select("conv_id", "n_turns", final("told").alias("turns_sha256"), "loss_chars", final("loss").alias("loss_sha256"), "formatted_chars",
                        "n_misplaced", "complete")
