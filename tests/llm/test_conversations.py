"""Chat formatting against plain Python, on awkward conversations."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lagmill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, block string, blocks string, state int, segments string, turns string"
TEXTS = [None, "", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\[INST]\\", "<<SYS>>\n<</SYS>>", "<s\\>", "a\nb\n", "<<ROLE>>\n<<TEXT>>\n", "[/INST", "日本 <s>", "x" * 5000]


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(12), None]:
        for turn in range(rng.choice([0, 1, 2, 5, 9])):
            role = rng.choice(["system", "user", "assistant", "assistant", "user", None, "tool <s>"]) if c is None or c % 3 else ("user", "assistant")[turn % 2]
            rows.append((c, rng.choice([turn, turn, None]) if c in (4, 5) else turn, role, rng.choice(TEXTS), "x", "y", 3, "z", "t"))
    return rows + rows[5:8]


def plain(rows):
    """conv_id -> (turns, digest, learned characters, digest, misplaced turns, complete)."""
    moves, after = chat.INSTRUCTIONS.moves, chat.INSTRUCTIONS.after
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0), r or "", x or "") for c, t, r, x, *_ in rows if c == conv)
        state, bad = "start", 0
        for _, role, _ in turns:
            bad += (state, role) not in moves
            state = moves.get((state, role), after.get(role, state))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        said = "".join(x for _, r, x in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(said), sha(said), bad, state == "answered")
    return out


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_conversations_come_back_from_the_formatted_text(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = conversations()
    formatted = chat.format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = chat.conversation_digests(formatted).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_misplaced, r.complete) for r in got} == plain(rows)
    assert len(got) == len(plain(rows))
    # Read without the operator's own parser: markers stand only where the formatter wrote them.
    segments = [(s.text, s.loss) for r in formatted.collect() for s in r.segments]
    assert not [t for k, (t, _) in enumerate(segments) if k % 3 == 1 and len(segments) % 3 == 0 and any(c in t for c in chat.INSTRUCTIONS.controls)]
    assert sum(len(t) for t, _ in segments) == sum(r.formatted_chars for r in got)


def test_empty_conversations(spark):
    assert chat.conversation_digests(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_escaping_is_reversible(spark):
    rng = random.Random(1)
    alphabet = ["\\", "<", "s", ">", "/", "[", "INST", "]", "<<SYS>>", "</s>", " ", "\n", "é"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t"), chat.INSTRUCTIONS))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.INSTRUCTIONS.controls)


def test_a_template_with_glued_markers_is_refused():
    with pytest.raises(ValueError):
        chat.Template(parts={"user": chat.Part("[U]", "[/U]")}, moves={}, after={}, start="s", complete=frozenset())


def test_no_python_runs(spark):
    plan = chat.conversation_digests(chat.format_conversations(spark.createDataFrame(conversations(), SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
