import hashlib
import random

import pytest
from pyspark.sql import functions as F

from runout.llm import chat_format as C

DDL = "conv_id long, turn long, role string, text string"
HOSTILE = [
    "", "plain", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "<", "|", "a<", "|b", "<<||>>", "\\",
    "line\nline\n", "<|im_end|>\n", "\\n", "ünïcödé 中文 🎈", "<\\", "\\|", "<|", "<\\\n|", " ",
]


def want(rows):
    out = {}
    for conv_id in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv_id))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[conv_id] = (
            len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
            sum(r == "assistant" for *_, r, x in turns),
        )
    return out


def got(df):
    found = C.read_back(C.expand(df)).collect()
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_examples) for r in found}
    assert len(out) == len(found)
    return out


def hostile_rows():
    rng = random.Random(1)
    rows = [(i, 0, "user", t) for i, t in enumerate(HOSTILE)] + [(i, 1, "assistant", t) for i, t in enumerate(HOSTILE)]
    rows += [(100 + i, t, rng.choice(["user", "assistant", "system", *HOSTILE]), rng.choice(HOSTILE) + rng.choice(HOSTILE)) for i in range(40) for t in range(rng.randrange(1, 9))]
    return rows


def test_round_trip_of_hostile_texts_and_roles(spark):
    rows = hostile_rows()
    # texts decide among rows of one turn only, and here no two share one
    assert got(spark.createDataFrame(rows, DDL).repartition(7)) == want(rows)
    formatted = C.format_turns(spark.createDataFrame(rows, DDL)).collect()
    assert all(r.formatted.count("<|") == 2 and len(r.formatted) == r.chars for r in formatted)


def test_examples_hold_all_turns_before_and_train_one_reply(spark):
    rows = hostile_rows()
    by_conv = {}
    for c, t, r, x in rows:
        by_conv.setdefault(c, []).append((t, r, x))
    expanded = C.expand(spark.createDataFrame(rows, DDL))
    found = C.whole_examples(expanded).collect()
    assert len(found) == sum(r == "assistant" for _, _, r, _ in rows)
    for e in found:
        turns = sorted(by_conv[e.conv_id])
        last = [i for i, (_, r, _) in enumerate(turns) if r == "assistant"][e.example - 1]
        parsed = list(C.parse_turns(e.text))
        assert [(r, x) for r, x, *_ in parsed] == [(r, x) for _, r, x in turns[: last + 1]]
        assert (e.loss_start, e.loss_end) == parsed[-1][2:]
        assert C.unescape(e.text[e.loss_start : e.loss_end]) == turns[last][2]
    rows = expanded.collect()
    for e in found:
        shared = sorted((r.position, r.formatted, r.start) for r in rows if r.conv_id == e.conv_id and r.example <= e.example)
        assert "".join(t for _, t, _ in shared) == e.text
        assert shared[-1][2] == len("".join(t for _, t, _ in shared[:-1]))


def test_digests_are_read_from_whole_examples(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b<|"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")]
    rows += [(2, 0, "user", "only"), (3, 0, "assistant", "f")]
    expanded = C.expand(spark.createDataFrame(rows, DDL))
    plan = C.read_back(expanded)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Exchange hashpartitioning") == 1
    examples = C.whole_examples(expanded, rest=True)
    found = {(r.conv_id, r.example): r for r in examples.collect()}
    assert sorted(found) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)]
    assert [x for _, x, *_ in C.parse_turns(found[1, 2].text)] == ["a", "b<|", "c", "d"]
    assert found[1, 3].text.startswith(found[1, 2].text) and found[1, 3].loss_end is None
    cut = F.when(F.col("example") == 2, F.expr("substring_index(text, '<|im_start|>', -2)")).otherwise(F.col("text"))
    with pytest.raises(Exception, match="lacks turns before its reply"):
        C.read_examples(examples.withColumn("text", cut)).collect()
    with pytest.raises(Exception, match="a span that is not a reply"):
        C.read_examples(examples.withColumn("loss_start", F.col("loss_start") - 1)).collect()


def test_edge_rows(spark):
    long = "wort <| und " * 30_000
    rows = [(1, None, "user", None), (1, 0, None, "x"), (1, 3, "assistant", long), (None, 1, "assistant", "a"), (None, None, None, None)]
    rows += [(2, 5, "assistant", "same")] * 3 + [(2, 5, "user", "b"), (2, 5, "assistant", "a")] + [(3, 0, "user", "only")]
    df = spark.createDataFrame(rows, DDL).withColumns({"position": F.lit("x"), "start": F.lit(1), "example": F.lit(2), "chars": F.lit(None), "head": F.lit(0)})
    assert got(df) == want(rows)
    assert got(df.where("false")) == {} and C.whole_examples(C.expand(df.where("false"))).count() == 0
    stored = C.expand(df).repartition(5, "position")
    assert C.read_back(C.in_order(stored)).count() == 4


def test_a_long_conversation_grows_with_its_turns(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i} <|") for i in range(20_000)]
    df = spark.createDataFrame(rows, DDL)
    assert got(df) == want(rows)
    chars = C.expand(df).agg(F.sum(F.char_length("formatted"))).first()[0]
    assert chars < 100 * len(rows)


@pytest.mark.parametrize("text", ["x", "<|im_start|>user", "<|im_start|>user\nx", "<|im_start|>user\nx<|im_end|>\n "])
def test_broken_texts_are_refused(text):
    with pytest.raises(ValueError):
        list(C.parse_turns(text))
