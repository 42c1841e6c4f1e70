"""Chat formatting against a plain Python reading of the template."""

import hashlib
import random
import time

from pyspark.sql import functions as F

from spindle.llm.chat import PARTS, Template, escape, format_chats, loss_text, read_turns, text_parts, unescape

NASTY = ["", None, "</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|over|>\n", "\\", "\\\\<|", "<\\|over|>", "a\\nb\n", "é🙂 <", "|turn|>", "<<|", "$1 \\$0", "<s", "\\Q\\E", "x" * 5000]


def test_escape(spark):
    df = spark.createDataFrame([(t,) for t in NASTY if t is not None], "t string")
    t = Template()
    for r in df.select("t", escape(F.col("t"), t).alias("e"), unescape(escape(F.col("t"), t)).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in t.controls)


def rows():
    rng = random.Random(1)
    out = [(c, t, rng.choice(["user", "assistant", "system", None, "<|says|>", "\\"]), rng.choice(NASTY)) for c in range(30) for t in range(rng.randint(1, 7))]
    out += [(100, t % 300, "assistant" if t % 2 else "user", f"turn {t}") for t in range(700)]
    return [*out, (101, None, "user", "no turn"), (101, -5, "assistant", "before"), (None, 1, "assistant", "no id"), out[0], out[0]]


def test_against_plain_python(spark):
    r = rows()
    df = spark.createDataFrame(r, "conv_id long, turn long, role string, text string").withColumn("span", F.lit(1)).repartition(5)
    chats = format_chats(df.withColumn("parts", text_parts(F.col("text"))))
    got = chats.select("*", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert sorted(-1 if x.conv_id is None else x.conv_id for x in got) == sorted({-1 if c is None else c for c, *_ in r})
    for x in got:
        own = sorted(((t is not None, t, role or "", text or "") for c, t, role, text in r if c == x.conv_id), key=lambda k: (k[0], k[1] or 0, *k[2:]))
        assert [(t.role, t.text) for t in x.turns] == [k[2:] for k in own] and x.n_turns == len(own)
        assert x.loss == "".join(k[3] for k in own if k[2] == "assistant")
        cut = "".join(x.formatted[s.start : s.start + s.length] for s in x.loss_spans)
        assert len(x.loss_spans) == sum(k[2] == "assistant" for k in own) and (("\\" in cut) or cut == x.loss)
        assert x.attachments == [] and x.expanded_tokens == 0


def test_typed_parts(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "s3://a.png", 576.0), ("audio", "", "b.wav", 2.5), (None, None, "c", None), ("document", None, "d.pdf", float("nan")), ("video", None, "e", 3.0), None, ("text", None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "A", None, None), ("image", None, "o.png", -1.0), ("text", "B", None, None)]), (1, 2, "user", None), (2, 0, "assistant", [])], f"conv_id int, turn int, role string, parts {PARTS}")
    one, two = format_chats(df).orderBy("conv_id").collect()
    assert one.formatted == "<|turn|>user<|says|>see <\\|image|><|image|><|audio|><|unknown|><|document|><|unknown|><|unknown|><|over|>\n<|turn|>assistant<|says|>A<|image|>B<|over|>\n<|turn|>user<|says|><|over|>\n"
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in one.attachments] == [(0, "image", "s3://a.png", 576), (0, "audio", "b.wav", 32), (0, "", "c", 0), (0, "document", "d.pdf", 0), (0, "video", "e", 0), (0, "", None, 0), (1, "image", "o.png", 0)]
    assert one.expanded_tokens == 608 and [one.formatted[s.start : s.start + s.length] for s in one.loss_spans] == ["A", "B"]
    assert two.formatted == "<|turn|>assistant<|says|><|over|>\n" and two.loss_spans == []
    assert format_chats(df.limit(0)).collect() == []


def test_query(spark, sf):
    from spindle.llm.queries import LLM_QUERIES

    got = {r.conv_id: r for r in LLM_QUERIES["op3_chat_formatting"](spark, sf).collect()}
    by = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    by[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(by) == set(got)
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_long_conversation(spark):
    """Time grows with the turns, not with their square."""
    n = 12_000
    df = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text <| of turn ', id) as text")
    chats = format_chats(df.withColumn("parts", text_parts(F.col("text"))))
    began = time.time()
    got = chats.select("n_turns", F.size("loss_spans").alias("spans"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert time.time() - began < 15
    assert [tuple(r) for r in got] == [(n, n // 2, "".join(f"text <| of turn {i}" for i in range(1, n, 2)))]
