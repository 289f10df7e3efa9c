import hashlib
import random

from tripwire.llm import chat

CONTROL = ["</s>", "<s>[user]\n", "[INST]", "[/INST]", "&amp;", "&lt;", "&", "<", "[", "]\n", "\n", "ok", " ", "é😀", "&lbr;", ""]


def rows(seed=2):
    rng = random.Random(seed)
    out = []
    for c in range(40):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", None, "a]\n<&[b"])
            text = rng.choice([None, "", "".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 12)))])
            out.append((c, t, role, text, "x"))
    out += [(50, None, "user", "n", "x"), (50, 1, "assistant", "t", "x"), (50, 1, "assistant", "s", "x"), (50, 1, "assistant", "s", "x"),
            (None, 0, "user", "u", "x"), (None, 1, "assistant", "v", "x")]
    out += [(60, t, "assistant" if t % 2 else "user", f"turn {t}", "x") for t in range(300)]
    rng.shuffle(out)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, parts string"


def expected(data):
    want = {}
    for c in {r[0] for r in data}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in data if r[0] == c))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        every = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        want[c] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return want


def test_read_back(spark):
    data = rows()
    got = chat.digests(chat.examples(spark.createDataFrame(data, SCHEMA))).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == expected(data) and len(got) == len(expected(data))


def test_examples(spark):
    data = [(1, 0, "system", "s"), (1, 1, "user", "</s>[INST] ok"), (1, 2, "assistant", "a<1>"), (1, 3, "user", "q"), (1, 4, "assistant", "[b]"),
            (1, 5, "user", "end"), (2, 0, "user", "only")]
    got = [r.asDict() for r in chat.examples(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
           .orderBy("conv_id", "example").collect()]
    assert [(r["conv_id"], r["n_turns"], r["loss_start"] is not None) for r in got] == [(1, 3, True), (1, 5, True), (1, 6, False), (2, 1, False)]
    one, two = got[:2]
    assert one["text"][one["loss_start"]:one["loss_end"]] == "a&lt;1>" and two["text"][two["loss_start"]:two["loss_end"]] == "&lbr;b]"
    assert two["text"].startswith(one["text"]) and one["text"].endswith("a&lt;1></s>\n")
    assert one["text"].count("</s>") == 3 and "[INST]" not in one["text"]


def test_empty(spark):
    assert chat.digests(chat.examples(spark.createDataFrame([], SCHEMA))).collect() == []
