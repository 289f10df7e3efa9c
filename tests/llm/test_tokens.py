import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from tripwire.llm import pieces
from tripwire.llm import token_counts as T

from .cases import DOC_SCHEMA, documents

MODEL = P.path("piece_bpe_32k.model")
RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["  a  b ", "▁a ▁b", "a\tb\nc\r\n", "ﬁ ① é é", "　x\xa0y​", "</s><s>[INST] \x00 \x7f", "", " ", "a▁", "▁▁", None, "x" * 50_000,
       " " * 5000, "中文字" * 3000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_ids_and_decoding_equal_the_library(spark, library):
    rows = documents() + [(i, t, None, None, None, None, None, None) for i, t in enumerate(ODD, 50_000)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    got = pieces.encode(docs, MODEL, keep=("doc_id", "text", "words"), outputs=tuple(pieces.OUTPUTS)).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r["text"] or "")
        assert (r["ids"], r["n_tokens"], r["ids_sha256"]) == (ids, len(ids), sha(",".join(map(str, ids))))
        assert r["decoded"] == library.decode(ids) and r["decoded_sha256"] == sha(r["decoded"])


def test_decode_round_trip(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD) if t and "▁" not in t]
    coded = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), MODEL)
    assert {r["doc_id"]: r["decoded"] for r in pieces.decode(coded, MODEL).collect()} == dict(rows)


def test_random_strings_and_a_small_table(library, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_ROWS", 50)
    table, rng = pieces.ChunkTable(open(MODEL, "rb").read()), random.Random(5)
    for _ in range(300):
        texts = ["".join(rng.choice("ab é▁ ▁  \t\n中😀\x00 the ing<s></s>0123'") for _ in range(rng.randint(0, 30))) for _ in range(5)]
        ids, plain = table.run(texts)
        assert ids == [",".join(map(str, library.encode(t))) for t in texts]
        assert plain == [library.decode(library.encode(t)) for t in texts]
    assert len(table.ids) <= 50 + 200


def test_empty_table(spark):
    e = spark.createDataFrame([], DOC_SCHEMA)
    assert pieces.encode(e, MODEL).collect() == []
    assert T.recount(T.count(e, RANKS, P.PATTERN), RANKS, P.PATTERN, T.redactions).collect() == []


@pytest.fixture(scope="module")
def counter():
    return T.Counter(open(RANKS, "rb").read(), P.PATTERN)


def test_edits_equal_a_full_count(counter, monkeypatch):
    monkeypatch.setattr(T, "SPAN", 3)
    monkeypatch.setattr(T, "FAN", 2)
    rng = random.Random(3)
    bits = ["ab", "é", " ", " ", "  ", "\n", "\t", "中", "😀", "\x1c", "'s", "'re", "12", "!", "...", "the ", "ing ", "<s>", "　", "\xa0"]
    some = lambda k: "".join(rng.choice(bits) for _ in range(rng.randint(0, k)))
    for _ in range(1500):
        text = some(120)
        doc = T.Document(text, *counter.leaves(text))
        for _ in range(2):
            n = len(doc.text)
            at = [rng.randint(0, n) for _ in range(rng.randint(0, 4))]
            do = T.cleaned([(s, s + rng.randint(0, 6), some(4)) for s in at], n)
            want = doc.text
            for s, e, r in reversed(do):
                want = want[:s] + r + want[e:]
            doc.edit(do, counter)
            assert doc.text == want
            assert doc.n_tokens == len(counter.encoding.encode_ordinary(want))
            assert all((b.sum() == doc.tokens[0].sum()) for b in doc.tokens)


def test_an_edit_touches_little(counter):
    text = " ".join(f"word{i}" for i in range(20_000))
    doc = T.Document(text, *counter.leaves(text))
    again = doc.edit([(60_000, 60_005, "changed")], counter)
    assert 0 < again < 1000 and doc.n_tokens == len(counter.encoding.encode_ordinary(doc.text))


def test_odd_edits():
    assert T.cleaned([(None, None, None), (5, 2, "a"), (3, 99, "b"), (-4, 1, "c")], 10) == [
        (0, 1, "c"), (1, 1, ""), (3, 10, "b"), (10, 10, "a")] or T.cleaned(None, 3) == []


def test_counts_in_spark(spark):
    ranks = T.Counter(open(RANKS, "rb").read(), P.PATTERN).encoding
    rows = documents() + [(7, "mail a.b@c.de or +1 (499) 555-6503 now", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    counted = T.count(docs, RANKS, P.PATTERN)
    got = T.recount(counted, RANKS, P.PATTERN, T.redactions, keep=("doc_id", "text", "n_tokens")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_tokens"] == len(ranks.encode_ordinary(r["text"] or ""))
        assert r["n_tokens_edited"] == len(ranks.encode_ordinary(r["text_edited"])) == sum(r["tree_tokens"])
        assert sum(r["tree_chars"]) == len(r["text_edited"])
    assert [r["text_edited"] for r in got if r["doc_id"] == 7] == ["mail [EMAIL] or [PHONE] now"]
    with_column = counted.selectExpr("*", "array(struct(0 AS s, 1 AS e, 'zz' AS t), null) AS edits").where("doc_id = 7")
    with_column = with_column.selectExpr("* EXCEPT (edits)", "filter(edits, x -> x is not null) AS edits")
    assert T.recount(with_column, RANKS, P.PATTERN, "edits").first()["text_edited"].startswith("zzail")
    assert isinstance(ranks, tiktoken.Encoding)


@pytest.mark.parametrize(("text", "want"), [
    ("mail a.b+c@x-y.org, or call +1 (017) 555-7713.", "mail [EMAIL], or call [PHONE]."),
    ("(017) 555-7713 017-555-7713 017.555.7713 +49 30 1234 5678", "[PHONE] [PHONE] [PHONE] [PHONE]"),
    ("9807915762804490!! 4845 1681 1440 7329 3782-822463-10005", "[CARD]!! [CARD] [CARD]"),
    ("from 233.254.104.120. or 8.8.8.8:53", "from [IP]. or [IP]:53"),
    ("1.2.3.4.5 256.1.1.1 v10.0.0.1 2024-05-06 12345678 9b0b3c6a43eb78aa99cbd7049c572391524f37a8 12 345 6789 3.14159265358979 +5", None),
    ("\uff11\uff12\uff13 555 7713 \u0661", None), ("", None)])
def test_redactions(text, want):
    got, at = "", 0
    for start, end, new in T.redactions(text):
        got, at = got + text[at:start] + new, end
    assert got + text[at:] == (text if want is None else want)
