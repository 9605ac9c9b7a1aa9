"""Token counts against the library over whole texts."""

import random

import pytest
import sentencepiece

from tests.llm.rows import documents, frame, stored
from vectrail.llm import token_counts as T

HARD = ["", " ", "  ", "\n", " \n ", "a  b", "a▁b ▁▁c", "<s> x</s><unk> <0x0A>", "tab\tand\r\nline", "naïve Straße 日本語 \U0001f600\U0001f600 é", "\0\x7f", "ﬁ Ａ", "x" * 300, " " * 40 + "y" + " " * 17, "　wide space"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=T.model_file())


def test_parts_are_cuts_of_the_model(model):
    p = T.Pretokens(model.serialized_model_proto())
    r = random.Random(3)
    alphabet = " ▁\n\t.,'-aAeEnNtThH0159éßçïあ日\U0001f600́<>/s#$%&()[]{}=\"\\"
    texts = HARD + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 200))) for _ in range(3000)]
    texts += ["".join(model.id_to_piece(r.randrange(3, 32000)) for _ in range(40)) for _ in range(2000)]
    for t in texts:
        assert sum(p.count(x) for s in p.slices(t.encode()) for x in s) == len(model.encode(t)), repr(t)


def test_slices_of_long_texts(model, monkeypatch):
    monkeypatch.setattr(T, "SLICE", 50)
    p = T.Pretokens(model.serialized_model_proto())
    t = " ".join("one  two\n three" for _ in range(200)) + "z" * 300 + "   "
    assert len(list(p.slices(t.encode()))) > 10
    assert sum(p.count(x) for s in p.slices(t.encode()) for x in s) == len(model.encode(t))


def test_awkward_rows(spark, model, monkeypatch, tmp_path):
    rows = documents() + [(200 + i, t, None, None, None, *"k", 1, "s", "t", "kept", 5, "r") for i, t in enumerate(HARD)]
    rows.append((999, "word\nbreak " * 60_000, "en", "web", 0, "k", 1, "s", "t", "kept", 5, "r"))
    rows = [(*r[:5], "k", 1, "s", "t", "kept", 5, "r") for r in rows]
    got = sorted(map(tuple, T.op13_token_counts(spark, stored(frame(spark, rows), tmp_path)).collect()), key=repr)
    counts = [(r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in rows]
    assert got == sorted([(*c, c[2] > 4096) for c in counts], key=repr)
    assert T.op13_token_counts(spark, str(tmp_path)).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_small_tiers_change_nothing(spark, model, monkeypatch):
    docs = frame(spark)
    whole = sorted(map(tuple, T.count_tokens(docs, T.model_file()).collect()), key=repr)
    p = T.Pretokens(model.serialized_model_proto())
    monkeypatch.setattr(T, "CACHED", 5)
    lengths = T.Lengths(p, {"▁a": 1})
    words = [f"▁w{i % 11}" for i in range(40)]
    assert [lengths[w] for w in words] == [p.count(w) for w in words] and len(lengths) <= 6
    assert whole == sorted(((r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in documents()), key=repr)


def test_empty_table(spark):
    assert T.count_tokens(frame(spark, []), T.model_file()).collect() == []


def test_frequent_come_from_all_rows(spark, model):
    d = spark.createDataFrame([(f"w{i} common common",) for i in range(300)], "t string").selectExpr("cast(t as binary) AS text").repartition(40)
    found = T.frequent_pretokens(d, model.serialized_model_proto(), keep=3)
    assert found[0] == "▁common" and len(found) == 3


def test_other_models_are_refused():
    with pytest.raises(Exception):
        T.Pretokens(b"not a model")
