import itertools
import random
import struct

import pytest
import sentencepiece

from paperloom.llm.pieces import MODEL, Transducer, encode_texts
from tests.llm.helpers import docs, prose

EDGES = ["", " ", "   ", "  a  b ", "a\nb\tc", "é́ 　x", "ﬁ ½ Ⅷ", "<s>hi</s><0x41>", "a" * 300, " " * 70 + "x", "\x00\x01", "日本語 한국어 🙂",
         "http://www.example.com/a?b=c&d=1", "== != <= ++ ...... ,,,,", "    def f(x):\n        return x+1\n\n\n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def fst():
    return Transducer(open(MODEL, "rb").read())


def test_encoding_and_decoding_equal_the_library(library, fst):
    r = random.Random(1)
    texts = EDGES + ["".join(r.choice("abcdefe  \n<>/s.,ЖяéüñßI1🙂") for _ in range(r.randint(1, 30))) for _ in range(400)]
    texts += ["".join(r.choice(fst.texts).replace("▁", " ") for _ in range(r.randint(1, 8))) for _ in range(600)]
    for t in texts:
        ids = fst.encode(t).tolist()
        assert ids == library.encode(t) and fst.decode(ids) == library.decode(ids)


def field(number, value):
    kind, body = (5, struct.pack("<f", value)) if isinstance(value, float) else (0, bytes([value])) if isinstance(value, int) else (2, bytes([len(value)]) + value)
    return bytes([number << 3 | kind]) + body


def scored_model(pieces):
    """A small model whose paths cost minus their scores."""
    body = field(1, field(1, b"<unk>") + field(2, 0.0) + field(3, 2))
    for p, s in pieces.items():
        body += field(1, field(1, p.encode()) + field(2, float(s)))
    return body + field(2, field(3, 1)) + field(3, field(1, b"identity") + field(3, 0) + field(4, 0))


def test_scored_pieces_take_the_best_of_all_paths():
    pieces = {"a": -3.0, "b": -3.5, "ab": -4.0, "ba": -5.5, "aba": -7.0, "bb": -6.0}
    fst = Transducer(scored_model(pieces))
    for n in range(1, 8):
        for text in map("".join, itertools.product("ab", repeat=n)):
            best = max((sum(pieces[p] for p in cut), cut) for cut in splits(text, pieces))[0]
            assert sum(fst.scores[i] for i in fst.encode(text)) == pytest.approx(best)


def splits(text, pieces):
    if not text:
        return [[]]
    return [[text[:k]] + rest for k in range(1, 4) if text[:k] in pieces for rest in splits(text[k:], pieces)]


def test_normaliser_rules_are_longest_first():
    fst = Transducer(open(MODEL, "rb").read(), {"ﬁ": "fi", "½": "1/2", "…": "...", "……": "--"})
    assert fst.decode(fst.encode("ﬁn ½ ……")) == "fin 1/2 --"


def test_rows(spark, library):
    texts = [None, "", *EDGES, "▁x", prose(1, 5000)]
    rows = docs(spark, texts).withColumnRenamed("lang", "ids")
    got = {r["doc_id"]: r for r in encode_texts(rows, carry=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode(t or "") and got[i]["n_ids"] == len(got[i]["ids"])
        assert got[i]["round_trip"] == ("▁" not in (t or ""))
    assert encode_texts(rows.limit(0), carry=["doc_id"]).count() == 0


def test_carried_columns_may_have_any_names(spark):
    rows = docs(spark, ["one two", None, "one two", ""]).withColumnsRenamed({"lang": "ids", "source": "__text", "n_chars": "Round_Trip"})
    out = encode_texts(rows)
    assert out.columns == ["doc_id", "text", "ids_carried", "__text", "Round_Trip_carried", "n_ids", "n_bytes_ids", "ids", "ids_sha256", "round_trip"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["ids"] == got[2]["ids"] and got[1]["ids"] == got[3]["ids"] == [] and all(r["round_trip"] and r["ids_carried"] == "en" for r in got.values())


def test_a_frequent_arc_is_compiled_once(monkeypatch):
    from paperloom.llm import pieces

    monkeypatch.setattr(pieces, "KEPT", 4)
    with open(pieces.MODEL, "rb") as f:
        fst = pieces.Transducer(f.read())
    compiled, merged = [], fst._merged
    fst._merged = lambda text: compiled.append(text) or merged(text)
    left, right = fst.ids["▁the"], fst.ids["re"]
    for i in range(40):
        if fst.accepted.get((left << 32) + right) is None:
            fst._accepts(left, right)
        fst._accepts(right, 1000 + i)
    assert compiled.count("▁there") == 1
