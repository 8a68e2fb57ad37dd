from __future__ import annotations

import random
from itertools import product

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from ledgerlens.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "hello  world ", " a", "ﬁ", "a\nb\tc", "<s>hi</s>", "日本🎉", "　x", "é", "\r\n \x00z", " " * 50 + "x" + " " * 17, "a" * 400, "ßßß ÖÄÜ", "def f(x):\n        return x**2",
       "<0x0A>", "▁ ▁▁x▁y", "\U0010ffff‍"]


@pytest.fixture(scope="module")
def model():
    return P.read_model(PATH)


def ids_of(v, texts):
    return [np.frombuffer(x, dtype=np.int32).tolist() for x in P.encode_texts(v, texts)]


def test_ids_equal_the_library_on_documents_and_odd_texts(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()] + ODD
    rng = random.Random(2)
    texts += ["".join(rng.choice("abcdethe inr▁ \n12.ßé🎉") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    assert ids_of(P.Vocabulary.from_model(model), texts) == sp.encode(texts)


def test_decode_inverts_and_equals_the_library(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    v = P.Vocabulary.from_model(model)
    for t in ODD:
        ids = sp.encode(t)
        assert P.decode_ids(v, ids) == sp.decode(ids) == t.replace("▁", " ")
    assert P.decode_ids(v, [1, None, -5, 10**6, *sp.encode("ab"), 2]) == "ab"


def unigram_model(pieces, bytes_too):
    proto = model_pb2.ModelProto()
    kinds = model_pb2.ModelProto.SentencePiece
    for piece, score, kind in [("<unk>", 0.0, kinds.UNKNOWN), ("<s>", 0.0, kinds.CONTROL), ("</s>", 0.0, kinds.CONTROL),
                               *([(f"<0x{b:02X}>", 0.0, kinds.BYTE) for b in range(256)] if bytes_too else []), *[(p, s, kinds.NORMAL) for p, s in pieces]]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.byte_fallback = bytes_too
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = proto.normalizer_spec.escape_whitespaces = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    return proto.SerializeToString()


def test_unigram_viterbi_equals_library_and_enumeration():
    rng = random.Random(4)
    names = ["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab", "cab", "bca", "▁▁"]
    pieces = [(p, -rng.uniform(1, 9)) for p in names]
    model = unigram_model(pieces, True)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    v, score = P.Vocabulary.from_model(model), dict(pieces)
    texts = ["".join(x) for n in range(1, 6) for x in product("abc ", repeat=n)]
    got = ids_of(v, texts)
    assert got == sp.encode(texts)

    def best(s):
        if not s:
            return 0.0
        return max(score[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in score)
    for t, ids in zip(texts, got):
        assert sum(score[sp.id_to_piece(i)] for i in ids) == pytest.approx(best("▁" + t.replace(" ", "▁")), abs=1e-4)


def test_trie_reuses_common_prefixes(model):
    v = P.Vocabulary.from_model(model)
    trie, steps = P.Trie(v), []
    extend = trie._extend_bpe
    trie._extend_bpe = lambda w, common: (steps.extend(w[:i] for i in range(common + 1, len(w) + 1)), extend(w, common))
    words = sorted(["▁inter", "▁internal", "▁international", "▁interval", "▁x"])
    for w in words:
        trie.walk(w)
    assert len(steps) == len(set(steps)) == len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_words_of_earlier_slices_are_kept_in_bounds(model, monkeypatch):
    monkeypatch.setattr(P, "MOST_WORDS", 8)
    monkeypatch.setattr(P, "MOST_PAIRS", 5)
    v, sp = P.Vocabulary.from_model(model), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for texts in (["one two three"], ["three four five six seven eight nine"], ["one nine", "x" * 100], ["two three four"]):
        assert ids_of(v, texts) == sp.encode(texts)
        assert len(v.known) <= 4 and len(v.older) <= 4 and len(v.pairs) <= 5 and not any(len(w) > 64 for w in v.known)


def test_dataframe_round_trip_nulls_repeats_extra_columns(docs, model, monkeypatch):
    rows = [(1, None), (2, ""), (3, "two  words\n"), (3, "two  words\n"), (4, "w" * 100_000), (5, "é🎉 " * 3000)]
    df = docs(rows, token_ids="old", decoded=1, Batch=2)
    out = P.decode(P.encode(df, model), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "Batch", "token_ids", "decoded"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.decoded == (r.text or "") and r.Batch == 2 for r in got)
    assert {r.doc_id: len(r.token_ids) for r in got}[1] == 0
    assert P.encode(df.where("false"), model).count() == 0
    null_ids = df.select("doc_id", F.lit(None).cast("array<int>").alias("token_ids"))
    assert {r.decoded for r in P.decode(null_ids, model).collect()} == {""}


def test_slices_cover_every_row(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(P, "SLICE", 10)
    assert list(P._slices(pa.array([4, 4, None, 40, 0, 1]), P.SLICE)) == [(0, 3), (3, 4), (4, 6)]
    assert list(P._slices(pa.array([], pa.int32()), P.SLICE)) == []


def test_names_with_dots_and_clashes(spark, model, monkeypatch):
    monkeypatch.setattr(P, "IDS", 3)
    df = spark.createDataFrame([(1, "one two three", 5, "x", 2.0, "c"), (2, None, 6, "y", None, None)],
                               "doc_id long, `the.text` string, `a.b` int, __in__ string, Decoded double, c0 string")
    got = P.decode(P.encode(df, model, text="the.text"), model)
    assert got.columns == ["doc_id", "the.text", "a.b", "__in__", "c0", "token_ids", "decoded"]
    assert [(r[0], r[2], r[3], r[4], r["decoded"]) for r in sorted(got.collect(), key=lambda r: r[0])] == [(1, 5, "x", "c", "one two three"), (2, 6, "y", None, "")]


def test_models_that_would_not_be_exact_are_refused():
    with pytest.raises(ValueError, match="space mark"):
        P.Vocabulary.from_model(unigram_model([("a▁b", -1.0)], True))


def test_words_are_cut_where_no_piece_joins_and_walked_once(model, monkeypatch):
    """Words that differ only beyond a border that no piece crosses share the stem; ids stay those of the library."""
    v, sp = P.Vocabulary.from_model(model), sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert v.words.findall("▁for.\nWhble▁▁x▁.a▁") == ["▁for", ".\n", "Whble", "▁▁x", "▁.a", "▁"]
    odd = "".join(ODD) + "it's l'a a-b x_y 3rd f(x).y[0] \"q\"."
    assert "".join(v.words.findall(odd)) == odd
    tied = [p for p in v.ids if len(p) > 1 and v.words.findall(p) != [p]]
    assert tied == [], tied[:5]
    walked, walk = [], P.Trie.walk
    monkeypatch.setattr(P.Trie, "walk", lambda trie, word: (walked.append(word), walk(trie, word))[1])
    stems = ["▁forblety", "▁Whble", "▁inter"]
    texts = [" ".join(f"{stem[1:]}{end}" for stem in stems for end in ("", ".", ",", "\nEd", ".\nThe", "é\n", "\n\n", "🎉x", "\x00."))] * 2
    assert ids_of(v, texts) == sp.encode(texts)
    assert len(walked) == len(set(walked)) and sum(w in stems for w in walked) == 3 and not any(w[:-1] in stems and w.endswith(".") for w in walked)


def test_one_look_up_a_code_point_finds_the_pieces_that_end_there(model):
    v = P.Vocabulary.from_model(model)
    usable = {p for p in v.ids if v.merge(p) == [p]}
    for word in ["▁international", "▁(\"x\")", "▁ßß日本", "....", "▁▁▁▁▁a"]:
        state = v.start
        for end in range(1, len(word) + 1):
            while word[end - 1] not in state[0] and state is not v.start:
                state = state[1]
            state = state[0].get(word[end - 1], v.start)
            assert [n for n, _ in state[2]] == [n for n in range(end, 0, -1) if word[end - n:end] in usable]
            assert all(v.ids[word[end - n:end]] == p for n, p in state[2])
