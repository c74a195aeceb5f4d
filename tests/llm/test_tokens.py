import random

import pytest

from sparkfathom.llm import piece_model, sentencepiece_codec, token_counts

from . import odd

NAME = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def path():
    return piece_model.vocabulary_path(NAME)


@pytest.fixture(scope="module")
def library(path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def texts():
    rng = random.Random(3)
    letters = "ab c  \n\t▁é漢\U0001f389\x00.<s>0a 1"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(800)]
    return made + ["", "  ", " \n ", "\n\n", " " * 40 + "x" + " " * 17, "x" * 3000, "<s></s><unk><0x0A>", "a▁▁b", "́e"]


def test_parsed_model_agrees_with_the_library(path, library):
    model = piece_model.load(path)
    assert [p for p, _, _ in model.pieces] == [library.id_to_piece(i) for i in range(library.get_piece_size())]
    assert model.model_type == piece_model.BPE and model.byte_fallback and model.splits_safely()


def test_whole_tokens_are_proved(path, library):
    some = sorted(token_counts.whole_tokens(path))[::97]
    assert all(len(library.encode("\n" + s)) == 3 for s in some)


@pytest.mark.parametrize("window", [7, 1 << 20])
def test_counts_ids_and_round_trips(path, library, monkeypatch, window):
    monkeypatch.setattr(piece_model, "WINDOW", window)
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 50)
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    count, encode, decode = token_counts.counter(path), sentencepiece_codec.encoder(path), sentencepiece_codec.decoder(path)
    import numpy as np

    for at in range(0, len(texts()), 60):
        group = texts()[at : at + 60]
        for text, (raw, parity, same) in zip(group, encode(group), strict=True):
            want = library.encode(text)
            ids = np.frombuffer(raw, np.int32).tolist()
            assert ids == want and count(text) == len(want) and parity and same
            assert decode([ids])[0] == library.decode(ids) == text.replace("▁", " ")


def test_ids_are_the_rebuilt_tokenizers_and_differences_show(path, library, monkeypatch):
    """A library that splits one word otherwise costs that word's texts their parity alone."""
    import numpy as np

    class Other:
        def encode(self, texts, num_threads=1):
            return [[y for x in library.encode(t) for y in ([262, 262] if x == odd_one else [x])] for t in texts]

    odd_one = library.encode("a house")[-1]
    monkeypatch.setattr(token_counts, "processor", lambda path: Other())
    got = sentencepiece_codec.encoder(path)(["a house here", "no such word", "mouse"])
    assert [parity for _, parity, _ in got] == [False, True, True]
    assert np.frombuffer(got[1][0], np.int32).tolist() == library.encode("no such word")


def test_decoding_leaves_control_pieces_out(path, library):
    ids = [1, *library.encode("plain words"), 2]
    assert sentencepiece_codec.decoder(path)([ids, []]) == ["plain words", ""]


def test_rebuilt_backend_encodes_and_decodes_whole_texts(path, library):
    whole = sentencepiece_codec.backend(piece_model.load(path))
    for text in texts()[:200]:
        got = whole.encode(text, add_special_tokens=False).ids
        assert got == library.encode(text)
        assert whole.decode(got) == text.replace("▁", " ")


def unigram_bytes():
    """A tiny unigram model in the wire format, written by hand."""
    import struct

    def field(number, kind, body):
        return bytes([number << 3 | kind]) + body

    def text(number, s):
        raw = s.encode()
        return field(number, 2, bytes([len(raw)]) + raw)

    def piece(s, score, kind):
        body = text(1, s) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁", -3.0, 1), ("▁a", -1.0, 1), ("b", -2.0, 1), ("ab", -1.5, 1), ("a", -2.5, 1)]
    trainer = field(2, 2, bytes([2]) + field(3, 0, bytes([1])))
    normaliser = field(3, 2, bytes([6]) + field(3, 0, b"\1") + field(4, 0, b"\0") + field(5, 0, b"\1"))
    return b"".join(piece(*p) for p in pieces) + trainer + normaliser


def test_unigram_models_are_rebuilt_too():
    data = unigram_bytes()
    model = piece_model.PieceModel.parse(data)
    assert model.model_type == piece_model.UNIGRAM and not model.splits_safely()
    whole = sentencepiece_codec.backend(model)
    assert whole.encode("ab ab", add_special_tokens=False).tokens == ["▁a", "b", "▁a", "b"]
    assert whole.decode([3, 4, 3, 4]) == "ab ab"


def test_odd_rows(spark, library):
    docs = odd.table(spark)
    want = {i: library.encode(t or "") for i, t, *_ in odd.rows()}
    counted = token_counts.count_tokens(docs, NAME)
    assert "text" not in counted.columns
    for r in counted.collect():
        assert r.n_tokens == len(want[r.doc_id])
    sizes = {r.doc_id: r.n_bytes for r in counted.collect()}
    assert all(sizes[i] == len((t or "").encode()) for i, t, *_ in odd.rows())
    encoded = sentencepiece_codec.encode(docs, NAME)
    assert [c for c in docs.columns if c != "token_ids"] == [c for c in encoded.columns if c in docs.columns and c != "token_ids"]
    for r in encoded.collect():
        assert r.token_ids == want[r.doc_id] and r.parity and r.round_trip
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(encoded, NAME).collect()}
    assert back == {i: t or "" for i, t, *_ in odd.rows()}


def test_empty_table(spark):
    assert token_counts.count_tokens(odd.table(spark, []), NAME).count() == 0
    assert sentencepiece_codec.encode(odd.table(spark, []), NAME).count() == 0
