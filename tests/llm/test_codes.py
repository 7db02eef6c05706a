import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import documents, edge_rows, prose  # noqa: F401

from hitlens.llm import codes
from hitlens.llm.queries import vocabulary_path
from hitlens.session import work_path


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_round_trip_and_single_ids(ids):
    shard = codes.Shard(codes.pack(np.array(ids, np.uint32), np.array([0, len(ids)])))
    assert shard.all().tolist() == ids
    for place in {0, len(ids) // 2, len(ids) - 1, 511, 512, 513} & set(range(len(ids))):
        assert shard[place] == ids[place]


def test_places_outside():
    shard = codes.Shard(codes.pack(np.array([5], np.uint32), np.array([0, 1])))
    with pytest.raises(IndexError):
        shard[1]
    with pytest.raises(ValueError):
        codes.Shard(b"nothing")


def sample_texts(prose):
    texts = ["", " ", "Don't  STOP\n\n12.5% 中文 é ΣΣ", "<|endoftext|> a<|startoftext|>b", "x" * 5000, "I'll've 's"]
    return texts + [prose(k, 200) for k in range(10)]


@pytest.mark.parametrize("name, by_pieces", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_every_vocabulary_gives_its_own_ids(prose, name, by_pieces):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    encoder, tokenizer = codes.PieceEncoder(path), Tokenizer.from_file(path)
    assert encoder.by_pieces == by_pieces
    texts = sample_texts(prose)
    for raw, text in zip(encoder.ids(texts), texts):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def changed_vocabulary(told, change):
    if change == "truncation":
        told[change] = {"direction": "Right", "max_length": 5, "strategy": "LongestFirst", "stride": 0}
    elif change == "lower case":
        del told["normalizer"]["normalizers"][2]
    elif change == "digits":
        split = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]
        split["Regex"] = split["Regex"].replace("[\\p{N}]|", "[\\p{N}]+|")
    else:
        token = {"id": 49408, "content": "stop", "single_word": False, "lstrip": False, "rstrip": False}
        told["added_tokens"].append({**token, "normalized": False, "special": True})
    return told


@pytest.mark.parametrize("change", ["truncation", "lower case", "digits", "added token"])
def test_changed_vocabularies(tmp_path, prose, change):
    from tokenizers import Tokenizer

    with open(vocabulary_path(), encoding="utf-8") as file:
        told = changed_vocabulary(json.load(file), change)
    path = tmp_path / "changed.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    encoder, tokenizer = codes.PieceEncoder(str(path)), Tokenizer.from_file(str(path))
    tokenizer.no_truncation()
    assert encoder.by_pieces == (change == "truncation")
    texts = [*sample_texts(prose), "Please stop 1234 Times"]
    for raw, text in zip(encoder.ids(texts), texts):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_documents_equal_the_tokenizer(spark, documents, edge_rows, prose):
    from tokenizers import Tokenizer

    rows = [row for row in edge_rows if row[0] is not None][: len(edge_rows) - 5]
    rows += [(100 + k, prose(k, 300) + " Größe, <|endoftext|> don't é ΣΣ. 12.5%") for k in range(40)]
    tokenizer = Tokenizer.from_file(vocabulary_path())
    path = work_path(spark, "codes-test")
    codes.write_shards(documents(rows).repartition(6), path, vocabulary_path(), shard_tokens=2000)
    got = sorted(codes.documents(spark, path).collect(), key=lambda r: (r.start, r.n_tokens))
    start, every = 0, []
    for row, (key, text, *_) in zip(got, sorted(rows, key=lambda r: r[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row.doc_id, row.start, row.n_tokens) == (key, start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
        every += ids
    assert len(got) == len(rows)
    asked = [0, 1, 1999, 2000, 2001, start // 2, start - 1]
    places = spark.createDataFrame([(p,) for p in asked], "position long")
    assert sorted(map(tuple, codes.tokens_at(spark, path, places).collect())) == sorted((p, every[p]) for p in set(asked))


def test_pieces_keep_their_ids_when_forgotten_or_long(prose):
    from tokenizers import Tokenizer

    encoder, tokenizer = codes.PieceEncoder(vocabulary_path(), most=40, longest=12), Tokenizer.from_file(vocabulary_path())
    asked, encode = [], encoder.encode_pieces
    encoder.encode_pieces = lambda texts: asked.extend(texts[0].split()) or encode(texts)
    texts = ["same words, same words", "", "x" * 500 + " y", "  ", "don't 12'stuff \x0b!'s", "ÀÉ ß", "中文 same"]
    texts += [prose(k, 30) for k in range(8)]
    for some in (texts[:2], texts[2:5] + texts[2:3], texts, [], texts[::-1]):
        expected = [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in some]
        assert encoder.ids(some) == expected
    assert asked[:3] == ["same", "words", ","]
    assert len(encoder.known) == len(encoder.starts) - 1 - sum(len(piece) > 12 for piece in asked[-len(encoder.starts) + 1 :])
