import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenloom.llm.piece_bpe import LONG, decode, digests, encode, load
from tokenloom.llm.queries import piece_model

PATH = piece_model()
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXT = st.text(st.characters(codec="utf-8"), max_size=120) | st.text(alphabet="ab ▁\n.,Éé<0x41>t", max_size=200)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_ids_and_texts_as_the_library(texts):
    m = load(PATH)
    ids = m.encode_many(texts)
    assert ids == LIB.encode(texts) if texts else ids == []
    assert [m.decode(i) for i in ids] == [LIB.decode(i) for i in ids]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=12) | st.lists(st.integers(0, 262), max_size=12))
def test_any_ids_decode_as_the_library(ids):
    assert load(PATH).decode(ids) == LIB.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdethinos▁é\n☃", min_size=1, max_size=LONG))
def test_heap_and_rows_agree(chunk):
    m = load(PATH)
    ids, start, size = m.merge_many(["ab", chunk, chunk[::-1]])
    assert ids[start[1]:start[1] + size[1]].tolist() == m.merge(chunk)
    assert ids[start[2]:start[2] + size[2]].tolist() == m.merge(chunk[::-1])


def test_awkward(awkward, nothing):
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    got = digests(awkward, PATH).collect()
    assert len(got) == awkward.count() and digests(nothing, PATH).count() == 0
    for r in got:
        ids = LIB.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(LIB.decode(ids)))
    again = decode(encode(awkward, PATH), PATH, text="back")
    assert again.columns[:-2] == awkward.columns
    assert {r.doc_id: r.back for r in again.collect()} == {i: LIB.decode(LIB.encode(t)) for i, t in texts.items()}


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        load(str(tmp_path / "none.model"))
