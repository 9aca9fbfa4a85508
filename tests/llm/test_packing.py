import json
import zlib
from array import array

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandline.llm.packing import OpenSequences, encoder, pack, pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60) | st.text("abz's' \n\t.,1é<|endoftext>你 ", max_size=60))
def test_ids_equal_the_tokenizers_own(text):
    assert encoder(PATH)(text) == reference()(text)


def test_pieces():
    assert list(pieces(1024, 1024)) == [(0, 1024)]
    assert list(pieces(1025, 1024)) == [(0, 1), (1, 1024)]
    assert list(pieces(5, 2)) == [(0, 1), (1, 2), (3, 2)]


def test_best_fit_takes_the_fullest_that_fits():
    s = OpenSequences(10, 2)
    assert s.place(6) == (0, 0) and s.place(7) == (1, 0)
    assert s.place(3) == (1, 7)  # free 3 is closer than free 4
    assert s.place(8) == (2, 0) and s.place(9) == (3, 0)  # the fullest of 0 and 2 closed: 2
    assert s.place(4) == (0, 6)


def test_pack(spark):
    whole = reference()
    texts = [None, ""] + ["some word " * (i * 37 % 1500) for i in range(150)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 0)]
    found = pack(spark.createDataFrame(rows, "doc_id long, text string, offset int").coalesce(2), PATH, with_ids=True).collect()
    want = sorted((i, tuple(ids[a : a + n]), a, n) for i, t, _ in rows for ids in [[*whole(t or ""), 2]] for a, n in pieces(len(ids), 1024))
    assert sorted((r["doc_id"], tuple(r["ids"]), r["start"], r["length"]) for r in found) == want
    by = {}
    for r in found:
        assert r["ids_crc32"] == zlib.crc32(array("I", r["ids"]).tobytes())
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= 1.1 * sum(r["length"] for r in found) / 1024 + 3
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_added_tokens_have_their_own_ids(spark):
    with open(PATH, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    assert added
    whole = Tokenizer.from_file(PATH)  # as the contract has it: special tokens' strings are not ordinary text
    for token, i in added.items():
        assert encoder(PATH)(f"a{token}b") == [*encoder(PATH)("a"), i, *encoder(PATH)("b")]
        texts = [token, token * 3, f"some  {token}  words", f" {token}\n{token[:-1]} {token[1:]}", f"{token[:4]}{token}{token[4:]}", f"é{token}你" * 700]
        for text in texts:
            assert encoder(PATH)(text) == whole.encode(text, add_special_tokens=False).ids
        got = {}
        for r in pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, with_ids=True).orderBy("doc_id", "start").collect():
            got.setdefault(r["doc_id"], []).extend(r["ids"])
        assert [got[k] for k in range(len(texts))] == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]
