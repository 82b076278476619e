import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sumtrace.llm import bpe

PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_split_rule_equals_the_librarys(library):
    """For every character of the written-out rule, in the middle, doubled, before and after a space."""
    split = library.pre_tokenizer.pre_tokenize_str
    for c in map(chr, range(0x250)):
        for text in (f"a{c}b", f"{c}{c} {c}x", f"1{c}2 {c}", f"  {c} !{c}?'{c}", f"{c}'s {c}'ll\n\n{c}"):
            assert bpe._WORD.findall(text) == [text[a:b] for _, (a, b) in split(text)], (hex(ord(c)), text)


def test_words_encode_alone_as_in_their_text(library):
    for text in ["a   b\n\n c\t\td  ", "don't  we'll 'tis ''s", "x  y\u0085z", " Привет  мир 你好吗"]:
        alone = [i for w in bpe.split(text, PATH) for i in library.encode(w, add_special_tokens=False).ids]
        assert alone == library.encode(text, add_special_tokens=False).ids


def test_pieces(library):
    table = bpe.pieces(PATH)
    assert len(table) == library.get_vocab_size() and table[50256] == b"<|endoftext|>"
    assert sorted(t for t in table if len(t) == 1) == [bytes([b]) for b in range(256)]


def test_round_trip(spark, odd_docs, no_docs, library):
    out = bpe.encoded(odd_docs, block_bytes=500)
    texts = sorted((r["text"] or "" for r in odd_docs.select("text").collect()))
    want = sorted((library.encode(t, add_special_tokens=False).ids for t in texts))
    rows = out.collect()
    assert sorted(list(r["ids"]) for r in rows) == want
    back = bpe.decoded(out).collect()
    assert sorted(r["decoded"] for r in back) == texts
    assert bpe.encoded(no_docs).count() == 0


def test_decoding_odd_ids(spark, library):
    rows = [(1, None), (2, []), (3, [64, None, 275]), (4, [-1, 99999999, 64]), (5, [50256]), (6, [160]), (7, [447, 64])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decoded(df).collect()}
    assert got[1] == got[2] == "" and got[3] == library.decode([64, 275]) and got[4] == "a"
    for i, ids in rows[4:]:
        assert got[i] == library.decode(ids, skip_special_tokens=False)


def test_decoding_from_buffers(library):
    """Texts are joined from buffers; broken characters stay within their text, others decode as in the library."""
    table = pa.array([*bpe.pieces(bpe.default_vocabulary()), b""], pa.large_binary())
    texts = ["plain words", "", "Grüße, žluť 漢字 🙂", None, "é"]
    ids = [None if t is None else library.encode(t, add_special_tokens=False).ids for t in texts]
    ids += [library.encode("🙂", add_special_tokens=False).ids[:1], library.encode("🙂", add_special_tokens=False).ids[1:], [None, 10**6, -4]]
    for some in (ids, ids[:5], ids[1:2], []):
        lists = pa.array(some, pa.list_(pa.int32()))
        want = ["" if x is None else library.decode([i for i in x if i is not None and 0 <= i < 10**6], skip_special_tokens=False) for x in some]
        assert bpe._joined(lists, table).to_pylist() == want
        assert bpe._joined(lists.slice(1), table).to_pylist() == want[1:]
