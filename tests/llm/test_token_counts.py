import public_tokenizers
from tokenizers import Tokenizer

from awkward import documents, empty
from lamplight.llm import token_counts as tc


def test_equals_library(spark):
    docs = documents(spark)
    lib = Tokenizer.from_file(public_tokenizers.path(tc.TOKENIZER))
    got = sorted(map(tuple, tc.token_counts(docs).collect()), key=repr)
    want = []
    for r in docs.collect():
        n = len(lib.encode(r.text or "", add_special_tokens=False))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 2048))
    assert got == sorted(want, key=repr)
    assert any(x[3] for x in got) and tc.token_counts(empty(spark)).count() == 0


def test_table_size_does_not_matter(spark):
    docs = documents(spark)
    assert sorted(map(tuple, tc.token_counts(docs, hot=3).collect()), key=repr) == sorted(map(tuple, tc.token_counts(docs).collect()), key=repr)


def test_fast_path_agrees_for_every_character():
    path = public_tokenizers.path(tc.TOKENIZER)
    lib, split = tc.library(path), tc.patterns()[1]
    for c in range(tc.FAST_BELOW):
        for t in (chr(c), f"a{chr(c)}B", f"1{chr(c)}!", chr(c) * 2 + "x"):
            if not tc.whole(t):
                assert sum(tc.lengths(path, split.findall(t.lower()))) == len(lib.encode(t, add_special_tokens=False)), hex(c)


def test_cache_is_bounded():
    from lamplight.llm.common import Lookup

    look = Lookup(lambda ws: [len(w) for w in ws], {"hot": 3}, most=10, longest=5)
    for k in range(100):
        assert look.numbers([f"w{k}", "hot", f"w{k}", "x" * 50]).tolist() == [len(f"w{k}"), 3, len(f"w{k}"), 50]
        assert len(look) <= 14 and "hot" in look
