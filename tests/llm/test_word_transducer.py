import hashlib
import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))
import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from awkward import documents, empty
from lamplight.llm import word_transducer as wt

PATH = public_tokenizers.path(wt.TOKENIZER)


def lexicon_of(tmp_path, words):
    (where := tmp_path / "lexicon.bin").write_bytes(wt.compile_words(words))
    return wt.Lexicon(str(where))


def lookups(lexicon, words):
    """Ids of each word, None where it is not held."""
    held, n, ids = lexicon.encode(words)
    ends = np.cumsum(n).tolist()
    return [tuple(ids[e - k : e].tolist()) if h else None for h, e, k in zip(held.tolist(), ends, n.tolist())]


def merged(words):
    n, ids = wt.merges(PATH).encode(words)
    ends = np.cumsum(n).tolist()
    return [tuple(ids[e - k : e].tolist()) for e, k in zip(ends, n.tolist())]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def library_rows(docs):
    lib = Tokenizer.from_file(PATH)
    out = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        out.append((r.doc_id, ids, lib.decode(ids, skip_special_tokens=False)))
    return sorted(out, key=repr)


def test_equals_library(spark):
    docs = documents(spark)
    out = wt.decode_bpe(wt.encode_bpe(docs))
    assert out.columns == ["doc_id", "ids", "decoded"]
    assert sorted(map(tuple, out.collect()), key=repr) == library_rows(docs)
    assert wt.encode_bpe(empty(spark)).count() == 0


def test_size_of_transducer_does_not_matter(spark):
    docs = documents(spark)
    want = library_rows(docs)
    for words in (1, 50):
        assert sorted(map(tuple, wt.decode_bpe(wt.encode_bpe(docs, words=words)).collect()), key=repr) == want


def test_digests(spark):
    docs = documents(spark)
    out = wt.decode_bpe(wt.encode_bpe(docs))
    n, ids, decoded = wt.digests(out["ids"], out["decoded"])
    want = [(i, len(x), digest(" ".join(map(str, x))), digest(t)) for i, x, t in library_rows(docs)]
    assert sorted(map(tuple, out.select("doc_id", n, ids, decoded).collect()), key=repr) == sorted(want, key=repr)


def test_decode_leaves_out_unknown_ids(spark):
    lib = Tokenizer.from_file(PATH)
    lists = [[320, 1929, 49407], [], [10**6, 320, -1], None, [None, 320]]
    got = {r.k: r.decoded for r in wt.decode_bpe(spark.createDataFrame(list(enumerate(lists)), "k int, ids array<int>")).collect()}
    assert got[0] == lib.decode(lists[0], skip_special_tokens=False) and got[1] == "" and got[3] is None
    assert got[2] == got[4] == lib.decode([320], skip_special_tokens=False)


def test_transducer_holds_just_its_words(tmp_path):
    rng = random.Random(2)
    words = {bytes(rng.choice(b"abcdeinthr") for _ in range(rng.randint(1, 9))) for _ in range(3000)} | {b"walking", b"talking", "naïve".encode()}
    held = dict(zip(sorted(words)[::2], merged(sorted(words)[::2])))
    lexicon = lexicon_of(tmp_path, held)
    order = sorted(words) + [b"", b"a" * 200]
    assert lookups(lexicon, order) == [held.get(w) for w in order]
    assert lookups(lexicon_of(tmp_path, {}), [b"a"]) == [None]


def test_ends_are_shared(tmp_path):
    """Words of the same end and ids share its states, so the automaton is no tree; states are minimal."""
    words = {a + b"ing": (k, 500) for k, a in enumerate((b"walk", b"talk", b"jump"))}
    lexicon = lexicon_of(tmp_path, words)
    # the states after a first letter differ only where what is read next differs: w|alking, t|alking, j|umping
    assert lexicon.states == 1 + len("alking") + 1 + len("ump")
    assert lookups(lexicon, sorted(words)) == [words[w] for w in sorted(words)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 5), min_size=1, max_size=4).map(tuple), max_size=40))
def test_any_mapping(tmp_path_factory, words):
    lexicon = lexicon_of(tmp_path_factory.mktemp("lexicon"), words)
    assert lookups(lexicon, list(words)) == list(words.values())
    assert lookups(lexicon, [w + b"!" for w in words]) == [words.get(w + b"!") for w in words]


def test_merges_equal_library():
    lib, rng = Tokenizer.from_file(PATH), random.Random(3)
    words = ["".join(rng.choice("abcdeinthr") for _ in range(n)) for n in [*range(1, 120), 3000, *[rng.randint(1, 12) for _ in range(3000)]]] + ["x" * 5000, "ab" * 24]
    assert merged([w.encode() for w in words]) == [tuple(lib.encode(w, add_special_tokens=False).ids) for w in words]
    assert merged([]) == []


def test_special_strings_between_stretches(tmp_path):
    lib, rng = Tokenizer.from_file(PATH), random.Random(4)
    lexicon = lexicon_of(tmp_path, {b"the": (518,)})
    for _ in range(50):
        text = "".join(rng.choice(["<|endoftext|>", "<|startoftext|>", "the", " ", "it's", "né 12", "\u2019s"]) for _ in range(rng.randint(1, 12)))
        assert wt.encode_stretches(PATH, lexicon, wt.split_text(PATH, text))[1].tolist() == lib.encode(text, add_special_tokens=False).ids
