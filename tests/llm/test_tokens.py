import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from scriptorium.llm import bpe, token_fst  # noqa: E402
from scriptorium.llm.bpe_tables import tables  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
FIXED = ["", "a", " the", "x<|endoftext|> y<|endoftext|><|endoftext|>", "  \n\n  a  b's don't", "日本語 𝕏 \x1c\x1f ² ½ Ⅷ ३४ 　a", "a" * 300, " " * 200, "\n" * 77, "_a__b 1_2"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def agree(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    encoder, decoder = bpe.codec(PATH)
    ids = encoder.encode(text)
    assert list(ids) == want
    assert decoder.decode(ids) == library.decode(want, skip_special_tokens=False)
    assert decoder.listed(ids).decode() == ",".join(map(str, want))
    assert all(token_fst.counter(PATH, n).count(text) == len(want) for n in (1, 2, 3, 7, 40, 4096))


@pytest.mark.parametrize("text", FIXED)
def test_fixed(library, text):
    agree(library, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdet hing'\n\t  .,0123é日ñ!_<|>", max_size=60))
def test_random(library, text):
    agree(library, text)


def test_glued_tokens(library):
    t, rng = tables(PATH), random.Random(3)
    for _ in range(300):
        agree(library, "".join(rng.choice(t.pieces).decode("utf-8", "ignore") for _ in range(rng.randint(1, 8))))


def test_pair_table():
    t, rng = tables(PATH), random.Random(4)
    for _ in range(2000):
        a, b = rng.randrange(len(t.pieces)), rng.randrange(300)
        assert t.apart(a, b) == (t.merged(t.pieces[a] + t.pieces[b]) == [a, b])



def test_frames(spark, library):
    rows = [(1, None, "x"), (1, "", "y"), (None, "Hi there", "z"), (2, "Hi there", None), (2, "Hi there", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")  # a clashing column that isn't kept
    counts = token_fst.token_counts(docs, PATH, ["doc_id"], limit=1).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in counts) == [(0, 8, 2, True), (1, 0, 0, False), (1, 0, 0, False), (2, 8, 2, True), (2, 8, 2, True)]
    made = bpe.digests(docs, PATH, ["doc_id"]).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sum(r.ids_sha256 == empty and r.decoded_sha256 == empty for r in made) == 2 and len(made) == 5
    assert {tuple(r.ids) for r in bpe.encode_decode(docs, PATH, ["doc_id"]).collect()} == {(), tuple(library.encode("Hi there").ids)}
    assert token_fst.token_counts(docs.limit(0), PATH, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        bpe.digests(docs, PATH, ["n_tokens"])


def test_chunk_maps_compose_in_any_grouping(library):
    counter = token_fst.counter(PATH, 9)
    text = "It's we're  they'll\n\n 12'3 o''clock 'v x'r\u3000\u3000a \t b  " * 6 + "don't"
    maps = [counter.chunk(text[i : i + 9]) for i in range(0, len(text), 9)]
    left = maps[0]
    for m in maps[1:]:
        left = counter.compose(left, m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = counter.compose(m, right)
    assert left == right
    states = [counter.start]
    for m in maps:  # one after the other
        states.append(counter.apply(m, states[-1])[0])
    assert [state for state, _ in counter.scan(maps, counter.start)] == states[1:]
    assert counter.apply(left, counter.start)[0] == states[-1]
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_counts_come_through_the_scan(library, monkeypatch):
    counter, text = token_fst.Counter(tables(PATH)), "some words and more words " * 400
    want = len(library.encode(text, add_special_tokens=False).ids)
    assert counter.count(text) == want
    monkeypatch.setattr(token_fst.Counter, "scan", lambda self, maps, entry: [self.apply(m, entry) for m in maps])
    assert counter.count(text) != want


def test_texts_without_any_border(library):
    counter = token_fst.Counter(tables(PATH))
    for text in ("7" * 300_000, "a" * 200_000, " " * 300_000, "don't" * 30_000):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_a_worker_forgets_other_operators_tables():
    """Workers are used again: what encoding keeps goes when another operator's task begins, not before."""
    from scriptorium.llm import bpe, worker

    first = bpe.codec(PATH)[0]
    ids = first.encode("some words that are kept").tolist()
    worker.begin("bpe")
    assert bpe.codec(PATH)[0] is first and len(first.words)
    assert list(worker.step("quality", lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert not bpe._codecs and not bpe.tables.cache_info().currsize
    assert bpe.codec(PATH)[0].encode("some words that are kept").tolist() == ids
