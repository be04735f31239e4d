"""Operators that SQL can't express, held against plain versions of what they compute."""

import collections
import hashlib
import itertools
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import lang_id, media, mixing, ngram_join, quality, toxicity
from scriptorium.llm.vamana import Graph, Params, _scaled, search

WORDS = "[^\\x20\\x09-\\x0d]+"


# Mixing


def turns(rows):
    """(slot, source, words) of every whole or partial turn of a document, in slot order."""
    return sorted((slot, r.source, r["size"]) for r in rows for slot in r.slots)


def test_any_stretch_of_the_mix_has_the_target_shares(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (20 + i % 7), f"s{i % 4}") for i in range(1200)], "doc_id bigint, text string, source string")

    def worst():
        rows = mixing.mix(docs, ["doc_id"], 16).collect()
        aims = {r.source: r.target for r in rows}
        order = turns(rows)
        worst = 0.0
        for begin, end in ((0, 0.2), (0, 0.5), (0.3, 0.6), (0.5, 0.9)):
            part = order[int(begin * len(order)) : int(end * len(order))]
            words = collections.Counter()
            for _, source, n in part:
                words[source] += n
            worst = max([worst, *(abs(words[s] / sum(words.values()) - aims[s] / sum(aims.values())) for s in aims)])
        return worst, {r.doc_id: r.first_slot for r in rows}

    far, slots = worst()
    assert far < 0.05
    monkeypatch.setattr(mixing, "GOLDEN", 1)  # no low discrepancy: one source after the other
    far, others = worst()
    assert far > 0.2 and others != slots


def test_pieces_of_the_mix(spark):
    rows = mixing.mix(spark.createDataFrame([(i, "w " * n, "ab"[i % 2]) for i, n in enumerate([5, 9, 40, 3, 17, 30, 1, 0])], "doc_id bigint, text string, source string"), ["doc_id"], 4).collect()
    for source in "ab":
        own = [r for r in rows if r.source == source]
        assert sum(r.taken for r in own) == math.floor(own[0].target)
        for r in own:
            assert (r.first_slot is None) == (r.taken == 0) and list(r.slots) == sorted(set(r.slots))
            assert r["size"] == 0 or -(-r.taken // r["size"]) == len(r.slots)
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([(1, "a", "s", 2)], "doc_id int, text string, source string, slots int"), ["doc_id", "slots"])


# Vector search


@pytest.mark.parametrize("name", ["plain", "huge", "tiny", "offset", "clusters", "line"])
def test_graph_recall_at_any_scale(name):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 16))
    v = {"plain": v, "huge": v * 1e150, "tiny": v * 1e-150, "offset": v + 1e6, "clusters": v * 0.01 + rng.normal(size=(30, 16))[rng.integers(0, 30, 700)] * 50, "line": np.arange(700.0)[:, None] * np.ones(16)}[name]
    points, queries = _scaled(v, v[:60])
    ids, _, _ = Graph(points, Params(build_beam=48)).search(queries, 96)
    far = np.sqrt(((points[None] - queries[:, None]) ** 2).sum(-1))
    want = np.sort(far, 1)[:, :10]
    got = np.take_along_axis(far, ids[:, :10], 1)
    assert (got <= want * (1 + 1e-9)).mean() >= 0.9


def test_ties_go_to_smaller_ids_across_shards(spark):
    rows = [(i, [float(j == i // 2) * (1 - 2 * (i % 2)) for j in range(20)]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = search(table, table.where("vec_id % 20 = 0"), params=Params(least_rows=8, most_rows=8)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, i, i + 1) for i in range(1, 11)] + [(20, i, i - 1) for i in range(1, 11)]
    assert all(r.score == math.sqrt(2) for r in got)
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 3.0]), (2, [5.0, 5.0])], "vec_id bigint, embedding array<double>")
    got = search(twice, twice.where("vec_id = 0"), k=3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 1, 2]  # every row is a candidate


# Candidates of the join


@pytest.mark.parametrize("percent", [50, 70, 80, 90, 99, 100])
def test_linked_sets_have_a_key_in_common(percent):
    rng = np.random.default_rng(percent)
    rule, pairs = ngram_join.Rule(3, percent), 0
    for _ in range(4):
        universe = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
        sets = []
        for _ in range(10):
            base = rng.choice(universe, int(rng.integers(3, 250)), replace=False)
            for _ in range(10):
                less = int(rng.integers(0, max(1, len(base) * (100 - percent) // 100) + 2))
                sets.append(np.unique(np.concatenate((rng.choice(base, max(1, len(base) - less), replace=False), rng.choice(universe, int(rng.integers(0, less + 1)), replace=False)))))
        common = set(universe[: int(rng.integers(0, 480))].tolist())
        number, keys = ngram_join.part_keys(sets, rule, lambda g: np.array([int(x) in common for x in g], bool))
        own = [set(keys[number == i].tolist()) for i in range(len(sets))]
        plain = [frozenset(s.tolist()) for s in sets]
        for i, j in itertools.combinations(range(len(sets)), 2):
            if plain[i] != plain[j] and 100 * len(plain[i] & plain[j]) >= percent * len(plain[i] | plain[j]):
                pairs += 1
                assert own[i] & own[j]
    assert pairs > 50 or percent > 98


def test_keys_are_packed_in_buckets():
    """Every row comes back from its bucket; a key and its share of the name take less than the 16 bytes of a plain row."""
    rng = np.random.default_rng(3)
    cids = np.repeat(rng.integers(0, 1 << 40, 60), rng.choice([1, 30, 700], 60))
    keys = rng.integers(0, 1 << 63, len(cids), dtype=np.uint64) * np.uint64(2)
    for buckets in (1, 7, 100):
        rows = list(ngram_join.packed(cids, keys, buckets))
        assert len({r[0] for r in rows}) == len(rows) and all(0 <= r[0] < buckets for r in rows)
        got = [(b, *x) for b, *made in rows for x in zip(*(y.tolist() for y in ngram_join.unpacked(*made)))]
        assert sorted(got) == sorted((k * buckets >> 64, c, k & (1 << 40) - 1) for c, k in zip(cids.tolist(), keys.tolist()))
        assert sum(len(x) for r in rows for x in r[1:]) < 8 * len(keys)
    assert not list(ngram_join.packed(cids[:0], keys[:0], 5))


# Languages


def test_proportions_against_plain_loops():
    rng = np.random.default_rng(4)
    names = ["aa", "bb", "cc"]
    model = lang_id.Model(pa.table({"lang": names, "cell": [0, 1, 2], "n": [5, 5, 5]}))
    bounds = np.array([0, 0, 1, 4, 12, 40])
    logs = -5 * rng.random((40, 3))
    logs[12:, 0] += 3

    def em(rows, share):
        for _ in range(lang_id.ROUNDS):
            total = [0.0] * 3
            for row in rows:
                part = [math.exp(row[i] - max(row)) * share[i] for i in range(3)]
                for i in range(3):
                    total[i] += part[i] / sum(part)
            share = [t / len(rows) for t in total]
        return share, sum(math.log(sum(math.exp(row[i] - max(row)) * share[i] for i in range(3))) for row in rows)

    for r, got in enumerate(model.proportions(logs, bounds)):
        rows = logs[bounds[r] : bounds[r + 1]].tolist()
        share = [1 / 3] * 3
        if rows:
            share, fit = em(rows, share)
            alive = {0, 1, 2}
            while len(alive) > 1:
                out = min(sorted(alive), key=lambda i: share[i])
                start = [max(share[i], 1e-3) if i in alive - {out} else 0.0 for i in range(3)]
                less, less_fit = em(rows, [x / sum(start) for x in start])
                if less_fit + 0.5 * math.log(max(len(rows), 2)) < fit:
                    break
                share, fit, alive = less, less_fit, alive - {out}
            assert np.allclose(got, share)


# Quality


def test_risk_and_its_gradient():
    rng = np.random.default_rng(5)
    p, u = rng.normal(1, 1, (30, 3)), rng.normal(0, 1, (50, 3))
    for prior, w in ((0.3, rng.normal(size=4)), (0.7, rng.normal(size=4)), (0.9, np.array([3.0, 3.0, 3.0, 2.0]))):
        plus = sum(math.log1p(math.exp(-(x @ w[:3] + w[3]))) for x in p) / 30
        minus_p = sum(math.log1p(math.exp(x @ w[:3] + w[3])) for x in p) / 30
        minus_u = sum(math.log1p(math.exp(x @ w[:3] + w[3])) for x in u) / 50
        value, gradient = quality.risk(w, p, u, prior)
        decay = quality.DECAY / 2 * float(w[:3] @ w[:3])
        assert math.isclose(value, prior * plus + max(0.0, minus_u - prior * minus_p) + decay)
        if minus_u >= prior * minus_p:
            for i in range(4):
                step = np.eye(4)[i] * 1e-5
                assert abs((quality.risk(w + step, p, u, prior)[0] - quality.risk(w - step, p, u, prior)[0]) / 2e-5 - gradient[i]) < 1e-6


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_is_estimated_without_negatives(prior):
    rng = np.random.default_rng(6)
    p = rng.normal(0, 1, (2000, 5))
    u = np.concatenate((rng.normal(0, 1, (int(4000 * prior), 5)), rng.normal(3, 1, (4000 - int(4000 * prior), 5))))
    assert abs(quality.estimate_prior(p, u) - prior) < 0.05


# Toxicity


def test_decoding_against_every_path():
    """The likeliest of all ways to read a short stretch, counted one by one."""
    rng = np.random.default_rng(7)
    decoder = toxicity.Decoder(rng.integers(0, 50, 27**3))
    logs = decoder.logs

    def ways(stretch, at, a, b, written, score):
        if at == len(stretch):
            yield score + logs[a, b, 0], "".join(chr(96 + c) if c > 0 else " " for c in written)
            return
        sign, before = stretch[at], stretch[at - 1] if at else ""
        gap = toxicity.LEET.get(sign) == ""
        if gap and before and toxicity.LEET.get(before) == "":
            yield from ways(stretch, at + 1, a, b, written, score)
            return
        options = [(sign, decoder.KEPT)] if sign.isalpha() else [(c, decoder.LIKE) for c in toxicity.LEET.get(sign, "")]
        for c, cost in options:
            yield from ways(stretch, at + 1, b, ord(c) - 96, [*written, ord(c) - 96], score + cost + logs[a, b, ord(c) - 96])
        if gap and b:
            yield from ways(stretch, at + 1, 0, 0, [*written, -64], score + logs[a, b, 0])
        if gap or sign == before or not options:
            yield from ways(stretch, at + 1, a, b, written, score + decoder.EXTRA)

    for stretch in ["1d10t", "s.t.u", "aa1!", "$tup1d", "x--y 1", "|11l", "b00b", "a.b..c"]:
        assert decoder.decode(stretch) == max(ways(stretch, 0, 0, 0, [], 0.0), key=lambda x: x[0])[1], stretch


# Media


def samples(form):
    """Pixels of a greyscale PNG, read in another way than the operator's."""
    size = struct.unpack(">II", form[16:24])
    raw = zlib.decompress(form[form.index(b"IDAT") + 4 : form.rindex(b"IEND") - 8])
    return b"".join(raw[i * (size[0] + 1) + 1 : (i + 1) * (size[0] + 1)] for i in range(size[1]))


def test_media_rows(spark):
    texts = {1: None, 2: "", 3: "a", 4: "x" * 192, 5: "é\n" * 3000, 6: "a", 7: " \x00z"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").selectExpr("*", "1 as media_bytes", "2 as item")
    made = media.stored_documents(docs, ["doc_id"]).cache()
    forms = {r.doc_id: bytes(r.media) for r in made.collect()}
    pages = media.sequences(made.select("doc_id", "n_bytes", "html"), ["doc_id", "n_bytes"])
    got = {r.doc_id: r for r in media.resolve(pages, media.features(made.select("digest", "media")), ["doc_id", "n_bytes"]).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert samples(forms[i]) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(forms[i]), hashlib.sha256(forms[i]).hexdigest())
        share = [n / len(payload) for n in collections.Counter(payload).values()]
        mean = sum(payload) / len(payload)
        deviation = math.sqrt(sum((x - mean) ** 2 for x in payload) / len(payload))
        assert r.feature == f"distinct={len(share)};mean={mean:.4f};deviation={deviation:.4f};entropy={abs(-sum(p * math.log2(p) for p in share)):.4f}"
        assert (r.pos, r.caption) == (1, f"{len(raw)} bytes")
    for bad, call in ((["digest"], media.stored_documents), (["items"], media.sequences)):
        with pytest.raises(ValueError):
            call(docs.withColumn(bad[0], F.lit(1)).withColumn("html", F.lit("")), bad)
    with pytest.raises(ValueError):
        media.resolve(pages, media.features(made.select("digest", "media")).withColumn("n_bytes", F.lit(1)), ["doc_id", "n_bytes"])
    assert media.stored_documents(docs.limit(0), ["doc_id"]).count() == 0


def test_sequence_of_broken_pages():
    show = lambda h: [(i["pos"], i["text"] or i["digest"], i["caption"]) for i in media.sequence(h)]
    assert show("<![foo[ x ]]>a") == [(0, "a", None)]
    assert show("<head><title>t<p>one<p>two") == [(0, "one", None), (1, "two", None)]
    assert show("<noscript>n<p>a") == [(0, "n", None), (1, "a", None)]
    assert show('<div><figure><img src="media:a"><figcaption>cap</div><p>later') == [(0, "a", "cap"), (1, "later", None)]
    assert show('<figure><img src="media:a"><figcaption>cap<p>prose') == [(0, "a", "cap"), (1, "prose", None)]
    nested = '<figure><img src="media:a"><figure><img src="media:b"><figcaption>B</figcaption></figure><figure><img src="media:c"></figure><figcaption>A</figcaption></figure>'
    assert show(nested) == [(0, "a", "A"), (1, "b", "B"), (2, "c", "A")]
    assert show('<video><source src="media:v"><source src="media:w"></video><picture><source srcset="x"><img src="media:i" alt="al">') == [(0, "v", None), (1, "i", "al")]
    for odd in ["<!--" * 50_000, "<a " * 50_000, "<![x" * 50_000, "<script>" * 50_000, "<template>" * 20_000, "<figure>" * 3000 + "<div>" * 3000, "<figure><figcaption>" + "<p> " * 20_000]:
        media.sequence(odd)


def test_recall_on_the_test_table(spark):
    from scriptorium.llm.recall import recall

    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert recall(table, table.where("vec_id % 100 = 0")) >= 0.9
