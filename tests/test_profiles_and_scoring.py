import pytest
from pyspark.sql import functions as F

from scriptorium.operators import calibrate, distill, hook, lint, massage, profile_algebra, prompts, retrieve, rules
from scriptorium.sources import baseline, corpus, markup, profiles, transcripts
from scriptorium.streaming.drafts import score_stream

FEATURES = "metric string, min double, max double, mean double, stddev double, weight double"


def stats(spark, documents=10, words=10000):
    return spark.createDataFrame([(documents, words)], "documents bigint, words bigint")


def test_scale_and_deviation(spark):
    row = spark.range(1).select(
        lint.scale(F.lit("comma_rate"), F.lit(10.0), F.lit(2.0), F.lit(100.0), F.lit(1000.0)).alias("short"),
        lint.scale(F.lit("comma_rate"), F.lit(10.0), F.lit(2.0), F.lit(5000.0), F.lit(1000.0)).alias("long"),
        lint.scale(F.lit("word_len_mean"), F.lit(10.0), F.lit(2.0), F.lit(100.0), F.lit(1000.0)).alias("plain"),
        lint.deviation(F.lit(5.0), F.lit(None).cast("double"), F.lit(3.0), F.lit(2.0)).alias("dev"),
    ).first()
    assert row.short == 10.0 and row.long == 2.0 and row.plain == 2.0 and row.dev == 1.0


def test_lint_rare_and_constant_features(spark):
    metrics = spark.createDataFrame([("d", 50, "semicolon_rate", 20.0), ("d", 50, "word_len_mean", 4.0)], "doc_id string, n_words bigint, metric string, value double")
    features = spark.createDataFrame([("semicolon_rate", 0.0, 0.0, 0.0, 0.0, 0.8), ("word_len_mean", 5.0, 5.0, 5.0, 0.0, 1.0)], FEATURES)
    met = lint.compared(metrics, features, stats(spark))
    assert [(r.metric, r.dev) for r in met.collect()] == [("semicolon_rate", 1.0)]  # a constant that is no rate isn't held against a draft
    assert lint.distances(met, ["doc_id"]).first().distance == 1.0


def test_avoided_spans_are_bytes(spark):
    docs = spark.createDataFrame([(1, "é—a—\\Eb aaa"), (2, None)], "doc_id int, text string")
    terms = spark.createDataFrame([("—",), ("aa",), ("",), ("zz",)], "term string")
    got = sorted((r.doc_id, r.term, r.start, r.end) for r in lint.avoided_spans(docs, terms, ["doc_id"]).collect())
    text = "é—a—\\Eb aaa".encode()
    assert got == [(1, "aa", text.index(b"aa"), text.index(b"aa") + 2), (1, "—", 2, 5), (1, "—", 6, 9)]


def test_weights_and_ranges(spark):
    rows = spark.createDataFrame([("a", v) for v in (2.0, 4.0, 4.0, 4.0, 5.0, 5.0, 7.0, 9.0)] + [("z", 0.0)], "metric string, value double")
    got = {r.metric: r for r in distill.features(rows, []).collect()}
    assert (got["a"].mean, got["a"].stddev, got["a"]["min"], got["a"]["max"], got["a"].weight) == (5.0, 2.0, 2.0, 8.0, 0.714)
    assert got["z"].weight == 0.8 and distill.avoid_list(["x", "", "y", "x"]) == ["x", "y"] and distill.Options(range_k=0).width == 1.5 and distill.thin(4)


def test_rules(spark):
    docs = spark.createDataFrame([(i, "One two three. Four five six.\n\nSeven eight nine. Ten.\n\nA b c. D e f.") for i in range(6)], "doc_id int, text string")
    mined = rules.mine(rules.paragraph_table(docs, ["doc_id"]), [])
    assert {(r.rule_id, r.param, r.support) for r in mined.collect()} == {("max-sentence-length", 3.0, 1.0), ("max-paragraph-length", 2.0, 1.0)}
    draft = spark.createDataFrame([(9, "This sentence runs on and on. Yes.\n\nFine.")], "doc_id int, text string")
    got = rules.check(rules.paragraph_table(draft, ["doc_id"]), mined, ["doc_id"]).collect()
    assert [(r.rule_id, r.paragraph, r.sentence, r.severity) for r in got] == [("max-sentence-length", 1, 1, "soft")]
    assert rules.mine(rules.paragraph_table(docs.limit(1), ["doc_id"]), []).count() == 0  # three paragraphs only


@pytest.mark.parametrize("pos, neg, want", [([1, 2], [3, 4], 1.0), ([3, 4], [1, 2], 0.0), ([1, 3], [2, 4], 0.75), ([1, 2], [2, 4], 0.875), ([], [1], 0.0)])
def test_auc(spark, pos, neg, want):
    scored = spark.createDataFrame([(float(x), True) for x in pos] + [(float(x), False) for x in neg], "distance double, target boolean")
    assert calibrate.auc(scored).first().auc == pytest.approx(want)


def test_threshold_and_split(spark):
    scored = spark.createDataFrame([(1.0, True), (3.0, True), (5.0, False), (6.0, False)], "distance double, target boolean")
    best = calibrate.youden(scored).first()
    assert (best.threshold, best.tpr, best.fpr, best.accuracy) == (3.0, 1.0, 0.0, 1.0)
    assert calibrate.discriminator(scored).first().separates
    parts = calibrate.split(spark.createDataFrame([(i,) for i in range(22)], "doc_id int"), "doc_id", 1)
    assert parts.where("split = 'holdout'").count() == 6  # fewer than two means every fourth
    with pytest.raises(ValueError):
        calibrate.guard(1, 1, 1)


def test_retrieval(spark):
    topic = {"sea": "whale ocean sailor harbor", "sky": "cloud thunder falcon breeze", "oven": "bread butter flour oven"}
    docs = spark.createDataFrame([(i, n, " ".join([w] * 7)) for i, (n, w) in enumerate(topic.items())] + [(3, "copy", " ".join([topic["sea"]] * 7)), (4, "short", "too short")], "ord int, source string, text string")
    chunks = retrieve.chunks(docs, "source", "ord")
    assert {r.source for r in chunks.collect()} == {"sea", "sky", "oven"}
    weights = retrieve.idf(chunks)
    bank = retrieve.postings(chunks, ["source", "para"], weights)
    asked = spark.createDataFrame([(1, "a whale in the harbor"), (2, "nothing alike")], "q int, text string")
    got = retrieve.top(bank, weights, asked, "q", 2).collect()
    assert [(r.query, r.rank, r.source) for r in got] == [(1, 1, "sea")]


def test_massage(spark):
    drafts = spark.createDataFrame([("dirty", "One — two."), ("clean", "One two."), ("stuck", "Keep this ; mark.")], "draft_id string, text string")
    features = spark.createDataFrame([], FEATURES)
    none = spark.createDataFrame([], "rule_id string, param double, severity string, statement string")
    profile = massage.Profile(features, stats(spark), none, avoided=("—", ";"))
    outcome, steps = massage.massage(drafts, profile, massage.replacing({"—": "-"}))
    assert {r.draft_id: (r.accepted, r.revisions) for r in outcome.collect()} == {"dirty": (True, 1), "clean": (True, 0), "stuck": (False, 1)}
    assert sorted((r.draft_id, r.revision) for r in steps.collect()) == [("clean", 0), ("dirty", 0), ("dirty", 1), ("stuck", 0)]
    outcome, _ = massage.massage(drafts, profile, None)
    assert {r.draft_id: r.revisions for r in outcome.collect()} == {"dirty": 0, "clean": 0, "stuck": 0}
    outcome, _ = massage.massage(drafts.where("draft_id = 'dirty'"), profile, massage.calling(lambda t: t + " — x"), most=2)
    assert outcome.first().revisions == 2 and not outcome.first().accepted


def test_profile_files(tmp_path):
    base = profiles.Profile(id="base", features=[{"id": "a", "weight": 1.0}], avoided=["x"], rules=[{"id": "r", "class": "judged"}])
    child = profiles.Profile(id="c", register="essay", inherits="base.profile.yaml", features=[{"id": "a", "weight": 0.5}, {"id": "b"}], avoided=["y", "x"])
    profiles.save(base, str(tmp_path / "base.profile.yaml"))
    profiles.save(child, str(tmp_path / "c.profile.yaml"))
    (tmp_path / "bad.profile.yaml").write_text("- not a mapping")
    got = profiles.find(str(tmp_path), "essay")
    assert got.features[0]["weight"] == 1.0 and len(got.features) == 2 and got.avoided == ["y", "x"] and len(got.rules) == 1
    assert profiles.resolve(got, str(tmp_path)) == got
    assert [p.id for _, p in profiles.listing(str(tmp_path))] == ["base", "c"]
    with pytest.raises(ValueError):
        profiles.load_strict(str(tmp_path))
    with pytest.raises(ValueError):
        profiles.find("", "name")
    assert profiles.is_path("a/b") and profiles.is_path("x.YML") and not profiles.is_path("essay")


def test_algebra_and_prompts(spark):
    rule = spark.createDataFrame([("a", "soft")], "rule_id string, severity string")
    every, skipped = profile_algebra.add_rules(rule, spark.createDataFrame([("a", "x"), ("b", "y")], "rule_id string, severity string"))
    assert sorted(r.rule_id for r in every.collect()) == ["a", "b"] and [r.rule_id for r in skipped.collect()] == ["a"]
    reply = spark.createDataFrame([('So: [{"id":"a","holds":false,"evidence":"e"}] end',), ("none",), ("[broken",)], "reply string")
    got = [r.v for r in reply.select(prompts.verdicts(F.col("reply")).alias("v")).collect()]
    assert got[0][0].id == "a" and got[0][0].holds is False and got[1] is None
    assert "up to 8 rules" in prompts.induction_prompt(["a"], 0) and "Never use: x" in prompts.revision_prompt("d", {"guidance": "g", "avoided": ["x"]})


def test_sources(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "a.md").write_text("alpha")
    (tmp_path / "sub dir" / "B.TXT").write_bytes(b"be\xffta")
    (tmp_path / "c.html").write_text("no")
    got = {r.doc_name.rsplit("/", 2)[-2] + "/" + r.doc_name.rsplit("/", 1)[-1]: r.text for r in corpus.read_corpus(spark, str(tmp_path), "essay").collect()}
    assert got == {f"{tmp_path.name}/a.md": "alpha", "sub dir/B.TXT": "be�ta"}
    (tmp_path / "base.tsv").write_text("# head\n\nThe\t5\nthe\t7\nbad\tx\nzero\t0\n")
    assert [(r.term, r.base) for r in baseline.load(spark, str(tmp_path / "base.tsv")).collect()] == [("the", 7)]
    book = f"head\n{baseline.START} X ***\nbody text\n{baseline.END} X ***\ntail"
    assert spark.createDataFrame([(book,)], "t string").select(baseline.without_banner(F.col("t")).alias("t")).first().t == "body text\n"
    wiki = spark.createDataFrame([('{"query":{"pages":{"1":{"extract":"hello"},"2":{}}}}',), ("nope",)], "value string")
    assert [r.text for r in baseline.extracts(wiki).collect()] == ["hello"]


def test_markup(spark):
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("t")).first().t
    assert one(markup.markdown_to_prose, "---\na: b\n---\nx <em>y</em> a < b [l](u) ![i](u) <!-- c -->") == "x y a < b l  "
    html = "<head><title>t</title></head><body><h2>H</h2><p>a &amp; b &#8212; &#x41;&#0;&bogus;<br>c</p><ul><li>d</li></ul></body>"
    assert one(markup.html_to_prose, html) == "\n\n## H\na & b -- A�\nc\n\n- d\n\n"


def test_transcripts_and_hook(spark):
    lines = [
        '{"type":"user","message":{"role":"user","content":"hi"}}',
        '{"type":"assistant","message":{"role":"assistant","content":"first"}}',
        '{"type":"assistant","message":{"content":[{"type":"text","text":"sec"},{"type":"tool_use"},{"type":"text","text":"ond"}]}}',
        '{"type":"assistant","isSidechain":true,"message":{"content":"side"}}',
        "garbage",
        '{"type":"assistant","message":{"content":[{"type":"tool_use"}]}}',
    ]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "conv int, turn int, value string")
    last = hook.last_assistant(transcripts.turns(rows, ["conv"]), "conv", "turn")
    assert last.first().text == "second"
    assert [hook.decisions(last, "conv", a).first().decision for a in (["ond"], ["zz"], [])] == ["block", "allow", "allow"]


def test_stream_equals_batch(spark, tmp_path):
    from scriptorium.operators.metrics import metrics_long

    docs = spark.createDataFrame([("a", "One, two. Three!"), ("b", "A longer draft, with commas, and more; perhaps."), ("c", "")], "draft_id string, text string")
    features = distill.features(metrics_long(docs, []), []).withColumn("max", F.col("mean"))
    want = lint.with_wordless(lint.distances(lint.compared(metrics_long(docs, ["draft_id"]), features, stats(spark, 3, 11)), ["draft_id"]), docs, ["draft_id"])
    docs.write.json(str(tmp_path / "in"))
    stream = score_stream(spark.readStream.schema(docs.schema).json(str(tmp_path / "in")), features, stats(spark, 3, 11), ["draft_id"])
    query = stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("scored").collect()} == {tuple(r) for r in want.collect()}
