import io
import json

import pytest
from pyspark.sql import functions as F

from scriptorium import api, cli
from scriptorium.operators import massage, model, retrieve
from scriptorium.service import Results, Service
from scriptorium.sources import baseline, corpus, profiles
from scriptorium.tools import Tools


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    for i in range(6):
        (folder / f"{i}.md").write_text(f"The whale swam on, and on. We saw it {'again ' * (i + 1)}today.\n\nIt was large. It was calm.\n\nThe end.")
    out = folder / "sea.profile.yaml"
    text = io.StringIO()
    assert cli.run(["distill", "--corpus", str(folder), "--register", "sea", "--avoid", "—,--", "--out", str(out)], spark, out=text) == 0
    return folder, profiles.load(str(out))


def test_distilled_profile(made):
    _, p = made
    assert (p.id, p.language, p.documents, p.avoided) == ("sea", "en", 6, ["—", "--"])
    assert len(p.features) == 49 and {r["id"] for r in p.rules} == {"max-sentence-length", "max-paragraph-length"}


def test_score_and_exit_codes(spark, made):
    folder, _ = made
    path = str(folder / "sea.profile.yaml")
    for extra, code in ([], 1), (["--json"], 0):
        out = io.StringIO()
        assert cli.run(["score", "--profile", path, *extra], spark, io.StringIO("Bad — dash."), out) == code
    found = json.loads(out.getvalue())
    assert found["hard_violations"] == 1 and found["lexical"][0]["start"] == 4 and found["on_target"] is None and found["distance"] > 0


def test_register_is_needed(spark, made):
    with pytest.raises(ValueError):
        api.distill(spark.createDataFrame([], "doc_id string, text string"), "", spark.createDataFrame([], "term string, base bigint"))


def test_hook(spark, made, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text('{"type":"assistant","message":{"content":"a — b"}}\n')
    got = cli.stop_hook(spark, {"transcript_path": str(path)}, "", ("—",))
    assert got["decision"] == "block" and "at byte 2" in got["reason"]
    assert cli.stop_hook(spark, {"transcript_path": str(path)}, "", ()) is None
    assert cli.stop_hook(spark, {"transcript_path": str(path), "stop_hook_active": True}, "", ("—",)) is None


def test_service(spark, made):
    _, p = made
    s = Service(spark, {"sea": p})
    assert s.answer("GET", "/profiles")[2]["profiles"][0]["links"].keys() == {"self", "assessments", "reviews"}
    assert s.answer("GET", "/nothing")[0] == 404 and s.answer("POST", "/profiles/sea/massages", b"{}")[0] == 405 and s.answer("POST", "/profiles/sea/reviews", b'{"text":" "}')[0] == 400
    status, headers, body = s.answer("POST", "/profiles/sea/reviews", json.dumps({"text": "A -- b."}).encode())
    assert status == 201 and s.answer("GET", headers["Location"])[2] == body and body["hard_violations"] == 1 and body["judging_prompt"] is None
    kept = Results(2)
    assert [kept.add("a", {"n": i}) for i in range(3)] == [1, 2, 3] and kept.get("a", 1) is None and kept.get("a", 3) == {"n": 2}


# Tools, calibration, the bank


@pytest.fixture(scope="module")
def two_corpora(tmp_path_factory):
    folder = tmp_path_factory.mktemp("two")
    for name, text in (("sea", "The whale swam on, and on, past the old grey rocks {}. We saw it {}today, and it saw us from far away below.\n\nIt was large. It was calm."), ("dry", "However! Results (see {}) were; in fact: {}good? Yes! Perhaps -- maybe they're fine!")):
        (folder / name).mkdir()
        for i in range(8):
            (folder / name / f"{i}.txt").write_text(text.format("abc"[i % 3], "again " * i))
    return folder


def test_tools(spark, two_corpora, monkeypatch):
    monkeypatch.chdir(two_corpora)
    sea, dry = str(two_corpora / "sea"), str(two_corpora / "dry")
    tools = Tools(spark, str(two_corpora))
    assert "note" in tools.call("list_profiles", {}) and tools.call("fly", {})["error"].startswith("no tool")
    made = tools.call("calibrate", {"target_dir": sea, "decoys_dir": dry, "register": "sea", "out": "sea.profile.yaml", "avoid": "--, —"})
    assert made["auc"] == 1.0 and made["tpr"] == 1.0 and made["fpr"] == 0.0 and made["separates"] and (made["train"], made["target_holdout"], made["decoys"]) == (6, 2, 8)
    assert tools.call("distill", {"corpus_dir": dry, "register": "dry", "out": "dry.profile.yaml"})["features"] == 49
    assert [(p["id"], p["calibrated"]) for p in tools.call("list_profiles", {})["profiles"]] == [("dry", False), ("sea", True)]
    found = tools.call("score", {"profile": "sea", "profile_path": "dry.profile.yaml", "text": "A -- b."})
    assert found["hard_violations"] == 0 and found["on_target"] is None  # a path goes before a name
    found = tools.call("style_review", {"profile": "sea", "text": "A -- b."})
    assert found["hard_violations"] == 1 and found["on_target"] is False and found["avoided_lexicon"] == ["--", "—"]
    near = tools.call("retrieve", {"corpus_dir": sea, "query": "whale rocks", "k": 2, "min_words": 5})["exemplars"]
    assert len(near) == 2 and "whale" in near[0]["text"]
    for name, a in (("distill", {}), ("calibrate", {"target_dir": "sea"}), ("retrieve", {"corpus_dir": sea, "query": " "}), ("score", {"profile": "none", "text": ""})):
        assert tools.call(name, a)["error"]
    out = io.StringIO()
    assert cli.run(["tools", "--profiles", str(two_corpora)], spark, io.StringIO('{"tool": "list_profiles"}\n\nodd\n'), out) == 0
    first, second = map(json.loads, out.getvalue().splitlines())
    assert len(first["profiles"]) == 2 and second["error"]


def test_calibrate_and_retrieve(spark, two_corpora):
    read = lambda name: corpus.read_corpus(spark, str(two_corpora / name), name).select(F.col("doc_name").alias("doc_id"), "text")
    base = spark.createDataFrame([("whale", 1), ("the", 50)], "term string, base bigint")
    with pytest.raises(ValueError):
        api.calibrate(read("sea"), read("dry").limit(0), "sea", base)
    assert api.calibrate(read("sea"), read("dry"), "sea", base, holdout_every=2).calibration["target_holdout"] == 4
    bank = api.Bank.of(read("sea"), min_words=5)
    assert [r.rank for r in bank.passages("whale", 0).collect()] == [1, 2, 3] and bank.passages("zebra").count() == 0
    bank.free()
    with pytest.raises(ValueError):
        api.passages(read("sea"), " ")


# Briefs, judges and the model's client


@pytest.fixture(scope="module")
def target(spark, made):
    _, p = made
    t = profiles.tables(spark, [p])
    rules = t["rules"].select("rule_id", "param", "severity", "statement", "class")
    judged = spark.createDataFrame([("calm-voice", 0.0, "hard", "Stay calm.", "judged"), ("no-jokes", 0.0, "soft", "Make no jokes.", "judged")], rules.schema)
    return massage.Profile(t["features"].drop("profile_id"), t["stats"].select("documents", "words"), rules.unionByName(judged), ("—", "--"), None, ("whale",))


def test_brief(spark, target):
    texts = [("a", "Bad — dash -- two — three."), ("b", "The whale swam on.")]
    drafts = spark.createDataFrame(texts, "draft_id string, text string")
    docs = spark.createDataFrame([(1, "The big whale and the small whale swam on and on past rocks.")], "doc_id bigint, text string")
    chunks = retrieve.chunks(docs, "doc_id", "doc_id", 3)
    weights = retrieve.idf(chunks)
    bank = massage.Bank(retrieve.postings(chunks, ["source", "para"], weights), weights, chunks)
    seen = massage.assess(drafts, target)
    got = {r.draft_id: r.brief for r in massage.briefs(seen, target, bank=bank, exemplars=0).collect()}
    assert [(x.term, x.start) for x in got["a"].lexical] == [("—", 4), ("--", 13), ("—", 20)] and got["b"].lexical == []
    assert len(got["a"].features) > 0 and got["a"].avoided == ["—", "--"] and got["a"].preferred == ["whale"] and got["a"].guidance and got["a"].threshold is None
    assert got["a"].exemplars == [] and "whale" in got["b"].exemplars[0].chunk
    assert {r.draft_id: r.brief.exemplars for r in massage.briefs(seen, target).collect()} == {"a": [], "b": []}


def test_reviser_gets_its_brief(spark, target):
    def revise(text, brief):
        assert brief["lexical"][0]["term"] == "—" and brief["avoided"] == ["—", "--"]
        return text.replace("—", ",")

    drafts = spark.createDataFrame([(1, "Bad — dash.")], "draft_id bigint, text string")
    outcome, steps = massage.massage(drafts, target, massage.calling(revise, briefed=True))
    assert [(r.text, r.accepted, r.revisions) for r in outcome.collect()] == [("Bad , dash.", True, 1)] and steps.count() == 2

    def fails(text):
        raise KeyError("nothing")

    with pytest.raises(Exception, match="revision 1"):
        massage.massage(drafts, target, massage.calling(fails))


@pytest.mark.parametrize("failed, accepted, revisions", [("calm-voice", False, 2), ("no-jokes", True, 0), ("unknown", True, 0)])
def test_judged_rules(spark, target, failed, accepted, revisions):
    """A failed hard rule blocks, a soft one doesn't, an unknown one is left out."""
    judge = massage.judging(lambda text, rules: [{"id": failed, "holds": False, "evidence": text[:3]}], target.rules)
    drafts = spark.createDataFrame([(1, "The whale swam on.")], "draft_id bigint, text string")
    outcome, steps = massage.massage(drafts, target, massage.calling(lambda t: t + " On."), most=2, judge=judge)
    assert [(r.accepted, r.revisions) for r in outcome.collect()] == [(accepted, revisions)]
    assert steps.orderBy("revision").first().rule_violations == (failed != "unknown")


def test_model_client():
    calls = []

    def answering(status, answer):
        def transport(address, headers, body):
            calls.append((address, headers, json.loads(body)))
            return status, answer if isinstance(answer, bytes) else json.dumps(answer).encode()

        return model.Client("k", "m", "http://host/", transport=transport, headers={"version": "1"})

    text = lambda *parts: {"content": [{"type": "other"}, *({"type": "text", "text": p} for p in parts)], "stop_reason": "end_turn"}
    brief = {"guidance": "Go.", "avoided": ["—"], "lexical": [{"term": "—", "start": 3}], "exemplars": [{"chunk": "A passage."}]}
    assert answering(200, text("new ", "draft")).revise("old draft", brief) == "new draft"
    address, headers, body = calls[-1]
    assert address == "http://host/v1/messages" and headers == {"content-type": "application/json", "x-api-key": "k", "version": "1"}
    assert body["max_tokens"] == 4096 and all(x in body["messages"][0]["content"] for x in ("Go.", "old draft", "A passage.", "byte 3"))
    rules = [{"rule_id": "r", "statement": "Be."}]
    assert answering(200, text('Well: [{"id": "r", "holds": false, "evidence": "e"}, 3] so')).judge("d", rules) == [{"id": "r", "holds": False, "evidence": "e"}]
    asked = len(calls)
    assert answering(200, text("[]")).judge("d", []) == [] and len(calls) == asked
    for client in (answering(500, b"\xc3\xa9" * 400), answering(200, b"no json"), answering(200, text("x") | {"stop_reason": "max_tokens"}), model.Client("", "m", "http://host")):
        with pytest.raises(RuntimeError):
            client.complete("s", "u")
    for odd in ("no list", "[{]"):
        with pytest.raises(RuntimeError):
            answering(200, text(odd)).judge("d", rules)
    assert model.truncated_bytes("éé".encode(), 3) == "é..." and model.truncated_bytes(b"abc", 3) == "abc"


# Sources


def test_baseline_total_counts_repeats(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# word\tcount\nThe\t5\nsea\t0\nthe\t7\nodd\n")
    assert [(r.term, r.base, r["all"]) for r in baseline.load(spark, str(tmp_path / "t.tsv")).collect()] == [("the", 7, 12)]


def test_keep_list(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "name string, text string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert [r.name for r in corpus.mirror(docs, names("a", "a"), "name", str(tmp_path / "kept")).collect()] == ["a"]
    with pytest.raises(ValueError, match="lacks c"):
        corpus.mirror(docs, names("a", "c"), "name", str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 1
