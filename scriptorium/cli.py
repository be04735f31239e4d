"""Command line: distil, score, calibrate, retrieve, list, hook, tools, serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scriptorium import api
from scriptorium.operators import distill, hook
from scriptorium.sources import profiles, results, transcripts
from scriptorium.tools import Tools, comma_list, documents, word_base


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scriptorium")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("distill", "calibrate"):
        c = sub.add_parser(name)
        c.add_argument("--corpus", required=True), c.add_argument("--register", required=True), c.add_argument("--id", default=""), c.add_argument("--out"), c.add_argument("--baseline")
        c.add_argument("--avoid", default=""), c.add_argument("--base", default=""), c.add_argument("--rules-file", default="")
        if name == "calibrate":
            c.add_argument("--decoys", required=True), c.add_argument("--holdout-every", type=int, default=4)
    c = sub.add_parser("score")
    c.add_argument("--profile", required=True), c.add_argument("--profiles", default=""), c.add_argument("--json", action="store_true"), c.add_argument("file", nargs="?")
    c = sub.add_parser("retrieve")
    c.add_argument("--corpus", required=True), c.add_argument("--query"), c.add_argument("-k", type=int, default=3)
    c = sub.add_parser("list")
    c.add_argument("--profiles", required=True)
    c = sub.add_parser("hook")
    c.add_argument("--profile", default=""), c.add_argument("--avoid", default="")
    c = sub.add_parser("tools")
    c.add_argument("--profiles", default=""), c.add_argument("--baseline")
    c = sub.add_parser("serve")
    c.add_argument("--profiles", required=True), c.add_argument("--port", type=int, default=8080)
    return p


def run(argv: list[str], spark: SparkSession, stdin=sys.stdin, out=sys.stdout) -> int:
    """Exit code 1 for a readable score with avoided terms; JSON scores always exit 0."""
    a = parser().parse_args(argv)
    if a.command in ("distill", "calibrate"):
        docs = documents(spark, a.corpus, a.register)
        more = {"id": a.id, "options": distill.Options(avoid=comma_list(a.avoid))}
        table = word_base(spark, a.baseline, docs)
        if a.command == "distill":
            made = api.distill(docs, a.register, table, base=a.base, rules_file=a.rules_file, **more)
        else:
            made = api.calibrate(docs, documents(spark, a.decoys, "decoys"), a.register, table, a.holdout_every, a.base, a.rules_file, **more)
        path = a.out or f"{made.profile.id}.profile.yaml"
        profiles.save(made.profile, path)
        print(f"{path}: {len(made.profile.features)} features, {len(made.profile.preferred)} terms, {len(made.profile.rules)} rules", *made.warnings, sep="\n", file=out)
        if made.calibration:
            print(json.dumps(made.calibration), file=out)
    elif a.command == "score":
        text = open(a.file, encoding="utf-8").read() if a.file else stdin.read()
        found = api.check(spark, text, profiles.find(a.profiles, a.profile))
        print(json.dumps(found, indent=2) if a.json else results.report(found), file=out)
        return int(not a.json and found["hard_violations"] > 0)
    elif a.command == "retrieve":
        for r in api.passages(documents(spark, a.corpus, ""), a.query or stdin.read(), a.k).orderBy("rank").collect():
            print(f"{r.rank}. {r.score:.4f} {r.source} [{r.para}]", file=out)
    elif a.command == "list":
        for path, p in profiles.listing(a.profiles):
            print(f"{p.id}\t{p.register}\t{p.language}\t{path}\t{'calibrated' if p.discriminator else 'not calibrated'}", file=out)
    elif a.command == "hook":
        try:  # whatever goes wrong, the session goes on
            answer = stop_hook(spark, json.loads(stdin.read() or "{}"), a.profile, comma_list(a.avoid))
            if answer:
                print(json.dumps(answer), file=out)
        except Exception as e:
            print(f"hook: {e} (allowed)", file=sys.stderr)
    elif a.command == "tools":
        Tools(spark, a.profiles, a.baseline).serve(stdin, out)
    else:
        from scriptorium.service import serve

        serve(spark, profiles.load_strict(a.profiles), a.port)
    return 0


def stop_hook(spark: SparkSession, payload: dict, profile: str, avoid: tuple[str, ...]) -> dict | None:
    """A block decision for the last assistant turn of a transcript, or None."""
    avoided = list(dict.fromkeys([*(profiles.load(profile).avoided if profile else []), *avoid]))
    path = payload.get("transcript_path")
    if not avoided or payload.get("stop_hook_active") or not path:
        return None
    lines = spark.read.format("text").option("wholetext", True).load(path).select(F.lit(0).alias("conv"), F.posexplode(F.split("value", "\n")).alias("turn", "value"))
    last = hook.last_assistant(transcripts.turns(lines, ["conv"]), "conv", "turn")
    found = hook.decisions(last, "conv", avoided).first()
    if found is None or found.decision == "allow":
        return None
    from scriptorium.operators.lint import avoided_spans

    spans = avoided_spans(last, spark.createDataFrame([(t,) for t in avoided], "term string"), ["conv"]).select(F.sort_array(F.collect_list(F.struct("start", "term"))).alias("s"))
    return {"decision": "block", "reason": spans.select(hook.reason(F.col("s"))).first()[0]}


def main() -> None:
    spark = SparkSession.builder.appName("scriptorium").getOrCreate()
    sys.exit(run(sys.argv[1:], spark))


if __name__ == "__main__":
    main()
