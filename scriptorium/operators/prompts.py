"""Texts for a language model: inducing rules, judging drafts, revising them; and reading its verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import trimmed

NOTHING_TO_JUDGE = "This profile has no judged rules; there is nothing to judge.\n"
JUDGE_HEAD = (
    "Say for each rule below whether the draft keeps it. Go by the rules and the draft alone.\n"
    'Answer with a JSON list of objects: "id" (of the rule), "holds" (true or false), "evidence" (where false: the words of the draft that break it).\n'
    "\nRules:\n"
)
INDUCE_HEAD = (
    "Below are samples of one author's prose. Name up to {n} rules of style that hold in them: of voice, rhythm, shape and stance, not of subject.\n"
    'Answer with a JSON list of objects: "id" (short, with hyphens), "statement" (one sentence in the imperative), "rationale".\n'
)
VERDICTS = "array<struct<id:string,holds:boolean,evidence:string>>"


def induction_prompt(samples: list[str], most: int = 8) -> str:
    parts = [INDUCE_HEAD.format(n=most if most > 0 else 8)]
    parts += [f"\n--- sample {i} ---\n{s.strip()}\n--- end of sample {i} ---\n" for i, s in enumerate(samples, 1)]
    return "".join(parts)


def rule_lines(rules: DataFrame, by: list[str]) -> DataFrame:
    """(by, rule_lines): the judged rules of each profile as one text, in rule order (``pos``)."""
    share = F.when(F.col("support") > 0, F.concat(F.lit(" (kept in "), F.round(F.col("support") * 100).cast("int").cast("string"), F.lit("% of the corpus)"))).otherwise("")
    line = F.concat(F.lit("- ["), F.col("rule_id"), F.lit("] "), F.col("statement"), share, F.lit("\n"))
    found = rules.where(F.col("class") == "judged").select(*by, F.struct("pos", line.alias("line")).alias("l")).groupBy(*by) if by else rules.where(F.col("class") == "judged").select(F.struct("pos", line.alias("line")).alias("l")).groupBy()
    return found.agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "").alias("rule_lines"))


def judging_prompt(draft: Column, lines: Column) -> Column:
    """The prompt for a draft, given its profile's rule lines (null or empty: none)."""
    body = F.concat(F.lit(JUDGE_HEAD), lines, F.lit("\n--- draft ---\n"), trimmed(draft), F.lit("\n--- end of draft ---\n"))
    return F.when(F.coalesce(lines, F.lit("")) == "", F.lit(NOTHING_TO_JUDGE)).otherwise(body)


def verdicts(reply: Column) -> Column:
    """The verdict list in a reply, whatever prose stands around it; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\[.*\]", 0), F.lit("")), VERDICTS)


def revision_prompt(draft: str, brief: dict) -> str:
    """What a reviser is told: guidance, terms, what is off, exemplars, the draft."""
    lines = [brief["guidance"], ""]
    if brief.get("avoided"):
        lines.append("Never use: " + ", ".join(brief["avoided"]))
    if brief.get("preferred"):
        lines.append("Prefer where it is natural: " + ", ".join(brief["preferred"]))
    lines += [f"- {f['metric']} is {f['deviation']:.2f} deviations out of range" for f in brief.get("features", [])]
    lines += [f"- remove {x['term']!r} at byte {x['start']}" for x in brief.get("lexical", [])]
    lines += [f"- [{r['severity']}] {r['statement']} ({r['evidence']})" for r in brief.get("rules", [])]
    for i, e in enumerate(brief.get("exemplars", []), 1):
        lines += ["", f"Passage {i} in the target style:", (e["chunk"] if isinstance(e, dict) else e).strip()]
    return "\n".join([*lines, "", "--- draft ---", draft.strip(), "--- end of draft ---", ""])
