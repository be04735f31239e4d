"""Results as JSON lines or readable reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(rows: DataFrame) -> DataFrame:
    """(value): each row as a JSON object."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def report(assessment: dict) -> str:
    """One draft's assessment as text."""
    target = {None: "not calibrated", True: "on target", False: "off target"}[assessment.get("on_target")]
    lines = [f"distance {assessment['distance']:.4f} ({target})"]
    lines += [f"  {f['metric']}: {f['value']} is {f['deviation']} deviations out" for f in assessment.get("features", [])]
    lines += [f"  avoided {x['term']!r} at byte {x['start']}" for x in assessment.get("lexical", [])]
    lines += [f"  {r['rule_id']} in paragraph {r['paragraph']}: {r['evidence']}" for r in assessment.get("rules", [])]
    return "\n".join(lines)
