"""Mixing sources to target weights by a low-discrepancy schedule.

Slot ``i`` of the schedule is the golden-ratio point ``frac(i * phi)``; the cumulative target shares map it to a source, and
its rank among the source's slots says which of the source's blocks it takes. A source's documents, shuffled by hash and
laid end to end, are cut into blocks of equally many words; ranks beyond the last block begin the source anew. Slots are
taken in order until their source has its target, so any stretch of the mix, which is in the order of its slots, has
nearly the target proportions, whatever machine reads it, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix_sums import running_start
from .workspace import stage

#: A word, as sizes count it.
WORD = "[^\\x20\\x09-\\x0D]+"
#: The weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is used at most so many times over.
REPEATS = 3
#: Words in a block.
BLOCK_WORDS = 1024
#: The golden ratio's fraction as a multiple of 1 / 2**31 (odd, so one period visits every multiple once).
GOLDEN, PERIOD = 1327217885, 1 << 31
#: Intervals are found through equal cells of [0, 1), so many at least and so many times the sources.
CELLS, CELLS_A_SOURCE = 1024, 4
#: Rows that one bucket of a running total aims at.
BUCKET_ROWS = 20_000


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``size``: the number of words (null text: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint"))


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of the total by weight, held at ``REPEATS`` times
    the source's size, what is cut off being shared again by weight until none is above.

    The sources held are those with the least limit per weight, so one running sum finds the level. One row a source:
    this table is as small as the list of sources."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, every = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    level = (F.col("total") - F.col("limit_before")).cast("double") / (F.col("weight_all") - F.col("weight_before"))
    ranked = (
        sources.withColumn("weight", F.element_at(weights, ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)).cast("bigint"))
        .withColumn("limit", F.col("source_size") * REPEATS)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("weight_all", F.sum("weight").over(every))
        .withColumn("limit_before", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level_here", level)
        .withColumn("held", F.col("limit") < F.col("level_here") * F.col("weight"))
    )
    free = F.max(F.when(~F.col("held"), F.col("level_here"))).over(every)
    return ranked.withColumn("level", free).select(
        "source", "source_size", F.when(F.col("held"), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target")
    )


def _bucket(key: Column, count: int) -> Column:
    return (key * count).cast("bigint")


def mix(docs: DataFrame, keep: list[str], block_words: int = BLOCK_WORDS, text: str = "text") -> DataFrame:
    """Each document's kept columns with ``source``, ``size``, ``source_size``, ``target``, ``taken`` (the words the mix takes
    of it, repeats counted), ``first_slot`` (where in the mix its first word comes first; null if it isn't taken) and
    ``slots`` (where each of its turns begins, in order, ``REPEATS`` and one more at most).

    ``docs`` has ``source`` and a text column; kept columns include ``doc_id``, by which documents are shuffled. A null
    source is a source of its own, last in order; a null or empty text has size 0 and is taken 0 words of; repeated rows
    are documents of their own, ties between them being between equals; an empty table gives an empty one. If all sizes
    are 0, so are all targets. Columns that are not kept don't matter, whatever their names."""
    added = {"source", "size", "source_size", "target", "taken", "first_slot", "slots"}
    own = [c for c in keep if c not in ("source",)]
    if set(own) & added or "doc_id" not in keep:
        raise ValueError("keep doc_id, and no column with the name of an added one")
    rows = stage(sized(docs.select(*own, "source", F.col(text).alias("text")), "text").drop("text"), "sizes")
    return placed(rows, own, block_words)


def schedule(aims: DataFrame, slots: int, n_sources: int) -> DataFrame:
    """(sid, rank, slot): the first ``slots`` slots, each mapped by its point to a source (``sid``, ``target``), and its rank
    among the source's slots."""
    spark = aims.sparkSession
    cells = max(CELLS, 1 << (CELLS_A_SOURCE * n_sources).bit_length())
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    shares = aims.where("target > 0").withColumn("high", F.sum("target").over(upto) / F.sum("target").over(whole))
    shares = shares.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("sid")), F.lit(0.0)))
    last = F.least(F.lit(cells - 1), F.floor(F.col("high") * cells))
    spans = shares.select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * cells), last)).alias("cell"))
    points = spark.range(slots).withColumn("u", ((F.col("id") % PERIOD) * GOLDEN % PERIOD) / float(PERIOD))
    points = points.withColumn("cell", F.floor(F.col("u") * cells))
    found = points.join(spans, "cell").where("u >= low and u < high").select("sid", F.col("id").alias("slot"), F.lit(1).alias("one"))
    found = found.withColumn("bucket", F.floor(F.col("slot") / BUCKET_ROWS))
    return running_start(found, "sid", "bucket", [F.col("slot")], "one", "rank").select("sid", "rank", "slot")


def placed(rows: DataFrame, own: list[str], block_words: int) -> DataFrame:
    # The list of sources, with an id that is never null.
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    aims = stage(targets(totals.select("source", "source_size")).withColumn("sid", F.row_number().over(named) - 1), "targets")
    counts = totals.agg(F.sum("n_rows"), F.sum("source_size"), F.count("*")).first()
    n_rows, total, n_sources = (int(x or 0) for x in counts)
    slots = max(1, -(-total // block_words))

    # Streams: a source's documents in the order of a hash.
    keyed = rows.join(aims.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    hashed = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")))
    spread = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    streams = keyed.withColumn("hashed", hashed).withColumn("bucket", _bucket(spread, -(-n_rows // BUCKET_ROWS) or 1))
    streams = running_start(streams, "sid", "bucket", ["hashed", "doc_id", "size"], "size", "begin").drop("bucket", "hashed")
    full = streams.where("size > 0")

    # A rank's block, and what of it is still to be taken. A source's last few ranks, where the schedule ends before
    # them (it is off by a few blocks a source), follow in turns after its end.
    plan = aims.where("target > 0 and source_size > 0").select(
        "sid", "source_size", F.floor("target").alias("aim"), F.ceil(F.col("source_size") / block_words).alias("blocks")
    )
    short, over = F.col("aim") % F.col("source_size"), F.floor(F.col("aim") / F.col("source_size"))
    plan = plan.withColumn("ranks", over * F.col("blocks") + F.ceil(short / block_words))
    ranked = schedule(aims, slots, n_sources)
    reached = ranked.groupBy("sid").agg(F.count("*").alias("done"))
    settled = plan.join(reached, "sid", "left").withColumn("done", F.coalesce("done", F.lit(0))).where("done < ranks")
    settled = settled.select("sid", "done", F.explode(F.sequence(F.col("done"), F.col("ranks") - 1)).alias("rank"))
    settled = settled.select("sid", "rank", (slots + (F.col("rank") - F.col("done")) * n_sources + F.col("sid")).alias("slot"))
    taken_ranks = ranked.unionByName(settled).join(plan, "sid").where("rank < ranks")
    block, lap = F.col("rank") % F.col("blocks"), F.floor(F.col("rank") / F.col("blocks"))
    left = F.col("aim") - lap * F.col("source_size") - block * block_words
    blocks = taken_ranks.select("sid", "slot", block.alias("block"), F.least(F.lit(block_words), F.col("source_size") - block * block_words, left).alias("words"))
    turns = F.sort_array(F.collect_list(F.struct("slot", "words")))  # one a lap
    used = blocks.groupBy("sid", "block").agg(turns.alias("turns"))

    # Documents meet blocks where they overlap. (sid, begin) names a document of any size above 0.
    cut = full.select("sid", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("begin") + F.col("size") - 1) / block_words))).alias("block"))
    base = F.col("block") * block_words
    overlap = lambda t: F.greatest(F.lit(0), F.least(F.col("begin") + F.col("size"), base + t["words"]) - F.greatest(F.col("begin"), base)).cast("bigint")
    pieces = cut.join(used, ["sid", "block"]).select(
        "sid", "begin", F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, t: a + overlap(t)).alias("words"),
        F.when(F.col("begin") >= base, F.transform(F.filter("turns", lambda t: overlap(t) > 0), lambda t: t["slot"])).alias("slots"),
    )
    took = pieces.groupBy("sid", "begin").agg(F.sum("words").alias("taken"), F.max("slots").alias("slots"))
    found = full.join(took, ["sid", "begin"], "left").unionByName(streams.where("size = 0"), allowMissingColumns=True)
    slots_ = F.coalesce("slots", F.array().cast("array<bigint>"))
    return found.select(*own, "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.try_element_at(slots_, F.lit(1)).alias("first_slot"), slots_.alias("slots"))


#: The same mix by another way: a source's stream is taken whole as often as its target allows, then its beginning; only
#: the slots of first words need the schedule.
ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight,
         3 * source_size AS lim FROM sources),
ranked AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS here
  FROM weighed
  WINDOW w AS (ORDER BY lim::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (SELECT *, lim < here * weight AS held, max(here) FILTER (WHERE NOT (lim < here * weight)) OVER () AS level FROM ranked),
aims AS (
  SELECT source, source_size, CASE WHEN held THEN lim::DOUBLE ELSE weight * level END AS target,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sid FROM levelled),
shares AS (
  SELECT sid, coalesce(sum(target) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(target) OVER () AS low,
         sum(target) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) / sum(target) OVER () AS high FROM aims),
size_of AS (SELECT CAST(greatest(1, ceil(sum(source_size) / {BLOCK_WORDS}.0)) AS BIGINT) AS slots, count(*) AS n FROM aims),
points AS (SELECT slot, (slot * {GOLDEN} % {PERIOD}) / {float(PERIOD)}::DOUBLE AS u FROM (SELECT unnest(range((SELECT slots FROM size_of))) AS slot)),
met AS (SELECT sid, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM points JOIN shares ON u >= low AND u < high),
done AS (SELECT a.sid, count(m.slot) AS done FROM aims a LEFT JOIN met m ON a.sid = m.sid GROUP BY a.sid),
laid AS (
  SELECT s.*, a.sid, a.source_size, a.target, CAST(floor(a.target) AS BIGINT) AS aim,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, source, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE CAST(aim // source_size * size + greatest(0, least(start + size, aim % source_size) - start) AS BIGINT) END AS taken,
       CASE WHEN size > 0 AND start < aim THEN coalesce(slot, slots + (start // {BLOCK_WORDS} - done) * n + laid.sid) END AS first_slot
FROM laid CROSS JOIN size_of JOIN done ON laid.sid = done.sid
LEFT JOIN met ON met.sid = laid.sid AND met.rank = start // {BLOCK_WORDS}
"""
