"""The same results in DuckDB's SQL, written independently of the operators: list functions and joins, no shared code but
the fixed values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql.window import WindowSpec

from scriptorium.operators import lexicon, metrics, prompts
from scriptorium.sources import markup

#: Decorations by doc_id, valid in both engines.
STYLED = """CASE doc_id % 8
 WHEN 0 THEN replace(text, ', ', ' — ')
 WHEN 1 THEN replace(text, chr(10), concat(chr(10), chr(10), '- '))
 WHEN 2 THEN replace(text, ' is ', concat(' isn', chr(39), 't '))
 WHEN 3 THEN text
 WHEN 4 THEN replace(replace(text, ' from ', ' perhaps from '), ' by ', ' -- by ')
 WHEN 5 THEN concat('# ', replace(text, '. ', '? '))
 WHEN 6 THEN replace(replace(text, ' to ', ' we '), ' the ', '; you ')
 ELSE replace(replace(text, ' of ', ' (it’s: '), chr(10), concat(chr(10), chr(10))) END"""
MARKED_UP = "concat('---', chr(10), 'slug: x', chr(10), '---', chr(10), '<p class=\"a\">', replace(text, ' the ', ' [the](http://x.org/a) '), '</p> ![i](j.png) if x<y <!-- c --> see https://x.org/q?r=1 end')"
AVOIDED = ("—", "--", "the", "é", "a. ")
HOOK_AVOIDED = ["la", "die ", "of the"]
CHILD_FEATURES = [("comma_rate", 0, 0.5), ("colon_rate", 1, 0.25), ("fw.the", 2, 1.0)]
BASE_FEATURES = [("colon_rate", 0, 0.75), ("hedge_rate", 1, 0.125)]
LISTING = [("d/a.profile.yaml", "a", "essay-a", "essay"), ("d/b.profile.yaml", "b", "essay-b", "essay"), ("d/essay.profile.yaml", "essay", "c", "notes")]
REFS = ["a", "essay", "essay-b", "notes", "none"]
JUDGED = [
    (0, "opens-with-scene", "judged", "soft", "Open with a scene.", 0.8),
    (1, "max-sentence-length", "deterministic", "soft", "Short sentences.", 0.9),
    (2, "no-lists", "judged", "hard", "Avoid lists.", 0.0),
]
REPLIES = [
    ("d1", 'Here you are: [{"id": "no-lists", "holds": false, "evidence": "- one"}, {"id": "opens-with-scene", "holds": true, "evidence": ""}] Done.'),
    ("d2", "I can not say."),
    ("d3", '[{"id": "unknown", "holds": false, "evidence": "x"}, {"id": "opens-with-scene", "holds": false, "evidence": "In short"}]'),
]
MARKDOWN_SAMPLES = [
    (1, "---\ntitle: a\n---\nBody *text* <em>here</em>."),
    (2, "---\nnever: closed\nmore"),
    (3, "a < b and vector<int> stay; <figure><img src=x><figcaption>gone</figcaption></figure>kept"),
    (4, "![drop](a.png)[keep](b) <!-- no\nno --> https://x.org/a?b c"),
    (5, "no markup"),
]

WIDE = {
    "sentence_stats": ["sentence_len_mean", "sentence_len_stddev"],
    "paragraph_len": ["paragraph_len_mean"],
    "reading_grade": ["reading_grade"],
    "word_len": ["word_len_mean"],
    "punctuation_rates": list(metrics.SIGNS),
    "lexical_class_rates": ["contraction_rate", *metrics.CLASSES],
    "structure_cadence": ["heading_cadence", "list_cadence"],
}
FUNCTION_WORD_QUERY = ("sentence_stats", "reading_grade", "word_len")  # these read the plain text


def window_by(column: str) -> WindowSpec:
    return Window.orderBy(column)


# Pieces ---------------------------------------------------------------------------------------------------------------

W = "'[\\p{L}\\p{M}]+(?:[''’][\\p{L}\\p{M}]+)*'"
_SPACE = "[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
PLAIN = "SELECT doc_id, source, text FROM documents WHERE lang = 'en'"
STYLED_DOCS = f"SELECT doc_id, source, {STYLED} AS text FROM documents WHERE lang = 'en'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def labelled(quality: int) -> str:
    return f"SELECT * FROM ({STYLED_DOCS}) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = {quality})"


def words(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, {W}), lambda w: lower(w))"


def paragraphs(text: str) -> str:
    return f"list_filter(list_transform(string_split_regex({text}, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda p: p <> '')"


def sentences(p: str) -> str:
    flat = f"regexp_replace({p}, '{_SPACE}+', ' ', 'g')"
    cut = f"regexp_replace({flat}, '([.!?]+(?:\\s+|$)|[。！？؟।]+)', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def r(expr: str, places: int = 4) -> str:
    return f"round(({expr}) * {10**places}::DOUBLE) / {10**places}::DOUBLE"


def counts_cte(docs: str, keep: str = "doc_id") -> str:
    """CTEs d0 to c: one row a document with what the metrics are made of."""
    return f"""d0 AS ({docs}),
d1 AS (SELECT {keep}, text, {words("text")} AS ws, {paragraphs("text")} AS ps FROM d0),
d2 AS (SELECT *, list_transform(ps, lambda p: {sentences("p")}) AS ss, string_split(text, chr(10)) AS ls FROM d1),
d3 AS (SELECT *, list_transform(flatten(ss), lambda s: len(regexp_extract_all(s, {W}))::BIGINT) AS lens,
  list_transform(ws, lambda w: len(regexp_extract_all(w, '[aeiouy]+'))) AS gs,
  list_transform(ls, lambda l: regexp_replace(l, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS tl FROM d2),
c AS (SELECT *, len(ws)::DOUBLE AS n, len(lens)::DOUBLE AS s, list_sum(lens)::DOUBLE AS sl,
  list_sum(list_transform(lens, lambda x: x * x))::DOUBLE AS sq, list_sum(list_transform(ws, lambda w: length(w)))::DOUBLE AS letters,
  list_sum(list_transform(list_zip(ws, gs), lambda z: greatest(1, z[2] - CASE WHEN ends_with(z[1], 'e') AND z[2] > 1 THEN 1 ELSE 0 END)))::DOUBLE AS syll
  FROM d3 WHERE len(ws) > 0)"""


def _count(literal: str) -> str:
    return f"((length(text) - length(replace(text, {q(literal)}, ''))) / {len(literal)})"


def _any(members: tuple[str, ...]) -> str:
    listed = ", ".join(q(m) for m in members)
    return f"len(list_filter(ws, lambda w: list_contains([{listed}], w)))"


def definitions() -> dict[str, str]:
    out = {
        "sentence_len_mean": "sl / s",
        "sentence_len_stddev": "sqrt(s * sq - sl * sl) / s",
        "reading_grade": "0.39::DOUBLE * (n / s) + 11.8::DOUBLE * (syll / n) - 15.59::DOUBLE",
        "paragraph_len_mean": "s / len(ps)",
        "word_len_mean": "letters / n",
        "contraction_rate": "len(list_filter(ws, lambda w: regexp_matches(w, '(n''t|''re|''ve|''ll|''d|''m|''s)$'))) * 1000.0::DOUBLE / n",
        "heading_cadence": "len(list_filter(tl, lambda l: starts_with(l, '#'))) * 100.0::DOUBLE / len(tl)",
        "list_cadence": "len(list_filter(tl, lambda l: starts_with(l, '- ') OR starts_with(l, '* ') OR starts_with(l, '+ '))) * 100.0::DOUBLE / len(tl)",
    }
    for name, signs in metrics.SIGNS.items():
        out[name] = f"({' + '.join(_count(x) for x in signs)}) * 1000.0::DOUBLE / n"
    for name, members in metrics.CLASSES.items():
        out[name] = f"{_any(members)} * 1000.0::DOUBLE / n"
    return out | {f"fw.{w}": f"{_any((w,))} * 1000.0::DOUBLE / n" for w in metrics.FUNCTION_WORDS}


def metrics_cte(docs: str, name: str = "m", keep: str = "doc_id", prefix: str = "") -> str:
    """CTEs up to ``name``: (keep, n_words, metric, value)."""
    made = ", ".join(f"{{'metric': {q(k)}, 'value': ({v})::DOUBLE}}" for k, v in definitions().items())
    text = counts_cte(docs, keep) + f", {name} AS (SELECT {keep}, n AS n_words, u.metric AS metric, u.value AS value FROM (SELECT {keep}, n, unnest([{made}]) AS u FROM c))"
    if prefix:  # several such chains in one statement
        for cte in ("d0", "d1", "d2", "d3", "c"):
            text = text.replace(f"{cte} AS (", f"{prefix}{cte} AS (").replace(f"FROM {cte} ", f"FROM {prefix}{cte} ").replace(f"FROM {cte})", f"FROM {prefix}{cte})")
    return text


def features_sql(m: str) -> str:
    low = "CASE WHEN metric = 'reading_grade' THEN mu - 1.5::DOUBLE * sd ELSE greatest(0, mu - 1.5::DOUBLE * sd) END"
    weight = "CASE WHEN mu = 0 THEN CASE WHEN sd = 0 THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END ELSE greatest(0.1::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE / (1.0::DOUBLE + sd / abs(mu)))) END"
    return f"""SELECT metric, {r("mu")} AS mean, {r("sd")} AS stddev, {r(low)} AS "min", {r("mu + 1.5::DOUBLE * sd")} AS "max", {r(weight, 3)} AS weight
FROM (SELECT metric, avg(value) AS mu, stddev_pop(value) AS sd FROM {m} GROUP BY metric)"""


def stats_sql(docs: str) -> str:
    return f"SELECT count(*) AS documents, CAST(sum(len(regexp_extract_all(text, {W}))) AS DOUBLE) AS words FROM ({docs})"


def compared_cte(m: str, train_m: str, train: str) -> str:
    """CTEs f, st, met from metrics of drafts and of the training corpus."""
    rate = "(starts_with(metric, 'fw.') OR ends_with(metric, '_rate'))"
    scale = f"CASE WHEN NOT {rate} THEN stddev ELSE greatest(sqrt(stddev * stddev + greatest(0, 1000.0::DOUBLE * mean / n_words - 1000.0::DOUBLE * mean / (words / documents))), 1000.0::DOUBLE / n_words) END"
    return f"""f AS ({features_sql(train_m)}), st AS ({stats_sql(train)}),
met AS (SELECT *, CASE WHEN value < "min" THEN ("min" - value) / sc WHEN value > "max" THEN (value - "max") / sc ELSE 0 END AS dev
  FROM (SELECT {m}.*, f.* EXCLUDE (metric), {scale} AS sc FROM {m} JOIN f USING (metric), st) WHERE sc >= 1e-9),
dist AS (SELECT doc_id, {r("sum(weight * dev) / sum(weight)")} AS distance FROM met GROUP BY doc_id)"""


def scored_cte(docs: str, train: str) -> str:
    return f"{metrics_cte(docs, 'm')}, {metrics_cte(train, 'tm', prefix='t_')}, {compared_cte('m', 'tm', train)}, drafts AS ({docs}), scored AS (SELECT doc_id, coalesce(distance, 0) AS distance FROM drafts LEFT JOIN dist USING (doc_id))"


_SPLIT = f"SELECT doc_id, text, CASE WHEN (row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 4 = 0 THEN 'holdout' ELSE 'train' END AS split FROM ({labelled(1)})"
_TRAIN = f"SELECT doc_id, text FROM ({_SPLIT}) WHERE split = 'train'"
_DRAFTS = f"SELECT doc_id, text FROM ({_SPLIT}) WHERE split = 'holdout' UNION ALL SELECT doc_id, text FROM ({labelled(0)})"


def _calibrated() -> str:
    """CTEs up to cs: (doc_id, is_target, distance), each distance's counts in cv, and best."""
    return f"""{scored_cte(_DRAFTS, _TRAIN)},
cs AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM ({_SPLIT}) WHERE split = 'holdout') AS is_target, distance FROM scored),
thr AS (SELECT DISTINCT distance AS t FROM cs),
cv AS (SELECT t, count(*) FILTER (WHERE is_target AND distance <= t) AS tp, count(*) FILTER (WHERE NOT is_target AND distance <= t) AS fp,
  count(*) FILTER (WHERE is_target AND distance > t) AS fn, count(*) FILTER (WHERE NOT is_target AND distance > t) AS tn FROM thr, cs GROUP BY t),
best AS (SELECT *, tp / (tp + fn)::DOUBLE AS tpr, fp / (fp + tn)::DOUBLE AS fpr, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy
  FROM cv ORDER BY tp * (fp + tn) - fp * (tp + fn) DESC, t LIMIT 1)"""


def _wide(name: str) -> str:
    docs = PLAIN if name in FUNCTION_WORD_QUERY else STYLED_DOCS
    made = definitions()
    return f"WITH {counts_cte(docs)} SELECT doc_id, {', '.join(f'{r(made[c])} AS {c}' for c in WIDE[name])} FROM c"


def paragraphs_cte(docs: str) -> str:
    return f"""p0 AS ({docs}), p1 AS (SELECT doc_id, {paragraphs("text")} AS ps FROM p0),
p2 AS (SELECT doc_id, unnest(ps) AS paragraph, generate_subscripts(ps, 1) AS i FROM p1),
p3 AS (SELECT *, {sentences("paragraph")} AS ss FROM p2),
p AS (SELECT *, list_transform(ss, lambda s: len(regexp_extract_all(s, {W}))) AS lens FROM p3),
v AS (SELECT doc_id, i, paragraph, ss, 'max-sentence-length' AS rule_id, list_max(lens)::BIGINT AS v FROM p
  UNION ALL SELECT doc_id, i, paragraph, ss, 'max-paragraph-length', len(ss)::BIGINT FROM p),
mined AS (SELECT rule_id, quantile_disc(v, 0.9)::DOUBLE AS param FROM v GROUP BY rule_id HAVING count(*) >= 5)"""


def truncated(text: str, n: int) -> str:
    return f"CASE WHEN length({text}) > {n} THEN left({text}, {n}) || '...' ELSE {text} END"


def _rules_check(docs: str = STYLED_DOCS) -> str:
    return f"""{paragraphs_cte(docs)},
broken AS (SELECT doc_id, 'max-sentence-length' AS rule_id, i AS paragraph, k AS sentence, {truncated("sent", 120)} AS evidence
  FROM (SELECT doc_id, i, unnest(ss) AS sent, unnest(lens) AS len, generate_subscripts(ss, 1) AS k FROM p), mined WHERE rule_id = 'max-sentence-length' AND len > param
  UNION ALL SELECT doc_id, rule_id, i, 0, len(ss) || '-sentence paragraph: ' || {truncated("paragraph", 120)}
  FROM p, mined WHERE rule_id = 'max-paragraph-length' AND len(ss) > param)"""


def _replace(text: str, steps: tuple) -> str:
    for pattern, by in steps:
        new = " || ".join(x for x in (q(by.replace("$1", "\\1").replace("\n", "\x00")).replace("\x00", "' || chr(10) || '"),))
        text = f"regexp_replace({text}, {q(pattern)}, {new}, 'g')"
    return text


def _html() -> str:
    text = _replace("html", markup.HTML)
    for name, by in markup.NAMED:
        text = f"replace({text}, {q(name)}, {q(by)})"
    return f"SELECT page_id, {_replace(text, markup.AFTER)} AS text FROM pages"


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: q(x).replace("\n", "' || chr(10) || '") if isinstance(x, str) else repr(x)
    listed = ", ".join("(" + ", ".join(cell(x) for x in row) + ")" for row in rows)
    return f"(VALUES {listed}) AS t({names})"


def _terms_cte() -> str:
    return f"""k0 AS ({STYLED_DOCS}), k1 AS (SELECT doc_id, {paragraphs("text")} AS ps FROM k0),
k2 AS (SELECT doc_id, unnest(ps) AS chunk, generate_subscripts(ps, 1) - 1 AS para FROM k1),
k3 AS (SELECT *, list_filter({words("chunk")}, lambda w: length(w) >= 3 AND NOT regexp_matches(w, '[''’]')) AS terms FROM k2),
ch AS (SELECT * FROM k3 WHERE len(terms) >= 20 QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY doc_id, para) = 1),
ct AS (SELECT doc_id, para, term, count(*) AS n FROM (SELECT doc_id, para, unnest(terms) AS term FROM ch) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, 1.0::DOUBLE + ln(((SELECT count(*) FROM ch) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM ct GROUP BY term)"""


def _retrieve() -> str:
    return f"""WITH {_terms_cte()},
cw AS (SELECT doc_id, para, term, n * idf AS w FROM ct JOIN idf USING (term)),
cn AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, para)) AS u FROM cw),
b AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest(list_filter({words("text")}, lambda w: length(w) >= 3 AND NOT regexp_matches(w, '[''’]'))) AS term FROM benchmark) GROUP BY ALL),
bw AS (SELECT item_id, term, n * idf AS w FROM b JOIN idf USING (term)),
bn AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS u FROM bw),
sc AS (SELECT item_id, doc_id, para, sum(bn.u * cn.u) AS score FROM bn JOIN cn USING (term) GROUP BY ALL)
SELECT item_id, rank, doc_id, CAST(para AS BIGINT) AS para, {r("score")} AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score * 1000000000::DOUBLE) DESC, doc_id, para) AS rank FROM sc) WHERE rank <= 3"""


def _lexicon() -> str:
    stop = ", ".join(q(w) for w in lexicon.NON_PROSE)
    return f"""WITH a AS (SELECT source AS register, doc_id, unnest({words("text")}) AS term FROM ({PLAIN})),
base AS (SELECT term, count(*) AS base FROM a GROUP BY term),
k AS (SELECT * FROM a WHERE length(term) >= 3 AND NOT contains(term, '''') AND term NOT IN ({stop})),
c AS (SELECT register, term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM k GROUP BY ALL),
s AS (SELECT *, ln((n::DOUBLE / sum(n) OVER (PARTITION BY register)) / (coalesce(base, 1)::DOUBLE / (SELECT sum(base) FROM base)::DOUBLE)) AS score FROM c LEFT JOIN base USING (term))
SELECT register, rank, term, {r("score")} AS score, n, docs FROM (
  SELECT *, row_number() OVER (PARTITION BY register ORDER BY n::DOUBLE / coalesce(base, 1) DESC, term) AS rank FROM s WHERE n >= 3 AND docs >= 2 AND score > 0) WHERE rank <= 10"""


def _spans() -> str:
    terms = ", ".join(f"({q(t)})" for t in AVOIDED)
    return f"""WITH a AS (SELECT doc_id, term, string_split(text, term) AS parts FROM ({STYLED_DOCS}), (VALUES {terms}) AS t(term)),
b AS (SELECT doc_id, term, parts, unnest(range(1, len(parts))) AS i FROM a),
e AS (SELECT doc_id, term, CAST(list_sum(list_transform(parts[1:i], lambda x: strlen(x))) + (i - 1) * strlen(term) AS BIGINT) AS start FROM b)
SELECT doc_id, term, start, CAST(start + strlen(term) AS BIGINT) AS "end" FROM e"""


def _massage() -> str:
    revised = "replace(replace(text, '—', ','), '--', ',')"
    hard = f"CAST({_count('—')} + {_count('--')} AS BIGINT)"
    drafts = f"SELECT doc_id * 2 AS doc_id, text FROM ({STYLED_DOCS}) UNION ALL SELECT doc_id * 2 + 1, {revised} FROM ({STYLED_DOCS}) WHERE {hard} > 0"
    check = _rules_check(labelled(1)).split("broken AS")[0].rstrip().rstrip(",")
    return f"""WITH {scored_cte(drafts, labelled(1))}, {check},
q1 AS (SELECT doc_id, {paragraphs("text")} AS ps FROM drafts), q2 AS (SELECT doc_id, unnest(ps) AS paragraph FROM q1), q3 AS (SELECT doc_id, {sentences("paragraph")} AS ss FROM q2),
mp AS (SELECT max(param) FILTER (WHERE rule_id = 'max-paragraph-length') AS most_p, max(param) FILTER (WHERE rule_id = 'max-sentence-length') AS most_s FROM mined),
q4 AS (SELECT doc_id, len(ss) > most_p AS long, unnest(list_transform(ss, lambda s: len(regexp_extract_all(s, {W})))) AS len, most_s, generate_subscripts(ss, 1) AS k FROM q3, mp),
hits AS (SELECT doc_id, CAST(sum(CASE WHEN long AND k = 1 THEN 1 ELSE 0 END + CASE WHEN len > most_s THEN 1 ELSE 0 END) AS BIGINT) AS rule_violations FROM q4 GROUP BY doc_id)
SELECT doc_id // 2 AS doc_id, doc_id % 2 AS revision, distance, {hard} AS hard_violations, coalesce(rule_violations, 0) AS rule_violations, {hard} = 0 AS accepted
FROM drafts JOIN scored USING (doc_id) LEFT JOIN hits USING (doc_id)"""


def _prompt() -> str:
    lines = "".join(f"- [{i}] {s}" + (f" (kept in {round(p * 100)}% of the corpus)" if p > 0 else "") + "\n" for _, i, c, _, s, p in JUDGED if c == "judged")
    head = q(prompts.JUDGE_HEAD + lines + "\n--- draft ---\n").replace("\n", "' || chr(10) || '")
    return f"SELECT doc_id, {head} || regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g') || chr(10) || '--- end of draft ---' || chr(10) AS prompt FROM ({PLAIN})"


def _verdicts() -> str:
    return f"""WITH v AS (SELECT draft, json_extract(nullif(regexp_extract(reply, '(?s)\\[.*\\]'), ''), '$[*]') AS items FROM {_values(REPLIES, "draft, reply")}),
e AS (SELECT draft, unnest(items) AS x FROM v)
SELECT draft, rule_id, severity, json_extract_string(x, '$.evidence') AS evidence FROM e
JOIN {_values(JUDGED, "pos, rule_id, class, severity, statement, support")} ON rule_id = json_extract_string(x, '$.id') AND class = 'judged' WHERE json_extract_string(x, '$.holds') = 'false'"""


def _merge() -> str:
    return f"""WITH child AS (SELECT * FROM {_values(CHILD_FEATURES, "id, pos, weight")}), base AS (SELECT * FROM {_values(BASE_FEATURES, "id, pos, weight")})
SELECT id, weight::DOUBLE AS weight, source, row_number() OVER (ORDER BY place) AS place FROM (
  SELECT id, coalesce(b.weight, c.weight) AS weight, CASE WHEN b.id IS NULL THEN 'child' ELSE 'base' END AS source, c.pos AS place FROM child c LEFT JOIN base b USING (id)
  UNION ALL SELECT id, weight, 'base', 1000 + pos FROM base WHERE id NOT IN (SELECT id FROM child))"""


def _resolve() -> str:
    refs = ", ".join(f"({q(x)})" for x in REFS)
    listing = _values(LISTING, "path, stem, id, register")
    return f"""SELECT ref, (SELECT arg_min(id, CASE WHEN stem = ref THEN '0' ELSE '1' END || path) FROM {listing} WHERE stem = ref OR id = ref OR register = ref) AS id FROM (VALUES {refs}) AS x(ref)"""


def all_sql() -> dict[str, str]:
    m = definitions()
    fw = ", ".join(f"{{'metric': {q(k)}, 'value': ({v})::DOUBLE}}" for k, v in m.items() if k.startswith("fw."))
    scored = scored_cte(STYLED_DOCS, labelled(1))
    last = "SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations WHERE role = 'assistant' AND coalesce(text, '') <> '' GROUP BY conv_id"
    n_hard = " + ".join(_count(t) for t in HOOK_AVOIDED)
    samples = _values(MARKDOWN_SAMPLES, "id, text")
    out = {name: _wide(name) for name in WIDE}
    return out | {
        "word_counts": f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {words('text')} AS w FROM ({PLAIN}))",
        "segment_counts": f"SELECT doc_id, CAST(len(ps) AS BIGINT) AS n_paras, CAST(len(flatten(list_transform(ps, lambda p: {sentences('p')}))) AS BIGINT) AS n_sents FROM (SELECT doc_id, {paragraphs('text')} AS ps FROM ({STYLED_DOCS}))",
        "metrics_long": f"WITH {metrics_cte(STYLED_DOCS)} SELECT doc_id, metric, {r('value')} AS value FROM m",
        "function_word_rates": f"WITH {counts_cte(PLAIN)} SELECT doc_id, u.metric AS metric, {r('u.value')} AS value FROM (SELECT doc_id, unnest([{fw}]) AS u FROM c)",
        "feature_ranges": f"WITH {metrics_cte(labelled(1))} {features_sql('m')}",
        "corpus_stats": f"SELECT source AS register, count(*) AS documents, CAST(sum(len(regexp_extract_all(text, {W}))) AS BIGINT) AS words FROM ({PLAIN}) GROUP BY source",
        "baseline_table": f"SELECT word, count(*) AS n FROM (SELECT unnest({words('text')}) AS word FROM ({PLAIN})) GROUP BY word ORDER BY n DESC, word LIMIT 1000",
        "lexicon_mine": _lexicon(),
        "rules_mine": f"WITH {paragraphs_cte(STYLED_DOCS)} SELECT rule_id, param, {r('avg(CASE WHEN v <= param THEN 1.0 ELSE 0.0 END)', 3)} AS support FROM v JOIN mined USING (rule_id) GROUP BY rule_id, param",
        "rules_counterexamples": f"""WITH {paragraphs_cte(STYLED_DOCS)}, ranked AS (SELECT rule_id, coalesce(ss[1], paragraph) AS first, row_number() OVER (PARTITION BY rule_id ORDER BY v DESC, doc_id, i) AS pos
  FROM v JOIN mined USING (rule_id) WHERE v > param) SELECT rule_id, pos, {truncated("first", 100)} AS evidence FROM ranked WHERE pos <= 3""",
        "rules_check": f"WITH {_rules_check()} SELECT doc_id, rule_id, CAST(paragraph AS BIGINT) AS paragraph, CAST(sentence AS BIGINT) AS sentence, evidence FROM broken",
        "avoided_spans": _spans(),
        "style_distance": f"WITH {scored} SELECT doc_id, distance FROM scored",
        "feature_violations": f"WITH {scored} SELECT doc_id, metric, {r('value')} AS value, {r('dev', 3)} AS deviation, 'soft' AS severity FROM met WHERE dev > 0",
        "holdout_split": f"SELECT doc_id, split FROM ({_SPLIT})",
        "calibration_scores": f"WITH {_calibrated()} SELECT doc_id, is_target, distance FROM cs",
        "auc": f"WITH {_calibrated()} SELECT {r('avg(CASE WHEN a.distance < b.distance THEN 1.0 WHEN a.distance = b.distance THEN 0.5 ELSE 0.0 END)')} AS auc FROM cs a, cs b WHERE a.is_target AND NOT b.is_target",
        "youden_threshold": f"WITH {_calibrated()} SELECT {r('t')} AS threshold, {r('tpr')} AS tpr, {r('fpr')} AS fpr, {r('accuracy')} AS accuracy FROM best",
        "confusion_matrix": f"WITH {_calibrated()} SELECT tp, fp, tn, fn FROM best",
        "on_target_verdict": f"WITH {scored}, best AS (WITH {_calibrated()} SELECT t FROM best) SELECT doc_id, distance, distance <= t AS on_target FROM scored, best",
        "chunk_dedup": f"WITH {_terms_cte()} SELECT doc_id AS source, CAST(para AS BIGINT) AS para, CAST(len(terms) AS BIGINT) AS n_terms FROM ch",
        "term_idf": f"WITH {_terms_cte()} SELECT term, df, {r('idf')} AS idf FROM idf",
        "retrieve_topk": _retrieve(),
        "profile_merge": _merge(),
        "profile_resolve": _resolve(),
        "last_assistant_turn": last,
        "hook_decision": f"SELECT conv_id, CASE WHEN n_hard > 0 THEN 'block' ELSE 'allow' END AS decision, n_hard FROM (SELECT conv_id, CAST({n_hard} AS BIGINT) AS n_hard FROM ({last}))",
        "judging_prompt": _prompt(),
        "verdict_violations": _verdicts(),
        "massage_trajectory": _massage(),
        "massage_brief": f"""WITH base AS ({_massage()}), feat AS (SELECT * FROM (WITH {scored} SELECT doc_id, count(*) AS n FROM met WHERE dev > 0 GROUP BY doc_id))
  SELECT doc_id, distance, coalesce(n, 0) AS n_features, hard_violations AS n_lexical, rule_violations AS n_rules FROM base LEFT JOIN feat USING (doc_id) WHERE revision = 0 AND NOT accepted""",
        "html_extract": _html(),
        "markdown_strip": f"SELECT doc_id, {_replace('text', ((markup.FRONT_MATTER, ''), *markup.MARKDOWN))} AS text FROM (SELECT doc_id, {MARKED_UP} AS text FROM ({STYLED_DOCS}) UNION ALL SELECT CAST(-id AS BIGINT), text FROM {samples})",
        "keep_list": "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS kept FROM documents",
    }
