"""The same queries in SQL for another engine."""

from __future__ import annotations

from ..settings import KEYWORDS, LAYERS, STRUCTURAL

_MASKS = """
  (r + g + b < 705 AND greatest(r, g, b) - least(r, g, b) > 8) AS is_tissue,
  (r + g + b < 705 AND greatest(r, g, b) - least(r, g, b) > 8 AND r + g + b > 495 AND greatest(r, g, b) - least(r, g, b) < 28) AS is_pale,
  (greatest(r, g, b) - least(r, g, b) > 75 AND (4 * r > 5 * g OR 4 * b > 5 * g OR 4 * g > 5 * r)) AS is_artifact,
  (r + g + b > 705) AS is_background"""


def _share(flag: str) -> str:
    return f"((count(*) FILTER ({flag}) * 20000 + count(*)) // (2 * count(*)))::BIGINT"


_CELLS = f"""
px AS (SELECT user_id AS case_id, CASE WHEN user_id % 5 = 0 THEN 4 * (event_id // 16 % 4) + event_id // 3 % 2 ELSE event_id // 16 % 16 END::INT AS gy,
  CASE WHEN user_id % 5 = 0 THEN 4 * (event_id % 4) + event_id // 7 % 2 ELSE event_id % 16 END::INT AS gx,
  CASE WHEN event_type = 'error' THEN 255 ELSE 150 - (CASE WHEN user_id % 3 = 0 OR user_id % 5 = 0 THEN 70 ELSE 0 END) + event_id * 7 % 60 END::INT AS r,
  CASE WHEN event_type = 'error' THEN 60 ELSE 150 - (CASE WHEN user_id % 3 = 0 OR user_id % 5 = 0 THEN 70 ELSE 0 END) + event_id * 13 % 60 END::INT AS g,
  CASE WHEN event_type = 'error' THEN 60 ELSE 150 - (CASE WHEN user_id % 3 = 0 OR user_id % 5 = 0 THEN 70 ELSE 0 END) + event_id * 29 % 60 END::INT AS b FROM events),
mask AS (SELECT *, {_MASKS} FROM px),
cells AS (SELECT case_id, gy, gx, count(*) AS n, {_share('is_tissue')} AS tissue, {_share('is_pale')} AS pale, {_share('is_artifact')} AS artifact
  FROM mask GROUP BY ALL HAVING count(*) FILTER (is_tissue) * 10000 >= count(*) * 800)"""
_COMPONENTS = _CELLS + """,
reach(case_id, k, root) AS (
  SELECT case_id, gy * 16 + gx, gy * 16 + gx FROM cells
  UNION SELECT c.case_id, c.gy * 16 + c.gx, r.root FROM reach r JOIN cells c
    ON c.case_id = r.case_id AND abs(c.gy - r.k // 16) <= 1 AND abs(c.gx - r.k % 16) <= 1),
roots AS (SELECT case_id, k, min(root) AS root FROM reach GROUP BY ALL),
components AS (SELECT c.*, root, dense_rank() OVER (PARTITION BY c.case_id ORDER BY root) - 1 AS component
  FROM cells c JOIN roots r ON c.case_id = r.case_id AND r.k = c.gy * 16 + c.gx)"""
_mean = lambda c: f"((sum({c}) * 20000 + count(*) * 10000) // (count(*) * 20000))::BIGINT AS {c}"
_PROPOSALS = _COMPONENTS + f""",
boxes AS (SELECT case_id, component::INT AS component, min(gx) * 100 AS x1, min(gy) * 100 AS y1, least(1600, (max(gx) + 1) * 100) AS x2, least(1600, (max(gy) + 1) * 100) AS y2,
  count(*) AS cell_count, {_mean('tissue')}, {_mean('pale')}, {_mean('artifact')} FROM components GROUP BY ALL),
kept AS (SELECT *, 'cluster_' || lpad(component::VARCHAR, 2, '0') AS cluster_id,
  (((x2 - x1)::BIGINT * (y2 - y1) * 20000 + 2560000) // 5120000)::BIGINT AS area_fraction FROM boxes WHERE (x2 - x1)::BIGINT * (y2 - y1) * 10000 >= 100 * 2560000),
proposals AS (SELECT * FROM kept UNION ALL
  SELECT DISTINCT c_custkey, 0, 320, 320, 1280, 1280, 0, 0, 0, 0, 'cluster_00', 0 FROM customer WHERE c_custkey NOT IN (SELECT case_id FROM kept))"""
_HINTED = _PROPOSALS + """,
hints AS (SELECT l_suppkey AS case_id, (l_partkey % 1500)::INT AS hx1, (l_orderkey % 1500)::INT AS hy1, (l_partkey % 1500)::INT + (l_quantity * 5)::INT AS hx2,
  (l_orderkey % 1500)::INT + (l_quantity * 5)::INT AS hy2, l_discount AS score FROM lineitem),
pairs AS (SELECT p.case_id, p.cluster_id, greatest(0, least(x2, hx2) - greatest(x1, hx1))::BIGINT * greatest(0, least(y2, hy2) - greatest(y1, hy1)) AS common,
  greatest(1, least((x2 - x1)::BIGINT * (y2 - y1), (hx2 - hx1)::BIGINT * (hy2 - hy1))) AS smaller FROM proposals p JOIN hints h ON p.case_id = h.case_id),
best AS (SELECT case_id, cluster_id, max((common * 20000 + smaller) // (2 * smaller)) AS hint_overlap FROM pairs GROUP BY ALL),
top_score AS (SELECT case_id, max(score) AS hint_score FROM hints GROUP BY ALL),
hinted AS (SELECT p.*, coalesce(hint_overlap, 0)::BIGINT AS hint_overlap, coalesce(hint_score, 0) AS hint_score
  FROM proposals p LEFT JOIN best b ON p.case_id = b.case_id AND p.cluster_id = b.cluster_id LEFT JOIN top_score t ON p.case_id = t.case_id)"""
_SCORED = _HINTED + """,
points AS (SELECT *, CASE WHEN tissue < 800 OR artifact > 2800 THEN 0
  ELSE 1 + (pale > 1000)::INT + (hint_overlap > 500)::INT + (area_fraction BETWEEN 200 AND 3500)::INT END AS p FROM hinted),
risky AS (SELECT *, CASE WHEN tissue < 800 THEN 'background' WHEN artifact > 2800 THEN 'artifact' WHEN p >= 2 THEN 'serrated_suspicious_mucosa' ELSE 'non_serrated_mucosa' END AS l,
  least(5, p) AS s, CASE WHEN p > 0 THEN least(5, p + (pale > 1800)::INT) ELSE 0 END AS risk FROM points),
scored AS (SELECT * EXCLUDE (p), p >= 2 AND risk >= 3 AS d, CASE l WHEN 'background' THEN 'low tissue fraction on overview screening' WHEN 'artifact' THEN 'high artifact-like color fraction'
  ELSE concat_ws('; ', 'mucosal tissue retained after overview filtering', CASE WHEN pale > 1000 THEN 'surface pallor / mucus-rich pattern supports a serrated lesion impression' END,
    CASE WHEN hint_overlap > 500 THEN 'region overlaps a route-C low-resolution hint' END, CASE WHEN area_fraction BETWEEN 200 AND 3500 THEN 'region size is suitable for structured lesion review' END,
    CASE WHEN p >= 2 AND risk >= 3 THEN 'cluster should enter structural crypt review' END) END AS description FROM risky)"""
_TOP = _SCORED + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, (x2 - x1) * (y2 - y1) DESC, component) AS rank FROM scored),
top AS (SELECT * FROM ranked WHERE rank <= 4)"""
_STEPS = _TOP + """,
specs AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE, 'serrated_lesion_assessment', 'level_1', 1024), (1, 2.5, 'ssl_like_architecture_assessment', 'level_2', 512), (2, 5.0, 'dysplasia_assessment', 'level_3', 256)) v(k, m, goal, gate, size)),
wanted AS (SELECT case_id, round_even((x1 + x2) * 10 / 2, 0)::INT AS cx, round_even((y1 + y2) * 10 / 2, 0)::INT AS cy, k, m, goal, gate, size, cluster_id,
  row_number() OVER (PARTITION BY case_id ORDER BY s DESC, cluster_id DESC, k) AS i FROM top JOIN specs ON k = 0 OR d WHERE s > 0 AND l NOT IN ('background', 'artifact')),
walk AS (
  SELECT DISTINCT case_id, 0::BIGINT AS i, []::STRUCT(x INT, y INT, m DOUBLE, goal VARCHAR, gate VARCHAR, size INT, cluster_id VARCHAR)[] AS acc FROM top
  UNION ALL
  SELECT w.case_id, w.i, CASE WHEN len(acc) >= 8 OR len(list_filter(acc, lambda p: p.m = w.m AND
      greatest(0, least(cx + w.size // 2, p.x + p.size // 2) - greatest(cx - w.size // 2, p.x - p.size // 2))::BIGINT
      * greatest(0, least(cy + w.size // 2, p.y + p.size // 2) - greatest(cy - w.size // 2, p.y - p.size // 2)) > 0.3 * w.size::BIGINT * w.size)) > 0 THEN acc
    ELSE list_append(acc, {'x': greatest(w.size // 2, least(16000 - w.size // 2, cx))::INT, 'y': greatest(w.size // 2, least(16000 - w.size // 2, cy))::INT,
      'm': w.m, 'goal': w.goal, 'gate': w.gate, 'size': w.size::INT, 'cluster_id': w.cluster_id}) END
  FROM walk a JOIN wanted w ON a.case_id = w.case_id AND w.i = a.i + 1),
done AS (SELECT case_id, arg_max(acc, i) AS acc FROM walk GROUP BY ALL),
closed AS (SELECT case_id, list_append(acc, {'x': coalesce(acc[len(acc)].x, 0), 'y': coalesce(acc[len(acc)].y, 0), 'm': 1.0::DOUBLE, 'goal': 'integrated_impression', 'gate': 'end', 'size': 256::INT, 'cluster_id': NULL::VARCHAR}) AS acc FROM done),
flat AS (SELECT case_id, unnest(range(len(acc))) AS ord, acc FROM closed),
steps AS (SELECT case_id, ord::INT AS ord, 'step_' || lpad(ord::VARCHAR, 2, '0') AS step_id, acc[ord + 1].x AS x, acc[ord + 1].y AS y, acc[ord + 1].m AS m, acc[ord + 1].goal AS review_goal,
  acc[ord + 1].gate AS stage_gate, acc[ord + 1].size AS size, acc[ord + 1].cluster_id AS cluster_id, CASE WHEN acc[ord + 1].gate = 'end' THEN 'stop' ELSE 'inspect' END AS action FROM flat),
needs AS (SELECT * FROM (VALUES
  ('level_1', 'Confirm whether this mucosal lesion belongs to the serrated lesion pathway by reviewing surface contour, mucus-rich change, and lesion context.'),
  ('level_2', 'Search for SSL-like crypt disorder, including basal dilatation, branching, horizontal growth, and serration extending toward the crypt base.'),
  ('level_3', 'Perform routine high-magnification cytology review for dysplasia or atypia after structural crypt assessment.'),
  ('end', 'Stop navigation and consolidate the layered serrated, SSL-like, and dysplasia evidence.')) v(gate, need)),
told AS (SELECT steps.*, CASE WHEN stage_gate = 'end' AND ord = 0 THEN 'Stop navigation because no reviewable lesion cluster was retained.' ELSE need END AS need_to_see FROM steps JOIN needs ON gate = stage_gate)"""
_WHICH = lambda a, b, c: f"CASE c_custkey % 3 WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END"
#: The same path where each case has sizes of its own.
_SIZED = _COMPONENTS + f""",
thumbs AS (SELECT c_custkey AS case_id, {_WHICH(1600, 1210, 2000)} AS tw, {_WHICH(1600, 900, 777)} AS th FROM customer),
sizes AS (SELECT *, tw * 10 + 3 AS fw, th * 9 - 1 AS fh FROM thumbs),
boxes AS (SELECT case_id, component::INT AS component, min(gx) * ((any_value(tw) + 15) // 16) AS x1, min(gy) * ((any_value(th) + 15) // 16) AS y1, least(any_value(tw), (max(gx) + 1) * ((any_value(tw) + 15) // 16)) AS x2,
  least(any_value(th), (max(gy) + 1) * ((any_value(th) + 15) // 16)) AS y2, count(*) AS cell_count, {_mean('tissue')}, {_mean('pale')}, {_mean('artifact')} FROM components JOIN sizes USING (case_id) GROUP BY ALL),
kept AS (SELECT boxes.*, 'cluster_' || lpad(component::VARCHAR, 2, '0') AS cluster_id, (((x2 - x1)::BIGINT * (y2 - y1) * 20000 + tw * th) // (2 * tw * th))::BIGINT AS area_fraction
  FROM boxes JOIN sizes USING (case_id) WHERE (x2 - x1)::BIGINT * (y2 - y1) * 10000 >= 100 * tw * th),
proposals AS (SELECT kept.*, tw, th, fw, fh FROM kept JOIN sizes USING (case_id) UNION ALL
  SELECT case_id, 0, tw * 2 // 10, th * 2 // 10, tw * 8 // 10, th * 8 // 10, 0, 0, 0, 0, 'cluster_00', 0, tw, th, fw, fh FROM sizes WHERE case_id NOT IN (SELECT case_id FROM kept))""" + _TOP[len(_PROPOSALS):] + _STEPS[len(_TOP):].replace(
    "round_even((x1 + x2) * 10 / 2, 0)::INT AS cx, round_even((y1 + y2) * 10 / 2, 0)::INT AS cy", """fw, fh, round_even((round_even(x1 * fw / tw, 0)::INT + round_even(x2 * fw / tw, 0)::INT) / 2, 0)::INT AS cx,
  round_even((round_even(y1 * fh / th, 0)::INT + round_even(y2 * fh / th, 0)::INT) / 2, 0)::INT AS cy""").replace(
    "least(16000 - w.size // 2, cx)", "least(greatest(w.size // 2, fw - w.size // 2), cx)").replace("least(16000 - w.size // 2, cy)", "least(greatest(w.size // 2, fh - w.size // 2), cy)")
_SEEN = _STEPS + """,
vectors AS (SELECT vec_id, unnest(range(len(embedding))) AS i, embedding FROM embeddings),
lit AS (SELECT vec_id, abs(floor(embedding[i + 1]::DOUBLE * 100)::BIGINT * 7 + i * 13) AS q, 110 + vec_id * 37 % 145 AS tone, 6 + vec_id * 11 % 40 AS spread FROM vectors),
coloured AS (SELECT vec_id, least(255, tone + q % spread) AS r, least(255, tone + q * 5 % spread) AS g, least(255, tone + q * 11 % spread) AS b FROM lit),
shares AS (SELECT vec_id, """ + _share("is_background") + """ AS background, """ + _share("is_tissue") + """ AS tissue, """ + _share("is_pale") + """ AS pale FROM (SELECT vec_id, """ + _MASKS + """ FROM coloured) GROUP BY ALL),
seen AS (SELECT s.*, background, v.tissue AS tissue, v.pale AS pale,
  t.l, coalesce(t.s, 0) AS priority, t.d, coalesce(t.risk, t.s, 0) AS risk FROM steps s JOIN shares v ON v.vec_id = (s.case_id * 9 + ord) % (SELECT count(*) FROM embeddings) LEFT JOIN top t ON s.case_id = t.case_id AND s.cluster_id = t.cluster_id WHERE action <> 'stop')"""
_LIST = ", ".join(f"('{layer}', '{c}', {i})" for i, (layer, c) in enumerate((k, c) for k, v in LAYERS.items() for c in v))
_HITS = _SEEN + f""",
criteria AS (SELECT * FROM (VALUES {_LIST}) v(layer, criterion, place)),
hits AS (SELECT seen.*, layer, criterion, place, CASE
  WHEN criterion = 'serrated_lesion_context' THEN CASE l WHEN 'serrated_suspicious_mucosa' THEN 'supporting' WHEN 'non_serrated_mucosa' THEN 'opposing' ELSE 'not_assessed' END
  WHEN layer = 'serrated' THEN CASE l WHEN 'serrated_suspicious_mucosa' THEN CASE WHEN pale > (CASE criterion WHEN 'mucus_rich_surface' THEN 1800 ELSE 1000 END) THEN 'supporting' ELSE 'uncertain' END
    WHEN 'non_serrated_mucosa' THEN CASE WHEN pale < 800 THEN 'opposing' ELSE 'uncertain' END ELSE 'not_assessed' END
  WHEN m < 2.5 THEN 'not_assessed'
  WHEN criterion IN ('serration_to_base', 'mucus_cap', 'abnormal_maturation') THEN CASE WHEN pale > 1800 AND priority >= 4 THEN 'supporting' ELSE 'uncertain' END
  WHEN criterion IN ('basal_dilatation', 'crypt_branching') OR layer = 'ssl_like' AND m >= 5 THEN
    CASE WHEN risk >= 5 AND tissue > 6000 AND pale > 1500 THEN 'supporting' WHEN risk >= 3 THEN 'uncertain' ELSE 'not_assessed' END
  WHEN m < 5 THEN 'not_assessed'
  WHEN priority >= 5 AND tissue > 7000 AND pale < 1200 THEN CASE WHEN criterion IN ('nuclear_enlargement_stratification', 'hyperchromasia') THEN 'supporting' ELSE 'uncertain' END
  WHEN tissue > 4000 THEN 'uncertain' ELSE 'not_assessed' END AS status FROM seen CROSS JOIN criteria)"""
_CHECKLIST = _HITS + """,
merged AS (SELECT case_id, criterion, CASE WHEN bool_or(status = 'supporting') THEN 'supporting' ELSE arg_max(status, ord) END AS status, string_agg(step_id, ',' ORDER BY ord) AS evidence_steps
  FROM hits WHERE status <> 'not_assessed' GROUP BY ALL),
everyone AS (SELECT c_custkey AS case_id FROM customer UNION SELECT case_id FROM proposals),
checklist AS (SELECT e.case_id, layer, c.criterion, coalesce(status, 'not_assessed') AS status, coalesce(evidence_steps, '') AS evidence_steps
  FROM everyone e CROSS JOIN criteria c LEFT JOIN merged m ON m.case_id = e.case_id AND m.criterion = c.criterion)"""
#: The checklist of three criteria: one known, one with a rule of its own, one without a rule.
_OTHER = _SEEN + """,
criteria AS (SELECT * FROM (VALUES ('serrated', 'serrated_lesion_context'), ('serrated', 'pale_rim'), ('dysplasia', 'unseen')) v(layer, criterion)),
hits AS (SELECT case_id, step_id, ord, criterion, CASE criterion
  WHEN 'serrated_lesion_context' THEN CASE l WHEN 'serrated_suspicious_mucosa' THEN 'supporting' WHEN 'non_serrated_mucosa' THEN 'opposing' END
  WHEN 'pale_rim' THEN CASE WHEN pale > 1800 AND tissue < 5000 THEN 'supporting' WHEN m >= 5 AND pale <= 1000 THEN 'opposing' WHEN pale > 1000 THEN 'uncertain' END END AS status
  FROM seen CROSS JOIN criteria),
merged AS (SELECT case_id, criterion, CASE WHEN bool_or(status = 'supporting') THEN 'supporting' ELSE arg_max(status, ord) END AS status, string_agg(step_id, ',' ORDER BY ord) AS evidence_steps
  FROM hits WHERE status IS NOT NULL GROUP BY ALL),
everyone AS (SELECT c_custkey AS case_id FROM customer UNION SELECT case_id FROM proposals),
checklist AS (SELECT e.case_id, layer, c.criterion, coalesce(status, 'not_assessed') AS status, coalesce(evidence_steps, '') AS evidence_steps
  FROM everyone e CROSS JOIN criteria c LEFT JOIN merged m ON m.case_id = e.case_id AND m.criterion = c.criterion)"""
_ASSESSED = _CHECKLIST + f""",
n AS (SELECT case_id, layer, count(*) FILTER (status = 'supporting') AS sup, count(*) FILTER (status = 'opposing') AS opp, count(*) FILTER (status = 'uncertain') AS unc,
  count(*) FILTER (status <> 'not_assessed') AS ass, count(*) FILTER (status = 'supporting' AND criterion IN {STRUCTURAL}) AS str FROM checklist GROUP BY ALL),
wide AS (SELECT a.case_id, a.sup AS s1, a.opp AS o1, b.sup AS s2, b.unc AS u2, b.str AS t2, c.sup AS s3, c.ass AS a3,
  coalesce((SELECT bool_or(l = 'serrated_suspicious_mucosa') FROM top WHERE top.case_id = a.case_id), false) AS trace
  FROM n a JOIN n b ON a.case_id = b.case_id AND b.layer = 'ssl_like' JOIN n c ON a.case_id = c.case_id AND c.layer = 'dysplasia' WHERE a.layer = 'serrated'),
flags AS (SELECT *, trace OR s1 >= 2 AS p1, (trace OR s1 >= 2) AND s2 >= 3 AND t2 >= 1 AS p2, s3 >= 2 AS p3 FROM wide),
labels2 AS (SELECT *, CASE WHEN NOT p1 THEN 'not_applicable_non_serrated' WHEN p2 THEN 'ssl_like_supported' WHEN s2 = 0 AND u2 > 0 THEN 'indeterminate_ssl_like' ELSE 'serrated_but_non_ssl_like' END AS l2 FROM flags),
assessed AS (SELECT case_id, CASE WHEN p1 THEN 'serrated_lesion' ELSE 'non_serrated_lesion' END AS serrated_label, p1 AS serrated_positive,
  least(95, greatest(5, 20 + 16 * s1 + 10 * trace::INT - 8 * o1))::DOUBLE / 100 AS serrated_score, l2 AS ssl_like_label, p2 AS ssl_like_positive,
  least(95, greatest(5, 18 + 10 * s2 + 8 * t2))::DOUBLE / 100 AS ssl_like_score,
  CASE WHEN p3 THEN 'dysplasia_supported' WHEN a3 = 0 THEN 'dysplasia_indeterminate' ELSE 'dysplasia_not_supported' END AS dysplasia_label, p3 AS dysplasia_positive,
  least(95, greatest(5, 15 + 12 * s3))::DOUBLE / 100 AS dysplasia_score,
  CASE WHEN NOT p1 THEN 'Overall impression favors a non-serrated lesion.'
   WHEN p2 AND p3 THEN 'Overall impression favors a serrated lesion with SSL-like crypt architecture and dysplasia / atypia.'
   WHEN p2 THEN 'Overall impression favors a serrated lesion with SSL-like crypt architecture without convincing dysplasia.'
   WHEN l2 = 'serrated_but_non_ssl_like' THEN 'Overall impression favors a serrated lesion without convincing SSL-like crypt disorder.'
   ELSE 'Overall impression remains within the serrated pathway but SSL-like architecture is indeterminate.' END AS impression FROM labels2)"""
_FAULTY = """,
faulty AS (SELECT case_id, ord, step_id, x, y, CASE WHEN case_id % 11 = 2 AND ord = 0 THEN 7.5 ELSE m END AS m, CASE WHEN case_id % 11 = 3 AND ord = 0 THEN '' ELSE need_to_see END AS need_to_see,
  CASE WHEN NOT (case_id % 11 = 4 AND ord = 0) THEN review_goal END AS review_goal, CASE WHEN NOT (case_id % 11 = 5 AND ord = 0) THEN stage_gate END AS stage_gate, cluster_id, action
  FROM told WHERE NOT (case_id % 7 = 1 AND stage_gate = 'level_2')),
bounds AS (SELECT case_id, 'error' AS severity, rule, step_id AS ref FROM (
  SELECT *, unnest([CASE WHEN NOT (x BETWEEN 0 AND 14500 AND y BETWEEN 0 AND 14500) THEN 'step_out_of_bounds' END, CASE WHEN NOT m BETWEEN 1 AND 5 THEN 'magnification_invalid' END,
    CASE WHEN coalesce(need_to_see, '') = '' THEN 'missing_need_to_see' END, CASE WHEN coalesce(review_goal, '') = '' THEN 'missing_review_goal' END,
    CASE WHEN coalesce(stage_gate, '') = '' THEN 'missing_stage_gate' END]) AS rule FROM faulty WHERE action <> 'stop') WHERE rule IS NOT NULL)"""
_absent = lambda rule, where: f"UNION ALL SELECT case_id, 'error', '{rule}', '' FROM everyone WHERE {where}"
_VIOLATIONS = _CHECKLIST + _FAULTY + f""",
violations AS (
  SELECT * FROM bounds
  UNION ALL SELECT case_id, 'error', 'gate_order', step_id FROM faulty s WHERE stage_gate = 'level_3' AND NOT EXISTS (
    FROM faulty t WHERE t.case_id = s.case_id AND t.cluster_id = s.cluster_id AND t.stage_gate = 'level_2' AND t.ord < s.ord)
  UNION ALL SELECT case_id, 'error', 'invalid_label', cluster_id FROM top WHERE case_id % 11 = 6 AND rank = 1
  {_absent('no_observations', 'case_id NOT IN (SELECT case_id FROM seen)')} {_absent('no_report', 'case_id % 13 = 1')} {_absent('no_prediction', 'case_id % 13 = 2')}
  {_absent('no_serrated_checklist', 'case_id % 17 = 0')} {_absent('no_ssl_like_checklist', 'case_id % 17 = 1')} {_absent('no_dysplasia_checklist', 'case_id % 17 = 2')}
  {_absent('export_failed', 'case_id % 19 IN (0, 1)')}
  UNION ALL SELECT case_id, 'warning', 'no_serrated_support', '' FROM checklist WHERE layer = 'serrated' GROUP BY case_id HAVING count(*) FILTER (status = 'supporting') = 0)"""
_STATUS = _VIOLATIONS + """,
audited AS (SELECT e.case_id, count(v.rule) FILTER (severity = 'error') AS errors, count(v.rule) FILTER (severity = 'warning') AS warnings FROM everyone e LEFT JOIN violations v ON v.case_id = e.case_id GROUP BY ALL),
statuses AS (SELECT *, CASE WHEN errors > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' ELSE 'ok' END AS status FROM audited)"""
_LINES = _ASSESSED + """,
lines AS (SELECT case_id, layer, coalesce(string_agg(CASE WHEN status = 'supporting' THEN criterion || ' (' || replace(evidence_steps, ',', ', ') || ')' END, '; ' ORDER BY place), 'No decisive supporting item recorded.') AS line
  FROM checklist JOIN criteria USING (layer, criterion) GROUP BY ALL)"""
_LABELLED = """
labelled AS (SELECT d.doc_id AS case_id, lang, n_chars, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 1 ELSE 0 END AS quality_target,
  CASE WHEN toxic IS NULL THEN NULL WHEN toxic = 1 THEN 1 ELSE 0 END AS toxic_target, (n_chars > 400)::INT AS quality_pred, (lang = 'en')::INT AS toxic_pred
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_four = lambda a, n: f"CASE WHEN {n} > 0 THEN (({a}) * 20000 + ({n})) // (2 * ({n})) ELSE 0 END / 10000.0::DOUBLE"
_KEY_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS criterion, CASE WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words) + " THEN 'supporting' ELSE 'uncertain' END AS status FROM documents"
    for name, words in KEYWORDS.items())
_w = "WITH RECURSIVE"

SQL = {
    "case_targets": f"WITH {_LABELLED} SELECT case_id, lang, quality_target, toxic_target FROM labelled",
    "last_order": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY ALL",
    "pilot_subset": f"WITH {_LABELLED}, r AS (SELECT case_id, lang, quality_target, row_number() OVER (PARTITION BY quality_target ORDER BY case_id) AS pick FROM labelled WHERE quality_target IS NOT NULL) "
                    "SELECT * EXCLUDE (pick), 'pilot_eval' AS pilot_split, 'aligned_manifest_and_labels_csv' AS selection_reason FROM r WHERE pick <= 12",
    "pixel_masks": f"WITH p AS (SELECT l_orderkey, l_linenumber, (l_partkey % 256)::INT AS r, (l_suppkey * 7 % 256)::INT AS g, (l_orderkey % 256)::INT AS b FROM lineitem) SELECT l_orderkey, l_linenumber, {_MASKS} FROM p",
    "array_block_stats": f"""WITH v AS (SELECT vec_id, unnest(range(len(embedding))) AS i, embedding FROM embeddings),
      q AS (SELECT vec_id, i, floor(embedding[i + 1]::DOUBLE * 100)::BIGINT AS q FROM v),
      p AS (SELECT vec_id, (abs(q * 3) % 256)::INT AS r, (abs(q * 5 + i) % 256)::INT AS g, (abs(q * 7 + i * 2) % 256)::INT AS b FROM q), m AS (SELECT *, {_MASKS} FROM p)
      SELECT vec_id, {_share('is_background')} AS background, {_share('is_tissue')} AS tissue, {_share('is_pale')} AS pale FROM m GROUP BY ALL""",
    "grid_cells": f"WITH {_CELLS} SELECT * FROM cells",
    "regions": f"{_w} {_COMPONENTS} SELECT case_id, gy, gx, root, component::INT AS component FROM components",
    "region_fallback": f"{_w} {_PROPOSALS} SELECT * FROM proposals",
    "hint_overlap": f"{_w} {_HINTED} SELECT case_id, cluster_id, hint_overlap, hint_score FROM hinted",
    "region_scores": f"{_w} {_SCORED} SELECT case_id, cluster_id, l, s, risk, d, description FROM scored",
    "top_regions": f"{_w} {_TOP} SELECT case_id, cluster_id, rank::INT AS rank, s FROM top",
    "case_geometry": f"""{_w} {_SIZED} SELECT steps.*, ((x::BIGINT * 2000000 + fw) // (2 * fw))::BIGINT AS x_millionths, ((y::BIGINT * 2000000 + fh) // (2 * fh))::BIGINT AS y_millionths FROM steps JOIN sizes USING (case_id)""",
    "failed_cases": f"""{_w} {_PROPOSALS},
      thumbs AS (SELECT c_custkey AS case_id, CASE WHEN c_custkey % 29 <> 3 THEN {_WHICH(1600, 1210, 2000)} END AS tw, {_WHICH(1600, 900, 777)} AS th FROM customer),
      faults AS (SELECT case_id, 1 AS place, 'ingest' AS stage, 'no image size' AS error FROM thumbs WHERE tw IS NULL
        UNION ALL SELECT c_custkey, 1, 'ingest', 'case is listed twice' FROM customer WHERE c_custkey % 31 = 5
        UNION ALL SELECT user_id, 1, 'ingest', 'pixel outside of the image' FROM events JOIN thumbs ON user_id = case_id WHERE tw IS NOT NULL
          AND NOT ((CASE WHEN event_type = 'error' AND user_id % 37 = 2 THEN 5000 ELSE event_id % 1200 END) < tw AND event_id * 7 % 700 < th)
        UNION ALL SELECT user_id, 2, 'trace', 'no proposal cluster_0' || event_id % 2 FROM events WHERE (user_id, 'cluster_0' || event_id % 2) NOT IN (SELECT (case_id, cluster_id) FROM proposals)),
      everyone AS (SELECT c_custkey AS case_id FROM customer UNION SELECT user_id FROM events WHERE user_id IN (SELECT case_id FROM faults)),
      one AS (SELECT case_id, min({{'p': place, 's': stage, 'e': error}}) AS f FROM faults GROUP BY ALL)
      SELECT case_id, CASE WHEN f IS NULL THEN 'completed' ELSE 'failed' END AS outcome, f.s AS stage, f.e AS error FROM everyone LEFT JOIN one USING (case_id)""",
    "stage_attempts": """WITH k AS (SELECT o_custkey AS customer, count(*) AS requests FROM orders GROUP BY ALL),
      t AS (SELECT *, customer % 3 = 0 AS a, customer % 5 <> 0 AND customer % 7 <> 1 AS b, customer % 11 <> 4 AS c FROM k)
      SELECT customer, requests, CASE WHEN a THEN 'external:ok' ELSE 'external:unavailable,' || CASE WHEN b THEN 'local:ok' ELSE 'local:error,local:error,' || CASE WHEN c THEN 'rules:ok' ELSE 'rules:error,rules:error' END END END AS attempts,
        (3 * CASE WHEN a THEN 1 WHEN b THEN 2 WHEN c THEN 4 ELSE 5 END)::BIGINT AS latency_ms, CASE WHEN a THEN 'external' WHEN b THEN 'local' WHEN c THEN 'rules' END AS provider,
        CASE WHEN a THEN customer WHEN b THEN -customer WHEN c THEN 0 END::BIGINT AS answer, CASE WHEN a OR b OR c THEN 'store' END AS provider_again FROM t""",
    "open_records": """WITH r AS (SELECT user_id AS case_id, event_id, event_type, CASE event_type WHEN 'error' THEN replace(props, '}', ', "more": [1, "x"]}') WHEN 'purchase' THEN replace(props, '}', '.5}') WHEN 'view' THEN replace(props, ': ', ': "n') ELSE props END AS record FROM events),
      p AS (SELECT *, CASE WHEN json_valid(record) THEN record::JSON END AS j FROM r)
      SELECT case_id, event_id, CASE WHEN json_type(j, '$.k') IN ('UBIGINT', 'BIGINT') THEN (j->>'$.k')::BIGINT END AS k,
        CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'no_record' WHEN json_type(j, '$.k') NOT IN ('UBIGINT', 'BIGINT', 'NULL') THEN 'k_not_long' END AS violation,
        CASE WHEN json_type(j) = 'OBJECT' THEN len(json_keys(j))::INT END AS n_keys, json(j)::VARCHAR AS rest FROM p""",
    "trajectory": f"{_w} {_STEPS} SELECT * FROM steps",
    "box_geometry": """WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 1000)::INT AS x1, (l_suppkey % 800)::INT AS y1, (l_partkey % 1000 + l_quantity)::INT AS x2, (l_suppkey % 800 + l_quantity * 2)::INT AS y2,
        (l_orderkey % 900)::INT AS u1, (l_orderkey % 700)::INT AS v1, (l_orderkey % 900)::INT + 120 AS u2, (l_orderkey % 700)::INT + 90 AS v2 FROM lineitem),
      i AS (SELECT *, greatest(x1, u1) AS a1, greatest(y1, v1) AS b1, least(x2, u2) AS a2, least(y2, v2) AS b2 FROM b),
      j AS (SELECT *, CASE WHEN a2 > a1 AND b2 > b1 THEN (a2 - a1)::BIGINT * (b2 - b1) ELSE 0 END AS common, greatest(0, x2 - x1)::BIGINT * greatest(0, y2 - y1) AS area FROM i)
      SELECT l_orderkey, l_linenumber, area, round_even((x1 + x2) / 2, 0)::INT AS cx, round_even((y1 + y2) / 2, 0)::INT AS cy, common,
        common / greatest(1, least(area, 10800))::DOUBLE AS overlap, greatest(0, least(x2, 900)) AS clamped_x2, least(4000, round_even(x1 * 4000 / 1000.0::DOUBLE, 0))::INT AS full_x1,
        ((least(x2, 1000) * 2000000 + 1000) // 2000)::BIGINT AS x2_millionths, greatest(128, least(1000 - 128, x1)) AS window_x FROM j""",
    "tiles": """WITH b AS (SELECT l_suppkey AS case_id, l_orderkey, l_linenumber, (l_partkey % 700)::INT AS x1, (l_orderkey % 500)::INT AS y1, (l_partkey % 700)::INT + (l_quantity * 20)::INT AS x2, (l_orderkey % 500)::INT + (l_quantity * 15)::INT AS y2 FROM lineitem),
      t AS (SELECT b.*, x1 + 256 * i AS tx, y1 + 256 * j AS ty FROM b, range(5) a(i), range(5) c(j) WHERE x1 + 256 * i <= x2 - 256 AND y1 + 256 * j <= y2 - 256),
      r AS (SELECT case_id, l_orderkey, l_linenumber, tx, ty, row_number() OVER (PARTITION BY case_id ORDER BY l_orderkey, l_linenumber, ty, tx) - 1 AS tile FROM t)
      SELECT case_id, l_orderkey, l_linenumber, tx::INT AS tx, ty::INT AS ty, tile::INT AS tile FROM r WHERE tile < 16""",
    "crop_window": f"""{_w} {_STEPS}, p AS (SELECT user_id AS case_id, event_id, (event_id * 97 % 16000)::INT AS px, (event_id * 61 % 16000)::INT AS py FROM events)
      SELECT s.case_id, step_id, event_id FROM steps s JOIN p ON s.case_id = p.case_id AND px >= x - size // 2 AND px < x + size // 2 AND py >= y - size // 2 AND py < y + size // 2 WHERE action <> 'stop'""",
    "gate_order": """SELECT conv_id, turn FROM conversations c WHERE role = 'user' AND NOT EXISTS (FROM conversations u WHERE u.conv_id = c.conv_id AND u.role = 'system' AND u.turn < c.turn)""",
    "step_bounds": f"{_w} {_STEPS} {_FAULTY} SELECT * FROM bounds",
    "reasoning_state": f"""{_w} {_SEEN}, why AS (SELECT case_id, step_id, ord, background, row_number() OVER (PARTITION BY case_id ORDER BY ord) AS i, CASE review_goal
        WHEN 'serrated_lesion_assessment' THEN 'This view is used to decide whether the lesion belongs to the serrated pathway before structural crypt review.'
        WHEN 'ssl_like_architecture_assessment' THEN 'This view evaluates whether the crypt pattern supports SSL-like structural disorder.'
        ELSE 'This view evaluates dysplasia or atypia after completing the structural crypt review.' END AS t FROM seen)
      SELECT case_id, string_agg(t, '|' ORDER BY ord) FILTER (i <= 8) AS supporting_evidence, coalesce(string_agg('Background-heavy crop at ' || step_id, '|' ORDER BY ord) FILTER (background > 7000), '') AS conflicts, count(*) AS observations FROM why GROUP BY ALL""",
    "text_observation": """WITH k AS (""" + _KEY_ROWS + f"""), c AS (SELECT * FROM (VALUES {_LIST}) v(layer, criterion, place)),
      f AS (SELECT doc_id, coalesce(string_agg(criterion, ',' ORDER BY place) FILTER (layer = 'serrated' AND status = 'supporting'), '') AS serrated_findings,
        coalesce(string_agg(criterion, ',' ORDER BY place) FILTER (layer = 'ssl_like' AND status = 'supporting'), '') AS ssl_like_findings,
        coalesce(string_agg(criterion, ',' ORDER BY place) FILTER (layer = 'dysplasia' AND status = 'supporting'), '') AS dysplasia_findings FROM k JOIN c USING (criterion) GROUP BY doc_id),
      g AS (SELECT doc_id, text, ['serrated_lesion_assessment', 'ssl_like_architecture_assessment', 'dysplasia_assessment'][doc_id % 3 + 1] AS goal FROM documents)
      SELECT doc_id, goal, left(regexp_extract(coalesce(text, ''), '([^\\n]*)\\s*$', 1), 320) AS observation, 'Local Patho-R1 textual evidence was used to summarize the requested diagnostic layer.' AS reasoning,
        CASE goal WHEN 'serrated_lesion_assessment' THEN 'Proceed to structural crypt review if the lesion remains within the serrated pathway.'
          WHEN 'ssl_like_architecture_assessment' THEN 'Proceed to high-magnification cytology review after structural crypt review.' ELSE 'Integrate the layered impression and finalize the report.' END AS next_step,
        CASE goal WHEN 'serrated_lesion_assessment' THEN 'supports_serrated_lesion' WHEN 'ssl_like_architecture_assessment' THEN 'supports_ssl_like_architecture' ELSE 'dysplasia_supported' END AS stage_decision,
        0.62::DOUBLE AS confidence, serrated_findings, ssl_like_findings, dysplasia_findings FROM g JOIN f USING (doc_id)""",
    "backend_clusters": f"""{_w} {_PROPOSALS}, a AS (SELECT user_id AS case_id, 'cluster_0' || (event_id % 2) AS cluster_id, max(event_id % 6)::INT AS s FROM events GROUP BY ALL)
      SELECT case_id, cluster_id, s, x1, y1, x2, y2, cell_count FROM a JOIN proposals USING (case_id, cluster_id)""",
    "crop_manifest": f"""{_w} {_STEPS} SELECT case_id, step_id, 'crops/' || step_id || '_mag' || printf('%.1f', m) || '_' || size || '.png' AS image_path, x, y, m, need_to_see AS o, size AS region_size_level0 FROM told WHERE action <> 'stop'""",
    "map_merge": """SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, event_type AS type, user_id::VARCHAR AS user, 3 AS entries FROM events""",
    "latency_sum": "SELECT user_id, event_type, coalesce(sum(CASE WHEN value < 100 THEN event_id % 500 END), 0)::BIGINT AS latency_ms FROM events GROUP BY ALL",
    "typed_ingest": """WITH r AS (SELECT user_id AS case_id, event_id, coalesce(json_extract_string(props, '$.k'), '') || CASE WHEN event_type = 'error' THEN '.5' ELSE '' END AS s, event_type FROM events)
      SELECT case_id, 'error' AS severity, 'priority_not_integer' AS rule, event_id::VARCHAR AS ref FROM r WHERE NOT regexp_full_match(s, '-?[0-9]+')
      UNION ALL SELECT case_id, 'error', 'flag_not_boolean', event_id::VARCHAR FROM r WHERE event_type = 'view'""",
    "trajectory_text": f"{_w} {_STEPS} SELECT case_id, step_id, need_to_see, ((x::BIGINT * 2000000 + 16000) // 32000)::BIGINT AS x_millionths, ((y::BIGINT * 2000000 + 16000) // 32000)::BIGINT AS y_millionths FROM told",
    "hits_long": f"{_w} {_HITS} SELECT case_id, step_id, layer, criterion, status FROM hits",
    "step_findings": f"""{_w} {_HITS} SELECT case_id, step_id, background, review_goal,
        coalesce(string_agg(criterion, ',' ORDER BY place) FILTER (layer = 'serrated' AND status = 'supporting'), '') AS serrated_findings,
        coalesce(string_agg(criterion, ',' ORDER BY place) FILTER (layer = 'ssl_like' AND status = 'supporting'), '') AS ssl_like_findings,
        coalesce(string_agg(criterion, ',' ORDER BY place) FILTER (layer = 'dysplasia' AND status = 'supporting'), '') AS dysplasia_findings,
        CASE WHEN background > 7000 THEN 'Background-heavy crop at ' || step_id END AS conflict,
        CASE review_goal WHEN 'serrated_lesion_assessment' THEN CASE WHEN bool_or(layer = 'serrated' AND status = 'supporting') THEN 'supports_serrated_lesion' ELSE 'leans_non_serrated_or_indeterminate' END
          WHEN 'ssl_like_architecture_assessment' THEN CASE WHEN bool_or(layer = 'ssl_like' AND status = 'supporting') THEN 'supports_ssl_like_architecture' ELSE 'serrated_but_non_ssl_like_or_indeterminate' END
          ELSE CASE WHEN bool_or(layer = 'dysplasia' AND status = 'supporting') THEN 'dysplasia_supported' ELSE 'dysplasia_not_supported_or_indeterminate' END END AS stage_decision,
        CASE WHEN background > 7000 THEN 'The crop is background-heavy and provides limited diagnostic tissue.' ELSE CASE review_goal
          WHEN 'serrated_lesion_assessment' THEN 'Low magnification preserves the overall lesion contour and mucosal context.'
          WHEN 'ssl_like_architecture_assessment' THEN 'Intermediate magnification targets crypt architecture and the distribution of abnormal serration.'
          ELSE 'High magnification focuses on cytologic atypia and dysplasia after structural review.' END END AS observation,
        CASE review_goal WHEN 'serrated_lesion_assessment' THEN 'This view is used to decide whether the lesion belongs to the serrated pathway before structural crypt review.'
          WHEN 'ssl_like_architecture_assessment' THEN 'This view evaluates whether the crypt pattern supports SSL-like structural disorder.'
          ELSE 'This view evaluates dysplasia or atypia after completing the structural crypt review.' END AS reasoning,
        CASE review_goal WHEN 'serrated_lesion_assessment' THEN CASE WHEN coalesce(d, false) THEN 'Proceed to structural crypt review.' ELSE 'Consolidate as a serrated lesion without strong SSL-like crypt disorder.' END
          WHEN 'ssl_like_architecture_assessment' THEN 'Proceed to routine high-magnification cytology review after the crypt review step.'
          ELSE 'Integrate serrated, structural, and cytologic evidence into the final layered report.' END AS next_step
      FROM hits GROUP BY case_id, step_id, background, review_goal, d""",
    "confidence": f"""{_w} {_HITS}, c AS (SELECT case_id, step_id, tissue, pale, priority, count(*) FILTER (status = 'supporting') AS support FROM hits GROUP BY ALL)
      SELECT case_id, step_id, ((least(950000, greatest(50000, 200000 + tissue * 20 + pale * 10 + support * 80000 + priority * 40000)) + 50) // 100) / 10000.0::DOUBLE AS confidence FROM c""",
    "keyword_hits": _KEY_ROWS,
    "event_checklist": """WITH h AS (SELECT *, CASE WHEN value < 20 THEN 'supporting' WHEN value < 60 THEN 'opposing' WHEN value < 120 THEN 'uncertain' ELSE 'not_assessed' END AS status FROM events)
      SELECT user_id AS case_id, event_type AS criterion, CASE WHEN bool_or(status = 'supporting') THEN 'supporting' ELSE arg_max(status, (ts, event_id)) END AS status,
        string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS evidence_steps FROM h WHERE status <> 'not_assessed' GROUP BY ALL""",
    "checklist": f"{_w} {_CHECKLIST} SELECT * FROM checklist",
    "other_criteria": f"{_w} {_OTHER} SELECT * FROM checklist",
    "completeness": f"{_w} {_CHECKLIST} SELECT case_id, layer, {_four('count(*) FILTER (status <> ' + chr(39) + 'not_assessed' + chr(39) + ')', 'count(*)')} AS completeness FROM checklist GROUP BY ALL",
    "assessment": f"{_w} {_ASSESSED} SELECT * FROM assessed",
    "report_text": f"""{_w} {_LINES} SELECT a.case_id, concat_ws(chr(10), 'Integrated Pathological Report', 'Task: serrated lesion -> SSL-like architecture -> dysplasia', '',
        'Serrated lesion assessment:', '- Impression: ' || serrated_label, '- Supporting findings: ' || x.line, '', 'SSL-like crypt architecture assessment:', '- Impression: ' || ssl_like_label, '- Supporting findings: ' || y.line, '',
        'Dysplasia assessment:', '- Impression: ' || dysplasia_label, '- Supporting findings: ' || z.line, '', 'Integrated impression:', '- ' || impression) AS report
      FROM assessed a JOIN lines x ON x.case_id = a.case_id AND x.layer = 'serrated' JOIN lines y ON y.case_id = a.case_id AND y.layer = 'ssl_like' JOIN lines z ON z.case_id = a.case_id AND z.layer = 'dysplasia'""",
    "violations": f"{_w} {_VIOLATIONS} SELECT * FROM violations",
    "audit_status": f"{_w} {_STATUS} SELECT * FROM statuses",
    "run_summary": f"""{_w} {_STATUS}, t AS (SELECT case_id, count(*) FILTER (action <> 'stop') AS steps FROM steps GROUP BY ALL), u AS (SELECT case_id, count(*) AS clusters FROM top GROUP BY ALL),
        w AS (SELECT user_id AS case_id, sum(CASE WHEN event_type <> 'view' THEN event_id % 500 ELSE 0 END) AS runtime_ms FROM events GROUP BY ALL),
        r AS (SELECT s.*, steps, coalesce(clusters, 0) + coalesce(steps, 0) AS cost, runtime_ms FROM statuses s LEFT JOIN t ON s.case_id = t.case_id LEFT JOIN u ON u.case_id = s.case_id LEFT JOIN w ON w.case_id = s.case_id)
      SELECT count(*) AS case_count, count(*) FILTER (status = 'warn') AS warn_cases, count(*) FILTER (status = 'fail') AS fail_cases, {_four('sum(coalesce(steps, 0))', 'count(*)')} AS avg_steps, {_four('sum(errors)', 'count(*)')} AS avg_errors,
        {_four('sum(cost)', 'count(*)')} AS avg_estimated_case_cost_units, {_four('sum(coalesce(runtime_ms, 0))', 'count(*)')} AS avg_runtime_ms FROM r""",
    "layer_metrics": f"""WITH {_LABELLED}, p AS (SELECT 'quality' AS layer, quality_target AS target, quality_pred AS pred FROM labelled UNION ALL SELECT 'toxic', toxic_target, toxic_pred FROM labelled),
      n AS (SELECT layer, count(*) FILTER (target IS NOT NULL AND pred IS NOT NULL) AS cases, count(*) FILTER (target = 1 AND pred = 1) AS tp, count(*) FILTER (target = 0 AND pred = 0) AS tn,
        count(*) FILTER (target = 0 AND pred = 1) AS fp, count(*) FILTER (target = 1 AND pred = 0) AS fn FROM p GROUP BY ALL)
      SELECT *, CASE WHEN cases > 0 THEN {_four('tp + tn', 'cases')} END AS accuracy, {_four('tp', '(tp + fn)')} AS recall, {_four('tn', '(tn + fp)')} AS specificity FROM n""",
    "predictions": f"WITH {_LABELLED} SELECT case_id, lang AS label, quality_target, toxic_target, quality_pred = 1 AS quality_positive, toxic_pred = 1 AS toxic_positive, CASE WHEN quality_target = quality_pred THEN true WHEN quality_target <> quality_pred THEN false END AS quality_correct FROM labelled",
    "timeline": """SELECT conv_id, count(*) AS events, string_agg('- [' || turn::VARCHAR || '] ' || role || '/' || 'chat' || ' status=ok input=None output=' || length(text)::VARCHAR, chr(10) ORDER BY turn, role, text) AS timeline FROM conversations GROUP BY ALL""",
    "json_payload": "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events",
    "content_cache": "SELECT doc_id, sha1(coalesce(text, '')) AS key, min(doc_id) OVER (PARTITION BY sha1(coalesce(text, ''))) AS first_seen, doc_id > min(doc_id) OVER (PARTITION BY sha1(coalesce(text, ''))) AS hit FROM documents",
    "fallback_chain": """WITH a AS (SELECT event_id, 0 AS priority, 'external' AS provider, CASE WHEN event_id % 3 = 0 THEN 'ok' ELSE 'unavailable' END AS status, event_type || ':0' AS output FROM events
      UNION ALL SELECT event_id, 1, 'local', CASE WHEN value < 50 THEN 'ok' ELSE 'error' END, event_type || ':1' FROM events UNION ALL SELECT event_id, 2, 'rules', CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END, event_type || ':2' FROM events),
      b AS (SELECT event_id, min(priority) FILTER (status = 'ok') AS won FROM a GROUP BY ALL)
      SELECT a.event_id, max(provider) FILTER (priority = won) AS provider, max(output) FILTER (priority = won) AS output, string_agg(provider || ':' || status, ',' ORDER BY priority) FILTER (won IS NULL OR priority <= won) AS attempts
      FROM a JOIN b ON a.event_id = b.event_id GROUP BY a.event_id""",
    "retry_log": """WITH t AS (SELECT user_id, event_type, event_id, CASE WHEN value < 40 THEN 'ok' ELSE 'error' END AS status, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events),
      u AS (SELECT *, coalesce(max((status = 'ok')::INT) OVER (PARTITION BY user_id, event_type ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM t WHERE attempt <= 2)
      SELECT user_id, event_type, event_id, status, attempt::INT AS attempt FROM u WHERE done = 0""",
    "mode_plan": """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'manual' WHEN l_linestatus = 'O' THEN 'model,heuristic' ELSE l_linestatus END AS modes FROM lineitem""",
    "box_spec": "SELECT l_orderkey, l_linenumber, i::INT AS box, (l_partkey % 100 + i)::INT AS x1, l_linenumber::INT AS y1, (l_partkey % 100 + i + 10)::INT AS x2, (l_linenumber + 20)::INT AS y2 FROM lineitem, range(2) t(i)",
    "event_metrics": f"SELECT {_four('sum(event_id % 500)', 'count(*)')} AS average_step_latency_ms, {_four('count(*) FILTER (value < 50)', 'count(*)')} AS cache_hit_rate, {_four('count(*) FILTER (event_type <> ' + chr(39) + 'error' + chr(39) + ')', 'count(*)')} AS success_rate FROM events",
    "last_line": r"SELECT doc_id, left(regexp_extract(coalesce(text, ''), '([^\n]*)\s*$', 1), 320) AS last_line FROM documents",
}
