"""What the queries must return, as SQL for DuckDB on the same tables, written from the operators' definitions.

Each part is a named subquery; ``sql`` puts together those that a query needs.
"""

from __future__ import annotations

import re
from itertools import combinations

from ..functions.columns import FORMULA_WORDS, SYMBOL_GLYPHS
from ..operators import evaluate as E
from ..sources import testdata as T
from ..sources import vocabulary as V
from . import fixtures as X
from .queries import CEILING, FLOOR, TODAY


def case(column: str, values: dict) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else f"[{', '.join(map(q, v))}]" if isinstance(v, list) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in values.items()) + " END"


def pick(values: list[str], n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{n} % {len(values)} + 1]"


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def spaced(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> ''))"


def unusable(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: w <> '')"
    loose = f"len(list_filter({words}, lambda w: length(w) = 1)) / len({words})"
    related = f"regexp_matches(replace({x}, 'xrightarrow', '→'), '(?s)[A-Za-z0-9].*(?:[=<>≤≥→]|->|rightarrow).*[A-Za-z0-9]')"
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN true WHEN len({words}) < 4 THEN false WHEN {loose} > 0.85 THEN true ELSE {loose} > 0.55 AND NOT {related} END)"


def readable(t: str, f: str) -> str:
    return f"coalesce(CASE WHEN NOT {unusable(t)} THEN {t} END, CASE WHEN {f} <> '' THEN {f} END, {t}, '')"


def symbols(x: str) -> str:
    for a, b in FORMULA_WORDS.items():
        x = f"replace({x}, '{a}', '{b}')"
    bare = f"regexp_replace({x}, '\\\\(?:begin|end)\\{{[a-z*]+\\}}|\\\\[a-zA-Z]+', ' ', 'g')"
    return f"lower(regexp_replace({bare}, '[^a-zA-Z0-9+\\-=<>*/^]', '', 'g'))"


def similarity(a: str, b: str) -> str:
    """Over columns that hold symbol texts."""
    n = lambda s, c: f"(length({s}) - length(replace({s}, {c}, '')))"
    chars = f"list_distinct(list_filter(string_split({a}, ''), lambda c: c <> ''))"
    return f"(CASE WHEN {a} = '' THEN 0.0 ELSE coalesce(list_sum(list_transform({chars}, lambda c: least({n(a, 'c')}, {n(b, 'c')}))), 0) / length({a}) END)"


def top(rows: str, by: str, k: int | None, order: str) -> str:
    limit = f" QUALIFY rank <= {k}" if k else ""
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rank FROM {rows}{limit}"


RANK = lambda c: f"({case(c, V.DISCLOSURE_RANK)})"
AXES = E.AXES
_IS_FORMULA = "block_type IN ('formula', 'code')"
_RATES = (
    "count(*) AS n, count(*) FILTER (answerable) AS n_answerable, round(avg(CAST(hit_candidates AS INT)) FILTER (answerable), 6) AS recall_candidates, "
    "round(avg(CAST(hit_pack AS INT)) FILTER (answerable), 6) AS recall_pack, round(avg(CAST(abstained AS INT)) FILTER (NOT answerable), 6) AS abstention, "
    "CAST(sum(violations) AS BIGINT) AS violations"
)

PARTS: dict[str, str] = {
    "src": "SELECT DISTINCT source, CAST(substr(source, 4) AS INT) AS n FROM documents",
    "sources": """SELECT source AS source_id, CASE WHEN n < 16 THEN 'approved' WHEN n < 18 THEN 'quarantined' WHEN n = 18 THEN 'retired' ELSE 'withdrawn' END AS approval_state,
        n % 5 <> 3 AS has_rights, n % 7 <> 6 AS scanned, sha256(source) AS checksum, 'ed' || (n % 3) AS edition, n FROM src""",
    "lines": "SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL",
    "typed": """SELECT *, CASE WHEN pos = 0 THEN 'heading' WHEN pos % 11 = 10 THEN 'page_footer' WHEN length(line) < 40 THEN 'caption' WHEN pos % 7 = 5 THEN 'formula'
        WHEN pos % 9 = 8 THEN 'table' ELSE 'paragraph' END AS block_type FROM lines""",
    "blocks": """SELECT doc_id, 'o' || doc_id AS object_id, doc_id || ':' || pos AS block_id, source AS source_id, pos, pos // 8 + 1 AS page, block_type,
        CASE WHEN block_type = 'formula' AND pos % 2 = 0 THEN '' ELSE line END AS text, CASE WHEN block_type = 'formula' AND pos % 2 = 0 THEN line END AS latex,
        CASE WHEN block_type = 'caption' THEN doc_id || ':' || (CASE WHEN pos % 10 < 5 THEN pos - 1 ELSE pos + 1 END) END AS linked_id,
        sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) - 1 AS char_start, length(line) AS n_chars FROM typed""",
    "quality": "SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id",
    "objects": f"""SELECT d.doc_id, 'o' || d.doc_id AS object_id, source AS source_id, {pick(['definition', 'explanation', 'example', 'exercise', 'solution', 'concept'], 'd.doc_id')} AS object_type,
        CASE WHEN d.doc_id % 6 = 4 THEN 'solution' ELSE {pick(['public', 'public', 'hint_gated', 'worked_step'], 'd.doc_id')} END AS disclosure,
        CASE WHEN d.doc_id % 5 = 0 THEN '7' ELSE '10' END AS grade, lang AS subject, CASE WHEN d.doc_id % 13 = 0 THEN 'tenant-other' WHEN d.doc_id % 17 = 0 THEN '{T.TENANT}' END AS tenant_scope,
        CASE WHEN quality = 0 THEN 'quarantined' ELSE 'approved' END AS approval_state, d.doc_id % 29 = 0 AS retired,
        substr(trim(string_split(coalesce(text, ''), chr(10))[1]), 1, 80) AS heading_path, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS content_hash
        FROM documents d LEFT JOIN quality q ON q.doc_id = d.doc_id""",
    "gold": """SELECT 'c' || i.item_id AS case_id, b.block_id, d.lang, CASE WHEN d.doc_id % 5 = 0 THEN '7' ELSE '10' END AS grade FROM benchmark i JOIN documents d ON length(i.text) > 0 AND contains(d.text, i.text) JOIN blocks b ON b.doc_id = d.doc_id
        WHERE b.char_start < instr(d.text, i.text) - 1 + length(i.text) AND b.char_start + b.n_chars > instr(d.text, i.text) - 1""",
    "goldset": "SELECT DISTINCT 'plan-' || case_id AS plan_id, block_id FROM gold",
    "cases": f"""SELECT 'c' || i.item_id AS case_id, i.item_id, i.text AS query, coalesce(g.grade, CASE WHEN i.item_id % 3 = 0 THEN '7' ELSE '10' END) AS grade, coalesce(g.lang, 'en') AS subject, coalesce(g.lang, 'en') AS language,
        {pick(['factual', 'procedural', 'conceptual'], 'i.item_id')} AS question_type, {pick(list(V.ROLES), 'i.item_id')} AS teaching_action, {pick(['cold_start', 'progressing'], 'i.item_id')} AS learner_state,
        {pick(list(V.CEILING), 'i.item_id')} AS assessment_state, {pick(['text', 'equation', 'table', 'diagram'], 'i.item_id')} AS modality, g.case_id IS NOT NULL AS answerable, i.item_id % 4 = 3 AS holdout, i.item_id % 3 AS n_adjudicators
        FROM benchmark i LEFT JOIN (SELECT case_id, min(lang) AS lang, min(grade) AS grade FROM gold GROUP BY case_id) g ON g.case_id = 'c' || i.item_id""",
    "plans": f"""SELECT 'plan-' || case_id AS plan_id, case_id, item_id, query, CASE WHEN trim(query) = '' THEN '' ELSE 'class ' || grade || ' ' || subject || ', ' || query END AS scoped, grade, subject,
        teaching_action, assessment_state, '{T.TENANT}' AS tenant, {case('assessment_state', V.CEILING)} AS ceiling FROM cases""",
    "allowed": f"""SELECT p.plan_id, o.object_id FROM plans p JOIN objects o ON o.grade = p.grade AND o.subject = p.subject JOIN sources s ON s.source_id = o.source_id
        WHERE NOT o.retired AND (o.tenant_scope IS NULL OR o.tenant_scope = p.tenant) AND {RANK('o.disclosure')} <= {RANK('p.ceiling')}
        AND ((o.approval_state = 'approved' AND s.approval_state = 'approved') OR (o.approval_state = 'quarantined' AND s.approval_state = 'quarantined' AND o.source_id IN ({', '.join(repr(x) for x in T.LICENSED)})))""",
    "licensed": f"SELECT o.object_id, o.source_id FROM objects o JOIN sources s ON s.source_id = o.source_id WHERE o.approval_state = 'quarantined' AND s.approval_state = 'quarantined' AND o.source_id IN ({', '.join(repr(x) for x in T.LICENSED)})",
    "own": f"""SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY pos) AS ord FROM (SELECT *, {flat("coalesce(nullif(text, ''), latex, '')")} AS body FROM blocks WHERE block_type NOT IN ('page_header', 'page_footer')) WHERE body <> ''""",
    "links": "SELECT o.object_id, o.ord, t.ord AS target FROM own o JOIN own t ON t.object_id = o.object_id AND t.block_id = o.linked_id AND t.ord <> o.ord",
    # A chain is followed until a block comes again.
    "hops": """SELECT object_id, ord, target AS here, [ord, target] AS seen FROM links
        UNION ALL SELECT h.object_id, h.ord, l.target, list_append(h.seen, l.target) FROM hops h JOIN links l ON l.object_id = h.object_id AND l.ord = h.here AND NOT list_contains(h.seen, l.target)""",
    "tied": "SELECT object_id, ord, arg_max(here, len(seen)) AS anchor FROM hops GROUP BY object_id, ord",
    "homes": "SELECT o.*, t.anchor, least(o.ord, coalesce(t.anchor, o.ord)) AS home FROM own o LEFT JOIN tied t ON t.object_id = o.object_id AND t.ord = o.ord",
    "seated": "SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY home, ord) AS seat FROM homes",
    "steps": "SELECT x.object_id, x.ord, a.ord AS up FROM seated x JOIN seated a ON a.object_id = x.object_id AND a.ord = x.anchor AND a.seat < x.seat",
    "climb": "SELECT object_id, ord, up, 1 AS n FROM steps UNION ALL SELECT c.object_id, c.ord, s.up, c.n + 1 FROM climb c JOIN steps s ON s.object_id = c.object_id AND s.ord = c.up",
    "leaders": "SELECT object_id, ord, arg_max(up, n) AS leader FROM climb GROUP BY object_id, ord",
    "begun": f"""SELECT s.*, l.leader, sum(CASE WHEN l.leader IS NULL AND NOT (s.{_IS_FORMULA} AND s.seat > 1) THEN 1 ELSE 0 END) OVER (PARTITION BY s.object_id ORDER BY s.seat) AS run
        FROM seated s LEFT JOIN leaders l ON l.object_id = s.object_id AND l.ord = s.ord""",
    "grouped": """SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY grp, seat) AS place FROM (
        SELECT b.object_id, b.block_id, b.pos, b.seat, b.block_type, b.body, CAST(coalesce(a.run, b.run) AS BIGINT) AS grp FROM begun b LEFT JOIN begun a ON a.object_id = b.object_id AND a.ord = b.leader)""",
    "sizes": "SELECT object_id, grp, sum(length(body) + 1) AS n, sum(length(body)) AS bare FROM grouped GROUP BY object_id, grp",
    "fold": """SELECT object_id, grp, CAST(1 AS BIGINT) AS w, n AS len, bare FROM sizes WHERE grp = 1 UNION ALL
        SELECT s.object_id, s.grp, f.w + CASE WHEN f.len >= 700 OR f.len + s.n > 1400 THEN 1 ELSE 0 END, CASE WHEN f.len >= 700 OR f.len + s.n > 1400 THEN s.n ELSE f.len + s.n END,
        CASE WHEN f.len >= 700 OR f.len + s.n > 1400 THEN s.bare ELSE f.bare + s.bare END FROM fold f JOIN sizes s ON s.object_id = f.object_id AND s.grp = f.grp + 1""",
    "ends": "SELECT object_id, max(w) AS top, arg_max(bare, grp) AS last FROM fold GROUP BY object_id",
    "numbered": "SELECT g.*, CASE WHEN f.w = e.top AND e.top > 1 AND e.last < 120 THEN e.top - 1 ELSE f.w END AS number FROM grouped g JOIN fold f ON f.object_id = g.object_id AND f.grp = g.grp JOIN ends e ON e.object_id = g.object_id",
    "backwards": "SELECT *, row_number() OVER (PARTITION BY object_id, number ORDER BY place DESC) AS back FROM numbered",
    "said": f"SELECT object_id, number + 1 AS number, arg_min(body, back) AS body, arg_min(block_id, back) AS block_id FROM backwards WHERE back <= 4 AND NOT {_IS_FORMULA} AND regexp_matches(lower(trim(body)), '^({'|'.join(T.OPENERS)})') GROUP BY object_id, number",
    "bodies": f"""SELECT object_id, number, list(block_id ORDER BY place) AS block_ids, string_agg(body, chr(10) ORDER BY place) AS body,
        CASE WHEN bool_or({_IS_FORMULA}) THEN 'equation' WHEN bool_or(block_type = 'table') THEN 'table' WHEN bool_or(block_type IN ('figure', 'image')) THEN 'diagram' ELSE 'text' END AS modality FROM numbered GROUP BY object_id, number""",
    "windows": """SELECT b.object_id || ':w1:' || b.number AS representation_id, b.object_id, b.number, b.block_ids, s.block_id AS context_id, o.heading_path, b.modality,
        concat_ws(chr(10), nullif(o.heading_path, ''), nullif(s.body, ''), nullif(b.body, '')) AS search_text FROM bodies b LEFT JOIN said s ON s.object_id = b.object_id AND s.number = b.number JOIN objects o ON o.object_id = b.object_id""",
    "allowed_windows": "SELECT a.plan_id, w.representation_id, w.object_id FROM windows w JOIN allowed a ON a.object_id = w.object_id",
    "wt": f"SELECT representation_id, object_id, unnest({toks('search_text')}) AS term FROM windows",
    "tf": "SELECT representation_id, object_id, term, count(*) AS tf FROM wt GROUP BY ALL",
    "lens": "SELECT representation_id, count(*) AS len FROM wt GROUP BY ALL",
    "nwin": f"SELECT count(*) AS n, avg(len({toks('search_text')})) AS mean FROM windows",
    "bstat": "SELECT term, count(*) AS df, greatest(0.0, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5))) AS w FROM tf, nwin GROUP BY term",
    "sq": f"SELECT DISTINCT plan_id, unnest({toks('scoped')}) AS term FROM plans",
    "rq": f"SELECT DISTINCT plan_id, unnest({toks('query')}) AS term FROM plans",
    "sqw": "SELECT sq.plan_id, sq.term, coalesce(b.w, (SELECT coalesce(max(w), 1.0) FROM bstat)) AS w FROM sq LEFT JOIN bstat b ON b.term = sq.term",
    "bm25": """SELECT * FROM (SELECT a.plan_id, t.representation_id, t.object_id, round(sum(q.w * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * l.len / n.mean))) / any_value(c.ceiling), 9) AS score
        FROM sqw q JOIN tf t ON t.term = q.term JOIN allowed_windows a ON a.plan_id = q.plan_id AND a.representation_id = t.representation_id JOIN lens l ON l.representation_id = t.representation_id
        JOIN (SELECT plan_id, sum(w) * 2.2 / 1.2 AS ceiling FROM sqw GROUP BY plan_id) c ON c.plan_id = q.plan_id, nwin n GROUP BY a.plan_id, t.representation_id, t.object_id) WHERE score > 0""",
    "bm25_best": "SELECT * FROM bm25 QUALIFY row_number() OVER (PARTITION BY plan_id, object_id ORDER BY score DESC, representation_id) = 1",
    "bm25_items": top("bm25_best", "plan_id", 20, "score DESC, object_id"),
    "widf": "SELECT term, count(DISTINCT representation_id) AS df, ln(1 + (SELECT count(DISTINCT representation_id) FROM wt) / (1 + count(DISTINCT representation_id))) AS w FROM wt GROUP BY term",
    "wqw": "SELECT rq.plan_id, rq.term, coalesce(i.w, (SELECT coalesce(max(w), 1.0) FROM widf)) AS w FROM rq LEFT JOIN widf i ON i.term = rq.term",
    "wmass": "SELECT plan_id, sum(w) AS mass FROM wqw GROUP BY plan_id",
    "kw": """SELECT a.plan_id, t.representation_id, t.object_id, round(sum(q.w) / any_value(m.mass), 9) AS score FROM wqw q JOIN tf t ON t.term = q.term
        JOIN allowed_windows a ON a.plan_id = q.plan_id AND a.representation_id = t.representation_id JOIN wmass m ON m.plan_id = q.plan_id GROUP BY a.plan_id, t.representation_id, t.object_id""",
    "kw_best": "SELECT * FROM kw QUALIFY row_number() OVER (PARTITION BY plan_id, object_id ORDER BY score DESC, representation_id) = 1",
    "kw_items": top("kw_best", "plan_id", 20, "score DESC, object_id"),
    "ot": f"SELECT DISTINCT object_id, unnest({toks('heading_path || chr(32) || text')}) AS term FROM objects",
    "oidf": "SELECT term, ln(1 + (SELECT count(DISTINCT object_id) FROM ot) / (1 + count(*))) AS w FROM ot GROUP BY term",
    "oqw": "SELECT rq.plan_id, rq.term, coalesce(i.w, (SELECT coalesce(max(w), 1.0) FROM oidf)) AS w FROM rq LEFT JOIN oidf i ON i.term = rq.term",
    "ko": """SELECT a.plan_id, t.object_id, round(sum(q.w) / any_value(m.mass), 9) AS score FROM oqw q JOIN ot t ON t.term = q.term JOIN allowed a ON a.plan_id = q.plan_id AND a.object_id = t.object_id
        JOIN (SELECT plan_id, sum(w) AS mass FROM oqw GROUP BY plan_id) m ON m.plan_id = q.plan_id GROUP BY a.plan_id, t.object_id""",
    "vectors": "SELECT w.representation_id, w.object_id, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS vector FROM windows w LEFT JOIN embeddings e ON e.vec_id = CAST(substr(w.object_id, 2) AS BIGINT) + w.number - 1",
    "planv": "SELECT p.plan_id, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM plans p JOIN embeddings e ON e.vec_id = p.item_id",
    "dense": "SELECT a.plan_id, a.representation_id, a.object_id, round((list_cosine_similarity(p.q, v.vector) + 1) / 2, 9) AS score FROM allowed_windows a JOIN vectors v ON v.representation_id = a.representation_id AND v.vector IS NOT NULL JOIN planv p ON p.plan_id = a.plan_id",
    "budget": """SELECT plan_id, representation_id, object_id, score FROM (SELECT *, max(score) OVER (PARTITION BY plan_id, object_id) AS best, row_number() OVER (PARTITION BY plan_id, object_id ORDER BY score DESC, representation_id) AS nth FROM dense)
        WHERE nth <= 3 AND round(best - score, 9) <= 0.02""",
    "dense_items": top("budget", "plan_id", 20, "score DESC, object_id, representation_id"),
    "dense_best": "SELECT * EXCLUDE rank FROM dense_items QUALIFY row_number() OVER (PARTITION BY plan_id, object_id ORDER BY score DESC, representation_id) = 1",
    "runs": "SELECT plan_id, object_id, representation_id, score, row_number() OVER (PARTITION BY plan_id ORDER BY score DESC, object_id) AS r, 0 AS run FROM bm25_items UNION ALL SELECT plan_id, object_id, representation_id, score, row_number() OVER (PARTITION BY plan_id ORDER BY score DESC, object_id), 1 FROM dense_best",
    "fused": "SELECT plan_id, object_id, round(sum(1.0 / (60 + r)), 9) AS fused, first(representation_id ORDER BY score DESC, run) AS representation_id, max(score) AS raw FROM runs GROUP BY plan_id, object_id",
    "base": f"""SELECT q.plan_id, t.object_id, count(*) / any_value(n.n) AS base FROM rq q JOIN ot t ON t.term = q.term JOIN (SELECT plan_id, count(*) AS n FROM rq GROUP BY plan_id) n ON n.plan_id = q.plan_id GROUP BY q.plan_id, t.object_id""",
    "wrong_grade": top("(SELECT b.plan_id, b.object_id, round(base + CASE WHEN o.grade <> p.grade THEN 1 ELSE 0 END, 9) AS score FROM base b JOIN objects o ON o.object_id = b.object_id JOIN plans p ON p.plan_id = b.plan_id)", "plan_id", 20, "score DESC, object_id"),
    "likes_answers": "SELECT p.plan_id, o.object_id, 2 AS bonus FROM plans p, objects o WHERE o.object_type IN ('solution', 'rubric', 'answer')",
    "likes_tenants": "SELECT p.plan_id, o.object_id, 2 AS bonus FROM plans p, objects o WHERE o.tenant_scope <> p.tenant",
    "answer_only": top("(SELECT coalesce(b.plan_id, l.plan_id) AS plan_id, coalesce(b.object_id, l.object_id) AS object_id, round(coalesce(base, 0) + coalesce(bonus, 0), 9) AS score FROM base b FULL JOIN likes_answers l ON l.plan_id = b.plan_id AND l.object_id = b.object_id)", "plan_id", 20, "score DESC, object_id"),
    "cross_tenant": top("(SELECT coalesce(b.plan_id, l.plan_id) AS plan_id, coalesce(b.object_id, l.object_id) AS object_id, round(coalesce(base, 0) + coalesce(bonus, 0), 9) AS score FROM base b FULL JOIN likes_tenants l ON l.plan_id = b.plan_id AND l.object_id = b.object_id)", "plan_id", 20, "score DESC, object_id"),
    "shuffled": "SELECT plan_id, object_id, count(*) OVER (PARTITION BY plan_id) AS n, row_number() OVER (PARTITION BY plan_id ORDER BY sha256('seed-1|' || plan_id || '|' || object_id)) AS rank FROM allowed",
    "random": "SELECT plan_id, object_id, round(1 - (rank - 1) / n, 9) AS score, rank FROM shuffled WHERE rank <= 20",
    "qplans": f"""SELECT 'plan-' || case_id AS plan_id, case_id, teaching_action, assessment_state, {case('assessment_state', V.CEILING)} AS ceiling, CASE WHEN assessment_state = 'graded' THEN
        CASE WHEN len(list_filter(roles, lambda r: r NOT IN ('rubric', 'worked_example'))) = 0 THEN ['explanation'] ELSE list_filter(roles, lambda r: r NOT IN ('rubric', 'worked_example')) END ELSE roles END AS roles,
        CASE WHEN teaching_action = 'misconception_correction' THEN case_id || '-misconception' END AS hypothesis FROM (SELECT *, {case('teaching_action', V.ROLES)} AS roles FROM cases)""",
    "top_bm25": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY rank) AS o FROM bm25_items) WHERE o <= 3",
    "top_kw": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY rank) AS o FROM kw_items) WHERE o <= 3",
    "agreed": """SELECT a.plan_id, count(*) AS corroboration, bool_or(o.object_type IN ('definition', 'concept')) AS anchored FROM top_bm25 a JOIN top_kw b ON b.plan_id = a.plan_id AND b.object_id = a.object_id
        JOIN windows x ON x.representation_id = a.representation_id JOIN windows y ON y.representation_id = b.representation_id JOIN objects o ON o.object_id = a.object_id
        WHERE a.representation_id = b.representation_id OR list_has_any(x.block_ids, y.block_ids) GROUP BY a.plan_id""",
    "facts": """SELECT p.plan_id, i.score IS NOT NULL AS ranked, coalesce(i.score, 0.0) AS top_score, coalesce(g.corroboration, 0) AS corroboration, coalesce(g.anchored, false) AS anchored
        FROM plans p LEFT JOIN bm25_items i ON i.plan_id = p.plan_id AND i.rank = 1 LEFT JOIN agreed g ON g.plan_id = p.plan_id""",
    "decisions": f"""SELECT *, reasons = '' AS answerable FROM (SELECT plan_id, top_score, corroboration, anchored, concat_ws('; ', CASE WHEN NOT ranked THEN 'no candidate' END, CASE WHEN ranked AND top_score < {FLOOR} THEN 'below floor' END,
        CASE WHEN ranked AND top_score < {CEILING} AND corroboration < 2 AND NOT anchored THEN 'not corroborated' END) AS reasons FROM facts)""",
    "packed": "SELECT i.* FROM bm25_items i JOIN decisions d ON d.plan_id = i.plan_id AND d.answerable WHERE i.rank <= 5",
    "sibs": f"""SELECT b.plan_id, b.object_id, b.representation_id, b.score FROM bm25 b JOIN packed p ON p.plan_id = b.plan_id AND p.object_id = b.object_id WHERE b.score >= {FLOOR}
        AND (NOT EXISTS (SELECT 1 FROM kw k WHERE k.plan_id = b.plan_id) OR EXISTS (SELECT 1 FROM kw k WHERE k.plan_id = b.plan_id AND k.representation_id = b.representation_id))""",
    "packparts": """SELECT p.plan_id, p.rank, p.object_id, 0 AS part, 0 AS num, 0 AS i, w.context_id AS block_id FROM packed p JOIN windows w ON w.representation_id = p.representation_id WHERE w.context_id IS NOT NULL
        UNION ALL SELECT p.plan_id, p.rank, p.object_id, 1, 0, generate_subscripts(w.block_ids, 1), unnest(w.block_ids) FROM packed p JOIN windows w ON w.representation_id = p.representation_id
        UNION ALL SELECT p.plan_id, p.rank, p.object_id, 2, w.number, generate_subscripts(w.block_ids, 1), unnest(w.block_ids) FROM packed p JOIN sibs s ON s.plan_id = p.plan_id AND s.object_id = p.object_id JOIN windows w ON w.representation_id = s.representation_id""",
    "packrows": "SELECT plan_id, rank, object_id, block_id, row_number() OVER (PARTITION BY plan_id, rank ORDER BY min((part, num, i))) AS seat FROM packparts GROUP BY plan_id, rank, object_id, block_id",
    "packs": "SELECT plan_id, rank, object_id, string_agg(block_id, '|' ORDER BY seat) AS blocks FROM packrows GROUP BY plan_id, rank, object_id",
    "spans": "SELECT r.plan_id, r.rank, r.object_id, CAST(coalesce(arg_min(b.page, r.seat), 1) AS BIGINT) AS page FROM packrows r LEFT JOIN blocks b ON b.block_id = r.block_id GROUP BY r.plan_id, r.rank, r.object_id",
    "filled": "SELECT p.plan_id, p.rank, p.object_id, q.case_id || '-s' || (least(p.rank, len(q.roles)) - 1) AS slot_id, q.roles[least(p.rank, len(q.roles))] AS role FROM packed p JOIN qplans q ON q.plan_id = p.plan_id",
    "slots": "SELECT plan_id, case_id || '-s' || (generate_subscripts(roles, 1) - 1) AS slot_id FROM qplans",
    "statuses": """SELECT d.plan_id, CASE WHEN NOT d.answerable THEN 'abstain' WHEN n.items > 0 AND coalesce(g.gaps, 0) = 0 THEN 'sufficient' ELSE 'insufficient' END AS status, coalesce(n.items, 0) AS items, coalesce(g.gaps, 0) AS gaps, d.reasons
        FROM decisions d LEFT JOIN (SELECT plan_id, count(*) AS items FROM packed GROUP BY plan_id) n ON n.plan_id = d.plan_id
        LEFT JOIN (SELECT s.plan_id, count(*) AS gaps FROM slots s JOIN decisions e ON e.plan_id = s.plan_id AND e.answerable WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.plan_id = s.plan_id AND f.slot_id = s.slot_id) GROUP BY s.plan_id) g ON g.plan_id = d.plan_id""",
    "resolved": "SELECT plan_id, true AS resolved FROM packs GROUP BY plan_id",
    "citations": """SELECT c.case_id, c.holdout, s.status <> 'abstain' AND s.items > 0 AS answered, coalesce(r.resolved, true) AS resolved, coalesce(g.n, 0) AS gold_blocks, coalesce(x.n, 0) AS gold_cited, coalesce(k.n, 0) AS cited_blocks
        FROM cases c JOIN statuses s ON s.plan_id = 'plan-' || c.case_id LEFT JOIN resolved r ON r.plan_id = s.plan_id LEFT JOIN (SELECT plan_id, count(*) AS n FROM goldset GROUP BY plan_id) g ON g.plan_id = s.plan_id
        LEFT JOIN (SELECT plan_id, count(DISTINCT block_id) AS n FROM packrows GROUP BY plan_id) k ON k.plan_id = s.plan_id
        LEFT JOIN (SELECT r.plan_id, count(DISTINCT r.block_id) AS n FROM packrows r JOIN goldset h ON h.plan_id = r.plan_id AND h.block_id = r.block_id GROUP BY r.plan_id) x ON x.plan_id = s.plan_id""",
    "binomial": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'P') AS successes, count(*) AS trials FROM orders GROUP BY o_orderpriority",
}


def broken(items: str, name: str) -> dict[str, str]:
    """Rule violations and case results of a run of items."""
    first = "SELECT i.plan_id, i.object_id, i.rank, i.score, w.representation_id FROM {} i LEFT JOIN windows w ON w.object_id = i.object_id AND w.number = 1".format(items)
    rep = f"SELECT plan_id, object_id, rank, score, representation_id FROM {items}" if items == "bm25_items" else first
    return {
        f"viol_{name}": f"""SELECT i.plan_id, count(*) FILTER (a.object_id IS NULL) AS unauthorised, count(*) FILTER ({RANK('o.disclosure')} > {RANK('p.ceiling')}) AS disclosure, count(*) FILTER (o.tenant_scope <> p.tenant) AS cross_tenant,
            count(*) FILTER (l.object_id IS NULL AND NOT (o.approval_state = 'approved' AND s.approval_state = 'approved')) AS unapproved, count(*) FILTER (o.retired) AS retired
            FROM {items} i JOIN plans p ON p.plan_id = i.plan_id JOIN objects o ON o.object_id = i.object_id JOIN sources s ON s.source_id = o.source_id LEFT JOIN allowed a ON a.plan_id = i.plan_id AND a.object_id = i.object_id
            LEFT JOIN licensed l ON l.object_id = i.object_id GROUP BY i.plan_id""",
        f"cited_{name}": f"SELECT i.plan_id, i.rank, unnest(w.block_ids) AS block_id FROM ({rep}) i JOIN windows w ON w.representation_id = i.representation_id",
        f"hits_{name}": f"SELECT c.plan_id, bool_or(g.block_id IS NOT NULL) AS hit, bool_or(g.block_id IS NOT NULL AND c.rank <= 5) AS hit5, count(DISTINCT c.block_id) FILTER (c.rank <= 5) AS n5 FROM cited_{name} c LEFT JOIN goldset g ON g.plan_id = c.plan_id AND g.block_id = c.block_id GROUP BY c.plan_id",
        f"results_{name}": f"""SELECT c.case_id, {', '.join('c.' + a for a in AXES)}, c.holdout, c.answerable AND coalesce(h.hit, false) AS hit_candidates, c.answerable AND coalesce(h.hit5, false) AS hit_pack,
            CASE WHEN NOT c.answerable THEN t.score IS NULL OR t.score < {FLOOR} END AS abstained, coalesce(t.score, 0.0) AS top_score, coalesce(h.n5, 0) AS blocks_at_pack,
            coalesce(v.unauthorised + v.disclosure + v.cross_tenant + v.unapproved + v.retired, 0) AS violations
            FROM cases c LEFT JOIN hits_{name} h ON h.plan_id = 'plan-' || c.case_id LEFT JOIN {items} t ON t.plan_id = 'plan-' || c.case_id AND t.rank = 1 LEFT JOIN viol_{name} v ON v.plan_id = 'plan-' || c.case_id""",
    }


for _items, _name in (("bm25_items", "bm25"), ("random", "random"), ("wrong_grade", "wrong_grade"), ("answer_only", "answer_only"), ("cross_tenant", "cross_tenant")):
    PARTS |= broken(_items, _name)
_keys = [f"'{a}=' || {a}" for a in AXES] + [f"'{a}×{b}=' || {a} || '×' || {b}" for a, b in combinations(sorted(AXES), 2)]
PARTS["sliced"] = f"SELECT *, unnest([{', '.join(_keys)}]) AS slice FROM results_bm25"
PARTS["slices"] = f"SELECT slice, {_RATES} FROM sliced GROUP BY slice"


def failing(least: int) -> str:
    return f"SELECT slice, CASE WHEN recall_candidates < 0.95 THEN 'candidates' WHEN recall_pack < 0.9 THEN 'pack' WHEN violations > 0 THEN 'violations' END AS failure FROM slices WHERE n >= {least} AND failure IS NOT NULL"


PARTS["failing3"] = failing(3)
PARTS["visible"] = "SELECT * FROM results_bm25 WHERE NOT holdout"
PARTS["calib"] = "SELECT min(top_score) FILTER (answerable) AS floor, max(top_score) FILTER (NOT answerable) AS ceiling, list(top_score ORDER BY top_score) FILTER (answerable) AS tops FROM visible"


def calibrated(cut: str) -> str:
    return f"""SELECT threshold, margin, floor, ceiling, round(avg(CAST(top_score < threshold AS INT)) FILTER (answerable), 6) AS false_abstain_rate, round(avg(CAST(top_score < threshold AS INT)) FILTER (NOT answerable), 6) AS refused_rate
        FROM visible, (SELECT round({cut}, 7) AS threshold, round(floor - ceiling, 6) AS margin, floor, ceiling FROM calib) GROUP BY ALL"""


def bounded(s: str, n: str) -> str:
    """The exact lower bound by bisection, as a list fold."""
    tail = f"list_sum(list_transform(range({s}, {n} + 1), lambda k: exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) + k * ln((a[1] + a[2]) / 2) + ({n} - k) * ln(1 - (a[1] + a[2]) / 2))))"
    fold = f"list_reduce(list_prepend([0.0, 1.0], list_transform(range(60), lambda i: [0.0, 0.0])), lambda a, x: CASE WHEN {tail} > 0.05 THEN [a[1], (a[1] + a[2]) / 2] ELSE [(a[1] + a[2]) / 2, a[2]] END)[1]"
    return f"round(CASE WHEN {n} <= 0 OR {s} <= 0 THEN 0.0 WHEN {s} >= {n} THEN pow(0.05, 1.0 / {n}) ELSE {fold} END, 6)"


_box = """SELECT *, w > 0 AND h > 0 AS ok, greatest(0.0, least(1.0, least(l, r) / nullif(w, 0))) AS x0, greatest(0.0, least(1.0, greatest(l, r) / nullif(w, 0))) AS x1,
    greatest(0.0, least(1.0, 1 - greatest(b, t) / h)) AS y0, greatest(0.0, least(1.0, 1 - least(b, t) / h)) AS y1 FROM (
    SELECT p_partkey AS id, CAST(p_partkey * 7 % 700 - 20 AS DOUBLE) AS l, CAST(p_partkey * 11 % 700 - 10 AS DOUBLE) AS b, CAST(p_partkey * 13 % 700 AS DOUBLE) AS r, CAST(p_partkey * 17 % 700 - 30 AS DOUBLE) AS t,
    CASE WHEN p_partkey % 50 = 0 THEN 0.0 ELSE 612.0 END AS w, 792.0 AS h FROM part)"""
PARTS["boxes"] = f"SELECT id, w AS pw, h AS ph, CASE WHEN ok THEN least(x0, 1 - greatest(x1 - x0, 1e-6)) END AS x, CASE WHEN ok THEN least(y0, 1 - greatest(y1 - y0, 1e-6)) END AS y, CASE WHEN ok THEN greatest(x1 - x0, 1e-6) END AS width, CASE WHEN ok THEN greatest(y1 - y0, 1e-6) END AS height FROM ({_box})"
PARTS["reading"] = "SELECT object_id AS document_id, page, block_type, coalesce(nullif(text, ''), latex) AS text, pos FROM blocks"
PARTS["poor"] = "SELECT document_id, page, CASE WHEN page % 2 = 0 THEN 'paragraph' ELSE block_type END AS block_type, text, pos FROM reading WHERE NOT (page % 3 = 0 AND pos % 2 = 0 OR page % 5 = 0)"
PARTS["sheet_rows"] = "SELECT *, CASE WHEN sheet = 'r1-3' AND case_id % 2 = 1 THEN 'r9' WHEN sheet <> 'r2-4' THEN reviewer END AS who FROM (SELECT *, reviewer || '-' || (case_id % 5) AS sheet FROM reviews)"
PARTS["sheet_names"] = "SELECT sheet, count(DISTINCT who) AS people FROM sheet_rows GROUP BY sheet"
PARTS["reviews"] = """SELECT doc_id AS case_id, 'r1' AS reviewer, CASE WHEN quality = 1 THEN 'agree' ELSE 'disagree' END AS verdict, CASE WHEN doc_id % 2 = 0 THEN 'seen' END AS note FROM labels
    UNION ALL SELECT doc_id, 'r2', CASE WHEN doc_id % 7 = 0 THEN 'unsure' WHEN toxic = 0 THEN 'agree' ELSE 'disagree' END, 'why' FROM labels"""
PARTS["cells"] = "SELECT CAST(l_orderkey % 997 AS VARCHAR) AS document_id, l_linenumber - 1 AS row, l_suppkey % 5 AS col, l_returnflag AS text, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS seq FROM lineitem"
PARTS["grid"] = "SELECT d.document_id, r.row, c.col, coalesce(x.text, '') AS text FROM (SELECT DISTINCT document_id FROM cells) d, range(6) r(row), range(4) c(col) LEFT JOIN (SELECT document_id, row, col, arg_max(text, seq) AS text FROM cells WHERE row BETWEEN 0 AND 5 AND col BETWEEN 0 AND 3 GROUP BY ALL) x ON x.document_id = d.document_id AND x.row = r.row AND x.col = c.col"
PARTS["gridlines"] = "SELECT document_id, row, '| ' || string_agg(text, ' | ' ORDER BY col) || ' |' AS line, max(text) AS most FROM grid GROUP BY document_id, row"
PARTS["cut"] = "SELECT doc_id, list_transform(string_split(text, chr(10)), lambda line: string_split(line, ', ')) AS rows FROM documents WHERE text IS NOT NULL"
PARTS["cutlines"] = "SELECT doc_id, width, list_transform(rows, lambda r: '| ' || array_to_string(list_resize(list_transform(r, lambda c: replace(c, '|', '\\|')), width, ''), ' | ') || ' |') AS ls FROM (SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS width FROM cut)"
PARTS["sectioned"] = "SELECT object_id AS document_id, pos, block_id, block_type, text, sum(CASE WHEN block_type = 'table' AND text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY object_id ORDER BY pos) AS number FROM blocks"
PARTS["damaged"] = f"SELECT object_id, block_id, page, block_type, t, {symbols('t')} AS s FROM (SELECT *, coalesce(nullif(text, ''), latex) AS t FROM blocks)"
PARTS["near"] = "SELECT DISTINCT f.block_id, f.s AS a, c.t AS candidate, c.s AS b FROM damaged f JOIN damaged c ON c.object_id = f.object_id AND c.page BETWEEN f.page - 1 AND f.page + 1 WHERE f.block_type = 'formula' AND c.block_type = 'table'"
_sel = lambda cols, part: f"SELECT {cols} FROM {part}"
_sha = "sha256({})"

QUERIES: dict[str, str] = {
    "scan_blocks": "SELECT block_type, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, max(page) AS last_page FROM blocks GROUP BY block_type",
    "source_registry": "SELECT s.source_id, s.approval_state, s.edition, s.checksum, coalesce(o.n, 0) AS objects FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM objects GROUP BY source_id) o ON o.source_id = s.source_id",
    "source_approval_check": "SELECT source_id, CASE WHEN approval_state NOT IN ('quarantined', 'approved') THEN 'state may not load' WHEN approval_state = 'approved' AND NOT has_rights THEN 'approved without rights' WHEN approval_state = 'approved' AND n % 4 = 1 THEN 'rights are for another file' WHEN approval_state = 'approved' AND NOT scanned THEN 'approved without scan' ELSE '' END AS problem FROM sources",
    "gold_cases": _sel(f"case_id, query, {', '.join(AXES)}, holdout", "cases"),
    "object_blocks_agg": "SELECT object_id, string_agg(block_id, '|' ORDER BY pos) AS blocks FROM blocks GROUP BY object_id",
    "upsert_merge": "SELECT object_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN 'retired' ELSE approval_state END AS approval_state, heading_path FROM objects UNION ALL SELECT object_id || '-new', 'retired', 'changed' FROM objects WHERE doc_id % 6 = 0",
    "upsert_sources": "SELECT source_id, CASE WHEN n % 6 = 3 THEN 'retired' ELSE approval_state END AS approval_state, n % 6 <> 3 AND has_rights AS has_rights, n % 6 = 3 OR scanned AS scanned, edition FROM sources UNION ALL SELECT source_id || '-new', 'retired', false, true, 'new' FROM sources WHERE n % 6 = 0",
    "corpus_union": "SELECT object_id, approval_state, CASE WHEN doc_id % 2 = 0 THEN 'second' ELSE heading_path END AS heading_path FROM objects WHERE doc_id % 2 = 0 OR doc_id % 3 <> 2",
    "licence_coverage": f"SELECT source_id, 'quarantined without a licence' AS problem, 'none' AS licence FROM sources WHERE approval_state = 'quarantined' UNION ALL SELECT source_id, 'not named by the licence', 'given' FROM sources WHERE source_id NOT IN ({', '.join(repr(s) for s in T.LICENSED)})",
    "attached_vectors": """SELECT w.representation_id, CASE WHEN m.h IS NULL THEN '' ELSE 'm1' END AS model, round(m.vector[1], 6) AS first FROM windows w
        LEFT JOIN (SELECT x.search_text AS h, arg_max(v.vector, x.representation_id) AS vector FROM windows x JOIN vectors v ON v.representation_id = x.representation_id WHERE x.number = 1 AND v.vector IS NOT NULL GROUP BY h) m ON m.h = w.search_text""",
    "block_regions": "SELECT block_id, page, (pos % 8) / 8 AS y, (pos % 8) / 8 + 0.125 AS bottom FROM blocks",
    "sheet_import": """SELECT sheet, '' AS case_id, 'not exactly one reviewer' AS problem FROM sheet_names WHERE people <> 1
        UNION ALL SELECT * FROM (SELECT n.sheet, CAST(n.case_id AS VARCHAR), CASE WHEN n.case_id % 11 = 0 OR n.case_id NOT IN (SELECT doc_id FROM documents) THEN 'unknown case' WHEN n.verdict = 'disagree' AND coalesce(n.note, '') = '' THEN 'disagreement without a note' END AS problem
        FROM sheet_rows n JOIN sheet_names p ON p.sheet = n.sheet WHERE p.people = 1) WHERE problem IS NOT NULL""",
    "citation_gates": """SELECT unnest(list_filter([CASE WHEN r < 1.0 THEN {'gate': 'resolution', 'value': r, 'floor': CAST(1.0 AS DOUBLE)} END, CASE WHEN k < 0.95 THEN {'gate': 'completeness', 'value': k, 'floor': CAST(0.95 AS DOUBLE)} END], lambda g: g IS NOT NULL), recursive := true)
        FROM (SELECT round(avg(CAST(resolved AS INT)), 6) AS r, round(avg(gold_cited / gold_blocks) FILTER (answered AND gold_blocks > 0), 6) AS k FROM citations)""",
    "vector_parse": "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(CAST(x AS VARCHAR) AS DOUBLE))), 4) AS total FROM embeddings",
    "embedding_cache_misses": "SELECT DISTINCT 'm1:document:' || sha256(search_text) AS cache_key FROM windows WHERE search_text NOT IN (SELECT search_text FROM windows WHERE number = 1)",
    "html_page_text": None,
    "html_tag_extract": None,
    "review_sheet": f"""SELECT c.case_id, c.query, coalesce(string_agg(x.line, chr(10) || chr(10) ORDER BY x.block_id), '') AS cited, coalesce(array_to_string(list_sort(list_distinct(list(x.page) FILTER (x.page IS NOT NULL))), ','), '') AS pages
        FROM cases c LEFT JOIN (SELECT DISTINCT g.case_id, g.block_id, {flat("coalesce(nullif(b.text, ''), b.latex, '')")} AS line, b.page FROM gold g JOIN blocks b ON b.block_id = g.block_id) x ON x.case_id = c.case_id WHERE c.holdout OR NOT c.answerable GROUP BY c.case_id, c.query""",
    "adjudication": """SELECT r.case_id, r.agreed, CASE WHEN d.doc_id IS NULL THEN 'unknown case' WHEN r.disputed THEN 'disputed' WHEN r.agreed >= 2 THEN 'adjudicated' WHEN r.unsure THEN 'unsure' ELSE 'open' END AS state, r.note_missing
        FROM (SELECT case_id, count(DISTINCT reviewer) FILTER (verdict = 'agree') AS agreed, bool_or(verdict = 'disagree') AS disputed, bool_or(verdict = 'unsure') AS unsure, bool_or(verdict = 'disagree' AND coalesce(note, '') = '') AS note_missing FROM reviews GROUP BY case_id) r
        LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 11 <> 0) d ON d.doc_id = r.case_id""",
    "review_import": "SELECT reviewer, verdict, count(*) AS n, count(*) FILTER (verdict = 'disagree' AND note IS NULL) AS without_note FROM reviews GROUP BY reviewer, verdict",
    "chapter_text": "SELECT object_id, length(t) AS chars, sha256(t) AS digest FROM (SELECT object_id, string_agg(body, chr(10) ORDER BY pos) AS t FROM own GROUP BY object_id)",
    "tokenize": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, CAST(len(list_distinct(t)) AS BIGINT) AS distinct_n, sha256(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {toks(chr(39).join(['coalesce(text, ', '', ')']))} AS t FROM documents)",
    "scoped_query": "SELECT plan_id, scoped FROM plans",
    "statement_blocks": f"SELECT block_id, block_type FROM own WHERE regexp_matches(lower(trim(body)), '^({'|'.join(T.OPENERS)})')",
    "unusable_text": f"SELECT block_id, {unusable('text')} AS plain, {unusable('spelt')} AS spelt, {unusable('related')} AS related FROM (SELECT *, spelt || ' = 4' AS related FROM (SELECT block_id, text, array_to_string(string_split(text, ''), ' ') AS spelt FROM blocks WHERE text <> ''))",
    "readable_text": f"SELECT block_id, sha256({readable('text', 'latex')}) AS digest FROM blocks",
    "unusable_formulas": f"SELECT block_id FROM blocks WHERE block_type = 'formula' AND {unusable('text')}",
    "geometry_region": "SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(width, 6) AS width, round(height, 6) AS height FROM boxes",
    "geometry_roundtrip": "SELECT id, round(x * pw, 4) AS \"left\", round((1 - y) * ph - height * ph, 4) AS bottom, round(x * pw + width * pw, 4) AS \"right\", round((1 - y) * ph, 4) AS top FROM boxes",
    "cosine_topk": "SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(v.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5",
    "hash_embedding": "SELECT plan_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY plan_id)), 6) AS value FROM (SELECT plan_id, CAST(('0x' || substr(sha256(word), 1, 8)) AS BIGINT) % 256 AS bucket, count(*) AS n FROM (SELECT plan_id, unnest(regexp_split_to_array(lower(scoped), '\\s+')) AS word FROM plans) WHERE word <> '' GROUP BY ALL)",
    "authorised_objects": "SELECT * FROM allowed",
    "authorised_objects_sql": "SELECT * FROM allowed",
    "licensed_objects": "SELECT * FROM licensed",
    "authorised_windows": "SELECT plan_id, representation_id, object_id FROM allowed_windows",
    "unapproved_sources": "SELECT source_id, approval_state FROM sources WHERE approval_state <> 'approved'",
    "contract_violations": """SELECT 'source' AS entity, source_id AS id, 'approved_without_rights_or_scan' AS rule FROM sources WHERE approval_state = 'approved' AND NOT (has_rights AND scanned)
        UNION ALL SELECT 'block', block_id, 'block_without_content' FROM blocks WHERE (pos % 10 = 9 OR text = '') AND coalesce(latex, '') = ''
        UNION ALL SELECT 'object', object_id, 'solution_made_public' FROM objects WHERE object_type = 'solution' AND doc_id % 5 = 1
        UNION ALL SELECT 'window', w.representation_id, 'vector_without_model' FROM windows w JOIN vectors v ON v.representation_id = w.representation_id WHERE (v.vector IS NULL) <> (w.number <> 1)
        UNION ALL SELECT 'region', CAST(p_partkey AS VARCHAR), unnest(list_filter([CASE WHEN p_partkey % 13 = 0 OR p_partkey % 17 = 0 OR p_partkey % 13 > 12 OR p_partkey % 17 > 16 THEN 'origin_outside_page' END,
            CASE WHEN p_partkey % 7 = 0 OR p_partkey % 11 IN (0, 10) THEN 'size_outside_page' END, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 19 > 17 THEN 'confidence_outside_bounds' END], lambda r: r IS NOT NULL)) FROM part
        UNION ALL SELECT 'verification', CAST(doc_id AS VARCHAR), 'pass_with_failing_gate' FROM labels WHERE quality = 1 AND list_has_any([true], list_transform(range(8), lambda i: doc_id % (23 + i) = 3 OR doc_id % (19 + i) = 5))
        UNION ALL SELECT 'licence', source_id, unnest(list_filter([CASE WHEN n % 5 = 2 THEN 'licence_without_source' END, CASE WHEN n % 4 = 3 OR n % 7 = 5 THEN 'licence_without_reason_or_grantor' END], lambda r: r IS NOT NULL)) FROM sources
        UNION ALL SELECT 'gate', CAST(n_nationkey AS VARCHAR), unnest(list_filter([CASE WHEN n_nationkey % 4 = 0 THEN 'corroboration_below_one' END, CASE WHEN n_nationkey % 3 = 0 THEN 'depth_below_one' END,
            CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 6 / 5 <= 0.5 THEN 'ceiling_not_above_floor' END], lambda r: r IS NOT NULL)) FROM nation""",
    "plan_violations": """SELECT 'plan' AS entity, plan_id AS id, rule FROM (SELECT 'plan-c' || item_id AS plan_id, unnest([CASE WHEN item_id % 4 = 1 THEN 'ceiling_above_assessment_state' END, CASE WHEN item_id % 5 = 2 THEN 'slot_min_above_max' END,
        CASE WHEN item_id % 5 <> 2 AND item_id % 7 = 3 THEN 'required_slot_without_minimum' END, CASE WHEN assessment_state = 'graded' AND item_id % 6 = 3 THEN 'graded_plan_with_banned_role' END,
        CASE WHEN teaching_action = 'misconception_correction' AND item_id % 2 <> 0 THEN 'misconception_without_hypothesis' END, CASE WHEN item_id % 4 = 3 THEN 'fallback_not_terminal' END,
        CASE WHEN item_id % 4 IN (0, 3) THEN 'corrective_retrievals_outside_bounds' END]) AS rule FROM cases) WHERE rule IS NOT NULL
        UNION ALL SELECT 'pack', s.plan_id, unnest(list_filter([CASE WHEN s.items < 1 THEN 'sufficient_without_evidence' END, CASE WHEN NOT d.answerable THEN 'sufficient_against_the_gate' END], lambda r: r IS NOT NULL))
        FROM statuses s JOIN decisions d ON d.plan_id = s.plan_id WHERE s.status = 'sufficient' OR CAST(substr(s.plan_id, 7) AS BIGINT) % 5 = 1""",
    "dangling_citations": "SELECT i.plan_id, i.object_id FROM bm25_items i WHERE NOT EXISTS (SELECT 1 FROM packed p WHERE p.plan_id = i.plan_id AND p.object_id = i.object_id)",
    "gold_violations": "SELECT 'case' AS entity, case_id AS id, 'answerable_unlike_gold' AS rule FROM cases WHERE item_id % 9 = 4",
    "rights_problems": f"""SELECT * FROM (SELECT source_id, concat_ws('; ', CASE WHEN n % 4 = 1 THEN 'checksum differs' END, CASE WHEN NOT scanned THEN 'not scanned' END, CASE WHEN n % 3 = 0 THEN 'storage not permitted' END, CASE WHEN n % 8 = 5 THEN 'display not permitted' END,
        CASE WHEN n % 9 = 2 THEN 'processing not permitted' END, CASE WHEN DATE '{TODAY}' + (n - 10) < DATE '{TODAY}' THEN 'term expired' END) AS problems FROM sources) WHERE problems <> ''""",
    "correction_status": "SELECT block_id, CASE WHEN pos % 5 = 2 THEN 'incomplete' WHEN pos % 5 = 1 THEN 'already applied' WHEN pos % 5 = 3 THEN 'text differs' ELSE 'applies' END AS status FROM blocks WHERE block_type = 'paragraph'",
    "formula_review_status": "SELECT block_id, CASE WHEN pos % 4 = 1 THEN 'one person read and checked' WHEN block_type <> 'formula' THEN 'not a formula' WHEN coalesce(latex, '') = '' OR pos % 3 = 0 THEN 'applies' ELSE 'another formula is there' END AS status FROM blocks",
    "table_markdown": "SELECT doc_id, length(m) AS chars, sha256(m) AS digest FROM (SELECT doc_id, array_to_string(list_concat(list_concat([ls[1]], ['|' || repeat('---|', width)]), ls[2:]), chr(10)) AS m FROM cutlines)",
    "grid_markdown": "SELECT document_id, CASE WHEN max(most) = '' THEN '' ELSE arg_min(line, row) || chr(10) || '|---|---|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY row) FILTER (row > 0) END AS markdown FROM gridlines GROUP BY document_id",
    "parse_layout_blocks": "SELECT document_id, order_index, document_id || ':texts-' || pos AS block_id, page FROM (SELECT object_id AS document_id, pos, page, text, row_number() OVER (PARTITION BY object_id ORDER BY page, pos * 7 % 5 DESC, pos % 3, '#/texts/' || pos) - 1 AS order_index FROM blocks) WHERE text <> ''",
    "empty_pages": "SELECT d.document_id, p.page FROM (SELECT document_id, max(page) AS pages FROM reading GROUP BY document_id) d, unnest(range(1, d.pages + 1)) p(page) WHERE NOT EXISTS (SELECT 1 FROM poor x WHERE x.document_id = d.document_id AND x.page = p.page)",
    "parse_diff": """SELECT document_id, page, ba AS blocks_a, bb AS blocks_b, ca AS chars_a, cb AS chars_b, concat_ws('; ', CASE WHEN ba = 0 AND bb > 0 THEN 'one produced no blocks' END, CASE WHEN bb = 0 AND ba > 0 THEN 'two produced no blocks' END,
        CASE WHEN ba > 0 AND bb > 0 AND ca > 0 AND cb > 0 AND least(ca, cb) / greatest(ca, cb) < 0.5 THEN CASE WHEN ca < cb THEN 'one' ELSE 'two' END || ' recovered less of the text' END,
        CASE WHEN sum(fa) OVER d > 0 AND sum(fb) OVER d > 0 AND (fa = 0) <> (fb = 0) THEN 'only ' || CASE WHEN fa > 0 THEN 'one' ELSE 'two' END || ' found formulas' END) AS reasons
        FROM (SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.page, b.page) AS page, coalesce(a.n, 0) AS ba, coalesce(b.n, 0) AS bb, CAST(coalesce(a.c, 0) AS BIGINT) AS ca, CAST(coalesce(b.c, 0) AS BIGINT) AS cb, coalesce(a.f, 0) AS fa, coalesce(b.f, 0) AS fb
        FROM (SELECT document_id, page, count(*) AS n, sum(length(text)) AS c, count(*) FILTER (block_type = 'formula') AS f FROM reading GROUP BY ALL) a
        FULL JOIN (SELECT document_id, page, count(*) AS n, sum(length(text)) AS c, count(*) FILTER (block_type = 'formula') AS f FROM poor GROUP BY ALL) b ON b.document_id = a.document_id AND b.page = a.page) WINDOW d AS (PARTITION BY document_id)""",
    "compose_sections": """SELECT document_id || ':s1:' || CAST(number AS BIGINT) AS object_id, heading, n_blocks, CASE WHEN f THEN 'equation' ELSE 'text' END AS modality, sha256(t) AS content_hash FROM (
        SELECT document_id, number, arg_min(text, pos) AS heading, count(*) AS n_blocks, bool_or(block_type = 'formula') AS f, string_agg(nullif(text, ''), chr(10) || chr(10) ORDER BY pos) AS t FROM sectioned WHERE number > 0 AND block_type <> 'page_footer' GROUP BY document_id, number) WHERE trim(t) <> ''""",
    "block_groups": "SELECT object_id, block_id, place, grp FROM grouped",
    "greedy_windows": "SELECT object_id, block_id, number FROM numbered",
    "window_modality": "SELECT representation_id, modality FROM windows",
    "window_representations": "SELECT representation_id, array_to_string(block_ids, '|') AS blocks, coalesce(context_id, '') AS context_id, sha256(search_text) AS content_hash FROM windows",
    "idf_table": "SELECT term, df, round(w, 6) AS idf FROM widf",
    "keyword_topk": top("ko", "plan_id", 20, "score DESC, object_id"),
    "window_keyword_topk": "SELECT plan_id, rank, object_id, representation_id, score FROM kw_items",
    "bm25_stats": "SELECT term, df, round(w, 6) AS w FROM bstat",
    "bm25_window_scores": "SELECT plan_id, representation_id, object_id, score FROM bm25",
    "bm25_topk": "SELECT plan_id, rank, object_id, representation_id, score FROM bm25_items",
    "dense_window_scores": "SELECT * FROM dense",
    "window_budget": "SELECT * FROM budget",
    "dense_topk": "SELECT * FROM dense_items",
    "dense_skipped": "SELECT a.plan_id, count(*) FILTER (v.vector IS NULL) AS skipped, count(*) AS windows FROM allowed_windows a JOIN vectors v ON v.representation_id = a.representation_id GROUP BY a.plan_id",
    "hybrid_rrf_topk": top("(SELECT f.plan_id, f.object_id, f.representation_id, coalesce(d.score, f.raw) AS score, f.fused FROM fused f LEFT JOIN dense d ON d.plan_id = f.plan_id AND d.representation_id = f.representation_id)", "plan_id", 20, "fused DESC, object_id"),
    "identity_rerank": "SELECT plan_id, rank, object_id, round((n - (rank - 1)) / n, 9) AS score FROM (SELECT *, count(*) OVER (PARTITION BY plan_id) AS n FROM bm25_items)",
    "rerank_topk": top(f"""(SELECT i.plan_id, i.object_id, i.representation_id, CASE WHEN n > 1 THEN round(len(list_intersect(p.ws, w.ws)) / greatest(1, len(p.ws)), 9) ELSE i.score END AS score
        FROM (SELECT *, count(*) OVER (PARTITION BY plan_id) AS n FROM bm25_items) i JOIN (SELECT plan_id, {spaced('scoped')} AS ws FROM plans) p ON p.plan_id = i.plan_id
        LEFT JOIN (SELECT representation_id, {spaced('search_text')} AS ws FROM windows) w ON w.representation_id = i.representation_id)""", "plan_id", 20, "score DESC, object_id"),
    "rerank_cache_keys": """SELECT p.plan_id, 'm2:' || sha256(p.scoped || k.docs) AS cache_key FROM plans p
        JOIN (SELECT i.plan_id, string_agg(chr(0) || sha256(w.search_text), '' ORDER BY i.rank) AS docs FROM kw_items i JOIN windows w ON w.representation_id = i.representation_id GROUP BY i.plan_id) k ON k.plan_id = p.plan_id""",
    "random_topk": "SELECT * FROM random",
    "wrong_grade_topk": "SELECT * FROM wrong_grade",
    "answer_only_topk": "SELECT * FROM answer_only",
    "cross_tenant_topk": "SELECT * FROM cross_tenant",
    "query_plans": f"SELECT plan_id, ceiling, CAST({RANK('ceiling')} AS BIGINT) AS ceiling_rank, array_to_string(list_transform(roles, lambda r, i: case_id || '-s' || (i - 1)), '|') AS slots, array_to_string(roles, '|') AS roles, coalesce(hypothesis, '') AS hypothesis FROM qplans",
    "top_objects": "SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY rank) AS object_rank, object_id, representation_id, score FROM (SELECT * FROM dense_items QUALIFY row_number() OVER (PARTITION BY plan_id, object_id ORDER BY rank) = 1) QUALIFY object_rank <= 3",
    "sufficiency_gate": "SELECT plan_id, top_score, corroboration, anchored, reasons, answerable FROM decisions",
    "sibling_windows": "SELECT * FROM sibs",
    "pack_blocks": "SELECT plan_id, rank, object_id, blocks FROM packs",
    "slot_fill": "SELECT * FROM filled",
    "evidence_pack": f"""SELECT t.plan_id, t.status, p.rank, p.object_id, f.slot_id, f.role, o.source_id, o.heading_path, s.page, k.blocks, p.score, sha256(coalesce(x.text, '')) AS text_digest FROM statuses t LEFT JOIN packed p ON p.plan_id = t.plan_id
        LEFT JOIN filled f ON f.plan_id = p.plan_id AND f.rank = p.rank LEFT JOIN objects o ON o.object_id = p.object_id LEFT JOIN spans s ON s.plan_id = p.plan_id AND s.rank = p.rank LEFT JOIN packs k ON k.plan_id = p.plan_id AND k.rank = p.rank
        LEFT JOIN (SELECT plan_id, rank, string_agg(line, chr(10) ORDER BY seat) AS text FROM (SELECT r.plan_id, r.rank, r.seat, {readable('b.text', 'b.latex')} AS line FROM packrows r JOIN blocks b ON b.block_id = r.block_id) WHERE line <> '' GROUP BY plan_id, rank) x ON x.plan_id = p.plan_id AND x.rank = p.rank""",
    "pack_status": "SELECT * FROM statuses",
    "pack_spans": "SELECT * FROM spans",
    "candidate_trace": "SELECT i.plan_id, i.object_id, i.rank, i.score, d.answerable AND i.rank <= 5 AS admitted, CASE WHEN NOT d.answerable THEN 'pack abstained: ' || d.reasons WHEN i.rank > 5 THEN 'ranked ' || i.rank || ', below the pack cut of 5' ELSE '' END AS rejection_reason FROM bm25_items i JOIN decisions d ON d.plan_id = i.plan_id",
    "corpus_checksum": """SELECT sha256(string_agg(d, '' ORDER BY shard)) AS checksum, CAST(sum(n) AS BIGINT) AS entries FROM (SELECT substr(sha256(id), 1, 2) AS shard, sha256(string_agg(id || x, '' ORDER BY kind, id)) AS d, count(*) AS n FROM (
        SELECT '1' AS kind, source_id AS id, checksum AS x FROM sources UNION ALL SELECT '2', object_id, content_hash FROM objects UNION ALL SELECT '3', representation_id, sha256(search_text) FROM windows) GROUP BY shard)""",
    "release_manifest": f"SELECT o.source_id, sha256(string_agg(o.object_id, '|' ORDER BY o.object_id)) AS objects_digest, count(*) AS objects FROM objects o JOIN sources s ON s.source_id = o.source_id WHERE NOT o.retired AND ((o.approval_state = 'approved' AND s.approval_state = 'approved') OR (o.approval_state = 'quarantined' AND s.approval_state = 'quarantined' AND o.source_id IN ({', '.join(repr(x) for x in T.LICENSED)}))) GROUP BY o.source_id",
    "lineage_failures": "SELECT * FROM (SELECT i.plan_id, i.object_id, CASE WHEN o.doc_id % 7 = 2 THEN 'object not in manifest' WHEN o.doc_id % 19 = 3 THEN 'object not in corpus' WHEN s.n % 6 = 1 THEN 'source not in manifest' END AS failure FROM bm25_items i JOIN objects o ON o.object_id = i.object_id JOIN sources s ON s.source_id = o.source_id WHERE i.rank <= 5) WHERE failure IS NOT NULL",
    "case_results": "SELECT case_id, answerable, hit_candidates, hit_pack, abstained, top_score, blocks_at_pack, violations FROM results_bm25",
    "invariant_violations": "SELECT * FROM viol_cross_tenant",
    "score_report": f"SELECT {_RATES}, round(avg(blocks_at_pack) FILTER (answerable), 6) AS blocks_per_pack FROM results_bm25",
    "slice_scores": "SELECT * FROM slices",
    "failing_slices": failing(20),
    "distinctive_failures": "SELECT slice, failure FROM failing3 WHERE NOT contains(slice, '×') UNION ALL SELECT slice, failure FROM (SELECT *, string_split(string_split(slice, '=')[1], '×') AS a, string_split(substr(slice, instr(slice, '=') + 1), '×') AS v FROM failing3 WHERE contains(slice, '×')) WHERE a[1] || '=' || v[1] NOT IN (SELECT slice FROM failing3) AND a[2] || '=' || v[2] NOT IN (SELECT slice FROM failing3)",
    "broken_detection": "SELECT r.retriever, r.recall_pack, r.violations, r.violations > b.violations OR coalesce(r.recall_pack, 0) <= round(coalesce(b.recall_pack, 0) - 0.15, 6) AS worse FROM reports r, (SELECT * FROM reports WHERE retriever = 'bm25') b",
    "calibrate_midpoint": calibrated("(floor + ceiling) / 2"),
    "calibrate_budget": calibrated("tops[least(CAST(floor(0.1 * len(tops)) AS INT) + 1, len(tops))]"),
    "spans_resolve": "SELECT * FROM resolved",
    "citation_cases": "SELECT * FROM citations",
    "citation_report": """SELECT *, resolution >= 1.0 AND coalesce(completeness >= 0.95, true) AS gates_hold FROM (SELECT count(*) AS packs, count(*) FILTER (answered) AS answered, round(avg(CAST(resolved AS INT)), 6) AS resolution,
        round(avg(CAST(gold_cited > 0 AS INT)) FILTER (answered AND gold_blocks > 0), 6) AS delivered_recall, round(avg(gold_cited / gold_blocks) FILTER (answered AND gold_blocks > 0), 6) AS completeness,
        round(avg(gold_cited / cited_blocks) FILTER (answered AND cited_blocks > 0), 6) AS evidence_precision FROM citations)""",
    "clopper_pearson": f"SELECT o_orderpriority, successes, trials, {bounded('successes', 'trials')} AS bound FROM binomial",
    "holdout_report": f"SELECT *, {bounded('refused', 'unanswerable')} AS refused_bound, {bounded('answered', 'answerable')} AS answered_bound FROM (SELECT c.holdout, count(*) FILTER (NOT c.answerable AND NOT d.answerable) AS refused, count(*) FILTER (NOT c.answerable) AS unanswerable, count(*) FILTER (c.answerable AND d.answerable) AS answered, count(*) FILTER (c.answerable) AS answerable FROM cases c JOIN decisions d ON d.plan_id = 'plan-' || c.case_id GROUP BY c.holdout)",
    "unadjudicated_cases": "SELECT case_id FROM cases WHERE (holdout OR NOT answerable) AND n_adjudicators < 2",
    "broken_gold": "SELECT block_id || 'x' AS block_id, case_id FROM gold WHERE CAST(substr(case_id, 2) AS INT) % 3 = 0",
    "orphan_gold": "SELECT block_id, case_id FROM gold WHERE block_id NOT IN (SELECT unnest(block_ids) FROM windows WHERE number > 1)",
    "formula_triage": f"SELECT CASE WHEN coalesce(latex, '') <> '' THEN 'attached' WHEN NOT {unusable('text')} THEN 'readable' ELSE 'needs human' END AS state, count(*) AS n FROM blocks WHERE block_type = 'formula' GROUP BY state",
    "roundtrip_drift": "SELECT block_id, 'gone' AS what FROM blocks WHERE pos % 13 = 5 OR pos % 17 = 3 UNION ALL SELECT block_id || 'n', 'new' FROM blocks WHERE pos % 13 <> 5 AND pos % 17 = 3 UNION ALL SELECT block_id, 'changed' FROM blocks WHERE pos % 13 <> 5 AND pos % 17 <> 3 AND pos % 4 = 1 AND upper(text) <> text",
    "screen_summary": "SELECT coalesce(CASE WHEN l.quality = 1 THEN 'agree' WHEN l.doc_id IS NOT NULL THEN 'disagree' END, 'error') AS verdict, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL",
    "paraphrase_registers": "SELECT CASE WHEN length(t.text) < 60 THEN 'short' WHEN contains(t.text, '?') THEN 'question' ELSE 'long' END AS register, count(*) AS n, count(DISTINCT t.conv_id) AS parents FROM conversations t JOIN (SELECT conv_id, min(turn) AS parent FROM conversations WHERE role = 'user' GROUP BY conv_id) p ON p.conv_id = t.conv_id AND t.turn > p.parent WHERE t.role = 'user' GROUP BY ALL",
    "learning_evidence": "SELECT user_id, count(*) AS n, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS most_hints, round(sum(value), 4) AS value FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY user_id",
    "multiset_similarity": f"SELECT block_id, round({similarity('a', 'b')}, 6) AS similarity FROM (SELECT d.block_id, d.s AS a, {symbols('o.heading_path')} AS b FROM damaged d JOIN objects o ON o.object_id = d.object_id WHERE d.block_type = 'formula')",
    "near_page_candidates": f"SELECT block_id, rank, candidate, similarity FROM ({top(f'(SELECT block_id, candidate, round({similarity(chr(97), chr(98))}, 6) AS similarity FROM near)', 'block_id', 8, 'similarity DESC, length(candidate), candidate')})",
}
PARTS["reports"] = " UNION ALL ".join(f"SELECT '{n}' AS retriever, round(avg(CAST(hit_pack AS INT)) FILTER (answerable), 6) AS recall_pack, CAST(sum(violations) AS BIGINT) AS violations FROM results_{n}" for n in ("bm25", "random", "wrong_grade", "answer_only", "cross_tenant"))


def _entities(x: str) -> str:
    """Character references that end with a semicolon, piece by piece between ampersands."""
    from html.entities import html5

    names = {k[:-1]: v for k, v in html5.items() if k.endswith(";") and k[:-1].isalnum() and f"&{k}" in X.REFERENCES + "".join(f"&{n};" for n in ("amp", "quot", "copy", "middot", "lt", "gt", "nbsp"))}
    known = f"map([{', '.join(repr(k) for k in names)}], [{', '.join('chr(%d)' % ord(v) for v in names.values())}])"
    name = "regexp_extract(p, '^(#[0-9]+|#x[0-9a-fA-F]+|[A-Za-z0-9]+);', 1)"
    char = f"CASE WHEN {name} LIKE '#x%' THEN chr(CAST('0x' || substr({name}, 3) AS INT)) WHEN {name} LIKE '#%' THEN chr(CAST(substr({name}, 2) AS INT)) ELSE {known}[{name}] END"
    piece = f"CASE WHEN {name} <> '' AND ({char}) IS NOT NULL THEN ({char}) || substr(p, length({name}) + 2) ELSE '&' || p END"
    return f"(string_split({x}, '&')[1] || coalesce(list_aggregate(list_transform(string_split({x}, '&')[2:], lambda p: {piece}), 'string_agg', ''), ''))"


def _bodies(tag: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(html, '(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1), lambda x: {_entities('x')}), '|') AS {tag}"


PARTS["marked"] = f"SELECT page_id, html || '<p>{X.REFERENCES}</p><b class=\"x\">' || page_id || '&ndash;&#' || (200 + page_id % 9000) || ';</b>' AS html FROM pages"
_no_tags = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
QUERIES["html_page_text"] = f"SELECT page_id, {flat(_entities(_no_tags))} AS text FROM marked"
QUERIES["html_tag_extract"] = f"SELECT page_id, {_bodies('p')}, {_bodies('b')} FROM marked"
_quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
_known, _glyphs = "".join(SYMBOL_GLYPHS), "".join(SYMBOL_GLYPHS.values())
_symbols = ", ".join(f"({i}, {_quoted(x)})" for i, x in X.SYMBOLS)
_formulas = ", ".join(f"({_quoted(a)}, {_quoted(c)})" for a, _, c in X.FORMULAS)
QUERIES["symbol_decode"] = f"""SELECT id, translate(raw, '{_known}', '{_glyphs}') AS decoded, CASE WHEN raw IS NOT NULL THEN array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(raw, '[\ue000-\uf8ff]')),
    lambda c: NOT contains('{_known}', c))), '|') END AS unknown FROM (VALUES {_symbols}) t(id, raw)"""
QUERIES["symbol_multiset"] = f"SELECT block_id, candidate, symbol, count(*) AS n FROM (SELECT block_id, candidate, unnest(string_split({symbols('candidate')}, '')) AS symbol FROM (VALUES {_formulas}) t(block_id, candidate)) WHERE symbol <> '' GROUP BY ALL"
QUERIES["decode_stats"] = f"""SELECT source_id, count(*) FILTER (raw <> text) AS touched, count(*) FILTER ({unusable('raw')} AND NOT {unusable('text')}) AS rescued, count(*) AS same
    FROM (SELECT source_id, text, translate(text, '()+=', '{X.IN_FONT}') AS raw FROM blocks) GROUP BY source_id"""


def sql(text: str) -> str:
    """text with all the parts that it names in front of it."""
    need: list[str] = []

    def add(part: str) -> None:
        for name in re.findall(r"[a-z_0-9]+", part):
            if name in PARTS and name not in need and name not in busy:
                busy.add(name)
                add(PARTS[name])
                need.append(name)

    busy: set[str] = set()
    add(text)
    if not need:
        return text
    once = lambda n: "" if n in ("fold", "hops", "climb") else " MATERIALIZED"
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS{once(n)} ({PARTS[n]})" for n in need) + "\n" + text


def oracle_sql() -> dict[str, str]:
    return {name: sql(text) for name, text in QUERIES.items() if text}
