"""Check SQL: the registered queries in plain SQL for an independent engine.

Statements are put together from named common table expressions, each of which
lists the ones it needs.
"""

from __future__ import annotations

from vibralake import domain
from vibralake.functions.numeric import NUMBER, NUMBER_OR_NAN
from vibralake.functions.text import WHITE_SPACE
from vibralake.plans import tables as t


def text(value: str | None) -> str:
    """A string literal; characters outside plain text are spelled with chr()."""
    if value is None:
        return "NULL"
    parts, plain = [], ""
    for ch in value:
        if ch.isprintable():
            plain += ch.replace("'", "''")
        else:
            if plain:
                parts.append(f"'{plain}'")
            plain = ""
            parts.append(f"chr({ord(ch)})")
    if plain or not parts:
        parts.append(f"'{plain}'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def strings(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


STRIP = text(WHITE_SPACE)


def strip(expr: str) -> str:
    return f"trim({expr}, {STRIP})"


def category(clean: str) -> str:
    states = ", ".join(text(s) for s in domain.OPERATIONAL_STATES)
    rules = " ".join(f"WHEN contains({clean}, {text(p)}) THEN {text(c)}" for p, c in domain.CATEGORY_RULES)
    return (
        f"CASE WHEN {clean} IS NULL THEN {text(domain.UNKNOWN)} WHEN {clean} IN ({states}) THEN 'normal' "
        f"{rules} ELSE {text(domain.OTHER_FAULT)} END"
    )


def sensors(value: str, k: str, user: str) -> str:
    return ", ".join(f"{t.sensor_formula(i, value, k, user)} AS {s}" for i, s in enumerate(domain.SENSORS))


def number(expr: str) -> str:
    value = f"CASE WHEN regexp_matches({expr}, {text(NUMBER)}) THEN TRY_CAST(trim({expr}) AS DOUBLE) END"
    return f"COALESCE(CASE WHEN isnan({value}) THEN 0e0 ELSE {value} END, 0e0)"


def ratios() -> str:
    out = [
        f"CASE WHEN {x} + 1e-6 = 0 THEN 0e0 ELSE {z} / ({x} + 1e-6) END AS {name}"
        for name, (z, x) in domain.AXIS_RATIOS.items()
    ]
    energy = "{a}_rms_velocity_mm_s * {a}_rms_velocity_mm_s + {a}_rms_acceleration_g * {a}_rms_acceleration_g"
    z, x = energy.format(a="z"), energy.format(a="x")
    out += [f"{z} AS vibration_energy_z", f"{x} AS vibration_energy_x", f"({z}) + ({x}) AS total_vibration_energy"]
    return ", ".join(out)


def title(expr: str) -> str:
    return f"array_to_string(list_transform(string_split({expr}, '_'), lambda w: upper(w[1:1]) || w[2:]), ' ')"


def filled(template: str, **values: str) -> str:
    from string import Formatter

    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(text(literal))
        if name:
            parts.append(f"CAST({values[name]} AS VARCHAR)")
    return "(" + " || ".join(parts) + ")"


def one_decimal(expr: str) -> str:
    return f"printf('%.1f', {expr})"


def thousands(expr: str) -> str:
    return f"format('{{:,}}', CAST({expr} AS BIGINT))"


K = "CAST(json_extract_string(props, '$.k') AS INT)"
TOKEN = r"[^\p{L}]+"
PARTS = ", ".join(
    " + ".join(f"COALESCE(abs(CAST(embedding[{i + 1}] AS DOUBLE)), 0e0)" for i in t.folded_places(c)) for c in range(len(t.CLASSES))
)
MANUAL_ROWS = ", ".join(f"({text(c)}, {text(d)}, {text(n)})" for c, d, n, _ in t.MANUAL_SOURCES)
MAP_ROWS = ", ".join(f"({text(c)}, {text(d)}, {text(n)}, {str(h).lower()})" for c, d, n, h in domain.DOCUMENT_MAP)
REQUIRED = domain.REQUIRED_FIELDS
SHOWN = (
    "rpm", "temperature_c", "temperature_f", "z_rms_velocity_mm_s", "x_rms_velocity_mm_s", "z_peak_acceleration_g",
    "x_peak_acceleration_g", "z_kurtosis", "x_kurtosis", "z_crest_factor", "x_crest_factor",
)
SUMMARIES = (
    filled(domain.SENSOR_SUMMARY, id="vec_id", **{c: c for c in SHOWN})
    + " AS sensor_summary, "
    + filled(domain.HISTORY_SUMMARY, similar_count="similar_count", occurrences=thousands("occ"), avg_rpm="avg_rpm", avg_temp_c="avg_temp_c")
    + " AS history_summary"
)


def search_ctes(prefix: str, items: str, queries: str, n: int, grouped: bool) -> dict[str, tuple[tuple[str, ...], str]]:
    """Search of ``queries(qid, qtext[, g])`` over ``items(iid, txt[, g])``."""
    p = prefix
    same = "WHERE q.g IS NULL OR q.g = i.g" if grouped else ""
    return {
        f"{p}_post": (
            (items,),
            f"SELECT iid, tok AS b, count(*) AS tf FROM (SELECT iid, unnest(list_filter(string_split_regex(lower(txt), {text(TOKEN)}), lambda x: x <> '')) AS tok FROM {items}) GROUP BY ALL",
        ),
        f"{p}_n": ((items,), f"SELECT count(*) AS n FROM {items}"),
        f"{p}_idf": ((f"{p}_post", f"{p}_n"), f"SELECT b, ln((n + 1e0) / (count(*) + 1e0)) AS idf FROM {p}_post, {p}_n GROUP BY b, n"),
        f"{p}_w": ((f"{p}_post", f"{p}_idf"), f"SELECT iid, b, tf * idf AS w FROM {p}_post JOIN {p}_idf USING (b)"),
        f"{p}_norm": ((f"{p}_w",), f"SELECT iid, sqrt(sum(w * w)) AS norm FROM {p}_w GROUP BY iid"),
        f"{p}_qw": (
            (queries, f"{p}_idf", f"{p}_n"),
            f"SELECT qid, b, tf * COALESCE(idf, ln(n + 1e0)) AS w FROM (SELECT qid, tok AS b, count(*) AS tf FROM (SELECT qid, unnest(list_filter(string_split_regex(lower(qtext), {text(TOKEN)}), lambda x: x <> '')) AS tok FROM {queries}) GROUP BY ALL) CROSS JOIN {p}_n LEFT JOIN {p}_idf USING (b)",
        ),
        f"{p}_qnorm": ((f"{p}_qw",), f"SELECT qid, sqrt(sum(w * w)) AS norm FROM {p}_qw GROUP BY qid"),
        f"{p}_dot": ((f"{p}_w", f"{p}_qw"), f"SELECT q.qid, i.iid, sum(q.w * i.w) AS dot FROM {p}_qw q JOIN {p}_w i USING (b) GROUP BY ALL"),
        f"{p}_all": (
            (f"{p}_dot", f"{p}_norm", f"{p}_qnorm", queries, items),
            f"SELECT q.qid, i.iid, round(CASE WHEN d.dot IS NULL OR qn.norm = 0 OR n.norm = 0 THEN 0e0 ELSE d.dot / qn.norm / n.norm END, 9) AS score FROM {queries} q CROSS JOIN {items} i LEFT JOIN {p}_dot d ON d.qid = q.qid AND d.iid = i.iid LEFT JOIN {p}_norm n ON n.iid = i.iid LEFT JOIN {p}_qnorm qn ON qn.qid = q.qid {same}",
        ),
        f"{p}_top": (
            (f"{p}_all",),
            f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, iid) AS rank FROM {p}_all QUALIFY rank <= {n}",
        ),
    }


def chunk_ctes(p: str, needs: tuple[str, ...], source: str, key: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Chunks of the column ``text`` of a table; paragraphs are lines."""
    size, step = domain.CHUNK_SIZE, domain.CHUNK_SIZE - domain.CHUNK_OVERLAP
    over = f"cur + len > {size}"
    return {
        f"{p}paras": (
            needs,
            f"SELECT {key}, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM {source}",
        ),
        f"{p}lens": ((f"{p}paras",), f"SELECT {key}, unnest(list_transform(ps, lambda x: length(x))) AS len, generate_subscripts(ps, 1) AS i FROM {p}paras"),
        f"{p}fold": (
            (f"{p}lens",),
            f"""SELECT {key}, 0 AS i, 1 AS first, 0 AS cnt, CAST(0 AS BIGINT) AS cur, CAST(0 AS BIGINT) AS last, NULL::INT AS e_first, NULL::INT AS e_cnt FROM {source}
            UNION ALL
            SELECT f.{key}, l.i,
              CASE WHEN {over} AND cnt > 1 THEN l.i - 1 WHEN {over} AND cnt > 0 THEN l.i ELSE first END,
              CASE WHEN {over} AND cnt > 1 THEN 2 WHEN {over} AND cnt > 0 THEN 1 ELSE cnt + 1 END,
              CASE WHEN {over} AND cnt > 1 THEN last + len WHEN {over} AND cnt > 0 THEN len ELSE cur + len END,
              len,
              CASE WHEN {over} AND cnt > 0 THEN first END,
              CASE WHEN {over} AND cnt > 0 THEN cnt END
            FROM {p}fold f JOIN {p}lens l ON l.{key} = f.{key} AND l.i = f.i + 1""",
        ),
        f"{p}spans": (
            (f"{p}fold",),
            f"SELECT {key}, e_first AS first, e_cnt AS cnt FROM {p}fold WHERE e_first IS NOT NULL UNION ALL SELECT {key}, first, cnt FROM {p}fold WHERE cnt > 0 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY i DESC) = 1",
        ),
        f"{p}chunks": (
            (f"{p}spans", f"{p}paras"),
            f"""SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY first) - 1 AS INT) AS chunk_index, array_to_string(ps[first : first + cnt - 1], chr(10)) AS text FROM {p}spans JOIN {p}paras USING ({key})
            UNION ALL SELECT {key}, CAST(s // {step} AS INT), substr(text, CAST(s + 1 AS INT), {size}) FROM (SELECT {key}, text, unnest(range(0, length(text), {step})) AS s FROM {p}paras WHERE len(ps) = 0)""",
        ),
        f"{p}counts": ((f"{p}chunks",), f"SELECT {key}, CAST(count(*) AS INT) AS chunks FROM {p}chunks GROUP BY {key}"),
    }


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), f"SELECT event_id, ts, user_id, event_type, value, {K} AS k FROM events"),
    "raw": (
        ("ev",),
        f"SELECT event_id AS id, ts AS created_at, {sensors('value', 'k', 'user_id')}, ({strings(t.RAW_LABELS)})[k % {len(t.RAW_LABELS)} + 1] AS fault FROM ev",
    ),
    "cleaned": (("raw",), f"SELECT *, lower({strip('fault')}) AS clean FROM raw"),
    "categorised": (("cleaned",), f"SELECT * EXCLUDE (clean), {category('clean')} AS fault_category FROM cleaned"),
    "readings": (("categorised",), "SELECT *, fault_category NOT IN ('normal', 'desconhecido') AS is_problem FROM categorised"),
    "daily": (
        ("readings",),
        "SELECT fault_category, CAST(created_at AS DATE) AS date, count(*) AS n, min(created_at) AS first_seen, max(created_at) AS last_seen FROM readings GROUP BY ALL",
    ),
    "lines": (
        (),
        f"SELECT l_orderkey, l_linenumber, l_partkey, {sensors('(l_extendedprice / 1e3)', '(l_linenumber + CAST(l_quantity AS INT))', 'l_suppkey')} FROM lineitem",
    ),
    "linefeatures": (("lines",), f"SELECT *, {ratios()} FROM lines"),
    "payloads": (("ev",), f"SELECT event_id, {t.PAYLOAD.format(text='VARCHAR')} AS payload FROM ev"),
    "parsed": (("payloads",), "SELECT event_id, payload, CASE WHEN json_valid(payload) THEN payload END AS j FROM payloads"),
    # similarity
    "dims": ((), "SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings"),
    "dimstats": (("dims",), "SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1e0 ELSE stddev_pop(x) END AS s FROM dims GROUP BY i"),
    "scaledvec": (("dims", "dimstats"), "SELECT vec_id, list((x - m) / s ORDER BY i) AS v FROM dims JOIN dimstats USING (i) GROUP BY vec_id"),
    "knn": (
        ("scaledvec",),
        f"SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_cosine_similarity(a.v, b.v), 9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS rank FROM scaledvec a CROSS JOIN scaledvec b QUALIFY rank <= {domain.SIMILAR_TOP_K}",
    ),
    "history": (("readings",), "SELECT r.* FROM readings r JOIN embeddings e ON e.vec_id = r.id"),
    "neighbours": (
        ("knn", "history"),
        "SELECT k.*, h.*, round(greatest(0e0, least(100e0, score * 100e0)), 2) AS similarity_score FROM knn k JOIN history h ON h.id = k.item_id",
    ),
    "labelmode": (
        ("neighbours",),
        "SELECT query_id, fault FROM (SELECT query_id, fault, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, fault) AS r FROM neighbours WHERE fault IS NOT NULL GROUP BY query_id, fault) WHERE r = 1",
    ),
    "context": (
        ("neighbours", "labelmode"),
        "SELECT n.query_id, CAST(count(*) AS INT) AS similar_count, round(avg(rpm), 1) AS avg_rpm, round(min(rpm), 1) AS min_rpm, round(max(rpm), 1) AS max_rpm, round(avg(temperature_c), 2) AS avg_temp_c, round(min(temperature_c), 2) AS min_temp_c, round(max(temperature_c), 2) AS max_temp_c, round(avg(z_rms_velocity_mm_s), 3) AS avg_z_rms_velocity, round(avg(x_rms_velocity_mm_s), 3) AS avg_x_rms_velocity, any_value(m.fault) AS primary_historical_fault, arg_min(fault_category, rank) AS match_category FROM neighbours n LEFT JOIN labelmode m USING (query_id) GROUP BY n.query_id",
    ),
    "historytotals": (
        ("readings",),
        "SELECT fault_category AS match_category, count(*) AS total_historical_occurrences, CASE WHEN count(DISTINCT CAST(created_at AS DATE)) > 1 THEN round(count(*) / count(DISTINCT CAST(created_at AS DATE)), 1) ELSE CAST(count(*) AS DOUBLE) END AS events_per_active_day FROM readings GROUP BY 1",
    ),
    # split
    "splitcounts": (
        ("readings",),
        "SELECT fault_category, n, total, total - CAST(ceil(total * 0.2) AS BIGINT) AS train FROM (SELECT fault_category, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM readings GROUP BY 1)",
    ),
    "splitfloors": (("splitcounts",), "SELECT *, (n * train) // total AS fl, (n * train) % total AS rest FROM splitcounts"),
    "splitsizes": (
        ("splitfloors",),
        "SELECT fault_category, n - fl - CASE WHEN row_number() OVER (ORDER BY rest DESC, fault_category) <= train - sum(fl) OVER () THEN 1 ELSE 0 END AS n_test FROM splitfloors",
    ),
    # metrics
    "pairs": ((), "SELECT label, CAST(vec_id % 10 AS INT) AS prediction, count(*) AS n FROM embeddings GROUP BY ALL"),
    "classes": (("pairs",), "SELECT label AS class FROM pairs UNION SELECT prediction FROM pairs"),
    "totals": (
        ("pairs", "classes"),
        "SELECT class, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM pairs WHERE label = class) AS support, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM pairs WHERE prediction = class) AS called, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM pairs WHERE label = class AND prediction = class) AS hit FROM classes",
    ),
    "report": (
        ("totals",),
        "SELECT class, support, hit, CASE WHEN called = 0 THEN 0e0 ELSE hit / called END AS precision, CASE WHEN support = 0 THEN 0e0 ELSE hit / support END AS recall, CASE WHEN called + support = 0 THEN 0e0 ELSE 2 * hit / (called + support) END AS f1 FROM totals",
    ),
    # probabilities
    "shares": ((), f"SELECT vec_id, label, list_transform([{PARTS}], lambda x: x / list_sum([{PARTS}])) AS p FROM embeddings"),
    "scored": (
        ("shares",),
        f"SELECT vec_id, label, p, ({strings(t.CLASSES)})[list_position(p, list_max(p))] AS fault_category, list_max(p) * 100e0 AS confidence FROM shares",
    ),
    "shareparts": (
        ("shares",),
        f"SELECT vec_id, unnest({strings(t.CLASSES)}) AS category, round(unnest(p) * 100e0, 2) AS percent, generate_subscripts(p, 1) AS i FROM shares",
    ),
    # documents
    **chunk_ctes("", (), "documents", "doc_id"),
    **chunk_ctes("u_", ("assembled",), "assembled", "doc_name"),
    "manualmap": ((), f"SELECT * FROM (VALUES {MANUAL_ROWS}) v(fault_category, src, title)"),
    "docmap": ((), f"SELECT * FROM (VALUES {MAP_ROWS}) v(fault_category, doc, title, has_document)"),
    "index": (
        ("chunks", "manualmap"),
        "SELECT 'Doc' || d.doc_id || '.pdf_' || m.fault_category || '_chunk_' || c.chunk_index AS chunk_id, c.text, 'Doc' || d.doc_id || '.pdf' AS source_doc, m.fault_category, m.title, c.chunk_index FROM chunks c JOIN documents d USING (doc_id) JOIN manualmap m ON m.src = d.source",
    ),
    "registry": (
        ("counts", "manualmap"),
        "SELECT m.fault_category, 'Doc' || d.doc_id || '.pdf' AS document_name, m.title, d.text AS text_content, COALESCE(c.chunks, 0) AS chunk_count FROM documents d JOIN manualmap m ON m.src = d.source LEFT JOIN counts c USING (doc_id) QUALIFY row_number() OVER (PARTITION BY m.fault_category ORDER BY d.doc_id DESC) = 1",
    ),
    "pages_in": (
        (),
        f"SELECT 'Doc' || conv_id || '.pdf' AS doc_name, CAST(turn AS INT) AS page_idx, {strip('text')} AS digital, role = 'user' AND length({strip('text')}) > {domain.MIN_DIGITAL_CHARS} AS use_digital, CASE WHEN role <> 'system' AND text <> '' THEN text END AS ocr FROM conversations",
    ),
    "routed": (
        ("pages_in",),
        "SELECT doc_name, page_idx, NOT use_digital AS is_ocr, CASE WHEN use_digital THEN digital ELSE ocr END AS text FROM pages_in WHERE use_digital OR ocr IS NOT NULL",
    ),
    "assembled": (
        ("routed",),
        f"SELECT doc_name, string_agg(CASE WHEN is_ocr THEN {filled(domain.PAGE_HEADER_OCR, number='page_idx + 1')} ELSE {filled(domain.PAGE_HEADER, number='page_idx + 1')} END || text, chr(10) ORDER BY page_idx) AS text FROM routed GROUP BY doc_name",
    ),
    # search
    "items": (("chunks",), "SELECT doc_id || '_' || chunk_index AS iid, c.text AS txt, d.lang AS g FROM chunks c JOIN documents d USING (doc_id)"),
    "asked": ((), "SELECT item_id AS qid, text AS qtext, CAST(NULL AS VARCHAR) AS g FROM benchmark"),
    "asked_lang": ((), f"SELECT item_id AS qid, text AS qtext, ({strings(t.LANGUAGES)})[CAST(item_id % {len(t.LANGUAGES)} + 1 AS INT)] AS g FROM benchmark"),
    "manual_items": (("index",), "SELECT chunk_id AS iid, text AS txt, fault_category AS g FROM index"),
    "manual_asked": (
        ("index",),
        f"SELECT DISTINCT fault_category AS qid, {filled(domain.RETRIEVAL_TEXT, category='fault_category')} AS qtext, fault_category AS g FROM index",
    ),
    **search_ctes("s", "items", "asked", domain.CONTEXT_CHUNKS, False),
    **search_ctes("l", "items", "asked_lang", domain.CONTEXT_CHUNKS, True),
    **search_ctes("m", "manual_items", "manual_asked", domain.CONTEXT_CHUNKS, True),
    "excerpts": (
        ("m_top", "index"),
        "SELECT qid AS fault_category, list(text ORDER BY rank) AS excerpts FROM m_top JOIN index ON chunk_id = iid GROUP BY qid",
    ),
    "status": (
        ("registry", "docmap", "scored"),
        f"SELECT s.vec_id, s.fault_category, s.confidence, (r.fault_category IS NOT NULL) OR COALESCE(m.has_document, false) AS has_document, CASE WHEN r.fault_category IS NOT NULL THEN r.document_name ELSE m.doc END AS document_name, CASE WHEN r.fault_category IS NOT NULL THEN r.title ELSE COALESCE(m.title, {text(domain.NO_DOCUMENT_TITLE)}) END AS title, CASE WHEN r.fault_category IS NOT NULL THEN r.chunk_count ELSE 0 END AS chunk_count FROM scored s LEFT JOIN registry r ON r.fault_category = s.fault_category LEFT JOIN docmap m ON m.fault_category = s.fault_category",
    ),
    "routes": (
        ("status",),
        "SELECT *, CASE WHEN fault_category = 'normal' THEN 'normal' WHEN NOT has_document THEN 'undocumented' ELSE 'documented' END AS route FROM status",
    ),
    "prescribed": (
        ("routes", "excerpts", "context", "historytotals", "readings"),
        "SELECT r.*, COALESCE(x.excerpts, []) AS excerpts, c.similar_count, c.avg_rpm, c.avg_temp_c, h.total_historical_occurrences AS occ, "
        + ", ".join(f"round({c}, 3) AS {c}" for c in SHOWN)
        + " FROM routes r JOIN context c ON c.query_id = r.vec_id JOIN historytotals h USING (match_category) JOIN readings s ON s.id = r.vec_id LEFT JOIN excerpts x ON x.fault_category = r.fault_category",
    ),
    "summaries": (
        ("prescribed",),
        f"SELECT *, {SUMMARIES} FROM prescribed",
    ),
    "streamed": (
        ("readings", "registry", "docmap", "excerpts"),
        "SELECT s.id AS vec_id, s.fault_category, 90e0 AS confidence, (r.fault_category IS NOT NULL) OR COALESCE(m.has_document, false) AS has_document, "
        f"CASE WHEN r.fault_category IS NOT NULL THEN r.title ELSE COALESCE(m.title, {text(domain.NO_DOCUMENT_TITLE)}) END AS title, "
        "CASE WHEN s.fault_category = 'normal' THEN 'normal' WHEN NOT ((r.fault_category IS NOT NULL) OR COALESCE(m.has_document, false)) THEN 'undocumented' ELSE 'documented' END AS route, "
        "COALESCE(r.document_name, m.doc) AS document_name, COALESCE(x.excerpts, []) AS excerpts, 0 AS similar_count, 0e0 AS avg_rpm, 0e0 AS avg_temp_c, 0 AS occ, "
        + ", ".join(f"round(s.{c}, 3) AS {c}" for c in SHOWN)
        + " FROM readings s LEFT JOIN registry r ON r.fault_category = s.fault_category LEFT JOIN docmap m ON m.fault_category = s.fault_category LEFT JOIN excerpts x ON x.fault_category = s.fault_category",
    ),
    "streamsummaries": (("streamed",), f"SELECT *, {SUMMARIES} FROM streamed"),
    # readings whose label follows from the value
    "graded": (
        ("ev",),
        f"SELECT *, {ratios()} FROM (SELECT * EXCLUDE (clean), {category('clean')} AS fault_category FROM (SELECT *, lower({strip('fault')}) AS clean FROM "
        f"(SELECT event_id AS id, ts AS created_at, {sensors('value', 'k', 'user_id')}, {t.GRADE} AS fault FROM ev)) WHERE fault IS NOT NULL)",
    ),
    "gradedcounts": (
        ("graded",),
        "SELECT *, n * train // total AS fl, n * train % total AS rest FROM (SELECT fault_category, n, total, total - CAST(ceil(total * 0.2) AS BIGINT) AS train FROM (SELECT fault_category, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM graded GROUP BY 1))",
    ),
    "gradedsizes": (
        ("gradedcounts",),
        "SELECT fault_category, n, n - fl - CASE WHEN row_number() OVER (ORDER BY rest DESC, fault_category) <= train - sum(fl) OVER () THEN 1 ELSE 0 END AS n_test FROM gradedcounts",
    ),
    "gradedsplit": (
        ("graded", "gradedsizes"),
        f"SELECT g.*, row_number() OVER (PARTITION BY fault_category ORDER BY md5(id || '|{domain.SPLIT_SEED}')) <= n_test AS is_test FROM graded g JOIN gradedsizes USING (fault_category)",
    ),
    "gradeddims": (
        ("gradedsplit",),
        f"SELECT id, is_test, unnest([{', '.join(domain.FEATURES)}]) AS x, unnest(range({len(domain.FEATURES)})) AS i FROM gradedsplit",
    ),
    "gradedstats": (("gradeddims",), "SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1e0 ELSE stddev_pop(x) END AS s FROM gradeddims WHERE NOT is_test GROUP BY i"),
    "gradedvec": (("gradeddims", "gradedstats"), "SELECT id, is_test, list((x - m) / s ORDER BY i) AS v FROM gradeddims JOIN gradedstats USING (i) GROUP BY id, is_test"),
    "gradedknn": (
        ("gradedvec",),
        f"SELECT a.id AS query_id, b.id AS item_id, round(list_cosine_similarity(a.v, b.v), 9) AS score, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.id) AS rank FROM gradedvec a JOIN gradedvec b ON a.is_test AND NOT b.is_test QUALIFY rank <= {domain.SIMILAR_TOP_K}",
    ),
    "gradedmet": (("gradedknn", "gradedsplit"), "SELECT k.*, h.* FROM gradedknn k JOIN gradedsplit h ON h.id = k.item_id"),
    "gradedmode": (
        ("gradedmet",),
        "SELECT query_id, fault FROM (SELECT query_id, fault, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, fault) AS r FROM gradedmet GROUP BY query_id, fault) WHERE r = 1",
    ),
    "gradedcontext": (
        ("gradedmet", "gradedmode"),
        "SELECT n.query_id, CAST(count(*) AS INT) AS similar_count, round(avg(rpm), 1) AS avg_rpm, any_value(m.fault) AS primary_historical_fault, arg_min(item_id, rank) AS best_match, round(greatest(0e0, least(100e0, max(score) * 100e0)), 2) AS best_score, arg_min(fault_category, rank) AS match_category FROM gradedmet n JOIN gradedmode m USING (query_id) GROUP BY n.query_id",
    ),
    "gradedanswers": (
        ("gradedsplit", "gradedcontext", "gradedsizes", "registry", "docmap", "excerpts"),
        "SELECT s.id AS event_id, s.fault_category, CASE WHEN s.fault_category = 'normal' THEN 'normal' WHEN r.fault_category IS NOT NULL OR COALESCE(m.has_document, false) THEN 'documented' ELSE 'undocumented' END AS route, "
        "COALESCE(len(x.excerpts), 0) AS excerpts, c.*, z.n - z.n_test AS occurrences FROM gradedsplit s JOIN gradedcontext c ON c.query_id = s.id JOIN gradedsizes z ON z.fault_category = c.match_category "
        "LEFT JOIN registry r ON r.fault_category = s.fault_category LEFT JOIN docmap m ON m.fault_category = s.fault_category LEFT JOIN excerpts x ON x.fault_category = s.fault_category WHERE s.is_test",
    ),
    # chat
    "lastmessages": (
        (),
        f"SELECT conv_id AS session_id, turn, role, text AS message, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS size FROM conversations QUALIFY back <= {domain.CHAT_WINDOW}",
    ),
    "window6": (
        ("lastmessages",),
        "SELECT session_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'model' END AS role, message FROM lastmessages WHERE size > 1 AND back > 1",
    ),
}


def build(body: str, *names: str) -> str:
    """``body`` behind the named expressions and all they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in CTES[name][0]:
            add(needed)
        ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{'idx' if n == 'index' else n} AS MATERIALIZED ({CTES[n][1]})" if not n.endswith("fold") else f"{n} AS ({CTES[n][1]})" for n in ordered]
    sql = "WITH RECURSIVE " + ", ".join(parts) + " " + body if parts else body
    return sql.replace("FROM index", "FROM idx").replace("JOIN index", "JOIN idx")


def _errors() -> str:
    def value(c: str) -> str:
        return f"json_extract_string(j, '$.{c}')"

    def ok(c: str) -> str:
        return f"COALESCE(regexp_matches({value(c)}, {text(NUMBER_OR_NAN)}), false)"

    checks = [f"CASE WHEN NOT {ok(c)} THEN {text(c)} END" for c in REQUIRED]
    checks += [
        f"CASE WHEN json_extract_string(j, '$.{c}') IS NOT NULL AND NOT {ok(c)} THEN {text(c)} END"
        for c in domain.PAYLOAD_DEFAULTS
    ]
    return f"CASE WHEN j IS NULL THEN 'json' ELSE array_to_string(list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL), ',') END"


def _json_fields(mode: str) -> str:
    columns = []
    for c in ("rpm", "temperature_c", "temperature_f", "z_peak_velocity_mm_s", "z_kurtosis"):
        value = number(f"json_extract_string(j, '$.{c}')")
        if mode == "api" and c in domain.PAYLOAD_DEFAULTS:
            value = f"CASE WHEN NOT list_contains(json_keys(j), '{c}') THEN {domain.PAYLOAD_DEFAULTS[c]:e} ELSE {value} END"
        columns.append(f"{value} AS {c}")
    return f"SELECT event_id, CAST(json_extract_string(j, '$.id') AS BIGINT) AS id, {', '.join(columns)}, '{mode}' AS mode FROM checked WHERE errors = ''"


def _rounded(columns, digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _scaler() -> str:
    parts = [
        f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, round(CASE WHEN stddev_pop({c}) = 0 THEN 1e0 ELSE stddev_pop({c}) END, 4) AS scale FROM linefeatures"
        for c in domain.FEATURES
    ]
    return " UNION ALL ".join(parts)


def _standardised() -> str:
    shown = ("rpm", "temperature_c", *domain.ENGINEERED)
    stats = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1e0 ELSE stddev_pop({c}) END AS s_{c}" for c in shown)
    scaled = ", ".join(f"round(({c} - m_{c}) / s_{c}, 4) + 0e0 AS {c}" for c in shown)
    return f"SELECT l_orderkey, l_linenumber, l_partkey, {scaled} FROM linefeatures CROSS JOIN (SELECT {stats} FROM linefeatures)"


def _prescription(source: str = "summaries") -> str:
    values = dict(
        category_title=title("fault_category"), category="fault_category", confidence=one_decimal("confidence"),
        title="title", sensor_summary="sensor_summary", history_summary="history_summary",
    )
    head = " || chr(10) || chr(10) || ".join(filled(p, **values) for p in domain.SYNTHESIS_HEAD)
    shown = strip(f"replace(x, {text(domain.PAGE_MARK)}, {text(domain.PAGE_MARK_SHOWN)})")
    body = f"list_transform(excerpts, lambda x, i: {filled(domain.SYNTHESIS_EXCERPT, number='i', text=shown)})"
    tail = strings(domain.SYNTHESIS_TAIL)
    synthesis = f"{head} || chr(10) || chr(10) || array_to_string(list_concat({body}, {tail}), chr(10) || chr(10))"
    missing = filled(
        domain.MISSING_TEXT, category_title=title("fault_category"), category="fault_category",
        confidence=one_decimal("confidence"), occurrences=thousands("occ"),
    )
    context = _context()
    prompt = filled(
        domain.PROMPT_TEXT, category_upper="replace(upper(fault_category), '_', ' ')", confidence=one_decimal("confidence"),
        title="title", sensor_summary="sensor_summary", history_summary="history_summary", context=context,
    )
    return f"""SELECT vec_id AS event_id, fault_category, route, route = 'documented' AS has_document, route = 'normal' AS is_operational_normal,
      CASE route WHEN 'normal' THEN {text(domain.NORMAL_TEXT)} WHEN 'undocumented' THEN {missing} ELSE {synthesis} END AS prescription,
      CASE WHEN route = 'documented' THEN document_name ELSE '' END AS referenced_docs,
      CASE WHEN route = 'documented' THEN CAST(len(excerpts) AS INT) ELSE 0 END AS chunks_used,
      CASE WHEN route = 'documented' THEN {prompt} ELSE '' END AS prompt FROM {source}"""


def _context() -> str:
    each = filled(domain.CONTEXT_EXCERPT, number="i", text="x")
    return f"array_to_string(list_transform(excerpts, lambda x, i: {each}), chr(10) || chr(10))"


HITS = "SELECT qid AS query_id, CAST(rank AS INT) AS rank, iid AS chunk_id, round(score, 3) AS score FROM {p}_top"


def statements() -> dict[str, str]:
    distribution = "SELECT fault_category, count(*) AS count, bool_or(is_problem) AS is_problem FROM readings GROUP BY 1"
    timeline = "SELECT strftime(created_at, '%Y-%m-%d') AS date, fault_category, count(*) AS occurrences FROM readings WHERE is_problem GROUP BY ALL"
    return {
        "label_category_map": build(
            "SELECT fault, fault_category, is_problem, fault_category = 'normal' AS is_operational, count(*) AS n FROM readings GROUP BY ALL", "readings"
        ),
        "category_distribution": build(distribution, "readings"),
        "category_value_counts": build("SELECT fault_category, count(*) AS count FROM readings GROUP BY 1", "readings"),
        "problem_ranking": build(f"SELECT * FROM ({distribution}) WHERE is_problem", "readings"),
        "kpi_summary": build(
            "SELECT total_events, total_problems, round(CASE WHEN total_events > 0 THEN (total_events - total_problems) / (total_events + 1e-6) * 100 ELSE 100e0 END, 4) AS normal_ratio, total_docs, total_prescriptions FROM (SELECT count(*) AS total_events, count(*) FILTER (is_problem) AS total_problems, (SELECT count(*) FROM registry) AS total_docs, (SELECT count(*) FROM conversations WHERE role = 'assistant') AS total_prescriptions FROM readings)",
            "readings", "registry",
        ),
        "daily_fault_timeline": build(timeline, "readings"),
        "category_recurrence": build(
            "SELECT fault_category, CAST(sum(n) AS BIGINT) AS total_occurrences, count(date) AS active_days, CASE WHEN count(date) > 1 THEN round(sum(n) / count(date), 1) ELSE CAST(sum(n) AS DOUBLE) END AS events_per_active_day, strftime(min(first_seen), '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(max(last_seen), '%Y-%m-%d %H:%M:%S.%f') AS last_seen FROM daily GROUP BY 1",
            "daily",
        ),
        "category_date_histogram": build("SELECT fault_category, strftime(date, '%Y-%m-%d') AS date, n AS occurrences FROM daily", "daily"),
        "numeric_coercion": build(
            f"SELECT event_id, number, CASE WHEN isinf(number) THEN 0e0 ELSE number END AS finite FROM (SELECT event_id, {number('raw')} AS number FROM (SELECT event_id, {t.TEXT_NUMBER.format(text='VARCHAR')} AS raw FROM ev))", "ev"
        ),
        "ratio_energy_features": build(f"SELECT l_orderkey, l_linenumber, l_partkey, {_rounded(domain.ENGINEERED, 6)} FROM linefeatures", "linefeatures"),
        "scaler_stats": build(_scaler(), "linefeatures"),
        "standardized_features": build(_standardised(), "linefeatures"),
        "stored_readings": build(
            f"SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') || '+00:00' AS created_at, fault, fault_category, CAST(is_problem AS INT) AS is_problem, round(total_vibration_energy, 4) AS total_vibration_energy FROM (SELECT *, {ratios()} FROM readings)", "readings"
        ),
        "time_sorted_readings": build("SELECT id, strftime(created_at, '%Y-%m-%d') AS day, fault_category FROM readings", "readings"),
        "display_formats": build(
            f"SELECT fault_category AS category, {title('fault_category')} AS title, replace(upper(fault_category), '_', ' ') AS upper, {thousands('count(*) * 1000')} AS shown FROM readings GROUP BY fault_category", "readings"
        ),
        "event_validation": build(f"SELECT event_id, errors = '' AS is_valid, errors FROM (SELECT event_id, {_errors()} AS errors FROM parsed)", "parsed"),
        "event_json_fields": build(
            f"SELECT * FROM (WITH checked AS (SELECT *, {_errors()} AS errors FROM parsed) {_json_fields('api')} UNION ALL {_json_fields('zero')})", "parsed"
        ),
        "similarity_topk": build("SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM knn", "knn"),
        "similarity_topk_cells": build("SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM knn", "knn"),
        "similarity_index_topk": build("SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM knn", "knn"),
        "vector_search_by_label": f"SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS INT) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label QUALIFY rank <= {domain.CONTEXT_CHUNKS}",
        "similarity_context": build("SELECT * FROM context", "context"),
        "similarity_matches": build(
            f"SELECT query_id, CAST(rank AS INT) AS rank, item_id AS id, similarity_score, fault AS original_label, round(rpm, 4) AS rpm FROM neighbours WHERE rank <= {domain.SHOWN_MATCHES}", "neighbours"
        ),
        "similarity_category_total": build(
            "SELECT query_id, match_category, total_historical_occurrences, events_per_active_day FROM context JOIN historytotals USING (match_category)", "context", "historytotals"
        ),
        "stratified_split": build(
            f"SELECT id, fault_category, row_number() OVER (PARTITION BY fault_category ORDER BY md5(id || '|{domain.SPLIT_SEED}')) <= n_test AS is_test FROM readings JOIN splitsizes USING (fault_category)", "readings", "splitsizes"
        ),
        "csv_scan": build(
            f"SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, rpm, CASE WHEN fault NOT IN ({', '.join(text(x) for x in domain.MISSING_TOKENS)}) THEN fault END AS fault FROM readings", "readings"
        ),
        "csv_quarantine": build(
            "SELECT CASE WHEN k % 17 = 3 THEN 'x' ELSE '' END || event_id AS given_id, CASE WHEN errors = '' THEN 'accepted' ELSE 'refused' END AS status, errors, CASE WHEN NOT short THEN 'polia' END AS fault FROM ("
            "SELECT *, CASE WHEN short OR long THEN 'columns' ELSE array_to_string(list_filter([CASE WHEN k % 17 = 3 THEN 'id' END, CASE WHEN k % 13 = 5 THEN 'created_at' END], lambda x: x IS NOT NULL), ',') END AS errors "
            "FROM (SELECT *, k % 23 = 6 AS short, k % 19 = 4 AS long FROM ev))", "ev"
        ),
        "processed_cache": build("SELECT id, fault_category, strftime(created_at, '%Y-%m-%d') AS day, true AS in_its_day FROM readings", "readings"),
        "cached_readings": build(
            "SELECT id, fault_category, fault_category NOT IN ('normal', 'desconhecido') AS is_problem, created_at FROM "
            f"(SELECT id, {category('clean')} AS fault_category, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM "
            f"(SELECT id, created_at, lower({strip('fault')}) AS clean FROM (SELECT id, created_at, CASE WHEN fault NOT IN ({', '.join(text(x) for x in domain.MISSING_TOKENS)}) THEN fault END AS fault FROM raw)))",
            "raw",
        ),
        "stored_texts": "SELECT 'Doc' || doc_id AS stem, CAST(length(text) AS INT) AS length, md5(text) AS digest FROM documents",
        "page_source": build(
            "SELECT 'Doc' || conv_id || '.pdf' AS doc_name, CAST(turn AS INT) AS page_idx, CAST(length(CASE WHEN role = 'user' THEN text END) AS INT) AS digital, CAST(length(CASE WHEN role <> 'system' THEN text END) AS INT) AS ocr FROM conversations"
        ),
        "event_json_text": "SELECT event_id, '{\"event_id\":' || event_id || ',\"event_type\":' || to_json(event_type) || ',\"fault\":null}' AS payload FROM events",
        "window_chunks": (
            f"SELECT doc_id, CAST(n AS INT) AS chunks, CAST(CASE WHEN n > 0 THEN least({domain.CHUNK_SIZE}, size) END AS INT) AS first, "
            f"CAST(CASE WHEN n > 0 THEN size - (n - 1) * {domain.CHUNK_SIZE - domain.CHUNK_OVERLAP} END AS INT) AS last "
            f"FROM (SELECT doc_id, length(text) AS size, (length(text) + {domain.CHUNK_SIZE - domain.CHUNK_OVERLAP} - 1) // {domain.CHUNK_SIZE - domain.CHUNK_OVERLAP} AS n FROM documents)"
        ),
        "forest_train_score": (
            "WITH v AS (SELECT vec_id AS id, 'class_' || label AS fault_category FROM embeddings), "
            "k AS (SELECT fault_category, count(*) AS n FROM v GROUP BY 1), "
            f"s AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total, CAST(sum(n) OVER () - ceil(sum(n) OVER () * {domain.TEST_FRACTION}e0) AS BIGINT) AS train FROM k), "
            "f AS (SELECT *, n * train // total AS fl, n * train % total AS rest FROM s), "
            "z AS (SELECT fault_category, n - fl - CASE WHEN row_number() OVER (ORDER BY rest DESC, fault_category) <= train - sum(fl) OVER () THEN 1 ELSE 0 END AS n_test FROM f) "
            "SELECT id, fault_category, true AS class_known, true AS confidence_in_range, true AS sums_to_100 FROM v JOIN z USING (fault_category) "
            f"QUALIFY row_number() OVER (PARTITION BY fault_category ORDER BY md5(id || '|{domain.SPLIT_SEED}')) <= n_test"
        ),
        "class_weights": build(
            "SELECT fault_category, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM readings GROUP BY 1", "readings"
        ),
        "confusion_matrix": build(
            "SELECT a.class AS label, b.class AS prediction, COALESCE(n, 0) AS n FROM classes a CROSS JOIN classes b LEFT JOIN pairs p ON p.label = a.class AND p.prediction = b.class", "classes", "pairs"
        ),
        "label_confusion": "WITH c AS (SELECT quality AS x FROM labels UNION SELECT toxic FROM labels), p AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL) SELECT a.x AS label, b.x AS prediction, COALESCE(n, 0) AS n FROM c a CROSS JOIN c b LEFT JOIN p ON quality = a.x AND toxic = b.x",
        "class_report": build(f"SELECT class, {_rounded(('precision', 'recall', 'f1'), 6)}, support FROM report", "report"),
        "metric_summary": build(
            "SELECT round(sum(hit) / sum(support), 6) AS accuracy, "
            + ", ".join(f"round(avg({m}), 6) AS {m}_macro, round(sum({m} * support) / sum(support), 6) AS {m}_weighted" for m in ("precision", "recall", "f1"))
            + ", CAST(sum(support) AS BIGINT) AS support FROM report",
            "report",
        ),
        "argmax_confidence": build("SELECT vec_id, fault_category, round(confidence, 6) AS confidence FROM scored", "scored"),
        "top_probabilities": build(
            f"SELECT vec_id, CAST(r - 1 AS INT) AS position, category, percent FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY percent DESC, i) AS r FROM shareparts) WHERE r <= {domain.SHOWN_PROBABILITIES}", "shareparts"
        ),
        "probability_map": build("SELECT vec_id, category, percent FROM shareparts", "shareparts"),
        "page_routing": build("SELECT * FROM routed", "routed"),
        "document_assembly": build("SELECT * FROM assembled", "assembled"),
        "document_chunks": build("SELECT doc_id, chunk_index, text FROM chunks", "chunks"),
        "document_summary": build(
            "SELECT 'Doc' || d.doc_id || '.pdf' AS doc_name, COALESCE(m.categories, '') AS categories, COALESCE(c.chunks, 0) AS chunks, CAST(length(d.text) AS INT) AS text_length FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN (SELECT src, string_agg(fault_category, ',' ORDER BY fault_category) AS categories FROM manualmap GROUP BY src) m ON m.src = d.source",
            "counts", "manualmap",
        ),
        "chunk_index": build("SELECT * FROM index", "index"),
        "document_registry": build("SELECT * FROM registry", "registry"),
        "chunk_upsert": build("SELECT chunk_id, CASE WHEN chunk_index % 2 = 0 THEN lower(text) ELSE text END AS text FROM index", "index"),
        "chunk_upsert_stored": build("SELECT chunk_id, CASE WHEN chunk_index % 2 = 0 THEN lower(text) ELSE text END AS text FROM index", "index"),
        "document_ingest": build(
            "SELECT 'success' AS status, a.doc_name AS filename, 'outro_defeito' AS fault_category, COALESCE(c.chunks, 0) AS chunks_indexed FROM (SELECT DISTINCT doc_name FROM pages_in) a LEFT JOIN u_counts c USING (doc_name)", "pages_in", "u_counts"
        ),
        "stream_prescriptions": build(
            f"SELECT event_id, fault_category, has_document, CAST(length(prescription) AS INT) AS text_length, CAST(length(payload) AS INT) AS raw_length FROM ({_prescription('streamsummaries')}) JOIN payloads USING (event_id)", "streamsummaries", "payloads"
        ),
        "latest_upsert": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "chunk_search": build(HITS.format(p="s"), "s_top"),
        "chunk_search_by_language": build(HITS.format(p="l"), "l_top"),
        "document_availability": build("SELECT vec_id, fault_category, has_document, document_name, title, chunk_count FROM status", "status"),
        "guardrail_route": build("SELECT vec_id, route FROM routes", "routes"),
        "prescription_text": build(_prescription(), "summaries"),
        "category_excerpts": build(f"SELECT fault_category, {_context()} AS context FROM excerpts", "excerpts"),
        "chat_context_window": build("SELECT * FROM window6", "window6"),
        "chat_prompts": build(
            f"SELECT l.session_id, CASE WHEN l.session_id % 2 = 0 THEN {filled(domain.CHAT_CONTEXT, fault_category=text('polia'), confidence=text('95.5'))} ELSE '' END || l.message AS prompt, CAST(COALESCE(len(w.roles), 0) AS INT) AS turns, COALESCE(array_to_string(w.roles, ','), '') AS roles FROM lastmessages l LEFT JOIN (SELECT session_id, list(role ORDER BY turn) AS roles FROM window6 GROUP BY 1) w USING (session_id) WHERE l.back = 1",
            "lastmessages", "window6",
        ),
        "chat_log_rows": "SELECT conv_id AS session_id, 'user' AS role, text AS message FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, 'assistant', 'Re: ' || text FROM conversations WHERE role = 'user'",
        "model_evaluation": build(
            "SELECT 1e0 AS accuracy, 1e0 AS precision_macro, 1e0 AS recall_macro, 1e0 AS f1_macro, 1e0 AS f1_weighted, (SELECT CAST(sum(n_test) AS BIGINT) FROM gradedsizes) AS test_samples, "
            "(SELECT CAST(sum(n) AS BIGINT) FROM gradedsizes) AS total_samples, (SELECT string_agg(fault_category, ',' ORDER BY fault_category) FROM gradedsizes) AS classes, "
            "(SELECT string_agg(a.fault_category || ':' || b.fault_category || ':' || CASE WHEN a.fault_category = b.fault_category THEN a.n_test ELSE 0 END, ',' ORDER BY a.fault_category, b.fault_category) FROM gradedsizes a CROSS JOIN gradedsizes b) AS confusion_matrix, 10::INT AS top_features",
            "gradedsizes",
        ),
        "event_prescriptions": build(
            "SELECT event_id, fault_category, route, route = 'documented' AS has_document, CAST(CASE WHEN route = 'documented' THEN excerpts ELSE 0 END AS INT) AS chunks_used, similar_count, best_match, best_score, occurrences AS total_historical_occurrences, avg_rpm, primary_historical_fault FROM gradedanswers", "gradedanswers"
        ),
        "stream_scored_prescriptions": build(
            "SELECT event_id, fault_category, route = 'documented' AS has_document, similar_count, true AS has_event FROM gradedanswers", "gradedanswers"
        ),
        "stream_deduplicated_log": build("SELECT vec_id AS event_id, fault_category, route = 'documented' AS has_document FROM streamed", "streamed"),
        "stream_daily_counts": build(timeline, "readings"),
        "stream_validated_events": build(
            f"SELECT payload, CASE WHEN errors = '' THEN 'accepted' ELSE 'refused' END AS status FROM (SELECT payload, {_errors()} AS errors FROM parsed)", "parsed"
        ),
    }
