"""SQL that the reference's operators are compared with, over the same tables."""

# Nodes, edges and chunks as the testbed makes them.
_N = """tp AS (SELECT id, any_value(topic_type) AS topic_type, any_value(title) AS title, any_value(shortdesc) AS shortdesc, any_value(body) AS body,
            any_value(coalesce(audience, [])) AS audience, any_value(coalesce(product, [])) AS product, any_value(coalesce(topic_keys, [])) AS keys,
            any_value(coalesce(uicontrols, [])) AS uic, any_value(coalesce(cmd_uicontrols, [])) AS cmd FROM topics GROUP BY id),
        n AS (SELECT id, title, shortdesc, CASE topic_type WHEN 'concept' THEN 'Concept' WHEN 'task' THEN 'Task' WHEN 'reference' THEN 'Reference'
                WHEN 'glossentry' THEN 'Glossary Entry' WHEN 'topic' THEN 'Topic' END AS okf_type, 1 AS ord FROM tp
            UNION ALL SELECT id, any_value(title), NULL, 'DITA Map', 0 FROM maps GROUP BY id),
        ti AS (SELECT id, arg_max(title, ord) AS title FROM n GROUP BY id)"""
_E = """e AS (SELECT DISTINCT edge_id AS ord, from_id AS src, split_part(to_id, '#', 1) AS dst, relation FROM graph_edges WHERE trim(to_id, ' ') <> '')"""
_C = "c AS (SELECT id, any_value(title) AS title, any_value(text) AS text FROM chunks GROUP BY id)"
_CUT = "CASE WHEN length(replace({0}, chr(10), ' ')) > {1} THEN left(replace({0}, chr(10), ' '), {1}) || '…' ELSE replace({0}, chr(10), ' ') END"
_REACH = f"""{_E}, w(id, lvl) AS (SELECT min(id), 0 FROM maps UNION SELECT e.dst, w.lvl + 1 FROM w JOIN e ON e.src = w.id WHERE w.lvl < 3)"""


def _content(words: list[str], scope: str = "") -> str:
    score = " + ".join(
        f"(CASE WHEN contains(lower(coalesce(title, '')), '{w}') THEN 5 ELSE 0 END)"
        f" + ((length(x) - length(replace(x, '{w}', ''))) // {len(w)})"
        for w in words
    )
    return f"""s AS (SELECT id, title, text, {score} AS score FROM (SELECT *, lower(coalesce(text, '')) AS x FROM c {scope}))
        SELECT row_number() OVER (ORDER BY score DESC, id)::INT AS rank, id, title, score::BIGINT AS score,
            {_CUT.format("coalesce(text, '')", 200)} AS excerpt, count(*) OVER () AS n_matches
        FROM s WHERE score > 0 QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 15"""


_LINKS = """l AS (SELECT id AS src, split_part(l.target_id, '#', 1) AS dst, l.relation AS relation, (i - 1)::INT AS ord
            FROM (SELECT id, i, links[i] AS l FROM (SELECT id, links, unnest(range(1, len(links) + 1)) AS i FROM topics)) WHERE trim(split_part(l.target_id, '#', 1), ' ') <> '')"""
_LINES = """x AS (SELECT doc_id AS doc, i - 1 AS pos, a[i] AS line FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i
            FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))),
        o AS (SELECT line, min(doc) AS owner FROM x WHERE length(line) > 20 GROUP BY line HAVING count(DISTINCT doc) > 1)"""
_APPLY = """ref AS (SELECT DISTINCT id, t FROM (SELECT id, unnest(uic) AS t FROM tp WHERE topic_type = 'reference')),
        own AS (SELECT t, count(*) AS n, min(id) AS ref, min(id) || CASE WHEN count(*) > 2 THEN ', ..., ' ELSE ', ' END || max(id) AS candidates FROM ref GROUP BY t),
        cmd AS (SELECT DISTINCT id, t FROM (SELECT id, unnest(cmd) AS t FROM tp WHERE topic_type = 'task'))"""
_PAIRS = "pr AS (SELECT DISTINCT least(src, dst) AS lo, greatest(src, dst) AS hi FROM e)"
_PRODUCT = "p AS (SELECT DISTINCT id, x FROM (SELECT id, unnest(product) AS x FROM tp) WHERE x IS NOT NULL)"
_CLASSES = """ps AS (SELECT id, list_sort(list(x)) AS v FROM p GROUP BY id),
        cl AS (SELECT id, min(id) OVER (PARTITION BY v) AS class, count(*) OVER (PARTITION BY v) AS n FROM ps),
        cx AS (SELECT class, n, x FROM cl JOIN p USING (id) WHERE id = class),
        ln AS (SELECT DISTINCT f.class AS a, g.class AS b FROM cx f JOIN cx g USING (x) WHERE f.class < g.class OR f.class = g.class AND f.n > 1),
        ex AS (SELECT DISTINCT lo, hi FROM pr JOIN p f ON f.id = lo JOIN p g ON g.id = hi AND g.x = f.x WHERE lo <> hi)"""

# Ids as they are claimed one by one: the first of its own id, that with the path behind it, and numbers behind that, which is free.
_CLAIM = """q AS (SELECT *, row_number() OVER (ORDER BY ord) AS i, b || '--' || replace(path, '/', '-') AS long FROM s),
        w(i, id, taken) AS (SELECT 0::BIGINT, NULL::VARCHAR, []::VARCHAR[]
            UNION ALL SELECT i, id, list_append(taken, id) FROM (SELECT q.i, w.taken,
                list_filter([b, long] || list_transform(range(2, 9), lambda k: long || '-' || k), lambda x: NOT list_contains(w.taken, x))[1] AS id
                FROM w JOIN q ON q.i = w.i + 1))
        SELECT w.id, path, ord AS topic_id FROM w JOIN q USING (i)"""
_FILES = "t AS (SELECT DISTINCT id, source_file FROM topics), f AS (SELECT id AS ord, source_file AS path, regexp_replace(regexp_extract(source_file, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS b FROM t)"

_COLLAPSE = r"trim(regexp_replace({0}, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')"
_TRIM = r"regexp_replace(regexp_replace({0}, '^[ \t\n\r\f\v]+', ''), '[ \t\n\r\f\v]+$', '')"
_PLANT = """CASE doc_id % 5 WHEN 0 THEN 'AK' || 'IA' || lpad(upper(hex(doc_id)), 16, '0') WHEN 1 THEN '-----BEGIN ' || 'EC PRIVATE KEY-----'
            WHEN 2 THEN 'gh' || 'o_' || lpad(doc_id::VARCHAR, 36, 'x') WHEN 3 THEN 'xo' || 'xp-' || lpad(doc_id::VARCHAR, 12, '0') ELSE 'akia' END"""
_SUGGEST = """m AS (SELECT asked FROM a WHERE asked NOT IN (SELECT id FROM k)), s AS (SELECT DISTINCT id, string_split(id, '--') AS q FROM k),
        u AS (SELECT id, array_to_string(q[i:], '--') AS tail FROM (SELECT id, q, unnest(range(2, len(q) + 1)) AS i FROM s))
        SELECT asked, min(id) AS suggestion FROM m JOIN u ON u.tail = asked GROUP BY asked HAVING count(*) = 1"""


def _secrets(of: str, text: str) -> str:
    return f"""SELECT DISTINCT doc_id AS file, k AS pattern FROM {of}, (VALUES ('aws-access-key-id', '(?:AKIA|ASIA)[0-9A-Z]{{16}}'),
            ('pem-private-key', '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----'), ('github-token', 'gh[pousr]_[A-Za-z0-9]{{36}}'),
            ('slack-token', 'xox[abprs]-[A-Za-z0-9-]{{10}}')) v(k, r) WHERE regexp_matches({text}, r)"""


ORACLE = {
    "search_topics": f"""WITH {_N} SELECT id, title, okf_type, title || ' (' || okf_type || ') [' || id || ']' AS line FROM n
        WHERE contains(lower(id), 'ledger') OR contains(lower(title), 'ledger')""",
    "search_content": f"WITH {_C}, {_content(['tenant', 'palette', 'tenant'])}",
    "search_content_scoped": f"WITH RECURSIVE {_REACH}, {_C}, {_content(['snapshot'], 'WHERE id IN (SELECT id FROM w)')}",
    "find_related": f"""WITH {_N}, {_E} SELECT src, ord AS edge_ord, relation, dst, coalesce(ti.title, dst) AS title
        FROM e LEFT JOIN ti ON ti.id = dst WHERE src IN (SELECT id FROM maps)""",
    "forward_reachable": f"WITH RECURSIVE {_REACH} SELECT DISTINCT id FROM w",
    "trace_dependencies": f"""WITH RECURSIVE {_E}, r AS (SELECT * FROM e WHERE relation = 'requires'),
        w(lvl, id, via, path) AS (SELECT 0, min(src), NULL::VARCHAR, []::BIGINT[] FROM r
            UNION ALL SELECT w.lvl + 1, r.dst, r.src, list_append(w.path, r.ord) FROM w JOIN r ON r.src = w.id WHERE w.lvl < 3)
        SELECT lvl AS level, via AS from_id, id AS to_id FROM
            (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl, path) = 1) WHERE lvl > 0""",
    "reachable_of_maps": f"""WITH RECURSIVE {_E}, w(map_id, id, lvl) AS (SELECT DISTINCT id, id, 0 FROM maps
            UNION SELECT w.map_id, e.dst, w.lvl + 1 FROM w JOIN e ON e.src = w.id WHERE w.lvl < 3)
        SELECT map_id, id, min(lvl)::INT AS level FROM w GROUP BY ALL""",
    "trace_of_topics": f"""WITH RECURSIVE {_E}, r AS (SELECT * FROM e WHERE relation = 'requires'),
        w(start, lvl, id, via, path) AS (SELECT DISTINCT src, 0, src, NULL::VARCHAR, []::BIGINT[] FROM r
            UNION ALL SELECT w.start, w.lvl + 1, r.dst, r.src, list_append(w.path, r.ord) FROM w JOIN r ON r.src = w.id WHERE w.lvl < 3)
        SELECT start, lvl AS level, via AS from_id, id AS to_id FROM
            (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY start, id ORDER BY lvl, path) = 1) WHERE lvl > 0""",
    "analyze_impact": f"""WITH RECURSIVE {_E}, {_C},
        w(lvl, id, via, rel, path) AS (SELECT 0, min(dst), NULL::VARCHAR, NULL::VARCHAR, []::BIGINT[] FROM e WHERE relation = 'requires'
            UNION ALL SELECT w.lvl + 1, e.src, e.dst, e.relation, list_append(w.path, e.ord) FROM w JOIN e ON e.dst = w.id WHERE w.lvl < 5),
        f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl, path) = 1)
        SELECT lvl AS level, f.id, rel AS relation, via, {_CUT.format('c.text', 140)} AS excerpt FROM f LEFT JOIN c ON c.id = f.id WHERE lvl > 0""",
    "infer_applies_to": f"""WITH {_N}, e0 AS (SELECT DISTINCT from_id AS src, split_part(to_id, '#', 1) AS dst FROM graph_edges
            WHERE trim(to_id, ' ') <> '' AND relation <> 'applies-to'), {_APPLY}
        SELECT DISTINCT cmd.id AS src, own.ref AS dst FROM cmd JOIN own USING (t) WHERE n = 1
            AND NOT EXISTS (SELECT 1 FROM e0 WHERE (src = cmd.id AND dst = own.ref) OR (dst = cmd.id AND src = own.ref))""",
    "ambiguous_terms": f"WITH {_N}, {_APPLY} SELECT cmd.id AS task_id, t AS term, n AS n_candidates, candidates FROM cmd JOIN own USING (t) WHERE n > 1",
    "term_candidates": f"WITH {_N}, {_APPLY} SELECT t AS term, id AS ref_id FROM ref JOIN own USING (t) WHERE n > 1",
    "related_counts": f"""WITH {_N}, {_E}, {_PAIRS}, {_PRODUCT},
        q AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.x = b.x AND a.id <> b.id)
        SELECT i.id, count(q.a) AS n_related FROM (SELECT DISTINCT id FROM p) i
        LEFT JOIN (SELECT q.* FROM q WHERE NOT EXISTS (SELECT 1 FROM pr WHERE lo = least(a, b) AND hi = greatest(a, b))) q ON q.a = i.id GROUP BY i.id""",
    "infer_related_to": f"""WITH {_N}, {_E}, {_PAIRS}, {_PRODUCT}, {_CLASSES}
        SELECT 'member' AS part, id AS a, class AS b FROM cl
        UNION ALL SELECT 'link', a, b FROM ln UNION ALL SELECT 'linked', lo, hi FROM ex""",
    "related_members": f"WITH {_N}, {_E}, {_PAIRS}, {_PRODUCT}, {_CLASSES} SELECT id, class FROM cl",
    "related_classes": f"WITH {_N}, {_E}, {_PAIRS}, {_PRODUCT}, {_CLASSES} SELECT a, b FROM ln",
    "related_exceptions": f"WITH {_N}, {_E}, {_PAIRS}, {_PRODUCT}, {_CLASSES} SELECT lo, hi FROM ex",
    "contains_depth_cut": f"""WITH {_E}, k AS (SELECT src, dst FROM e WHERE relation = 'contains'),
        s AS (SELECT id FROM maps UNION SELECT dst FROM k WHERE src IN (SELECT id FROM maps))
        SELECT DISTINCT src, dst FROM k WHERE src IN (SELECT id FROM s)""",
    "resolve_links": f"WITH {_N}, {_LINKS} SELECT src, dst, relation, min(ord) AS ord FROM l WHERE dst IN (SELECT id FROM n) AND src <> dst GROUP BY ALL",
    "unresolved_links": f"WITH {_N}, {_LINKS} SELECT DISTINCT src AS subject, 'Unresolved link: ' || dst AS message FROM l WHERE dst NOT IN (SELECT id FROM n)",
    "dedup_ids": f"WITH RECURSIVE {_FILES}, s AS (SELECT * FROM f), {_CLAIM}",
    "dedup_ids_planted": f"""WITH RECURSIVE {_FILES}, c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY b ORDER BY ord) > 1),
        s AS (SELECT ord, path, b FROM f
            UNION ALL SELECT '0' || ord, 'first/' || path, b || '--' || replace(path, '/', '-') FROM c
            UNION ALL SELECT ord || '~', 'last/' || path, b || '--' || replace(path, '/', '-') || '-2' FROM c), {_CLAIM}""",
    "generated_from": f"WITH {_LINES} SELECT DISTINCT doc AS src, owner AS dst FROM x JOIN o USING (line) WHERE doc <> owner",
    "canonical_body": f"""WITH {_LINES}, k AS (SELECT doc, string_agg(line, chr(10) ORDER BY pos) AS body FROM x LEFT JOIN o USING (line)
            WHERE owner IS NULL OR owner = doc GROUP BY doc)
        SELECT doc AS doc_id, CASE WHEN length(trim(body, ' ')) > 0 THEN body END AS body FROM k""",
    "text_chunks": f"""WITH {_N} SELECT tp.id, tp.title, CASE WHEN tp.shortdesc IS NULL AND body IS NULL THEN NULL ELSE concat_ws(chr(10) || chr(10), tp.shortdesc, body) END AS text,
        n.okf_type AS "topicType", CASE WHEN len(product) > 0 THEN array_to_string(product, '|') END AS product,
        CASE WHEN len(audience) > 0 THEN array_to_string(audience, '|') END AS audience, 'topics/' || tp.id || '.md' AS "okfNode"
        FROM tp JOIN n ON n.id = tp.id AND n.ord = 1""",
    "graph_view": f'WITH {_N} SELECT id, okf_type AS "type" FROM n',
    "tags": f"WITH {_N} SELECT id, array_to_string(list_transform(audience || product || keys, lambda x: coalesce(x, '')), '|') AS tags FROM tp",
    "listed_relations": f"WITH {_E} SELECT src AS id, relation, ord AS edge_ord, dst AS target FROM e WHERE relation IN ('contains', 'applies-to', 'requires')",
    "sections": f"""WITH {_N}, {_E}, g AS (SELECT src, relation, min(ord) AS first FROM e GROUP BY ALL),
        k AS (SELECT src, relation, row_number() OVER (PARTITION BY src ORDER BY first)::INT AS section FROM g)
        SELECT e.src AS id, section, e.relation, e.ord AS edge_ord, dst, coalesce(ti.title, dst) AS title
        FROM e JOIN k USING (src, relation) LEFT JOIN ti ON ti.id = dst""",
    "dangling": f"WITH {_N}, {_E} SELECT DISTINCT src, relation, dst FROM e WHERE dst NOT IN (SELECT id FROM n)",
    "redundant_links": f"WITH {_E} SELECT src, dst, count(*) AS n FROM e GROUP BY ALL HAVING count(*) > 1",
    "duplicate_ids": "SELECT id, count(*) AS n FROM (SELECT id FROM topics UNION ALL SELECT id FROM maps) GROUP BY id HAVING count(*) > 1",
    "secret_scan": _secrets("documents", "text"),
    "secret_scan_planted": f"WITH planted AS (SELECT doc_id, text || chr(10) || {_PLANT} AS text FROM documents) " + _secrets("planted", "text"),
    "suggest_id": f"WITH {_N}, a AS (SELECT DISTINCT replace(source_file, '/', '-') AS asked FROM topics), k AS (SELECT id FROM n), {_SUGGEST}",
    "suggest_id_planted": f"""WITH {_N}, a AS (SELECT DISTINCT topic_type || '--' || regexp_extract(id, '[^-]*$') AS asked FROM topics),
        k AS (SELECT id FROM n UNION ALL SELECT DISTINCT id || '--' || topic_type || '--' || regexp_extract(id, '[^-]*$') FROM topics), {_SUGGEST}""",
    "explain": f"""WITH {_N}, {_E}, {_C}, k AS (SELECT n.* FROM n JOIN tp ON tp.id = n.id AND n.ord = 1 WHERE topic_type = 'task')
        SELECT id, 0 AS part, 0::BIGINT AS ord, NULL::VARCHAR AS relation, title AS text FROM k
        UNION ALL SELECT id, 1, 0, NULL, coalesce(shortdesc, '(no description available)') FROM k
        UNION ALL SELECT c.id, 2, 0, NULL, {_CUT.format('c.text', 300)} FROM c WHERE text IS NOT NULL AND id IN (SELECT id FROM k)
        UNION ALL SELECT e.src, CASE relation WHEN 'requires' THEN 3 WHEN 'contains' THEN 4 ELSE 5 END, e.ord, relation, coalesce(ti.title, dst) || ' (' || dst || ')'
            FROM e LEFT JOIN ti ON ti.id = dst WHERE relation IN ('requires', 'contains', 'applies-to') AND src IN (SELECT id FROM k)""",
    "summary": f"WITH {_N} SELECT id, title || ': ' || coalesce(shortdesc, '(no description available)') AS summary FROM n",
    "index_changes": f"""WITH {_N}, {_C}, b AS (SELECT id, title, CASE WHEN shortdesc IS NULL AND body IS NULL THEN NULL
            ELSE concat_ws(chr(10) || chr(10), shortdesc, body) END AS text FROM tp)
        SELECT coalesce(b.id, c.id) AS id, CASE WHEN c.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM c FULL JOIN b ON b.id = c.id WHERE c.id IS NULL OR b.id IS NULL OR c.title IS DISTINCT FROM b.title OR c.text IS DISTINCT FROM b.text""",
    "contained": """WITH i AS (SELECT id FROM topics UNION SELECT id FROM maps),
        l AS (SELECT id, (i - 1)::INT AS ord, split_part(l.target_id, '#', 1) AS dst, l.relation AS relation
            FROM (SELECT id, i, links[i] AS l FROM (SELECT id, any_value(links) AS links, unnest(range(1, len(any_value(links)) + 1)) AS i FROM maps GROUP BY id)))
        SELECT id AS src, dst, relation, ord FROM l WHERE relation = 'contains' AND dst IN (SELECT id FROM i)""",
    "reused": f"""WITH {_N}, {_LINKS} SELECT src, dst, 'generated-from' AS relation, min(ord) AS ord FROM l
        WHERE relation = 'generated-from' AND dst IN (SELECT id FROM n) AND src <> dst GROUP BY ALL""",
    "graph_edge_lines": f"""WITH {_E} SELECT ord AS edge_ord, ',' || to_json({{'from': src, 'to': dst, 'relation': relation}})::VARCHAR AS line FROM e""",
    "edges_into_targets": f"""WITH {_E} SELECT src, dst, relation, ord AS edge_ord FROM e
        WHERE dst = (SELECT dst FROM e GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)""",
    "xml_maps": """WITH m AS (SELECT id, list_filter(list_transform(any_value(links), lambda l: split_part(l.target_id, '#', 1)), lambda x: trim(x, ' ') <> '') AS a FROM maps GROUP BY id),
        x AS (SELECT id, a, unnest(range(1, len(a) + 1)) AS i FROM m)
        SELECT id AS map_id, (i - 1)::INT AS ord, CASE WHEN i % 2 = 0 THEN a[i - 1] END AS container, a[i] AS target, (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)::INT AS level FROM x""",
    "xml_topics": f"""WITH {_N}, c AS (SELECT id, CASE WHEN topic_type = 'glossentry' THEN 'glossentry' ELSE topic_type END AS topic_type,
            {_COLLAPSE.format("title")} AS title, {_TRIM.format("coalesce(shortdesc, '')")} AS shortdesc, {_COLLAPSE.format("coalesce(body, '')")} AS body,
            {_COLLAPSE.format("array_to_string(audience, ' ')")} AS audience, array_to_string(list_distinct_in_order, '|') AS uicontrols
            FROM (SELECT *, list_filter(list_transform(range(1, len(uw) + 1), lambda i: CASE WHEN uw[i] <> '' AND list_position(uw, uw[i]) = i THEN uw[i] END), lambda x: x IS NOT NULL) AS list_distinct_in_order
                FROM (SELECT *, list_transform(list_filter(uic, lambda x: x IS NOT NULL), lambda x: {_COLLAPSE.format("x")}) AS uw FROM tp)))
        SELECT id, topic_type, CASE WHEN title = '' THEN id ELSE title END AS title, nullif(shortdesc, '') AS shortdesc,
            nullif({_COLLAPSE.format("body || ' ' || replace(uicontrols, '|', ' ')")}, '') AS body, replace(audience, ' ', '|') AS audience, uicontrols FROM c""",
}
