"""Standard SQL of the catalog's queries, for an independent engine over the same tables; more of it is in ``catalog_sql_forms``."""

from __future__ import annotations

from quillmesh.functions.chat import TEMPLATES

#: White space at the ends of a text, as the strip functions see it.
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


#: A model's answer made of a text: one of three has closed reasoning, one reasoning without end.
THOUGHTS = "CASE doc_id % 3 WHEN 0 THEN '<think>' || text || '</think> answer ' || CAST(doc_id AS STRING) WHEN 1 THEN 'start <thinking>' || text ELSE text END"

_HREF = "concat('<a href=\"/', CASE doc_id % 4 WHEN 0 THEN 'guide' ELSE 'docs' END, '/', (doc_id * 7) % 1000, '?x=1#top\">one</a> <a class=\"x\" href=\"https://www.docs.example/docs/', (doc_id * 3) % 1000, '\">two</a> <a href=\"https://other.example/docs/1\">three</a>')"
#: Columns of the pages made of the corpus.
PAGES = [
    "doc_id",
    "concat('https://docs.example/docs/', doc_id) AS url",
    f"concat('<html><head><style>p {{}}</style></head><body><nav>menu</nav><article class=\"bd-article\"><h1>', coalesce(source, 'page'), '</h1><p>', coalesce(text, ''), '</p>', {_HREF}, '<script>var x = \"</p>\";</script><!-- end --></article><footer>foot</footer></body></html>') AS html",
]
_PAGES = f"(SELECT {', '.join(PAGES)} FROM documents)"

_BASE = r"regexp_extract(file_path, '([^/\\]*)$', 1)"
_EXT = rf"lower(regexp_extract({_BASE}, '[^.].*?(\.[^.]*)$', 1))"
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _fixed(size: int, step: int) -> str:
    return f"""
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_idx, CAST(s AS INT) AS chunk_start, chunk FROM (
            SELECT doc_id, s, {_strip(f"substring(t, CAST(s + 1 AS INT), {size})")} AS chunk FROM (
                SELECT doc_id, t, unnest(range(0, length(t), {step})) AS s FROM (SELECT doc_id, {_strip("text")} AS t FROM documents) WHERE length(t) > 0))
        WHERE chunk <> ''"""


def _topk(k: int) -> str:
    return f"(SELECT e.vec_id, {_COS} AS cos, row_number() OVER (ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY rank <= {k})"


def _found(where: str = "TRUE") -> str:
    return f"(SELECT d.*, greatest(0, least(1, h.cos)) AS similarity_score, h.rank FROM {_topk(20)} h JOIN documents d ON d.doc_id = h.vec_id WHERE greatest(0, least(1, h.cos)) >= 0.2 AND {where})"


def _scored(where: str = "TRUE") -> str:
    return f"SELECT doc_id, round(similarity_score, 6) AS similarity_score, CAST(rank AS INT) AS rank FROM {_found(where)}"


# Fixed value: the instruction before the contexts.
_RAG = "Here are the contexts to base your answer on.  However, I need to reiterate that I only want you to base your response on these contexts and do not use outside knowledge that you may have been trained with."
_JOINED = f"(SELECT string_agg(text, E'\\n\\n---\\n\\n' ORDER BY rank) AS ctx FROM {_found('text IS NOT NULL')})"


def _cleaned(x: str) -> str:
    inner = f"regexp_replace({x}, '\\n[ \\t]+\\n', E'\\n\\n', 'g')"
    return f"regexp_replace({_strip(inner)}, '\\n[\\s\\x{{0b}}]*\\n[\\s\\x{{0b}}]*\\n*', E'\\n\\n', 'g')"


_RULE = "-" * 80
_NO_RESULT = "No chunks passed the similarity threshold.\n\nTry lowering the ''Similarity'' setting in the Database Query settings tab (e.g. from 0.7 to 0.4) and run the query again."
_VALID = lambda c: f"CASE WHEN {c} BETWEEN 0 AND 100 THEN {c} END"
_ONCE = "(SELECT * FROM metrics_sample QUALIFY row_number() OVER (PARTITION BY session_id, sample_ts ORDER BY sample_id) = 1)"
_SIZED = "(SELECT doc_id, n, CAST(floor(doc_id / 5000) AS BIGINT) AS shard, row_number() OVER (PARTITION BY floor(doc_id / 5000) ORDER BY n DESC, doc_id) - 1 AS position FROM (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL))"
_STATS = f"(SELECT shard, CAST(floor(position / 64) AS INT) AS batch_id, count(*) AS rows, max(n) AS longest, sum(n) AS real_tokens, count(*) * max(n) - sum(n) AS pad_tokens FROM {_SIZED} GROUP BY 1, 2)"
_LINKS = rf"""(SELECT DISTINCT url, link FROM (SELECT url, regexp_replace(CASE WHEN href LIKE '/%' THEN concat('https://docs.example', href) ELSE href END, '[?#].*$', '') AS link
    FROM (SELECT url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']([^"'']*)["'']', 1)) AS href FROM {_PAGES}))
    WHERE regexp_replace(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^www\.', '') = 'docs.example')"""
_SENTENCE_ITEMS = f"list_filter(list_transform(string_split_regex(text, '[.!?;]+[\\s\\x{{0b}}]*'), lambda s: {_strip('s')}), lambda s: s <> '')"
_ISLANDS = r"""(SELECT id, min(p) AS a, max(p) AS b FROM (SELECT id, p, p - row_number() OVER (PARTITION BY id ORDER BY p) AS g FROM
    (SELECT DISTINCT id, CAST(unnest(regexp_extract_all(page_content, '\[\[page(\d+)\]\]', 1)) AS INT) AS p FROM document_metadata)) GROUP BY id, g)"""
_RANGES = f"SELECT id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE concat(a, '-', b) END, ', ' ORDER BY a) AS pages FROM {_ISLANDS} GROUP BY id"
_ESCAPED = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"

_RENDERED = rf"regexp_replace(regexp_replace(text, '\n[\s\x{{0b}}]*\n', E'\n', 'g'), '^{_SPACE}+', '')"
_CUT = "CASE WHEN length(text) > 700 THEN left(text, 700) || ' ...' ELSE text END"

_FORMS = " UNION ALL ".join(
    f"SELECT doc_id, '{family}' AS family, " + " || ".join(f"E'{part}'".replace("\n", "\\n") for part in before) + " || text || " + f"E'{after}'".replace("\n", "\\n") + " AS prompt FROM documents"
    for family, (before, after) in {f: ((t.split("{query}")[0].replace("{system}", "Be brief."),), t.split("{query}")[1]) for f, t in TEMPLATES.items()}.items()
)

SQL: dict[str, str] = {
    "chunk_fixed": _fixed(700, 450),
    "chunk_overlap_variants": _fixed(1200, 600),
    "chunk_paged": rf"""
        WITH pdf AS (SELECT id, page_content FROM document_metadata WHERE lower(regexp_extract({_strip("file_name")}, '[^.].*?(\.[^.]*)$', 1)) = '.pdf'),
        parts AS (SELECT id, regexp_replace(page_content, '\[\[page(\d+)\]\]', '', 'g') AS t, string_split_regex(page_content, '\[\[page\d+\]\]') AS pieces, regexp_extract_all(page_content, '\[\[page(\d+)\]\]', 1) AS pages FROM pdf),
        marks AS (SELECT id, CAST(pages[k] AS INT) AS page, k, list_sum(list_transform(pieces[1:k], lambda x: length(x))) AS pos FROM (SELECT *, unnest(range(1, len(pages) + 1)) AS k FROM parts)),
        cut AS (SELECT id, s, {_strip("substring(t, CAST(s + 1 AS INT), 700)")} AS chunk FROM (SELECT id, t, unnest(range(0, length(t), 450)) AS s FROM parts WHERE length(t) > 0))
        SELECT c.id, CAST(row_number() OVER (PARTITION BY c.id ORDER BY c.s) - 1 AS INT) AS chunk_idx, CAST(c.s AS INT) AS chunk_start, c.chunk,
            coalesce((SELECT arg_max(m.page, m.k) FROM marks m WHERE m.id = c.id AND m.pos <= c.s), 1) AS page_number
        FROM cut c WHERE c.chunk <> ''""",
    "chunk_heading": rf"""
        WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '(?m)^#+ ', '### ', 'g'), E'\n') AS l FROM documents)),
        marked AS (SELECT *, starts_with({_strip("line")}, '###') AS h FROM lines),
        grouped AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS g, lag(h) OVER (PARTITION BY doc_id ORDER BY i) AS below FROM marked),
        joined AS (SELECT doc_id, g, {_strip("string_agg(line, E'\\n' ORDER BY i)")} AS chunk FROM grouped WHERE g > 0 AND ({_strip("line")} <> '' OR below) GROUP BY doc_id, g)
        SELECT doc_id, CAST(g - 1 AS INT) AS chunk_idx, chunk, {_strip("regexp_replace(string_split(chunk, E'\\n')[1], '^#+', '')")} AS heading FROM joined""",
    "chunk_stats": f"""
        SELECT count(*) AS chunks, min(n) AS shortest, max(n) AS longest, round(avg(n), 6) AS mean_length,
            arg_min(doc_id, n * 1000000000000 + doc_id * 10000 + chunk_idx) AS shortest_doc_id, arg_min(chunk_idx, n * 1000000000000 + doc_id * 10000 + chunk_idx) AS shortest_chunk_idx,
            arg_min(doc_id, -n * 1000000000000 + doc_id * 10000 + chunk_idx) AS longest_doc_id, arg_min(chunk_idx, -n * 1000000000000 + doc_id * 10000 + chunk_idx) AS longest_chunk_idx
        FROM (SELECT doc_id, chunk_idx, length(chunk) AS n FROM ({_fixed(700, 450)}))""",
    "oversize_chunks": "SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) > 2048",
    "assembled_pages": f"""
        SELECT CAST(floor(doc_id / 4) AS BIGINT) AS doc_id, coalesce(string_agg(concat('[[page', doc_id % 4 + 1, ']]', text), '' ORDER BY doc_id % 4) FILTER (WHERE {_strip("text")} <> ''), '') AS text
        FROM documents GROUP BY floor(doc_id / 4)""",
    "chunks_per_database": f"""
        SELECT db_name, CAST(sum(ceil(n / greatest(chunk_size - chunk_overlap, 1))) AS BIGINT) AS chunks, count(*) AS documents
        FROM (SELECT source, length({_strip("text")}) AS n FROM documents) JOIN created_databases ON source = db_name WHERE n > 0 GROUP BY db_name""",
    "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "stale_hashes": "SELECT CASE WHEN coalesce(hash, '') = '' THEN 'missing' WHEN page_content IS NULL THEN 'no text' WHEN lower(hash) = sha256(page_content) THEN 'valid' ELSE 'stale' END AS state, count(*) AS n FROM document_metadata GROUP BY 1",
    "duplicate_docs": "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "first_of_content": "SELECT id, hash, file_name FROM document_metadata QUALIFY coalesce(hash, '') = '' OR row_number() OVER (PARTITION BY lower(hash) ORDER BY id) = 1",
    "clean_context": f"SELECT doc_id, {_cleaned('text')} AS cleaned FROM documents",
    "corrupt_fraction": rf"""
        SELECT doc_id, round(CASE WHEN length(s) = 0 THEN 0.0 WHEN s IS NULL THEN NULL ELSE (length(regexp_replace(s, '[^\x{{fffd}}\x{{e000}}-\x{{f8ff}}]', '', 'g')) + length(s) - length(regexp_replace(s, '\(cid:\d+\)', '', 'g'))) / length(s) END, 6) AS fraction
        FROM (SELECT doc_id, {_strip("text || repeat('(cid:12)', CAST(doc_id % 3 AS INT))")} AS s FROM documents)""",
    "think_strip": rf"SELECT doc_id, regexp_replace(regexp_replace({THOUGHTS}, '(?s)<think>.*?</think>|<thinking>.*$', '', 'g'), '^{_SPACE}+', '') AS answer FROM documents",
    "think_pieces": rf"SELECT doc_id AS conv_id, regexp_replace(regexp_replace({THOUGHTS}, '(?s)<think>.*?</think>|<thinking>.*$', '', 'g'), '^{_SPACE}+', '') AS answer FROM documents WHERE {THOUGHTS} IS NOT NULL",
    "snippets": f"SELECT doc_id, {_ESCAPED(_CUT)} AS snippet FROM documents",
    "rendered_response": f"SELECT doc_id, replace({_ESCAPED(_RENDERED)}, E'\\n', '<br>') AS html FROM documents",
    "sentence_split": f"SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS n, unnest(l) AS sentence FROM (SELECT doc_id, {_SENTENCE_ITEMS} AS l FROM documents)",
    "joined_lines": f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, E'\\n'), lambda s: {_strip('s')}), lambda s: s <> ''), ' ') AS line FROM documents",
    "chat_prompts": _FORMS,
    "assistant_prompts": "SELECT CAST(floor(doc_id / 5) AS BIGINT) AS n, 'Answer from the excerpts.' || E'\\n\\nUSER GUIDE EXCERPTS:\\n' || coalesce(string_agg(text, E'\\n\\n' ORDER BY doc_id), '') || E'\\n\\nQUESTION: What now?' AS prompt FROM documents GROUP BY 1",
    "realigned_chunks": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)",
    "prefixed_queries": """
        SELECT db_name, family, CASE WHEN family IN ('qwen', 'harrier') THEN 8192 WHEN family = 'modernbert' AND contains(lower(model), '8192') THEN 8192 ELSE 512 END AS max_sequence,
            CASE family WHEN 'qwen' THEN 'Instruct: Given a web search query, retrieve relevant passages that answer the query Query: what is a quorum?' WHEN 'bge' THEN 'Represent this sentence for searching relevant passages: what is a quorum?' ELSE 'what is a quorum?' END AS query
        FROM (SELECT db_name, model, CASE WHEN contains(lower(model), 'harrier') THEN 'harrier' WHEN contains(lower(model), 'qwen') OR contains(lower(model), 'octen') THEN 'qwen' WHEN contains(lower(model), 'bge') THEN 'bge' WHEN contains(lower(model), 'modernbert') THEN 'modernbert' ELSE 'generic' END AS family
            FROM (SELECT db_name, coalesce(model, concat('vendor/BGE-base-', db_name)) AS model FROM created_databases))""",
    "document_paths": rf"""
        SELECT id, {_BASE} AS name, {_EXT} AS extension, substring({_BASE}, 1, length({_BASE}) - length({_EXT})) AS stem,
            CASE WHEN {_EXT} IN ('.pdf', '.docx', '.txt', '.eml', '.msg', '.csv', '.xls', '.xlsx', '.xlsm', '.rtf', '.md', '.html', '.htm') THEN 'document'
                 WHEN {_EXT} IN ('.png', '.jpg', '.jpeg', '.bmp', '.gif', '.tif', '.tiff', '.webp') THEN 'image'
                 WHEN {_EXT} IN ('.mp3', '.m4a', '.ogg', '.wav', '.webm', '.mp4', '.avi', '.mkv', '.wma', '.flac', '.aac') THEN 'audio' END AS kind
        FROM document_metadata""",
    "doctype_distribution": rf"""
        SELECT coalesce(document_type, CASE WHEN {_EXT} IN ('.pdf', '.docx', '.txt', '.eml', '.msg', '.csv', '.xls', '.xlsx', '.xlsm', '.rtf', '.md', '.html', '.htm') THEN 'document'
            WHEN {_EXT} IN ('.png', '.jpg', '.jpeg', '.bmp', '.gif', '.tif', '.tiff', '.webp') THEN 'image' WHEN {_EXT} IN ('.mp3', '.m4a', '.ogg', '.wav', '.webm', '.mp4', '.avi', '.mkv', '.wma', '.flac', '.aac') THEN 'audio' END) AS document_type,
            lower(file_type) AS file_type, count(*) AS n FROM document_records GROUP BY 1, 2""",
    "metadata_roundtrip": "SELECT file_type, count(*) AS n, count(hash) AS with_hash FROM document_records GROUP BY file_type",
    "latest_versions": """
        SELECT file_path, modification_date, sha256(page_content) AS text_hash, CAST(versions AS INT) AS versions FROM (
            SELECT r.*, row_number() OVER (PARTITION BY file_path ORDER BY modification_date DESC NULLS LAST, hash DESC NULLS LAST, sha256(page_content) DESC NULLS LAST) AS n, v.versions
            FROM document_records r JOIN (SELECT file_path AS p, count(DISTINCT sha256(page_content)) AS versions FROM document_records GROUP BY 1) v ON v.p IS NOT DISTINCT FROM r.file_path)
        WHERE n = 1""",
    "impossible_dates": "SELECT document_type, count(*) AS n FROM document_records WHERE try_cast(modification_date AS TIMESTAMP) < try_cast(creation_date AS TIMESTAMP) GROUP BY 1",
    "staged_names": rf"""
        SELECT file_path, CASE WHEN n > 1 THEN concat(substring(name, 1, length(name) - length(regexp_extract(name, '[^.].*?(\.[^.]*)$', 1))), '_', substring(md5(file_path), 1, 8), regexp_extract(name, '[^.].*?(\.[^.]*)$', 1)) ELSE name END AS staged_name
        FROM (SELECT file_path, {_BASE} AS name, row_number() OVER (PARTITION BY lower({_BASE}) ORDER BY file_path) AS n FROM (SELECT DISTINCT file_path FROM document_metadata))""",
    "file_listing": "SELECT file_name, file_path FROM document_metadata",
    "kept_downloads": r"""
        SELECT count(*) FILTER (WHERE k) AS files, CAST(sum(octet_length(encode(page_content))) FILTER (WHERE k) AS BIGINT) AS bytes
        FROM (SELECT page_content, NOT regexp_matches(file_name, '^.*copy.*$|^index\..*$') AND regexp_matches(file_name, '^.*\.pdf$|^.*\.txt$|^.*\.md$') AS k FROM document_metadata WHERE file_name IS NOT NULL)""",
    "chunks_per_document": """
        SELECT o.document_id, count(*) AS chunks, max(o.copies) AS copies FROM hash_chunk_ids c
        LEFT JOIN (SELECT lower(hash) AS h, min(id) AS document_id, count(*) AS copies FROM document_metadata WHERE hash <> '' GROUP BY 1) o ON lower(c.hash) = o.h GROUP BY o.document_id""",
    "orphan_chunks": "SELECT tiledb_id, hash FROM hash_chunk_ids c WHERE NOT EXISTS (SELECT 1 FROM document_metadata m WHERE m.hash <> '' AND lower(m.hash) = lower(c.hash))",
    "registry_models": """
        SELECT db_name, coalesce(model, 'none') AS model, CASE WHEN contains(model, 'Ostrea') THEN 'float16' WHEN contains(model, 'Quill') THEN 'bfloat16' WHEN contains(model, 'bge') THEN 'float32' ELSE 'float32' END AS precision FROM created_databases""",
    "source_union": """
        SELECT source_no, document_type, count(*) AS n, count(DISTINCT hash) AS hashes FROM (
            SELECT 0 AS source_no, file_path, hash, document_type FROM document_records UNION ALL SELECT 1, file_path, hash, NULL FROM document_metadata) GROUP BY 1, 2""",
    "set_diff": """
        SELECT file_path, 'added' AS change FROM (SELECT file_path FROM document_records EXCEPT SELECT file_path FROM document_metadata)
        UNION ALL SELECT file_path, 'removed' FROM (SELECT file_path FROM document_metadata EXCEPT SELECT file_path FROM document_records)""",
    "gpu_rank": "SELECT p_partkey, p_size, p_retailprice, round(p_retailprice / max(p_retailprice) OVER () * 100, 6) AS percent FROM part WHERE p_size BETWEEN 10 AND 20",
    "repeated_metadata": """
        SELECT batch, count(*) FILTER (WHERE r) AS repeats, count(*) AS n FROM (
            SELECT batch, lang IS NOT DISTINCT FROM lag(lang) OVER w AND source IS NOT DISTINCT FROM lag(source) OVER w AND row_number() OVER w > 1 AS r
            FROM (SELECT *, CAST(floor(doc_id / 1000) AS BIGINT) AS batch FROM documents) WINDOW w AS (PARTITION BY batch ORDER BY doc_id))
        GROUP BY batch""",
    "knn_topk": f"SELECT vec_id, round(greatest(0, least(1, cos)), 6) AS similarity_score, CAST(rank AS INT) AS rank FROM {_topk(5)}",
    "knn_multi": f"""
        SELECT q.vec_id AS query_id, e.vec_id AS id, round(greatest(0, least(1, {_COS})), 5) AS similarity_score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS INT) AS rank
        FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q QUALIFY rank <= 5""",
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, 1.0::DOUBLE AS unit FROM embeddings",
    "search_threshold": _scored(),
    "search_term": _scored("contains(lower(d.text), 'the')"),
    "search_type": _scored("d.document_type = 'document'"),
    "search_chunks_only": f"""
        SELECT coalesce(string_agg(concat('{_RULE}', E'\\nCONTEXT ', n, ' | ', coalesce(source, 'Unknown'), E'\\n{_RULE}\\n') || {_cleaned('text')} || E'\\n', E'\\n' ORDER BY n), '{_NO_RESULT}') AS response
        FROM (SELECT *, row_number() OVER (ORDER BY rank) AS n FROM {_found()})""",
    "rag_prompt": f"SELECT concat('{_RAG}', E'\\n\\n---\\n\\n', ctx, E'\\n\\n-----\\n\\nWhat was decided?') AS prompt FROM {_JOINED}",
    "token_budget": f"""
        SELECT c AS context_tokens, r AS rag_tokens, 5 AS query_tokens, 0 AS response_tokens, c <= 3996 AS fits, 4096 - c - r - 5 AS remaining_tokens
        FROM (SELECT CAST(ceil(length(ctx) / 4.0) AS INT) AS c, CAST(ceil({len(_RAG)} / 4.0) AS INT) AS r FROM {_JOINED})""",
    "distance_stats": f"SELECT round(min(1 - cos), 6) AS min_distance, round(max(1 - cos), 6) AS max_distance, round(avg(1 - cos), 6) AS mean_distance FROM {_topk(20)}",
    "cited_sources": rf"""
        WITH hits AS (SELECT regexp_extract(m.file_path, '^(.*?[/\\].*?[/\\].*?)[/\\]', 1) AS file_path, greatest(0, least(1, h.cos)) AS s, CAST(h.vec_id % 7 + 1 AS INT) AS p FROM {_topk(40)} h JOIN document_metadata m ON m.id = h.vec_id),
        runs AS (SELECT file_path, min(p) AS a, max(p) AS b FROM (SELECT file_path, p, p - row_number() OVER (PARTITION BY file_path ORDER BY p) AS g FROM (SELECT DISTINCT file_path, p FROM hits)) GROUP BY file_path, g),
        pages AS (SELECT file_path, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE concat(a, '-', b) END, ', ' ORDER BY a) AS pages FROM runs GROUP BY file_path)
        SELECT file_path, CASE WHEN min(s) = max(s) THEN printf('%.4f', round(min(s), 4)) ELSE concat(printf('%.4f', round(min(s), 4)), '-', printf('%.4f', round(max(s), 4))) END AS scores, any_value(pages) AS pages, round(min(s), 6) AS min_score
        FROM hits JOIN pages USING (file_path) GROUP BY file_path""",
    "page_ranges": _RANGES,
    "page_ranges_array": _RANGES,
    "link_extract": f"SELECT * FROM {_LINKS}",
    "link_frontier": f"SELECT DISTINCT link FROM {_LINKS} WHERE link NOT IN (SELECT url FROM {_PAGES} WHERE doc_id % 2 = 0)",
    "html_filename": rf"""
        SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat('docs.example_docs_', doc_id, '_', substring(md5(concat(url, '?a=1')), 1, 8)) ELSE concat('docs.example_docs_', doc_id) END AS file_name FROM {_PAGES}""",
    "html_plain": rf"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|footer|svg)\b.*?</(script|style|nav|footer|svg)>|<!--.*?-->', '', 'g'), '<[^>]*>', ' ', 'g'), '[\s\x{{0b}}]+', ' ', 'g'), ' ') AS text FROM {_PAGES}",
    "url_valid": """
        SELECT doc_id, FALSE AS deep, doc_id % 5 = 2 AND doc_id % 3 <> 0 AS valid, FALSE AS elsewhere FROM documents""",
    "rate_limits": """
        SELECT site, min(seq) AS stopped_at FROM (SELECT *, sum(CAST(status = 429 AS INT)) OVER (PARTITION BY site, run ORDER BY seq) AS n FROM (
            SELECT user_id AS site, event_id AS seq, CASE event_type WHEN 'error' THEN 429 WHEN 'purchase' THEN 200 ELSE 404 END AS status,
                sum(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)) WHERE n >= 5 GROUP BY site""",
    "length_sorted_batches": f"SELECT doc_id, shard, CAST(position AS INT) AS position, CAST(floor(position / 64) AS INT) AS batch_id FROM {_SIZED}",
    "batch_padding": f"SELECT * FROM {_STATS}",
    "padding_efficiency": f"SELECT CAST(sum(real_tokens) AS BIGINT) AS real_tokens, CAST(sum(pad_tokens) AS BIGINT) AS pad_tokens, round(sum(real_tokens) / (sum(real_tokens) + sum(pad_tokens)) * 100, 6) AS efficiency FROM {_STATS}",
    "ocr_gate": rf"""
        SELECT CAST(floor(doc_id / 5) AS BIGINT) AS doc_id, bool_or(CASE WHEN bad > 0.3 THEN TRUE WHEN doc_id % 7 >= 4 THEN FALSE ELSE (doc_id % 10) / 10.0 >= CASE WHEN has_text THEN 0.5 ELSE 0.05 END OR doc_id % 23 >= 20 END) AS needs_ocr
        FROM (SELECT doc_id, coalesce(s <> '', FALSE) AS has_text, CASE WHEN s <> '' THEN (length(regexp_replace(s, '[^\x{{fffd}}\x{{e000}}-\x{{f8ff}}]', '', 'g')) + length(s) - length(regexp_replace(s, '\(cid:\d+\)', '', 'g'))) / length(s) ELSE 0 END AS bad FROM (SELECT doc_id, {_strip("text")} AS s FROM documents)) GROUP BY 1""",
    "ocr_events": """
        SELECT kind, CAST(len(p) AS INT) AS n_pages, concat(array_to_string(p[1:10], ', '), CASE WHEN len(p) > 10 THEN ', ...' ELSE '' END) AS pages FROM (
            SELECT CASE WHEN event_type = 'view' THEN CASE WHEN value / 5000 >= 0.002 THEN 'notext_visible' ELSE 'notext_blank' END ELSE event_type END AS kind, list_sort(list(DISTINCT user_id % 40)) AS p FROM events GROUP BY 1)""",
    "ocr_zoom": "SELECT p_partkey, round(greatest(least(4.0, 12000.0 / greatest(w, h), sqrt(30e6 / (w * h))), 0.1), 6) AS zoom FROM (SELECT p_partkey, greatest(p_size * 300.0, 1) AS w, greatest(p_retailprice * 5.0, 1) AS h FROM part)",
    "orientation": """
        SELECT l_orderkey AS page, CASE WHEN coalesce(max(l_discount * 10) FILTER (WHERE l_linenumber = 1), 0) < 0.9 AND max(l_quantity) FILTER (WHERE l_linenumber <> 1) > coalesce(max(l_quantity) FILTER (WHERE l_linenumber = 1), 0) * 1.2
            THEN concat('rot', arg_max(l_linenumber, l_quantity * 100 + l_linenumber) FILTER (WHERE l_linenumber <> 1)) ELSE 'none' END AS orientation FROM lineitem GROUP BY 1""",
    "metrics_valid": "SELECT session_id, count(*) AS samples, "
    + ", ".join(f"count({_VALID(c)}) AS n_{c}" for c in ("cpu_usage", "ram_usage_percent", "gpu_utilization", "vram_usage_percent", "power_usage_percent"))
    + f", round(avg({_VALID('cpu_usage')}), 6) AS avg_cpu FROM metrics_sample GROUP BY session_id",
    "metrics_once": f"SELECT session_id, count(*) AS samples, CAST(sum(sample_id) AS BIGINT) AS id_sum FROM {_ONCE} GROUP BY session_id",
    "metrics_tumbling": f"SELECT session_id, time_bucket(INTERVAL 1 HOUR, sample_ts) AS window_start, count(*) AS samples, round(avg(cpu_usage), 6) AS avg_cpu, round(max(cpu_usage), 6) AS max_cpu, round(avg(ram_usage_percent), 6) AS avg_ram, round(avg(gpu_utilization), 6) AS avg_gpu FROM {_ONCE} GROUP BY 1, 2",
    "metrics_sliding": """
        SELECT session_id, window_start, count(*) AS samples, round(avg(cpu_usage), 6) AS avg_cpu FROM (
            SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, sample_ts), time_bucket(INTERVAL 30 MINUTE, sample_ts) - INTERVAL 30 MINUTE]) AS window_start FROM metrics_sample) GROUP BY 1, 2""",
    "metrics_bursts": """
        SELECT session_id, min(sample_ts) AS burst_start, max(sample_ts) + INTERVAL 30 MINUTE AS burst_end, count(*) AS samples FROM (
            SELECT session_id, sample_ts, sum(CAST(gap AS INT)) OVER (PARTITION BY session_id ORDER BY sample_ts, sample_id ROWS UNBOUNDED PRECEDING) AS b FROM (
                SELECT session_id, sample_ts, sample_id, coalesce(sample_ts - lag(sample_ts) OVER (PARTITION BY session_id ORDER BY sample_ts, sample_id) > INTERVAL 30 MINUTE, TRUE) AS gap FROM metrics_sample)) GROUP BY session_id, b""",
    "metrics_history": """
        SELECT sample_id, count(*) OVER w AS in_history, round(avg(cpu_usage) OVER w, 6) AS mean_cpu FROM metrics_sample WINDOW w AS (PARTITION BY session_id ORDER BY sample_ts, sample_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""",
    "metrics_latest": "SELECT session_id, sample_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY sample_ts DESC, sample_id DESC) - 1 AS INT) AS age FROM metrics_sample QUALIFY age < 100",
    "metrics_lateness": "SELECT session_id, count(*) FILTER (WHERE arrived_ts - sample_ts > INTERVAL 1 HOUR) AS late, count(*) AS samples FROM metrics_sample GROUP BY session_id",
    "stream_tumbling": f"""
        SELECT session_id, window_start, samples, max_cpu FROM (
            SELECT session_id, time_bucket(INTERVAL 1 HOUR, sample_ts) AS window_start, count(*) AS samples, round(max(cpu_usage), 6) AS max_cpu FROM {_ONCE} GROUP BY 1, 2)
        WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(sample_ts) - INTERVAL 3 DAY FROM metrics_sample)""",
    "rel_join": "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    "rel_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "rel_cube": "SELECT lang, document_type, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY CUBE (lang, document_type)",
    "rel_window": "SELECT o_orderkey, rank() OVER w AS r, ntile(4) OVER w AS quartile, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "rel_set": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 100000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "rel_semi": "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49) AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)",
    "rel_median": "SELECT p_brand, count(*) AS n, round(median(p_retailprice), 4) AS middle FROM part GROUP BY p_brand",
}
