"""Standard SQL of more queries: compatibility forms, files and stores, markup, encoders, layout.

Compatibility composition is done here by a map of characters made from the
character database, page text by the rule that made the pages, and so on: each
by another way than the operator's own.
"""

from __future__ import annotations

import unicodedata

from quillmesh.plans.catalog_sql import _COS, _ESCAPED, _EXT, _HREF, _LINKS, _NO_RESULT, _PAGES, _SPACE, THOUGHTS, _strip, _topk

#: Characters with a compatibility form, and these forms.
_FORMS = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.decomposition(chr(c)).startswith("<")}


def _strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_WITH_FORMS = f"forms AS MATERIALIZED (SELECT MAP([{_strings(_FORMS)}], [{_strings(_FORMS.values())}]) AS m)"


def _nfkc(x: str) -> str:
    """Composition after each character has its compatibility form; plain ASCII as it is."""
    return rf"CASE WHEN regexp_matches({x}, '[^\x00-\x7f]') THEN nfc_normalize(array_to_string(list_transform(regexp_extract_all(nfc_normalize({x}), '(?s).'), lambda c: coalesce(forms.m[c], c)), '')) ELSE {x} END"


_DROPPED = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{fffd}\x{e000}-\x{f8ff}\x{ad}\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}\x{10000}-\x{10ffff}]"
_INNER_SPACE = r"[ \f\r\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _normalized(x: str, single: bool = False) -> str:
    """The stored form of a text, null if nothing is left."""
    t = rf"regexp_replace(regexp_replace({_nfkc(x)}, '\r', ' ', 'g'), '{_DROPPED}', '', 'g')"
    if single:
        t = f"regexp_replace({t}, '{_SPACE}+', ' ', 'g')"
    else:
        t = rf"regexp_replace(regexp_replace({t}, '{_INNER_SPACE}+', ' ', 'g'), ' *\n *', E'\n', 'g')"
        t = rf"regexp_replace({t}, '\n{{3,}}', E'\n\n', 'g')"
    return f"nullif({_strip(t)}, '')"


_ONE_LINE = rf"regexp_replace(regexp_replace(regexp_replace({_nfkc('text')}, '[\n\t\r]', ' ', 'g'), '[\x00-\x1f\x7f\x{{10000}}-\x{{10ffff}}]', '', 'g'), '{_SPACE}+', ' ', 'g')"

_CHUNKS = rf"""
    WITH {_WITH_FORMS},
    docs AS (SELECT row_number() OVER () AS r, file_path, coalesce(file_type = '.pdf', FALSE) AS pdf, page_content AS t FROM document_records),
    parts AS (SELECT r, file_path, pdf, CASE WHEN pdf THEN regexp_replace(t, '\[\[page(\d+)\]\]', '', 'g') ELSE {_strip("t")} END AS t,
        CASE WHEN pdf THEN string_split_regex(t, '\[\[page\d+\]\]') END AS pieces, CASE WHEN pdf THEN regexp_extract_all(t, '\[\[page(\d+)\]\]', 1) END AS pages FROM docs),
    marks AS (SELECT r, CAST(pages[k] AS INT) AS page, k, list_sum(list_transform(pieces[1:k], lambda x: length(x))) AS pos FROM (SELECT *, unnest(range(1, len(pages) + 1)) AS k FROM parts)),
    cut AS (SELECT r, file_path, pdf, s, {_strip("substring(t, CAST(s + 1 AS INT), 700)")} AS raw FROM (SELECT r, file_path, pdf, t, unnest(range(0, length(t), 450)) AS s FROM parts WHERE length(t) > 0)),
    numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY s) - 1 AS INT) AS chunk_idx FROM cut WHERE raw <> ''),
    chunks AS (SELECT file_path, chunk_idx, CAST(s AS INT) AS chunk_start, {_normalized("raw")} AS chunk,
        CASE WHEN pdf THEN coalesce((SELECT arg_max(m.page, m.k) FROM marks m WHERE m.r = c.r AND m.pos <= c.s), 1) END AS page_number FROM numbered c, forms)"""

# The corpus as files, and what the loaders make of them.
_KIND = "CASE WHEN doc_id % 11 = 10 THEN '.odt' WHEN doc_id % 4 = 0 THEN '.txt' WHEN doc_id % 4 = 1 THEN '.CSV' WHEN doc_id % 4 = 2 THEN '.html' ELSE '.eml' END"
_FILLED = f"{_strip('t')} <> ''"
_LOADED = rf"""(SELECT *, CASE WHEN kind = '.odt' THEN 'no loader for .odt' WHEN page_content IS NULL THEN 'no text' END AS error FROM (
    SELECT concat('/in/f', doc_id, kind) AS file_path, lower(kind) AS file_type, kind, CASE kind WHEN '.odt' THEN NULL WHEN '.txt' THEN CASE WHEN {_FILLED} THEN t END
        WHEN '.CSV' THEN concat(doc_id, ' ', t) WHEN '.html' THEN concat(doc_id, ' menu x', t, ' foot')
        ELSE concat('Subject: Note ', doc_id, CASE WHEN {_FILLED} THEN E'\n' || t ELSE '' END) END AS page_content
    FROM (SELECT doc_id, coalesce(text, '') AS t, {_KIND} AS kind FROM documents)))"""

_HOST = "https://docs.example/docs/"
_NAME = "regexp_replace(url, '^https://docs.example/docs/', 'docs.example_docs_')"
_MOST = "(SELECT hash FROM hash_chunk_ids WHERE hash <> '' GROUP BY hash ORDER BY count(*) DESC, hash LIMIT 1)"


def _embedded(d: int, texts: str) -> str:
    """(k, place, x): the places that aren't zero of each text, words placed by md5."""
    words = f"list_filter(string_split_regex(lower(t), '{_SPACE}+'), lambda w: w <> '')"
    return f"""(SELECT k, place, s / sqrt(sum(s * s) OVER (PARTITION BY k)) AS x FROM (
        SELECT k, place, CAST(sum(sign) AS DOUBLE) AS s FROM (
            SELECT k, CAST(('0x' || md5(w)[1:7])::BIGINT % {d} AS INT) AS place, CASE WHEN md5(w)[8] < '8' THEN 1 ELSE -1 END AS sign FROM (SELECT k, unnest({words}) AS w FROM {texts})) GROUP BY k, place) WHERE s <> 0)"""


# Words of each text on pages of forty, set in two columns.
_WORDS = r"(SELECT doc_id, CAST(floor((i - 1) / 40) AS INT) AS page, CAST((i - 1) % 40 AS INT) AS line_no, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split_regex(trim(text, ' '), ' +') AS w FROM documents WHERE text IS NOT NULL)))"
_LINES = f"(SELECT *, (doc_id + page * 40 + line_no) % 11 / 10.0 AS score, concat('bbox ', 520 * (line_no % 2), ' ', line_no // 2 * 30, ' ', 520 * (line_no % 2) + 400, ' ', line_no // 2 * 30 + 20) AS box FROM {_WORDS})"

# One step of the packer: pieces behind each other, parted by a control character, the last one growing.
_HELD = "string_split(a, chr(2))[-1]"
_PACK = f"CASE WHEN length({_HELD}) + length(b) + 1 <= 100 THEN a || ' ' || b WHEN {_HELD} = '' THEN a || b || chr(2) ELSE a || chr(2) || '<continue> ' || b END"
_BLANKS = r"[\s\x{0b}]+"

SQL: dict[str, str] = {
    "chunk_documents": _CHUNKS + " SELECT * FROM chunks WHERE chunk IS NOT NULL",
    "ingested_once": _CHUNKS + " SELECT file_path, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS characters FROM chunks WHERE chunk IS NOT NULL GROUP BY file_path",
    "split_counts": _CHUNKS.replace("file_path", "file_type").replace("page_content AS t FROM document_records", "page_content AS t FROM (SELECT lower(file_type) AS file_type, page_content FROM document_records UNION ALL SELECT '.png', chr(8203) || chr(173) || ' ' || chr(65279) FROM range(3))")
    + """ SELECT d.file_type, d.documents, coalesce(c.chunks, 0) AS chunks, coalesce(c.skipped, 0) AS skipped, CAST(coalesce(c.characters, 0) AS BIGINT) AS characters
        FROM (SELECT file_type, count(*) AS documents FROM docs GROUP BY 1) d
        LEFT JOIN (SELECT file_type, count(chunk) AS chunks, count(*) - count(chunk) AS skipped, sum(length(chunk)) AS characters FROM chunks GROUP BY 1) c ON c.file_type IS NOT DISTINCT FROM d.file_type""",
    "normalize_text": f"WITH {_WITH_FORMS} SELECT doc_id, {_normalized('text')} AS normalized FROM documents, forms",
    "normalize_single_line": f"WITH {_WITH_FORMS} SELECT doc_id, {_normalized('text', True)} AS normalized, CASE WHEN text IS NOT NULL THEN coalesce(nullif({_strip(_ONE_LINE)}, ''), ' ') END AS query_form FROM documents, forms",
    "loaded_files": f"SELECT file_path, file_type, page_content, sha256(page_content) AS hash, error FROM {_LOADED}",
    "loaded_pdfs": r"""
        SELECT concat('/in/f', doc_id, '.PDF') AS file_path, '.pdf' AS file_type, CASE WHEN w <> '' THEN '[[page2]]' || w END AS page_content, CASE WHEN w = '' THEN 'no text' END AS error
        FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'), ' ') AS w FROM documents)""",
    "ingest_counts": f"""
        SELECT file_type, count(*) AS files, count(*) FILTER (WHERE error IS NULL) AS read, count(*) FILTER (WHERE error = 'no text') AS empty, count(*) FILTER (WHERE error <> 'no text') AS failed,
            CAST(coalesce(sum(length(page_content)), 0) AS BIGINT) AS characters FROM {_LOADED} GROUP BY file_type""",
    "transcripts_again": "SELECT file_path, file_name, sha256(coalesce(page_content, '')) AS text_hash, document_type, creation_date, FALSE AS broken FROM document_records",
    "store_points": """
        SELECT CAST(vec_id AS VARCHAR) AS id, '{"label":' || label || '}' AS metadata, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm
        FROM embeddings WHERE vec_id IN (SELECT id FROM document_metadata)""",
    "store_without": f"""
        WITH kept AS (SELECT * FROM hash_chunk_ids WHERE hash <> '' AND hash <> {_MOST})
        SELECT 'vectors' AS part, count(*) AS n FROM kept UNION ALL SELECT 'hash_chunk_ids', count(*) FROM kept
        UNION ALL SELECT 'document_metadata', count(*) FROM document_metadata WHERE hash IS DISTINCT FROM {_MOST}""",
    "answers_gathered": r"""
        WITH RECURSIVE walk AS (SELECT doc_id AS conv_id, -1 AS n, '' AS piece, text AS rest FROM documents WHERE text <> '' UNION ALL
            SELECT conv_id, n + 1, left(rest, size), substring(rest, size + 1) FROM (
                SELECT *, CASE WHEN nl BETWEEN 1 AND 56 THEN CAST(ceil(nl / 7.0) * 7 AS INT) ELSE 56 END AS size FROM (SELECT *, position(E'\n' IN rest) AS nl FROM walk WHERE rest <> '')))
        SELECT conv_id, n, piece FROM walk WHERE n >= 0""",
    "sentence_packs": rf"""
        SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS n, unnest(l) AS piece FROM (
            SELECT doc_id, flatten(list_transform(string_split(regexp_replace(text, '([.!?]){_BLANKS}', '\1' || chr(1), 'g'), chr(1)), lambda s: CASE WHEN length(s) <= 100 THEN [s]
                ELSE list_filter(list_transform(string_split(list_reduce(list_filter(string_split_regex(s, '{_BLANKS}'), lambda w: w <> ''), lambda a, b: {_PACK}, ''), chr(2)), lambda p: {_strip("p")}), lambda p: p <> '') END)) AS l
            FROM documents WHERE text IS NOT NULL)""",
    "metrics_csv": "SELECT strftime(sample_ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, "
    + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in ("cpu_usage", "ram_usage_percent", "gpu_utilization", "vram_usage_percent", "power_usage_percent", "power_limit_percent"))
    + " FROM metrics_sample",
    "padded_tokens": rf"""
        WITH sized AS (SELECT doc_id, CAST(floor(doc_id / 5000) AS BIGINT) AS shard, least(n, 512) AS n FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '{_BLANKS}'), lambda w: w <> '')) AS n FROM documents) WHERE n > 0),
        placed AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY shard ORDER BY n DESC, doc_id) - 1) / 64) AS INT) AS batch_id FROM sized)
        SELECT shard, batch_id, max(n) AS shortest, max(n) AS longest, CAST(sum(n) AS BIGINT) AS real_tokens FROM placed GROUP BY shard, batch_id""",
    "hashed_embeddings": f"""
        SELECT d.doc_id, d.place, round(coalesce(e.x, 0), 4) AS x FROM (SELECT doc_id, CAST(unnest(range(0, 16)) AS INT) AS place FROM documents) d
        LEFT JOIN {_embedded(16, "(SELECT doc_id AS k, text AS t FROM documents)")} e ON e.k = d.doc_id AND e.place = d.place""",
    "search_words": f"""
        SELECT doc_id, round(greatest(0, least(1, cos)), 4) AS similarity_score FROM (
            SELECT c.k AS doc_id, coalesce(sum(c.x * q.x), 0) AS cos FROM {_embedded(32, "(SELECT doc_id AS k, text AS t FROM documents)")} c
            LEFT JOIN {_embedded(32, "(SELECT 0 AS k, 'Which committee checks the harbour records?' AS t)")} q ON q.place = c.place GROUP BY c.k)
        QUALIFY row_number() OVER (ORDER BY round(cos, 6) DESC, doc_id) <= 20""",
    "search_prefiltered": f"""
        SELECT vec_id AS doc_id, round(greatest(0, least(1, {_COS})), 6) AS similarity_score, CAST(row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS INT) AS rank
        FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
        WHERE contains(lower(d.text), 'the') AND d.document_type = 'document' QUALIFY rank <= 20""",
    "citation_html": rf"""
        WITH hits AS (SELECT m.file_path, m.file_name, h.cos, h.rank FROM (SELECT vec_id, greatest(0, least(1, cos)) AS cos, rank FROM {_topk(10)}) h JOIN document_metadata m ON m.id = h.vec_id),
        cited AS (SELECT file_path, arg_min(coalesce(file_name, 'Unknown'), rank) AS name, {_EXT} AS kind, min(cos) AS low, max(cos) AS high FROM hits GROUP BY file_path),
        items AS (SELECT low, concat('<li><a href="file:', {_ESCAPED('file_path')}, '">', {_ESCAPED('name')}, '</a> [', printf('%.4f', round(low, 4)), CASE WHEN high > low THEN concat('-', printf('%.4f', round(high, 4))) ELSE '' END, ']',
            CASE WHEN kind = '.pdf' THEN ' Pages: 1' ELSE '' END, '</li>') AS item FROM cited)
        SELECT concat('<ol>', string_agg(item, '' ORDER BY low, item), '</ol>') AS html FROM items""",
    "reading_order": f"""
        SELECT doc_id, page, line_no, CASE WHEN line_no % 2 = 0 THEN line_no // 2 ELSE (m + 1) // 2 + line_no // 2 END AS position
        FROM (SELECT doc_id, page, line_no, count(*) OVER (PARTITION BY doc_id, page) AS m FROM {_WORDS})""",
    "hocr": rf"""
        SELECT doc_id, page, coalesce(string_agg(concat('<span class=''ocr_line'' id=''line_', line_no, ''' title=''', box, '''><span class=''ocrx_word'' id=''word_', line_no, ''' title=''', box, '; x_wconf ', CAST(round(score * 100) AS INT), '''>', {_ESCAPED('word')}, '</span></span>'), E'\n' ORDER BY line_no) FILTER (WHERE score >= 0.3), '') AS body,
            count(*) FILTER (WHERE score >= 0.3) AS emitted, count(*) FILTER (WHERE score < 0.3) AS dropped, count(*) FILTER (WHERE score >= 0.3 AND score < 0.6 AND length(word) >= 3) AS flagged, round(coalesce(avg(score) FILTER (WHERE score >= 0.3), 0), 6) AS mean_conf
        FROM {_LINES} WHERE word <> '' GROUP BY doc_id, page""",
    "sentences_kept": rf"SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS n, unnest(l) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){_BLANKS}', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents WHERE text IS NOT NULL)",
    "flattened_texts": "SELECT CAST(floor(doc_id / 5) AS BIGINT) AS n, coalesce(string_agg(text, ' ' ORDER BY doc_id) FILTER (WHERE text <> ''), '') AS text FROM documents GROUP BY 1",
    "stream_answers": rf"SELECT doc_id AS conv_id, regexp_replace(regexp_replace({THOUGHTS}, '(?s)<think>.*?</think>|<thinking>.*$', '', 'g'), '^{_SPACE}+', '') AS answer FROM documents WHERE {THOUGHTS} IS NOT NULL",
    "file_compatibility": f"""
        SELECT file_path AS path, coalesce({_EXT} IN ('.pdf', '.docx', '.txt', '.eml', '.msg', '.csv', '.xls', '.xlsx', '.xlsm', '.rtf', '.md', '.html', '.htm'), FALSE) AS known
        FROM (SELECT concat(file_path, CASE WHEN id % 5 = 0 THEN '.bak' ELSE '' END) AS file_path FROM document_metadata WHERE file_path IS NOT NULL)""",
    "file_times": "SELECT doc_id, strftime(ingested_at, '%Y-%m-%dT%H:%M:%S.%f') AS ingested FROM documents",
    "own_databases": "SELECT db_name, chunk_size FROM created_databases WHERE db_name <> 'user_manual'",
    "search_nothing": f"SELECT '{_NO_RESULT}' AS response",
    "index_seeds": "SELECT CAST(floor(doc_id / 50) AS BIGINT) AS n, concat('https://docs.example/guide/', doc_id) AS url FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0",
    "restored_order": "SELECT doc_id, length(text) AS n_tokens FROM documents WHERE text IS NOT NULL",
    "line_scores": f"""
        SELECT doc_id, page, round(sum(CASE WHEN length(word) >= 3 THEN score * length(word) ELSE 0 END), 4) AS mass, round(coalesce(avg(score) FILTER (WHERE length(word) >= 3), 0), 6) AS confidence FROM {_LINES} GROUP BY doc_id, page""",
    "turned_boxes": """
        SELECT p_partkey, turns, round(CASE turns WHEN 0 THEN 0.5 WHEN 1 THEN w - 1 - h / 2 WHEN 2 THEN w - 1 - w / 2 ELSE 2.0 END, 4) AS x0, round(CASE turns WHEN 0 THEN 2.0 WHEN 1 THEN 0.5 WHEN 2 THEN h - 1 - h / 2 ELSE h - 1 - w / 2 END, 4) AS y0,
            round(CASE turns WHEN 0 THEN w / 2 WHEN 1 THEN w - 1 - 2 WHEN 2 THEN w - 1 - 0.5 ELSE h / 2 END, 4) AS x1, round(CASE turns WHEN 0 THEN h / 2 WHEN 1 THEN w / 2 WHEN 2 THEN h - 1 - 2 ELSE h - 1 - 0.5 END, 4) AS y1
        FROM (SELECT p_partkey, CAST(p_size + 10 AS DOUBLE) AS w, CAST(p_partkey % 50 + 10 AS DOUBLE) AS h, CAST(unnest(range(0, 4)) AS INT) AS turns FROM part)""",
    "outputs_verified": """
        SELECT doc_id, problem IS NULL AS ok, problem FROM (
            SELECT o_orderkey AS doc_id, CASE WHEN pages IS NULL THEN 'missing' WHEN pages <> 4 THEN 'page count' WHEN o_orderkey % 3 = 0 AND chars = 0 THEN 'no text' END AS problem
            FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS pages, sum(CASE WHEN l_returnflag = 'R' THEN 7 ELSE 0 END) AS chars FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1) ON l_orderkey = o_orderkey)""",
    "page_metrics": f"""
        SELECT doc_id, page, words, CASE WHEN filled > 0 THEN emitted END AS emitted, CASE WHEN filled > 0 THEN filled - emitted END AS dropped FROM (
            SELECT doc_id, page, CAST(count(*) AS INT) AS words, count(*) FILTER (WHERE word <> '') AS filled, count(*) FILTER (WHERE word <> '' AND score >= 0.3) AS emitted FROM {_LINES} GROUP BY doc_id, page)""",
    "tokenized": r"""
        SELECT doc_id, CASE WHEN bad THEN NULL ELSE least(length(t), 512) END AS tokens, CASE WHEN NOT bad THEN CAST(coalesce(list_sum(list_transform(regexp_extract_all(left(t, 512), '(?s).'), lambda c: unicode(c))), 0) AS BIGINT) END AS total, CASE WHEN bad THEN 'ValueError: tab' END AS error
        FROM (SELECT doc_id, coalesce(text, '') AS t, contains(coalesce(text, ''), chr(9)) AS bad FROM documents)""",
    "tokens_to_resume": "SELECT doc_id, source FROM documents WHERE doc_id % 3 <> 0",
    "chunk_metadata": r"""
        SELECT doc_id, concat('{', array_to_string(list_filter([CASE WHEN source IS NOT NULL THEN '"source":"' || source || '"' END, CASE WHEN lang IS NOT NULL THEN '"lang":"' || lang || '"' END,
            CASE WHEN ingested_at IS NOT NULL THEN '"ingested_at":"' || regexp_replace(regexp_replace(strftime(ingested_at, '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '\.$', '') || '"' END,
            concat('"both":"[', CASE WHEN source IS NULL THEN 'null' ELSE '\"' || source || '\"' END, ',', CASE WHEN lang IS NULL THEN 'null' ELSE '\"' || lang || '\"' END, ']"')], lambda x: x IS NOT NULL), ','), '}') AS metadata FROM documents""",
    "html_strip_cruft": rf"SELECT doc_id, regexp_replace(html, '(?is)<(script|style|nav|footer|svg)\b.*?</(script|style|nav|footer|svg)>|<!--.*?-->', '', 'g') AS html FROM {_PAGES}",
    "html_saved": f"SELECT concat('docs.example_docs_', doc_id) AS file_name, url, replace(html, '<body>', concat('<body><a href=\"', url, '\">Original Source</a>')) AS html FROM {_PAGES}",
    "html_by_site": f"""
        SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN concat('<html><head><style>p {{}}</style></head><body><nav>menu</nav>', article, '<script>var x = "</p>";</script><!-- end --></article><footer>foot</footer></body></html>')
            WHEN doc_id = 7 THEN '<html><body></body></html>' ELSE concat('<html><body>', replace(replace(article, '&quot;', chr(34)), '&#x27;', chr(39)), '</article></body></html>') END AS content
        FROM (SELECT doc_id, concat('<article class="bd-article"><h1>', coalesce(source, 'page'), '</h1><p>', {_ESCAPED("coalesce(text, '')")}, '</p>', {_HREF}) AS article FROM documents)""",
    "markdown_pages": rf"""
        SELECT doc_id, concat(E'# Title

>', CASE WHEN w <> '' THEN ' ' || w ELSE '' END, E'

## More

see `<b>`') AS plain,
            concat(E'<h1>Title</h1>
<blockquote>
', CASE WHEN w <> '' THEN concat('<p>', w, E'</p>
') ELSE '' END, E'</blockquote>
<h2>More</h2>
<p>see <code>&lt;b&gt;</code></p>') AS page
        FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'), ' ') AS w FROM documents)""",
    "html_main_content": f"""
        SELECT doc_id, concat('<html><body><article class="bd-article"><h1>', coalesce(source, 'page'), '</h1><p>', replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</p>', {_HREF}, '</article></body></html>') AS content,
            {_strip(f"regexp_replace(concat(coalesce(source, 'page'), ' ', coalesce(text, ''), ' one two three'), '{_SPACE}+', ' ', 'g')")} AS text
        FROM documents""",
    "crawl": f"""
        WITH RECURSIVE edges AS MATERIALIZED (SELECT url, link FROM {_LINKS}),
        reach(url, depth) USING KEY (url) AS (SELECT '{_HOST}1', 0 UNION SELECT e.link, min(r.depth) + 1 FROM reach r JOIN edges e ON e.url = r.url
            WHERE e.link NOT IN (SELECT url FROM recurring.reach) GROUP BY e.link)
        SELECT url, depth FROM reach""",
    "crawl_tries": """
        SELECT url, CASE WHEN bool_or(status = 200) THEN 200 ELSE arg_max(status, attempt) END AS status, coalesce(min(attempt) FILTER (WHERE status = 200), max(attempt)) AS attempts, NOT bool_or(status = 200) AS failed
        FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY event_id) AS attempt FROM (
            SELECT concat('https://docs.example/', event_id % 97, '/', user_id) AS url, event_id, CASE event_type WHEN 'error' THEN 429 WHEN 'purchase' THEN 200 ELSE 404 END AS status FROM events)) WHERE attempt <= 3 GROUP BY url""",
    "seeds_merged": f"SELECT url, CAST(row_number() OVER (ORDER BY doc_id % 2, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE -doc_id END) AS INT) AS position FROM (SELECT doc_id, concat('{_HOST}', doc_id) AS url FROM documents)",
    "queue_unsaved": f"SELECT url, {_NAME} AS file_name FROM (SELECT doc_id, concat('{_HOST}', doc_id) AS url FROM documents) WHERE doc_id % 3 <> 0",
    "page_sidecars": f"SELECT {_NAME} AS file_name, coalesce(string_agg(link, E'\\n' ORDER BY link), '') AS links FROM (SELECT concat('{_HOST}', doc_id) AS url FROM documents) LEFT JOIN {_LINKS} l USING (url) GROUP BY url",
    "resumed_queue": f"""
        SELECT link AS url FROM {_LINKS} WHERE CAST(regexp_extract(url, '[0-9]+$') AS BIGINT) % 5 = 0
        UNION SELECT concat('{_HOST}', doc_id) FROM documents WHERE doc_id % 7 = 0 OR doc_id < 3""",
}
