"""The jobs as registered queries: each runs twice into one new folder, and its whole output is read back."""

from __future__ import annotations

from corpusloom.functions import rules
from corpusloom.operators.state import new_folder
from corpusloom.plans import queries as catalogue
from jobs import chunk_feed, prompt_batch


def job1_chunk_feed(spark, sf_dir):
    out = new_folder(spark, "job1-chunk-feed")
    for _ in range(2):
        chunk_feed.run(spark, f"{sf_dir}/documents.parquet", out)
    return chunk_feed.current(spark, out).select("chunk_id", "doc_id", "chunk_index", "text", "token_estimate", "paragraph_start", "paragraph_end", "chunk_char_count", "content_hash", "source")


def job2_prompt_batch(spark, sf_dir):
    out = new_folder(spark, "job2-prompt-batch")
    for _ in range(2):
        prompt_batch.run(spark, f"{sf_dir}/embeddings.parquet", f"{sf_dir}/documents.parquet", out)
    return prompt_batch.read(spark, out)


QUERIES = {"job1_chunk_feed": job1_chunk_feed, "job2_prompt_batch": job2_prompt_batch}

# Normalised documents: characters, page numbers and boilerplate, repeated lines, white space (the table has no code blocks).
CLEAN = f"""(WITH z AS (SELECT doc_id, translate(translate(translate(coalesce(text, ''), '{rules.ZERO_WIDTH}', ''), '{rules.SPECIAL_FROM}', '{rules.SPECIAL_TO.replace("'", "''")}'), '{rules.BULLETS}', '{"-" * len(rules.BULLETS)}') AS t FROM documents WHERE doc_id IS NOT NULL),
    y AS (SELECT doc_id, list_filter({catalogue.lines_without(catalogue.PAGE_RE, "t")}, lambda l: NOT regexp_matches(l, '{catalogue.BOILER_RE}')) AS ls FROM z),
    x AS (SELECT doc_id, unnest(CASE WHEN len(ls) = 0 THEN [''] ELSE ls END) AS line, generate_subscripts(CASE WHEN len(ls) = 0 THEN [''] ELSE ls END, 1) AS i FROM y),
    w AS (SELECT *, {catalogue.strip("line")} AS bare, count(*) OVER (PARTITION BY doc_id) AS n, count(*) OVER (PARTITION BY doc_id, {catalogue.strip("line")}) AS k FROM x),
    v AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT (n >= 3 AND k >= 2 AND bare <> '' AND len(bare) < 100)), '') AS t FROM w GROUP BY doc_id)
    SELECT doc_id, {catalogue.strip(catalogue.WS.format("v.t"))} AS text FROM v)"""

ORACLES = {
    "job1_chunk_feed": "SELECT c.*, sha256(coalesce(o.text, '')) AS content_hash, o.source FROM (" + catalogue.CHUNK_SQL.replace(catalogue.D, CLEAN) + ") c JOIN documents o USING (doc_id)",
    "job2_prompt_batch": f"""WITH h AS (SELECT t.query_id, t.rank, t.distance, d.text, '/' || d.source AS relative_path, d.lang AS section FROM ({catalogue.TOP}) t JOIN documents d ON d.doc_id = t.id WHERE t.rank <= 3),
        c AS (SELECT query_id, count(*) AS n_chunks,
            string_agg('[' || rank || '] (' || coalesce(nullif(concat_ws(' | ', relative_path, 'section: ' || section), ''), 'unknown source') || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context,
            string_agg('  [' || rank || '] ' || coalesce(relative_path, 'unknown') || printf(' (dist: %.4f)', round(abs(distance), 6)) || chr(10) || '      ' || replace(substr(text, 1, 100), chr(10), ' ') || '...', chr(10) ORDER BY rank) AS sources
            FROM h GROUP BY query_id)
        SELECT q.vec_id AS query_id, 'What do the sources say about item ' || q.vec_id || '?' AS question, coalesce(n_chunks, 0) AS n_chunks, context, replace('{catalogue.A.SYSTEM_PROMPT.replace("'", "''")}', '{{context}}', context) AS system_prompt, sources, q.label
        FROM embeddings q LEFT JOIN c ON c.query_id = q.vec_id WHERE q.vec_id % 50 = 0""",
}
