"""Query catalogue: one entry for each operator group, with the SQL that says the same.

Every query reads whole tables.  Where the corpus lacks what an operator works
on (markers, fences, typographic characters), the query adds it to the texts
first, and so does the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions import text as T
from corpusloom.operators import answer as A
from corpusloom.operators import chunk as C
from corpusloom.operators import index as I
from corpusloom.operators import carry, ivf, lsa
from corpusloom.operators import metadata as V
from corpusloom.operators import normalize as N
from corpusloom.operators import retrieve as R
from corpusloom.operators import state
from corpusloom.operators.buckets import Buckets
from corpusloom.operators.embed import embed_hashed
from corpusloom.operators.markdown import structure
from corpusloom.operators.state import new_folder

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, before: str = "''", after: str = "''") -> DataFrame:
    """doc_id and text of all documents, with expressions put around the text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(f"concat({before}, coalesce(text, ''), {after})").alias("text"))


# ------------------------------------------------------------ SQL pieces
def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def lines_without(pattern: str, text: str) -> str:
    return rf"list_filter(string_split({text}, chr(10)), lambda l: NOT regexp_matches(l, '{pattern}'))"


PAGE_RE = "|".join(f"(?:{p})" for p in rules.PAGE_NUMBERS)
BOILER_RE = "|".join(f"(?:{p})" for p in rules.BOILERPLATE).replace("'", "''")
EST = r"greatest(1, len(regexp_extract_all({}, '[\pL\pN_]+|[^\s]')))"
WS = r"regexp_replace(regexp_replace(regexp_replace(replace(replace({}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)[ \t]+$', '', 'g'), '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
D = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"


# ------------------------------------------------------------ N: normalisation
@query(
    "basic_normalize",
    rf"""SELECT doc_id, {strip("regexp_replace(regexp_replace(translate(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '{0}', '{1}'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g')".format(rules.BASIC_FROM, rules.BASIC_TO.replace("'", "''")))} AS text
    FROM (SELECT doc_id, '  “' || text || '”' || chr(13) || chr(10) || chr(13) || chr(10) || chr(10) || 'a  –  b ' AS t FROM {D})""",
)
def basic_normalize(spark, sf):
    return texts(spark, sf, "'  “'", "concat('”', char(13), char(10), char(13), char(10), char(10), 'a  –  b ')").select("doc_id", T.basic(F.col("text")).alias("text"))


INJECT = "concat('“a”–b • c', '​', 'd', ' e')"
INJECT_SQL = "'“a”–b • c' || '​' || 'd' || ' e'"


@query(
    "char_rules",
    f"""WITH d AS (SELECT doc_id, text || {INJECT_SQL} AS t FROM {D}),
    z AS (SELECT doc_id, len(t) - len(translate(t, '{rules.ZERO_WIDTH}', '')) AS zero_width, translate(t, '{rules.ZERO_WIDTH}', '') AS t FROM d),
    s AS (SELECT doc_id, zero_width, len(t) - len(translate(t, '{rules.SPECIAL_FROM}', '')) AS special_chars, translate(t, '{rules.SPECIAL_FROM}', '{rules.SPECIAL_TO.replace("'", "''")}') AS t FROM z)
    SELECT doc_id, zero_width::INT AS zero_width, special_chars::INT AS special_chars, (len(t) - len(translate(t, '{rules.BULLETS}', '')))::INT AS bullets,
           translate(t, '{rules.BULLETS}', '{"-" * len(rules.BULLETS)}') AS text FROM s""",
)
def char_rules(spark, sf):
    out = N.zero_width(texts(spark, sf, after=INJECT), "text", "a", "zero_width")
    out = N.bullets(N.special_chars(out, "a", "b", "special_chars"), "b", "c", "bullets")
    return out.select("doc_id", "zero_width", "special_chars", "bullets", F.col("c").alias("text"))


def _line_query(name: str, rule, after: str, after_sql: str, pattern: str) -> None:
    sql = f"""SELECT doc_id, (len(string_split(t, chr(10))) - len({lines_without(pattern, "t")}))::INT AS removed, array_to_string({lines_without(pattern, "t")}, chr(10)) AS text
    FROM (SELECT doc_id, text || {after_sql} AS t FROM {D})"""

    @query(name, sql)
    def run(spark, sf):
        return rule(texts(spark, sf, after=after), "text", "out", "removed").select("doc_id", "removed", F.col("out").alias("text"))


_line_query("page_number_lines", N.page_numbers, r"concat('\nPage ', doc_id, '\n - 3 - \nx\n(', doc_id, ')\np. 7')", "chr(10) || 'Page ' || doc_id || chr(10) || ' - 3 - ' || chr(10) || 'x' || chr(10) || '(' || doc_id || ')' || chr(10) || 'p. 7'", PAGE_RE)
_line_query("boilerplate_lines", N.boilerplate, r"'\nDRAFT\n for internal use only \nCopyright (c) 2020 x\nnot a draft'", "chr(10) || 'DRAFT' || chr(10) || ' for internal use only ' || chr(10) || 'Copyright (c) 2020 x' || chr(10) || 'not a draft'", BOILER_RE)
_line_query("custom_lines", lambda d, a, b, n: N.custom_lines(d, a, b, n, [r"[A-Z]\w+ the", r"\s*Licensed"]), "''", "''", r"^(?:[A-Z][0-9A-Za-z_\pL\pN]+ the|\s*Licensed)")


@query(
    "repeated_lines",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {D}),
    c AS (SELECT *, {strip("line")} AS bare, count(*) OVER (PARTITION BY doc_id) AS n, count(*) OVER (PARTITION BY doc_id, {strip("line")}) AS k FROM l),
    m AS (SELECT *, n >= 3 AND k >= 2 AND bare <> '' AND len(bare) < 100 AS gone FROM c)
    SELECT doc_id, count_if(gone)::INT AS removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id""",
)
def repeated_lines(spark, sf):
    return N.repeated_lines(texts(spark, sf), "text", "out", "removed").select("doc_id", "removed", F.col("out").alias("text"))


@query(
    "custom_replacements",
    f"""SELECT doc_id, ((len(text) - len(replace(text, 'the', ''))) / 3 + (len(replace(text, 'the', 'THE')) - len(replace(replace(text, 'the', 'THE'), '. ', ''))) / 2)::INT AS replaced,
    replace(replace(text, 'the', 'THE'), '. ', '.  ') AS text FROM {D}""",
)
def custom_replacements(spark, sf):
    return N.replacements(texts(spark, sf), "text", "out", "replaced", {"the": "THE", ". ": ".  "}).select("doc_id", "replaced", F.col("out").alias("text"))


@query("whitespace_rule", f"SELECT doc_id, {WS.format('t')} AS text FROM (SELECT doc_id, replace(text, ', ', ',  ' || chr(9)) || ' ' || chr(9) || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || 'z ' AS t FROM {D})")
def whitespace_rule(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(r"concat(replace(coalesce(text, ''), ', ', ',  \t'), ' \t\r\n\n\n\nz ')").alias("text"))
    return docs.select("doc_id", N.whitespace(F.col("text")).alias("text"))


@query(
    "code_blocks",
    f"""SELECT doc_id, 'preserve_code_blocks,normalize_whitespace' AS rules_applied, replace({strip(WS.format("text || chr(10) || '@@@' || chr(10) || 'tail  end  '"))}, '@@@', '```py  ' || doc_id || chr(10) || '  “x”  ```') AS text FROM {D}""",
)
def code_blocks(spark, sf):
    config = N.NormalizationConfig(False, False, False, True, False, False, False, True)
    docs = texts(spark, sf, after=r"concat('\n```py  ', doc_id, '\n  “x”  ```\ntail  end  ')")
    return N.normalize(docs, config).select("doc_id", F.array_join("normalized.rules_applied", ",").alias("rules_applied"), "normalized.text")


@query(
    "normalize_report",
    f"""WITH d AS (SELECT doc_id, text AS t0, text || chr(10) || 'Page ' || doc_id || chr(10) || '• “q”' AS t FROM {D}),
    s AS (SELECT doc_id, len(t) AS original_length, len(t) - len(translate(t, '{rules.SPECIAL_FROM}', '')) AS special_chars, len(t) - len(translate(t, '{rules.BULLETS}', '')) AS bullet_chars,
        translate(translate(t, '{rules.SPECIAL_FROM}', '{rules.SPECIAL_TO.replace("'", "''")}'), '{rules.BULLETS}', '{"-" * len(rules.BULLETS)}') AS t FROM d),
    p AS (SELECT *, {lines_without(PAGE_RE, "t")} AS l1, string_split(t, chr(10)) AS l0 FROM s),
    b AS (SELECT *, list_filter(l1, lambda l: NOT regexp_matches(l, '{BOILER_RE}')) AS l2 FROM p),
    l AS (SELECT doc_id, unnest(l2) AS line, generate_subscripts(l2, 1) AS i FROM b),
    c AS (SELECT *, {strip("line")} AS bare, count(*) OVER (PARTITION BY doc_id) AS n, count(*) OVER (PARTITION BY doc_id, {strip("line")}) AS k FROM l),
    m AS (SELECT doc_id, count_if(gone) AS headers, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t FROM (SELECT *, n >= 3 AND k >= 2 AND bare <> '' AND len(bare) < 100 AS gone FROM c) GROUP BY doc_id)
    SELECT doc_id, original_length::INT AS original_length, len({strip(WS.format("m.t"))})::INT AS normalized_length, special_chars::INT AS special_chars, bullet_chars::INT AS bullet_chars,
        (len(l0) - len(l1))::INT AS page_numbers, (len(l1) - len(l2))::INT AS boilerplate, headers::INT AS headers_footers,
        array_to_string(list_filter(['normalize_special_chars', 'normalize_bullets', 'remove_page_numbers', CASE WHEN len(l1) > len(l2) THEN 'remove_boilerplate' END, CASE WHEN headers > 0 THEN 'remove_headers_footers' END, 'normalize_whitespace'], lambda x: x IS NOT NULL), ',') AS rules_applied
    FROM b JOIN m USING (doc_id)""",
)
def normalize_report(spark, sf):
    done = N.normalize(texts(spark, sf, after=r"concat('\nPage ', doc_id, '\n• “q”')"))
    count = lambda k: F.coalesce(F.try_element_at("normalized.removed_patterns", F.lit(k)), F.lit(0)).alias(k)
    return done.select(
        "doc_id", "normalized.original_length", "normalized.normalized_length", *map(count, ("special_chars", "bullet_chars", "page_numbers", "boilerplate", "headers_footers")), F.array_join("normalized.rules_applied", ",").alias("rules_applied")
    )


# ------------------------------------------------------------ C: tokens, units, chunks
@query("token_estimate", f"SELECT doc_id, {EST.format('text')}::INT AS tokens FROM {D}")
def token_estimate(spark, sf):
    return texts(spark, sf).select("doc_id", T.estimate_tokens(F.col("text")).cast("int").alias("tokens"))


SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({{}}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"


@query("sentences", f"SELECT doc_id, unnest(s) AS sentence, (generate_subscripts(s, 1) - 1)::INT AS i FROM (SELECT doc_id, {SENTENCES.format(strip('text'))} AS s FROM {D})")
def sentences(spark, sf):
    return texts(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))


@query(
    "paragraphs",
    rf"""SELECT doc_id, unnest(s) AS paragraph, (generate_subscripts(s, 1) - 1)::INT AS i FROM (
        SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda x: {strip("x")}), lambda x: x <> '') AS s
        FROM (SELECT doc_id, replace(text, '. ', '.' || chr(10) || ' ' || chr(10)) || chr(10) || chr(10) || 'end' AS t FROM {D}))""",
)
def paragraphs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(r"concat(replace(coalesce(text, ''), '. ', '.\n \n'), '\n\nend')").alias("text"))
    return docs.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("i", "paragraph"))


def packing(units: str, size: int, overlap: int) -> str:
    """CTEs after ``u(doc_id, i, n)`` (i from 1): rec(doc_id, st, en) holds the packed ranges.

    fit is the last unit that fits from a start, back the start of the overlap for an end; both by as-of joins
    on prefix sums, so that the recursion only follows pointers.
    """
    return f"""{units},
    pre AS (SELECT doc_id, i, sum(n) OVER w AS p, sum(n) OVER w - n AS q, max(i) OVER (PARTITION BY doc_id) AS last FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    ends AS (SELECT doc_id, p, max(i) AS i FROM pre GROUP BY ALL),
    begins AS (SELECT doc_id, q, max(i) AS i FROM pre GROUP BY ALL),
    fits AS (SELECT a.doc_id, a.i, greatest(a.i, coalesce(b.i, a.i)) AS fit FROM pre a ASOF LEFT JOIN ends b ON a.doc_id = b.doc_id AND a.q + {size} >= b.p),
    backs AS (SELECT a.doc_id, a.i, coalesce(b.i, 1) AS back FROM pre a ASOF LEFT JOIN begins b ON a.doc_id = b.doc_id AND a.p - {overlap} >= b.q),
    nxt AS (SELECT f.doc_id, f.i, f.fit, k.back, e.last FROM fits f JOIN backs k USING (doc_id, i) JOIN pre e USING (doc_id, i)),
    rec AS (
        SELECT doc_id, 0::BIGINT AS c, i AS st, fit AS en, last FROM nxt WHERE i = 1
        UNION ALL
        SELECT r.doc_id, r.c + 1, s.i, greatest(r.en + 1, s.fit), r.last
        FROM rec r JOIN nxt e ON e.doc_id = r.doc_id AND e.i = r.en JOIN nxt s ON s.doc_id = r.doc_id AND s.i = least(r.en, greatest(r.st, e.back))
        WHERE r.en < r.last)"""


@query(
    "chunk_ranges",
    "WITH RECURSIVE s AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, " + SENTENCES.format(strip("text")) + f" AS l FROM {D})), "
    + packing(f"u AS (SELECT doc_id, i, {EST.format('x')} AS n FROM s)", 60, 9)
    + " SELECT doc_id, c::INT AS chunk_index, (st - 1)::INT AS first_unit, (en - 1)::INT AS last_unit FROM rec",
)
def chunk_ranges(spark, sf):
    docs = texts(spark, sf).withColumn("n", T.fence(F.transform(T.sentences(F.col("text")), lambda x: T.estimate_tokens(x).cast("int"))))
    ranges = docs.select("doc_id", C.chunk_ranges(F.col("n"), C.ChunkConfig(60, 0.15)).alias("r"))
    return ranges.select("doc_id", F.posexplode("r").alias("chunk_index", "x")).select("doc_id", "chunk_index", F.col("x.first").alias("first_unit"), F.col("x.last").alias("last_unit"))


def word_packing(size: int) -> str:
    """CTEs after ``lw(k, wi, word, n)`` (wi from 1, n <= size): wrec(k, c, st, en)."""
    return f"""wp AS (SELECT *, sum(n + 1) OVER w AS p, sum(n + 1) OVER w - n - 1 AS q, max(wi) OVER (PARTITION BY k) AS last FROM lw WINDOW w AS (PARTITION BY k ORDER BY wi)),
    wfit AS (SELECT a.k, a.wi, a.last, greatest(a.wi, b.wi) AS fit FROM wp a ASOF JOIN wp b ON a.k = b.k AND a.q + {size} + CASE WHEN a.wi > 1 OR a.n = {size} THEN 1 ELSE 0 END >= b.p),
    wrec AS (SELECT k, 0 AS c, wi AS st, fit AS en, last FROM wfit WHERE wi = 1
        UNION ALL SELECT r.k, r.c + 1, f.wi, f.fit, r.last FROM wrec r JOIN wfit f ON f.k = r.k AND f.wi = r.en + 1 WHERE r.en < r.last)"""


@query(
    "word_units",
    rf"""WITH RECURSIVE t AS (SELECT doc_id AS k, string_split_regex({strip("text")}, '\s+') AS l FROM {D} WHERE {strip("text")} <> ''),
    lw AS (SELECT k, generate_subscripts(l, 1) AS wi, unnest(l) AS word, {EST.format("unnest(l)")} AS n FROM t), {word_packing(50)}
    SELECT k AS doc_id, c::INT AS i, st::INT - 1 AS first_word, en::INT - 1 AS last_word FROM wrec""".replace(EST.format("unnest(l)"), EST.format("word")).replace("unnest(l) AS word, " + EST.format("word") + " AS n FROM t)", "unnest(l) AS word FROM t), lw AS (SELECT *, " + EST.format("word") + " AS n FROM lw0)").replace("lw AS (SELECT k, generate", "lw0 AS (SELECT k, generate"),
)
def word_units(spark, sf):
    docs = texts(spark, sf).withColumn("n", T.fence(F.transform(T.words(F.col("text")), lambda w: T.estimate_tokens(w).cast("int"))))
    out = docs.select("doc_id", F.posexplode(C.word_ranges(F.col("n"), 50)).alias("i", "r"))
    return out.select("doc_id", "i", F.col("r.first").alias("first_word"), F.col("r.last").alias("last_word"))


SIZE, OVERLAP = 60, 9
CHUNK_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, {strip("text")} AS t FROM {D}),
    pl AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda x: {strip("x")}), lambda x: x <> '') AS l FROM d),
    p AS (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [''] ELSE l END) AS x, generate_subscripts(CASE WHEN len(l) = 0 THEN [''] ELSE l END, 1) AS pi FROM pl),
    pn AS (SELECT *, CASE WHEN x = '' THEN 0 ELSE {EST.format("x")} END AS n FROM p),
    sl AS (SELECT doc_id, pi, CASE WHEN n <= {SIZE} THEN [x] ELSE {SENTENCES.format("x")} END AS l FROM pn),
    s AS (SELECT doc_id, pi, unnest(l) AS x, generate_subscripts(l, 1) AS si FROM sl),
    sn AS (SELECT *, CASE WHEN x = '' THEN 0 ELSE {EST.format("x")} END AS n, doc_id || ':' || pi || ':' || si AS k FROM s),
    lw0 AS (SELECT k, generate_subscripts(string_split_regex(x, '\s+'), 1) AS wi, unnest(string_split_regex(x, '\s+')) AS word FROM sn WHERE n > {SIZE}),
    lw AS (SELECT *, {EST.format("word")} AS n FROM lw0),
    {word_packing(SIZE)},
    wt AS (SELECT r.k, r.c, string_agg(w.word, ' ' ORDER BY w.wi) AS x FROM wrec r JOIN lw w ON w.k = r.k AND w.wi BETWEEN r.st AND r.en GROUP BY ALL),
    ux AS (SELECT doc_id, pi, si, 0 AS wi, x FROM sn WHERE n <= {SIZE} UNION ALL SELECT sn.doc_id, sn.pi, sn.si, wt.c, wt.x FROM sn JOIN wt USING (k)),
    ut AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pi, si, wi) AS i, x FROM ux),
    {packing(f"u AS (SELECT doc_id, i, CASE WHEN x = '' THEN 0 ELSE {EST.format('x')} END AS n FROM ut)", SIZE, OVERLAP)},
    ct AS (SELECT r.doc_id, r.c, r.st, r.en, string_agg(ut.x, chr(10) || chr(10) ORDER BY ut.i) AS t FROM rec r JOIN ut ON ut.doc_id = r.doc_id AND ut.i BETWEEN r.st AND r.en GROUP BY ALL)
    SELECT printf('%s::chunk-%04d', doc_id::VARCHAR, c) AS chunk_id, doc_id, c::INT AS chunk_index, t AS text, CASE WHEN t = '' THEN 0 ELSE {EST.format("t")} END::INT AS token_estimate,
        (st - 1)::INT AS paragraph_start, (en - 1)::INT AS paragraph_end, len(t)::INT AS chunk_char_count
    FROM ct"""


@query("chunk_rows", CHUNK_SQL)
def chunk_rows(spark, sf):
    rows = C.chunks(table(spark, sf, "documents"), C.ChunkConfig(SIZE, 0.15))
    return rows.select("chunk_id", "doc_id", "chunk_index", "text", "token_estimate", "paragraph_start", "paragraph_end", "chunk_char_count")


LAST_HEADER = r"regexp_extract_all(t, '(?m)^(#{1,6})\s+(.+)$', 2)[-1]"
TURN = "CASE WHEN turn % 2 = 0 THEN '[PAGE:' || (turn + 1) || ']' || chr(10) ELSE '' END || CASE WHEN turn % 3 = 1 THEN '## Part ' || turn || '  ' || chr(10) ELSE '' END || coalesce(text, '')"


@query(
    "turn_context",
    rf"""WITH t AS (SELECT conv_id, turn, {TURN} AS t FROM conversations),
    m AS (SELECT *, nullif(regexp_extract(t, '(?m)^\[PAGE:(\d+)\]$', 1), '')::INT AS own_page, {strip(LAST_HEADER)} AS own_section FROM t)
    SELECT conv_id, turn, last_value(own_page IGNORE NULLS) OVER w AS page, last_value(own_section IGNORE NULLS) OVER w AS section,
        {strip(r"regexp_replace(regexp_replace(t, '(?m)^\[PAGE:\d+\]$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS text
    FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
)
def turn_context(spark, sf):
    marked = F.concat(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("[PAGE:"), F.col("turn") + 1, F.lit("]\n"))).otherwise(""), F.when(F.col("turn") % 3 == 1, F.concat(F.lit("## Part "), "turn", F.lit("  \n"))).otherwise(""), F.coalesce("text", F.lit("")))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", marked.alias("t"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.select("conv_id", "turn", F.last(T.page_marker(F.col("t")), True).over(w).alias("page"), F.last(T.section(F.col("t")), True).over(w).alias("section"), T.strip_markers(F.col("t")).alias("text"))


# ------------------------------------------------------------ S: Markdown, ids
MD = r"concat('---\ntitle: \"Doc ', doc_id, '\"\ntags: [a, \'b\']\n# note\nempty:\n---\n# Head ', lang, '\n## \n- one\n12. two\n[x](http://e/', doc_id, ')\n```\ncode\n```\n', coalesce(text, ''))"
MD_SQL = """'---' || chr(10) || 'title: "Doc ' || doc_id || '"' || chr(10) || 'tags: [a, ''b'']' || chr(10) || '# note' || chr(10) || 'empty:' || chr(10) || '---' || chr(10) || '# Head ' || lang || chr(10) || '## ' || chr(10) || '- one' || chr(10) || '12. two' || chr(10) || '[x](http://e/' || doc_id || ')' || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' || chr(10) || coalesce(text, '')"""


@query(
    "md_structure",
    rf"""WITH d AS (SELECT doc_id, lang, {MD_SQL} AS t FROM documents), l AS (SELECT *, string_split(t, chr(10)) AS ls FROM d)
    SELECT doc_id, true AS has_frontmatter, 'Doc ' || doc_id AS title, '["a","b"]' AS tags, 
        len(list_filter(ls, lambda x: starts_with({strip("x")}, '# ')))::INT AS h1, len(list_filter(ls, lambda x: starts_with({strip("x")}, '## ') OR {strip("x")} = '##'))::INT AS h2, 'note' AS first_h1,
        ((len(t) - len(replace(t, '```', ''))) // 6)::INT AS code_blocks, len(list_filter(ls, lambda x: regexp_matches(x, '^\s*(?:[-*+]|\d+\.)\s+')))::INT AS list_items,
        len(regexp_extract_all(t, '\[([^\]]+)\]\(([^)]+)\)'))::INT AS link_count, len(ls)::INT AS line_count FROM l""",
)
def md_structure(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(MD).alias("text"))
    return structure(docs).select("doc_id", "has_frontmatter", "title", "tags", "h1", "h2", "first_h1", "code_blocks", "list_items", "link_count", "line_count")


@query("slugs_and_hashes", "SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'document') AS doc_id, sha256(html) AS content_hash FROM pages")
def slugs_and_hashes(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.slug(F.col("url")).alias("doc_id"), F.sha2("html", 256).alias("content_hash"))


# ------------------------------------------------------------ W: state
# Two snapshots of the corpus: the older one has other texts for every 7th document and lacks every 5th.
OLD = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text, source FROM documents WHERE doc_id % 5 <> 0)"


def snapshots(spark, sf) -> tuple:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    old = docs.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    hashed = lambda d: d.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("/"), "source", F.lit("/"), "doc_id").alias("source_path"))
    return hashed(docs), hashed(old)


@query("incremental_skip", f"SELECT d.doc_id, sha256(d.text) AS content_hash, o.doc_id IS NOT NULL AND o.text = d.text AS up_to_date FROM documents d LEFT JOIN {OLD} o ON d.doc_id = o.doc_id")
def incremental_skip(spark, sf):
    new, old = snapshots(spark, sf)
    fresh = state.changed(new, old).select("doc_id", "content_hash", F.lit(False).alias("up_to_date"))
    return fresh.unionByName(state.up_to_date(new, old).select("doc_id", "content_hash", F.lit(True).alias("up_to_date")))


@query("replace_by_doc", f"SELECT doc_id, sha256(text) AS content_hash FROM {OLD} WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, sha256(text) FROM documents WHERE doc_id % 3 = 0")
def replace_by_doc(spark, sf):
    new, old = snapshots(spark, sf)
    return state.replace_by_key(old, new.where("doc_id % 3 = 0")).select("doc_id", "content_hash")


@query("replace_buckets", f"SELECT doc_id, sha256(text) AS content_hash, '/' || source || '/' || doc_id AS source_path FROM {OLD} WHERE doc_id % 3 <> 0 AND doc_id % 11 <> 4 UNION ALL SELECT doc_id, sha256(text), '/' || source || '/' || doc_id FROM documents WHERE doc_id % 3 = 0")
def replace_buckets(spark, sf):
    """The older snapshot in buckets; every third document replaced, some others deleted, in the buckets that hold them."""
    new, old = snapshots(spark, sf)
    held = Buckets(spark, new_folder(spark, "buckets"), "doc_id bigint, content_hash string, source_path string", rows_per_bucket=10_000)
    held.replace(old)
    held.replace(new.where("doc_id % 3 = 0"), old.where("doc_id % 11 = 4"))
    return held.read()


@query("orphans", "SELECT doc_id, '/' || source || '/' || doc_id AS source_path FROM documents WHERE doc_id % 5 = 0")
def orphans(spark, sf):
    new, old = snapshots(spark, sf)
    return state.orphans(new, old).select("doc_id", "source_path")


@query(
    "run_report",
    f"SELECT count(*) FILTER (s = 'processed') AS processed, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'failed') AS failed, sum(n)::BIGINT AS total_chunks FROM (SELECT CASE WHEN n_chars % 11 = 0 THEN 'failed' WHEN n_chars % 3 = 0 THEN 'skipped' ELSE 'processed' END AS s, CASE WHEN n_chars % 11 = 0 OR n_chars % 3 = 0 THEN 0 ELSE {EST.format('text')} // 60 + 1 END AS n FROM documents)",
)
def run_report(spark, sf):
    status = F.when(F.col("n_chars") % 11 == 0, "failed").when(F.col("n_chars") % 3 == 0, "skipped").otherwise("processed")
    n = F.when(status == "processed", F.floor(T.estimate_tokens(F.col("text")) / 60) + 1).otherwise(0)
    return state.run_report(table(spark, sf, "documents").select(status.alias("status"), n.alias("chunks")))


# ------------------------------------------------------------ I: index
def manifest(spark, sf) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    joined = docs.select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    meta = F.struct(F.when(F.col("quality").isNotNull(), F.concat(F.lit("q"), "quality")).alias("ingestion_timestamp"), F.col("lang").alias("section"), F.col("quality").alias("quality"))
    return joined.select("doc_id", F.concat(F.lit("/"), "source").alias("source_path"), meta.alias("metadata"))


def pieces(spark, sf) -> DataFrame:
    """One chunk, the whole text, for each document."""
    return table(spark, sf, "documents").select("doc_id", F.lit(0).alias("chunk_index"), "text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("s"), "doc_id")).alias("section"), F.when(F.col("doc_id") % 4 == 0, F.col("doc_id").cast("int")).alias("page"))


FLAT = """SELECT d.doc_id, '/' || d.source AS source_path, 0 AS chunk_index, d.text, CASE WHEN d.doc_id % 2 = 0 THEN 's' || d.doc_id ELSE d.lang END AS section,
    CASE WHEN d.doc_id % 4 = 0 THEN d.doc_id::INT END AS page, 'q' || l.quality AS ingestion_timestamp, l.quality AS quality, 'q' || l.quality AS "timestamp"
    FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id"""


@query("metadata_flatten", f"SELECT * REPLACE (page::VARCHAR AS page, quality::VARCHAR AS quality) FROM ({FLAT})")
def metadata_flatten(spark, sf):
    flat = I.flatten(manifest(spark, sf), pieces(spark, sf))
    return flat.withColumn("page", F.col("page").cast("string")).withColumn("quality", F.col("quality").cast("string"))


@query(
    "metadata_coverage",
    f"""WITH f AS ({FLAT}), n AS (SELECT count(*) AS n FROM f), c AS (
        SELECT 'doc_id' AS field, true AS required, count(doc_id) AS n_present FROM f UNION ALL SELECT 'source_path', true, count(source_path) FROM f UNION ALL SELECT 'chunk_index', true, count(chunk_index) FROM f
        UNION ALL SELECT 'timestamp', true, count("timestamp") FROM f UNION ALL SELECT 'page', false, count(page) FROM f UNION ALL SELECT 'section', false, count(section) FROM f)
    SELECT field, required, n_present, round_even(n_present / n * 100, 1) AS pct FROM c, n""",
)
def metadata_coverage(spark, sf):
    return I.coverage(I.flatten(manifest(spark, sf), pieces(spark, sf)))


@query(
    "verify_sample",
    f"""WITH f AS ({FLAT} ORDER BY md5(chr(10) || d.doc_id || chr(10) || '0') LIMIT 100)
    SELECT count(*) AS verified_chunks, count(*) FILTER (source_path IS NULL OR "timestamp" IS NULL OR "timestamp" = '') AS missing_fields, round_even(count("timestamp") / count(*) * 100, 1) AS timestamp_pct,
        round_even(count(page) / count(*) * 100, 1) AS page_pct, round_even(count(section) / count(*) * 100, 1) AS section_pct FROM f""",
)
def verify_sample(spark, sf):
    pct = lambda c: F.col("field_coverage")[c].alias(f"{c}_pct")
    return I.verify(I.flatten(manifest(spark, sf), pieces(spark, sf))).select("verified_chunks", "missing_fields", pct("timestamp"), pct("page"), pct("section"))


# Two states of the chunks (1,000 characters each) of all documents: in the new one every third document has a longer
# end, every third begins with another chunk, so that its own chunks move; some documents come and some go.
EDITED = "CASE doc_id % 3 WHEN 0 THEN coalesce(text, '') || ' more' WHEN 1 THEN repeat('new ', 250) || coalesce(text, '') ELSE coalesce(text, '') END"
CUT_OLD, CUT_NEW = ("unnest(regexp_extract_all({}, '(?s).{{1,1000}}'))".format(x) for x in ("text", EDITED))


def cut(docs: DataFrame, text: str) -> DataFrame:
    pieces_ = F.expr(f"regexp_extract_all({text}, '(?s).{{1,1000}}', 0)")
    return docs.select("doc_id", F.posexplode(pieces_).alias("chunk_index", "text")).withColumn("digest", carry.digest(F.col("text"), "hashed-64"))


@query(
    "carry_over",
    f"""WITH o AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, {CUT_OLD} AS t FROM documents WHERE doc_id % 11 <> 4) GROUP BY ALL), n AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, {CUT_NEW} AS t FROM documents WHERE doc_id % 13 <> 5) GROUP BY ALL)
    SELECT doc_id, sum(CASE WHEN o.n IS NOT NULL THEN coalesce(n.n, 0) ELSE 0 END)::BIGINT AS n_reused, sum(CASE WHEN o.n IS NULL THEN n.n ELSE 0 END)::BIGINT AS n_embedded, sum(CASE WHEN n.n IS NULL THEN o.n ELSE 0 END)::BIGINT AS n_deleted,
        sum(CASE WHEN o.n IS NOT NULL THEN coalesce(n.n, 0) ELSE 0 END)::BIGINT AS n_carried, sum(coalesce(n.n, 0))::BIGINT AS n_vectors
    FROM o FULL JOIN n USING (doc_id, t) GROUP BY doc_id""",
)
def carry_over(spark, sf):
    """What a re-index does to every document: counts by comparison of the states, and as found in the rows it leaves."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    embed = lambda rows: embed_hashed(rows, size=64)
    held, matched = new_folder(spark, "carry-held"), new_folder(spark, "carry-matched")
    embed(cut(docs.where("doc_id % 11 <> 4"), "text")).select("doc_id", "digest", "embedding").write.parquet(held)
    old = spark.read.parquet(held)
    carry.match(old, cut(docs.where("doc_id % 13 <> 5"), EDITED)).write.parquet(matched)
    new = spark.read.parquet(matched)
    left = carry.complete(new, embed).groupBy("doc_id").agg(F.count_if("carried").alias("n_carried"), F.count("embedding").alias("n_vectors"))
    counts = carry.changes(old, new).join(left, "doc_id", "left")
    return counts.select("doc_id", "n_reused", "n_embedded", "n_deleted", F.coalesce("n_carried", F.lit(0)).alias("n_carried"), F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"))


# ------------------------------------------------------------ R: retrieval
# The query set is every vector whose id is divisible by 50, against all vectors.
TOP = """SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, list_cosine_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance, q.label AS query_label,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id) AS rank
    FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0"""


def vectors(spark, sf) -> tuple:
    all_ = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return all_, all_.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")


@query("topk_cosine", f"SELECT query_id, id, rank::INT AS rank, round(abs(distance), 6) AS distance FROM ({TOP}) WHERE rank <= 5")
def topk_cosine(spark, sf):
    rows, asked = vectors(spark, sf)
    return R.top_k(rows.select("id", "embedding"), asked, 5).select("query_id", "id", "rank", F.round(F.abs("distance"), 6).alias("distance"))


@query("topk_filtered", f"SELECT query_id, id, rank::INT AS rank, round(abs(distance), 6) AS distance FROM ({TOP} AND e.label = 3) WHERE rank <= 3")
def topk_filtered(spark, sf):
    rows, asked = vectors(spark, sf)
    return R.top_k(rows, asked, 3, R.filters(label=3)).select("query_id", "id", "rank", F.round(F.abs("distance"), 6).alias("distance"))


# Page, time, access and place of a vector, as chunks have them; one in seven has no page, one in five no access list.
MARKED = """vec_id AS id, embedding, label, CASE WHEN vec_id % 7 > 0 THEN vec_id % 40 END AS page, '2024-01-' || lpad((vec_id % 28 + 1)::VARCHAR, 2, '0') AS "timestamp",
    CASE vec_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'team' WHEN 2 THEN 'team,staff' WHEN 3 THEN 'staff' ELSE 'guest,teams' END AS acl_read"""

MARKED_COLUMNS = ["vec_id AS id", "embedding", "label", "CASE WHEN vec_id % 7 > 0 THEN vec_id % 40 END AS page", "'2024-01-' || lpad(CAST(vec_id % 28 + 1 AS STRING), 2, '0') AS timestamp", "CASE vec_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'team' WHEN 2 THEN 'team,staff' WHEN 3 THEN 'staff' ELSE 'guest,teams' END AS acl_read"]


@query(
    "topk_ranges",
    f"""WITH e AS (SELECT {MARKED} FROM embeddings), m AS (
        SELECT 'page' AS filter, * FROM e WHERE page BETWEEN 10 AND 20 UNION ALL SELECT 'time', * FROM e WHERE "timestamp" >= '2024-01-15' UNION ALL SELECT 'reader', * FROM e WHERE list_contains(string_split(acl_read, ','), 'team')
        UNION ALL SELECT 'mix', * FROM e WHERE label = 3 AND page >= 5 AND "timestamp" >= '2024-01-08' AND list_contains(string_split(acl_read, ','), 'staff')),
    r AS (SELECT filter, q.vec_id AS query_id, m.id, list_cosine_distance(q.embedding::DOUBLE[], m.embedding::DOUBLE[]) AS d FROM embeddings q, m WHERE q.vec_id % 50 = 0)
    SELECT filter, query_id, id, rank::INT AS rank, round(abs(d), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY filter, query_id ORDER BY d, id) AS rank FROM r) WHERE rank <= 3""",
)
def topk_ranges(spark, sf):
    """Nearest rows under a page range, a time range, a reader, and all of them with equality."""
    asked = vectors(spark, sf)[1]
    rows = table(spark, sf, "embeddings").selectExpr(*MARKED_COLUMNS)
    asks = {"page": R.filters(page_from=10, page_to=20), "time": R.filters(since="2024-01-15"), "reader": R.filters(reader="team"), "mix": R.filters(label=3, page_from=5, since="2024-01-08", reader="staff")}
    found_ = None
    for name, where in asks.items():
        hits = R.top_k(rows.where(where).select("id", "embedding"), asked, 3).select(F.lit(name).alias("filter"), "query_id", "id", "rank", F.round(F.abs("distance"), 6).alias("distance"))
        found_ = hits if found_ is None else found_.unionByName(hits)
    return found_


@query(
    "retrieval_eval",
    f"""WITH h AS (SELECT query_id, query_label, min(rank) FILTER (label = query_label AND id <> query_id) AS r, min(distance) FILTER (label = query_label AND id <> query_id) AS d FROM ({TOP}) WHERE rank <= 10 GROUP BY ALL)
    SELECT query_label::VARCHAR AS query_type, count(*) AS n, count(*) FILTER (r IS NOT NULL AND d <= 1.0) AS n_passed, round(avg(CASE WHEN r IS NOT NULL AND d <= 1.0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / r, 0.0)), 6) AS mrr FROM h GROUP BY query_label""",
)
def retrieval_eval(spark, sf):
    rows, asked = vectors(spark, sf)
    kind = rows.select(F.col("id").alias("query_id"), F.col("label").alias("query_label"))
    hits = R.top_k(rows, asked, 10).join(kind, "query_id").where("id <> query_id AND label = query_label")
    first = hits.select("query_id", F.col("query_label").cast("string").alias("id"), "rank", "distance")
    expected = asked.join(kind, "query_id").select("query_id", F.col("query_label").cast("string").alias("query_type"), F.col("query_label").cast("string").alias("expected_id"))
    return R.pass_rates(R.evaluate(first, expected))


HITS = f"""SELECT t.query_id, t.rank, t.id, t.distance, d.text, CASE WHEN d.doc_id % 3 > 0 THEN '/' || d.source END AS relative_path, CASE WHEN d.doc_id % 2 = 0 THEN d.doc_id END AS page, CASE WHEN d.doc_id % 3 = 1 THEN d.lang || repeat('x', 45) END AS section
    FROM ({TOP}) t JOIN documents d ON d.doc_id = t.id WHERE t.rank <= 3"""


def found(spark, sf) -> DataFrame:
    rows, asked = vectors(spark, sf)
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("/"), "source")).alias("relative_path"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("page"), F.when(F.col("doc_id") % 3 == 1, F.concat("lang", F.repeat(F.lit("x"), 45))).alias("section")
    )
    return R.top_k(rows.select("id", "embedding"), asked, 3).join(docs, "id")


@query(
    "context_prompt",
    f"""WITH h AS ({HITS}), c AS (SELECT query_id, count(*) AS n_chunks, string_agg('[' || rank || '] (' || coalesce(nullif(concat_ws(' | ', relative_path, 'page ' || page, 'section: ' || section), ''), 'unknown source') || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id)
    SELECT q.query_id, 'what?' AS question, coalesce(n_chunks, 0) AS n_chunks, context, replace('{A.SYSTEM_PROMPT.replace("'", "''")}', '{{context}}', context) AS system_prompt
    FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0) q LEFT JOIN c USING (query_id)""",
)
def context_prompt(spark, sf):
    asked = vectors(spark, sf)[1].select("query_id", F.lit("what?").alias("question"))
    return A.contexts(found(spark, sf), asked)


FLAT_TEXT = f"replace({strip('text')}, chr(10), ' ')"


@query(
    "hit_format",
    f"""SELECT query_id, rank::INT AS rank, '[' || rank || '] doc_id=' || id || ' chunk_id=None path=' || coalesce(relative_path, 'None') || printf(' | distance=%.4f', round(abs(distance), 6))
        || CASE WHEN place <> '' THEN chr(10) || '    [' || place || ']' ELSE '' END || chr(10) || '    ' || CASE WHEN len(f) > 120 THEN regexp_replace(substr(f, 1, 117), '\\s+$', '') || '...' ELSE f END AS line
    FROM (SELECT *, {FLAT_TEXT} AS f, concat_ws(', ', 'page ' || page, 'section "' || CASE WHEN len(section) > 40 THEN substr(section, 1, 37) || '...' ELSE section END || '"') AS place FROM ({HITS}))""",
)
def hit_format(spark, sf):
    h = found(spark, sf)
    meta = {"doc_id": F.col("id"), "relative_path": F.col("relative_path"), "page": F.col("page"), "section": F.col("section")}
    return h.select("query_id", "rank", R.hit_text(F.col("rank"), F.col("text"), meta, F.round(F.abs("distance"), 6), 120).alias("line"))


@query(
    "source_lines",
    f"""SELECT query_id, rank::INT AS rank, '  [' || rank || '] ' || coalesce(relative_path, 'unknown') || coalesce(' (page ' || page || ')', '') || printf(' (dist: %.4f)', round(abs(distance), 6)) || chr(10) || '      ' || replace(substr(text, 1, 100), chr(10), ' ') || '...' AS line FROM ({HITS})""",
)
def source_lines(spark, sf):
    return found(spark, sf).select("query_id", "rank", R.source_line(F.col("rank"), F.col("text"), F.col("relative_path"), F.col("page"), F.round(F.abs("distance"), 6)).alias("line"))


@query("embed_documents")
def embed_documents(spark, sf):
    """Hashed embeddings of all documents; checked by unit length in the tests, as SQL has no such hash."""
    return embed_hashed(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "embedding")


@query("topk_ivf")
def topk_ivf(spark, sf):
    """Top ten by inverted lists, with as many probes as a recall of 0.97 takes on other queries; recall is tested against the exact search, as k-means has no SQL."""
    rows, asked = vectors(spark, sf)
    path = new_folder(spark, "ivf")
    ivf.build(rows, path)
    index = ivf.read(spark, path)
    return ivf.search(index, asked, 10, ivf.tune(index)[0]).select("query_id", "id", "label", "rank", F.round(F.abs("distance"), 6).alias("distance"))


@query("embed_lsa")
def embed_lsa(spark, sf):
    """Learned embeddings of all documents by a model of all documents; tested against an exact SVD and against hashing, as SQL has no SVD."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lsa.fit_embed(docs, ("doc_id",))


# ------------------------------------------------------------ I: free metadata
# Document metadata with values of all kinds; chunk metadata with spans of five shapes.
DOC_JSON = """'{"acl_read":"team","language":"' || coalesce(lang, '?') || '","nested":{"a":[1,true],"b":"x"},"page":99,"quality":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '0.5' END || ',"source_path":"/given/' || doc_id || '","title":"Doc ' || doc_id || '"}'"""
CHUNK_JSON = """'{"checked":true,"title":' || CASE WHEN doc_id % 4 = 0 THEN 'null' ELSE '"Part ' || doc_id || '"' END || ',"page":' || CASE WHEN doc_id % 2 = 0 THEN '' || doc_id ELSE 'null' END || ',"section":"' || coalesce(source, '?') || '","n":' || doc_id || ',"paragraph_span":' ||
    CASE doc_id % 5 WHEN 0 THEN '[' || doc_id || ',' || (doc_id + 2) || ']' WHEN 1 THEN '"3-4"' WHEN 2 THEN '[1]' WHEN 3 THEN '{"from":1}' ELSE 'null' END || '}'"""


def free_metadata(spark, sf) -> tuple:
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/"), "source").alias("source_path"), F.expr(DOC_JSON).alias("d"), F.expr(CHUNK_JSON).alias("c"))
    docs = docs.select("doc_id", "source_path", T.fence(V.parse(F.col("d"))).alias("d"), T.fence(V.parse(F.col("c"))).alias("c"))
    return docs, V.flattened({"source_path": F.col("source_path"), "doc_id": F.col("doc_id")}, F.col("d"), F.col("c"))


@query(
    "metadata_free",
    f"""WITH d AS (SELECT doc_id, '/' || source AS source_path, {DOC_JSON} AS d, {CHUNK_JSON} AS c FROM documents),
    c AS (SELECT doc_id, e.key, e.value FROM d, json_each(d.c) e),
    s AS (SELECT doc_id, value, json_type(value) = 'ARRAY' AND json_array_length(value) = 2 AS pair FROM c WHERE key = 'paragraph_span' AND json_type(value) <> 'NULL'),
    a AS (
        SELECT doc_id, 0 AS p, 'source_path' AS name, to_json(source_path) AS v FROM d UNION ALL SELECT doc_id, 0, 'doc_id', to_json(doc_id) FROM d
        UNION ALL SELECT doc_id, 1, e.key, e.value FROM d, json_each(d.d) e
        UNION ALL SELECT doc_id, 2, 'paragraph_start', value->0 FROM s WHERE pair UNION ALL SELECT doc_id, 2, 'paragraph_end', value->1 FROM s WHERE pair
        UNION ALL SELECT doc_id, 2, 'paragraph_span', to_json(value->>'$') FROM s WHERE NOT pair
        UNION ALL SELECT doc_id, 2, key, value FROM c WHERE key IN ('page', 'section') AND json_type(value) <> 'NULL'
        UNION ALL SELECT doc_id, 3, key, value FROM c WHERE key NOT IN ('page', 'section', 'paragraph_span'))
    SELECT doc_id, name, CASE WHEN json_type(v) = 'VARCHAR' THEN 'text' WHEN json_type(v) = 'BOOLEAN' THEN 'boolean' WHEN json_type(v) IN ('ARRAY', 'OBJECT') THEN 'json' ELSE 'number' END AS kind, v->>'$' AS value
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY p DESC) AS r FROM a) WHERE r = 1 AND json_type(v) <> 'NULL'""",
)
def metadata_free(spark, sf):
    docs, flat = free_metadata(spark, sf)
    return V.listed(docs, ["doc_id"], flat)


@query("metadata_profile", "SELECT event_type, e.key AS name, count(*) AS n FROM events, json_each(props) e WHERE json_type(e.value) <> 'NULL' GROUP BY ALL")
def metadata_profile(spark, sf):
    rows = table(spark, sf, "events").select("event_type", T.fence(V.parse(F.col("props"))).alias("m"))
    return V.profile(rows, ["event_type"], F.map_filter("m", lambda _, v: ~F.is_variant_null(v))).drop("type")
