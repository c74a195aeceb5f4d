"""Queries over the structure of texts and over gated query sets, with oracle SQL.

Pages become lines of marked-up text: headings get their mark, the article stands
between page breaks, and long words are broken as a typesetter would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfathom.functions import chunking, structure
from sparkfathom.functions import text as T
from sparkfathom.operators import query_sets
from sparkfathom.sources.tables import table

#: Words of a chunk and of its overlap, in the queries of this module.
SIZE, OVERLAP = 64, 16

#: Documents that ``phrase_set`` asks a phrase of.
PHRASES = 100

#: What becomes of markup, in this order; RE2 and Java read these patterns alike.
MARKUP = [
    (r"(?s)<script.*?</script>|<style.*?</style>|<title.*?</title>", ""),
    (r"<h1[^>]*>", "\n# "), (r"<h[2-6][^>]*>", "\n## "), (r"</?article[^>]*>", "\n\f\n"),
    (r"</(h[1-6]|p|li|div)>|<br>", "\n"), (r"<[^>]*>", ""), (r"(\p{Ll}{4})(\p{Ll}{5,})", "$1-\n$2"),
]


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, text`` of whole pages."""
    text = F.col("html")
    for pattern, by in MARKUP:
        text = F.regexp_replace(text, pattern, by)
    return table(spark, sf_dir, "pages").select("page_id", text.alias("text"))


def _literal(value: str) -> str:
    """A SQL string; line ends and form feeds are written as ``chr``."""
    quoted = value.replace("'", "''").replace("$", "\\")
    for sign in "\n\f":
        quoted = quoted.replace(sign, f"' || chr({ord(sign)}) || '")
    return f"('{quoted}')"


def _marked_sql() -> str:
    text = "html"
    for pattern, by in MARKUP:
        text = f"regexp_replace({text}, {_literal(pattern).replace('$', chr(92))}, {_literal(by)}, 'g')"
    return f"SELECT page_id, {text} AS t FROM pages"


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_BROKEN = f"'{structure.BROKEN}'"
_MENDED = f"""p AS ({_marked_sql()}),
h AS (SELECT page_id, t, regexp_extract_all(t, {_BROKEN}) AS m, regexp_extract_all(t, {_BROKEN}, 1) AS l, regexp_extract_all(t, {_BROKEN}, 2) AS r,
regexp_split_to_array(t, {_BROKEN}) AS b, list_distinct(regexp_extract_all(t, '\\p{{L}}+')) AS w, list_distinct(regexp_extract_all(t, '{structure.INTACT}')) AS c FROM p),
d AS (SELECT page_id, t AS raw, array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || CASE WHEN i > len(m) THEN ''
WHEN NOT (regexp_matches(l[i], '\\p{{Ll}}$') AND regexp_matches(r[i], '^\\p{{Ll}}')) OR length(l[i]) < 2 OR list_contains({_listed(T.FUNCTION_WORDS)}, r[i])
OR list_contains(c, l[i] || '-' || r[i]) OR (list_contains({_listed(structure.COMPOUND_PREFIXES)}, l[i]) AND NOT list_contains(w, l[i] || r[i])) THEN m[i]
ELSE l[i] || r[i] END), '') AS t FROM h)"""


def dehyphenated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken words before and after they are joined, and a digest of each page's text."""
    mended = structure.dehyphenated(F.col("text"))
    rows = marked_pages(spark, sf_dir).select("page_id", F.regexp_count("text", F.lit(structure.BROKEN)).alias("broken"), mended.alias("mended"))
    return rows.select("page_id", "broken", F.regexp_count("mended", F.lit(structure.BROKEN)).alias("kept"), F.sha2("mended", 256).alias("text_sha256"))


_DEHYPHENATED = f"""WITH {_MENDED} SELECT page_id, len(regexp_extract_all(raw, {_BROKEN}))::INTEGER AS broken,
len(regexp_extract_all(t, {_BROKEN}))::INTEGER AS kept, sha256(t) AS text_sha256 FROM d"""


def structure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with broken words joined, cut at headings and page breaks, long segments in windows."""
    chunks = structure.rider_chunks(marked_pages(spark, sf_dir), ["page_id"], "text", SIZE, OVERLAP)
    return chunks.select("page_id", "chunk_index", "section", "heading", F.sha2("content", 256).alias("content_sha256"))


_STEP = SIZE - OVERLAP
_STRUCTURE = f"""WITH {_MENDED},
s AS (SELECT page_id, string_split(regexp_replace(t, '(?m)^(#{{1,6}} \\S)', chr(1) || '\\1', 'g'), chr(1)) AS ss FROM d),
s1 AS (SELECT page_id, unnest(range(len(ss))) AS section, unnest(ss) AS x FROM s),
g AS (SELECT page_id, section, CASE WHEN regexp_matches(x, '^#{{1,6}} \\S') THEN trim(regexp_extract(x, '^#{{1,6}} ([^\\n]*)', 1), ' ') END AS heading,
string_split(regexp_replace(x, '(?m)^(\\f+[ \\t]*\\n)', '\\1' || chr(1), 'g'), chr(1)) AS gs FROM s1),
g1 AS (SELECT page_id, section, heading, unnest(range(len(gs))) AS segment, unnest(gs) AS x FROM g),
w AS (SELECT *, list_filter(regexp_split_to_array(x, '\\s+'), lambda v: v <> '') AS ws FROM g1),
i AS (SELECT *, unnest(range(1 + greatest(ceil((len(ws) - {SIZE}) / {_STEP}.0), 0)::INT)) AS k FROM w WHERE len(ws) > 0),
c AS (SELECT page_id, section, heading, segment, k, CASE WHEN len(ws) <= {SIZE} THEN x ELSE array_to_string(ws[k * {_STEP} + 1 : k * {_STEP} + {SIZE}], ' ') END AS content,
CASE WHEN len(ws) <= {SIZE} THEN ws ELSE ws[k * {_STEP} + 1 : k * {_STEP} + {SIZE}] END AS own FROM i),
f AS (SELECT * FROM c WHERE len(list_filter(own, lambda v: NOT regexp_matches(v, '[\\p{{L}}\\p{{N}}]'))) / len(own)::DOUBLE < {T.PUNCTUATION_SHARE})
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY section, segment, k) - 1)::INTEGER AS chunk_index, section::INTEGER AS section, heading,
sha256(content) AS content_sha256 FROM f"""


def structure_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often headings, page breaks and broken words occur in all pages."""
    return structure.census(marked_pages(spark, sf_dir), "text")


_CENSUS = f"""WITH {_MENDED} SELECT sum(len(regexp_extract_all(raw, '(?m)^#{{1,6}} \\S')))::BIGINT AS heading_lines,
count(*) FILTER (regexp_matches(raw, '(?m)^#{{1,6}} \\S')) AS spans_with_heading, sum(len(regexp_extract_all(raw, '(?m)^\\f+[ \\t]*\\n')))::BIGINT AS page_breaks,
sum(len(regexp_extract_all(raw, '\\f')))::BIGINT AS form_feeds, sum(len(regexp_extract_all(raw, {_BROKEN})))::BIGINT AS broken_words,
sum(len(regexp_extract_all(raw, {_BROKEN})) - len(regexp_extract_all(t, {_BROKEN})))::BIGINT AS joined,
sum(length(raw) - length(replace(raw, chr(173), '')))::BIGINT AS soft_hyphens FROM d"""


def rebuilt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put together again from their overlapping chunks, beside their words."""
    docs = table(spark, sf_dir, "documents")
    chunks = chunking.chunk_words(docs, ["doc_id"], "text", 4 * SIZE, 4 * OVERLAP)
    return structure.rebuilt(chunks, ["doc_id"], "chunk_index", "content", 4 * (SIZE - OVERLAP)).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


_REBUILT = """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda v: v <> '') AS ws FROM documents)
SELECT doc_id, sha256(array_to_string(ws, ' ')) AS text_sha256 FROM w WHERE len(ws) > 0"""


def _windows(spark: SparkSession, sf_dir: str) -> query_sets.Windows:
    return query_sets.Windows(table(spark, sf_dir, "documents"), "doc_id", "text", SIZE, OVERLAP)


def rare_token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rare capitalised word of every document that has one."""
    found = query_sets.rare_token_set(_windows(spark, sf_dir), "doc_id", "chunk_index", "content")
    return found.select(F.col("gold").alias("doc_id"), "place", "query")


def phrase_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known-item phrase of a hundred documents, drawn by a digest of their identifiers."""
    drawn = F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")))
    found = query_sets.phrase_set(_windows(spark, sf_dir), "doc_id", "chunk_index", "content", PHRASES, drawn)
    return found.select(F.col("gold").alias("doc_id"), "place", "query")


_CHUNKS = f"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda v: v <> '') AS t FROM documents),
i AS (SELECT doc_id, t, unnest(range(1 + greatest(ceil((len(t) - {SIZE}) / {_STEP}.0), 0)::INT)) AS i FROM w WHERE len(t) > 0),
c AS (SELECT doc_id, i, array_to_string(t[i * {_STEP} + 1 : i * {_STEP} + {SIZE}], ' ') AS content FROM i),
u AS (SELECT doc_id, i, unnest(list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+'))) AS term FROM c)"""

_GATE = """o AS (SELECT *, sum(chunks) OVER (PARTITION BY query ORDER BY document ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
k AS (SELECT query, list(document) AS held FROM o WHERE coalesce(before, 0) < 100 GROUP BY query HAVING count(*) <= 5),
y AS (SELECT a.* FROM a JOIN k USING (query) WHERE list_contains(held, a.doc_id)),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM y)"""

_RARE_TOKENS = f"""WITH {_CHUNKS},
t AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+'), lambda v: regexp_full_match(v, '[A-Z][A-Za-z]{{2,}}'))) AS token FROM c WHERE i < 8),
a0 AS (SELECT doc_id, token AS shown, lower(token) AS query, (row_number() OVER (PARTITION BY doc_id ORDER BY length(token) DESC, token) - 1)::INTEGER AS place
FROM t WHERE token NOT IN ({", ".join(f"'{x}'" for x in T.CAPITAL_STOPWORDS)})),
a AS (SELECT * FROM a0 WHERE place < 10),
m AS (SELECT term AS query, doc_id AS document, count(*) AS chunks FROM u WHERE term IN (SELECT query FROM a) GROUP BY ALL), {_GATE}
SELECT doc_id, place, shown AS query FROM z WHERE n = 1"""

_PHRASES = f"""WITH {_CHUNKS},
s AS (SELECT doc_id, i, unnest(range(len(ss))) AS sn, unnest(ss) AS sentence FROM (SELECT doc_id, i, string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM c WHERE i BETWEEN 2 AND 7)),
x AS (SELECT doc_id, i, sn, regexp_extract_all(sentence, '[A-Za-z][A-Za-z-]*') AS own FROM s),
l AS (SELECT *, unnest([6, 5, 4, 3]) AS size FROM x WHERE len(own) >= 6),
q AS (SELECT *, unnest(range(1, len(own) - size + 2)) AS start FROM l),
r AS (SELECT doc_id, i, sn, size, start, own[start : start + size - 1] AS run FROM q),
a0 AS (SELECT doc_id, array_to_string(run, ' ') AS shown, (row_number() OVER (PARTITION BY doc_id ORDER BY i, sn, size DESC, start) - 1)::INTEGER AS place FROM r
WHERE NOT list_contains({_listed(T.FUNCTION_WORDS)}, lower(run[1])) AND NOT list_contains({_listed(T.FUNCTION_WORDS)}, lower(run[-1]))),
a AS (SELECT *, list_sort(list_distinct(regexp_extract_all(lower(shown), '[a-z0-9]+'))) AS query FROM a0 WHERE place < 12),
qs AS (SELECT DISTINCT query FROM a), qt AS (SELECT query, unnest(query) AS term FROM qs),
df AS (SELECT term, count(*) AS df FROM u GROUP BY term), rare AS (SELECT query, arg_min(term, (df, term)) AS term FROM qt JOIN df USING (term) GROUP BY query),
cs AS (SELECT doc_id, i, list(term) AS terms FROM u GROUP BY ALL),
m AS (SELECT rare.query, u.doc_id AS document, count(*) AS chunks FROM rare JOIN u USING (term) JOIN cs USING (doc_id, i) WHERE list_has_all(cs.terms, rare.query) GROUP BY ALL),
{_GATE}
SELECT doc_id, place, shown AS query FROM z WHERE n = 1 ORDER BY md5('7:' || doc_id::VARCHAR) LIMIT {PHRASES}"""

QUERIES = {
    "dehyphenated_pages": dehyphenated_pages,
    "structure_chunks": structure_chunks,
    "structure_census": structure_census,
    "rebuilt_texts": rebuilt_texts,
    "rare_token_set": rare_token_set,
    "phrase_set": phrase_set,
}

ORACLES = {
    "dehyphenated_pages": _DEHYPHENATED,
    "structure_chunks": _STRUCTURE,
    "structure_census": _CENSUS,
    "rebuilt_texts": _REBUILT,
    "rare_token_set": _RARE_TOKENS,
    "phrase_set": _PHRASES,
}
