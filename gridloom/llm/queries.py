"""The registered queries of the operators and, where SQL can say the same, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import (
    chat_format,
    embedding_dedup,
    exact_dedup,
    fill_middle,
    html_extract,
    katz,
    line_dedup,
    mixing,
    ngram_jaccard,
    packing,
    phrases,
    token_counts,
    toxicity,
)
from gridloom.llm.common import read, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


MIX_SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
k AS (
  SELECT *, md5(concat_ws('|', 'mix-1', coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(source, 'null'),
                          CAST(size AS VARCHAR))) AS key FROM s),
t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM s GROUP BY source),
c AS (SELECT *, source_size * 2e0 AS cap FROM t),
l AS (
  SELECT *, ((SELECT sum(size) FROM s) * 1.5e0
             - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM c WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
g AS (
  SELECT source, source_size,
         least(cap, weight * (SELECT max(level) FROM l WHERE level * weight <= cap)) AS target FROM l),
p AS (
  SELECT k.doc_id, k.size, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e"""


@query("op3_mixing", MIX_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix of all documents takes of each."""
    docs = read(spark, folder, "documents").select("doc_id", "source", word_count("text").alias("size"))
    marks = mixing.mix_marks(docs, size_col="size")
    return marks.select("doc_id", "size", "_mix.source_size", "_mix.target", "_mix.taken")


@query(
    "op6_exact_dedup",
    r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Group and fate of every document."""
    return exact_dedup.duplicate_groups(read(spark, folder, "documents"))


@query(
    "op7_line_dedup",
    r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''),
           '<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[^>]*>', chr(10), 'gis'), chr(10)),
           lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages),
n AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
c AS (SELECT host, line, count(*) AS k
      FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY ALL),
b AS (SELECT host, list(line) AS drops FROM c JOIN n USING (host) WHERE k >= 3 AND k > pages * 0.1e0 GROUP BY host),
r AS (SELECT page_id, p.host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(drops, x), false)) AS stay
      FROM p LEFT JOIN b ON p.host = b.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(stay) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(stay, chr(10)), '') AS text
FROM r""",
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Text of every page without its site's boilerplate lines."""
    pages = read(spark, folder, "pages").withColumn("host", line_dedup.host_of(F.col("url")))
    done = line_dedup.line_dedup(pages, F.col("host"), line_dedup.html_lines(F.col("html")), counts=True)
    return done.select("page_id", "host", "n_lines", "n_dropped", "text")


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g')) AS chars,
         length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) AS role_chars,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS last
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + CASE WHEN last = role THEN 3 ELSE role_chars + 13 END) AS BIGINT) AS formatted_chars,
       CAST(count(*) FILTER (last IS DISTINCT FROM role) AS BIGINT) AS n_messages
FROM e GROUP BY conv_id"""


@query("op8_chat_format", CHAT_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """What all formatted conversations, and one of control strings, say when read back."""
    odd = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"),
    )
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.chat_digest(chat_format.format_conversations(turns))


@query("op1_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens."""
    return packing.pack(read(spark, folder, "documents"), with_ids=False).drop("ids")


@query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents, from flat files of their ids."""
    counts = token_counts.count_document_tokens(read(spark, folder, "documents"))
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")
    split = F.regexp_extract("file", r"-c(\d+)", 1).cast("bigint")
    return counts.select(
        part.alias("part"), split.alias("split"), "doc_no", "start", "n_tokens", "ended"
    )


@query("op4_embedding_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding_dedup.near_duplicates(read(spark, folder, "embeddings"))


@query("op9_ngram_jaccard")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Shingles and class of near duplicates of every document."""
    return ngram_jaccard.jaccard_classes(read(spark, folder, "documents")).drop("text_mark")


@query("op2_katz")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document under the model and under its base."""
    return katz.katz_scores(read(spark, folder, "documents"), order=katz.ORDER)


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every whole text, learned from four folds of the labels in five."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    network = toxicity.train(docs, read(spark, folder, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(0)) == 0
    return toxicity.score(docs, network).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


FIM_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
k AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS u,
         CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS v,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, coalesce(array_to_string(units[1:least(u, v)], ''), '') AS prefix,
         coalesce(array_to_string(units[least(u, v) + 1:greatest(u, v)], ''), '') AS middle,
         coalesce(array_to_string(units[greatest(u, v) + 1:], ''), '') AS suffix
  FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""


@query("op11_fill_middle", FIM_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Form and cuts of every document, and digests of its output and of the text read back from it."""
    made = fill_middle.fill_in_middle(read(spark, folder, "documents").select("doc_id", "text")).drop("text")
    back = fill_middle.restore(made)
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


#: What the template of these tables makes of a page; the character references are those that occur in its articles.
PAGES_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's') AS body FROM pages),
b AS (
  SELECT page_id, url, list_transform(string_split(regexp_replace(body, '</?(?:p|h1)>', chr(1), 'g'), chr(1)), lambda x:
         trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(
           regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'),
           '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks
  FROM a),
t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t"""


@query("op12_html_extract", PAGES_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    done = html_extract.main_text(read(spark, folder, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


PHRASES_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS piece, lang, text
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS text
        FROM documents)),
w AS (SELECT lang, piece, regexp_extract_all(text, '[^\x20\x09]+') AS ws FROM p),
o AS (SELECT lang, piece, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w1 FROM w),
s AS (SELECT lang, w1, lead(w1) OVER i AS w2, lead(w1, 2) OVER i AS w3 FROM o WINDOW i AS (PARTITION BY piece ORDER BY pos)),
n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM s GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM s WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM s WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, 1 AS cut, x.f AS l, y.f AS r
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, x.f, y.f
  FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, x.f, y.f
  FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3),
scored AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS f
  FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
stay AS (
  SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.f IS NULL OR 100 * o.f < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM stay JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""


@query("op13_phrases", PHRASES_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 strongest phrases of two and three words of every language."""
    return phrases.collocations(read(spark, folder, "documents").select("lang", "text"))
