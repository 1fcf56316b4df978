"""The registered queries of this subpackage and their DuckDB twins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, embedding_dedup, jaccard_join, lang_id, line_dedup, mixing, prefix_trie, quality_fm, quality_rules, token_counts, token_output, url_filter
from .common import fold, read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return put


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids of every text, encoded by distinct words, and the text decoded from them (digests)."""
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.encode_and_decode(read_table(spark, sf_dir, "documents"), ranks))


@query("op9_token_output")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids written to seekable files and read back from them (digests)."""
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    shards = token_output.write_tokens(read_table(spark, sf_dir, "documents"), spec, end_id=2)
    return token_output.digest(token_output.read_tokens(shards))


@query("op10_mixing", """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS ord FROM documents),
src AS (
  SELECT *, CASE (source_no % 3) WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no
    FROM sized GROUP BY source)),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source_no
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY 2 * source_size / weight, source_no
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM src),
goals AS (
  SELECT source, source_size, least(2 * source_size::DOUBLE,
         weight * (SELECT max(level) FROM levels WHERE level <= 2 * source_size / weight)) AS target FROM levels),
placed AS (
  SELECT s.*, g.source_size, g.target, round(g.target)::BIGINT AS quota,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY ord, doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - start - source_size)))::BIGINT AS taken
FROM placed
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document (weights 3, 1, 2; 150 % of all words; 2 epochs)."""
    return mixing.taken(*mixing.plan(read_table(spark, sf_dir, "documents")))


_BASE_SQL = " AND ".join(r.sql() for r in quality_rules.BASE)
_KEPT_SQL = " AND ".join(r.sql() for r in (*quality_rules.BASE, *quality_rules.RULES))
_STOP_SQL = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)


@query("op2_quality_rules", f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) AS v(k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(list_aggregate(list_append(ws, ''), 'string_agg', ''))::BIGINT AS word_chars,
         length(regexp_replace(list_aggregate(list_append(ws, ''), 'string_agg', ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         len(list_filter(ws, lambda x: x IN ({_STOP_SQL}))) AS n_stop_words, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       NOT ({_BASE_SQL}) AS base_failed, ({_KEPT_SQL}) AS kept FROM m
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts of every text and the verdict of the threshold table."""
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_jaccard_join", """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS r FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(r) AS component_id FROM reach GROUP BY a) m ON m.a = d.doc_id
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose five-word shingle sets link at Jaccard 0.8."""
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op3_embedding_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y
  ON len(x.e) = len(y.e) AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach AS (
  SELECT vec_id AS a, vec_id AS r FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.r = links.a),
c AS (SELECT a, min(r) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of vectors at cosine 0.95."""
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query("op6_line_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines of which an earlier exact or fuzzy occurrence stays."""
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def language_model(docs: DataFrame):
    """Languages and network learned from the rows that are not held out."""
    return lang_id.train(lang_id.sample(docs, fold("doc_id", 4) != 2, "doc_id", "text", "lang"))


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and its mean probability for every whole text."""
    docs = read_table(spark, sf_dir, "documents")
    found = lang_id.identify(docs, *language_model(docs), keep=["doc_id"])
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op7_quality_fm")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text by a factorisation machine."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    machine = quality_fm.learn(docs, labels, fold("doc_id", 5) != 0)
    return quality_fm.score(docs, machine).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op5_url_filter")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return url_filter.verdicts(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op11_collocations", r"""
WITH p AS (
  SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x
    FROM documents)),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, range(1, 6) AS t(k) WHERE len(ws) >= k)),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, f AS a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS head, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
covers AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY ALL),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
  FROM best b LEFT JOIN covers c ON c.lang = b.lang AND c.phrase = b.phrase WHERE c.most IS NULL OR 100 * c.most < 100 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 collocations of two to five words of each language."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"), least=100, cover_percent=100, top=2000)


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than 2,048 tokens."""
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    counted = token_counts.count_tokens(read_table(spark, sf_dir, "documents"), spec)
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


@query("op13_prefix_trie", """
WITH t AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, md5(printf('%016X', strlen(role)) || role || text), strlen(text)) AS ts
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
c AS (
  SELECT conv_id, ts, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x % 2)))), 4294967295::BIGINT) % 9 AS h FROM t),
r AS (
  SELECT c.conv_id, list_concat(coalesce(l.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts FROM c LEFT JOIN t l ON l.conv_id = c.conv_id - c.conv_id % 5),
nodes AS (
  SELECT ts[1:d] AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CASE WHEN len(ts) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
  FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM r) GROUP BY ts[1:d], d),
kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
own AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.path[n.depth].text) END AS saved
  FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path),
sums AS (
  SELECT path[1:d] AS path, d AS depth, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM own) GROUP BY path[1:d], d)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, sha256(o.ends) AS ends_sha256
FROM own o JOIN sums s ON s.depth = o.depth AND s.path = o.path LEFT JOIN nodes p ON p.depth = o.depth - 1 AND p.path = o.path[1:o.depth - 1]
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))
