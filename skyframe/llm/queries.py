"""The registered queries of the ten operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyframe.llm import decontaminate, langid, line_dedup, ngram_lm, packing, quality, quotes, repair, simhash, topk, toxicity, url_filter, whitening
from skyframe.llm.common import table

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def mail_form(conversations: DataFrame) -> DataFrame:
    """The conversations as a mail archive has them: each message below its two predecessors, quoted at levels 2 and 1."""
    turns = Window.partitionBy("conv_id").orderBy("turn", "text")
    quote = lambda text, mark: F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit(f"\n{mark}")))
    return conversations.withColumn("text", F.concat_ws("\n", quote(F.lag("text", 2).over(turns), "> > "), quote(F.lag("text", 1).over(turns), "> "), F.col("text")))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(mail_form(table(spark, sf_dir, "conversations")))


OP3_SQL = r"""
WITH mail AS (
  SELECT conv_id, turn, role, concat_ws(chr(10), '> > ' || replace(lag(text, 2) OVER w, chr(10), chr(10) || '> > '),
         '> ' || replace(lag(text, 1) OVER w, chr(10), chr(10) || '> '), text) AS raw
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)
), m AS (
  SELECT conv_id, turn, raw, min(role) AS role FROM mail GROUP BY conv_id, turn, raw
), split AS (
  SELECT conv_id, turn, raw, unnest(string_split(raw, chr(10))) AS x, unnest(range(len(string_split(raw, chr(10))))) AS pos FROM m
), lines AS (
  SELECT conv_id, turn, raw, pos, length(regexp_replace(regexp_extract(x, '^((?:[ \t]*>)*)[ \t]?', 1), '[^>]', '', 'g')) AS depth,
         regexp_replace(x, '^(?:[ \t]*>)+[ \t]?', '') AS line FROM split
), bodies AS (
  SELECT conv_id, turn, raw, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE depth = 0), '') AS body FROM lines GROUP BY ALL
), said AS (
  SELECT DISTINCT conv_id, turn, norm FROM (
    SELECT conv_id, turn, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM (
      SELECT conv_id, turn, body AS x FROM bodies UNION ALL SELECT conv_id, turn, unnest(string_split(body, chr(10))) FROM bodies)
  ) WHERE norm <> ''
), islands AS (
  SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn, raw, depth ORDER BY pos) AS island FROM lines WHERE depth > 0
), passages AS (
  SELECT conv_id, turn, raw, depth, island, string_agg(line, chr(10) ORDER BY pos) AS whole FROM islands GROUP BY ALL
), asked AS (
  SELECT conv_id, turn, raw, depth, island, kind, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM (
    SELECT conv_id, turn, raw, depth, island, 0 AS kind, whole AS x FROM passages
    UNION ALL SELECT conv_id, turn, raw, depth, island, 1, line FROM islands)
), hits AS (
  SELECT a.conv_id, a.turn, a.raw, a.depth, a.island, a.kind, max(s.turn) AS origin
  FROM asked a JOIN said s ON a.conv_id = s.conv_id AND a.norm = s.norm AND s.turn < a.turn GROUP BY ALL
), links AS (
  SELECT conv_id, turn, raw, depth, island, coalesce(max(origin) FILTER (WHERE kind = 0), max(origin)) AS origin FROM hits GROUP BY ALL
), linked AS (
  SELECT conv_id, turn, raw, count(origin) AS n_linked, max(origin) FILTER (WHERE depth = 1) AS parent_turn FROM links GROUP BY ALL
), counted AS (
  SELECT conv_id, turn, raw, count(*) AS n_passages, max(depth) AS max_depth FROM passages GROUP BY ALL
)
SELECT b.conv_id, b.turn, m.role, b.body AS text, coalesce(n_passages, 0) AS n_passages, coalesce(n_linked, 0) AS n_linked,
       coalesce(max_depth, 0)::INT AS max_depth, parent_turn, (row_number() OVER (PARTITION BY b.conv_id ORDER BY b.turn, b.body))::INT AS position
FROM bodies b JOIN m USING (conv_id, turn, raw) LEFT JOIN counted USING (conv_id, turn, raw) LEFT JOIN linked USING (conv_id, turn, raw)
"""


def answer_form(conversations: DataFrame) -> DataFrame:
    """The conversations as a mailing list has them: message n answers message (n - 1) / 2, quoted whole but with lines broken anew."""
    asked = conversations.select(F.col("conv_id").alias("c"), (F.col("turn")).alias("t"), F.col("text").alias("quoted"))
    answered = F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2))
    both = conversations.join(asked.hint("merge"), (F.col("conv_id") == F.col("c")) & (answered == F.col("t")), "left")
    wrapped = F.regexp_replace("quoted", r"([^\n]{30,60}) ", "$1\n")
    return both.select("conv_id", "turn", "role", F.concat_ws("\n", F.concat(F.lit("> "), F.replace(wrapped, F.lit("\n"), F.lit("\n> "))), F.col("text")).alias("text"))


def quoted_mail_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply-ordered conversations without quotes, from mail in which threads branch and quotes are wrapped."""
    ordered = quotes.reply_order(quotes.link_quotes(answer_form(table(spark, sf_dir, "conversations"))))
    line = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n\n")
    return quotes.chats(ordered).select("conv_id", "part", F.size("messages").alias("n_messages"), line.alias("chat"))


CHATS_SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, min(role) AS role, text FROM conversations GROUP BY conv_id, turn, text
), said AS (
  SELECT DISTINCT conv_id, turn, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
  FROM (SELECT conv_id, turn, text AS x FROM m UNION ALL SELECT conv_id, turn, unnest(string_split(text, chr(10))) FROM m)
), answers AS (
  SELECT b.conv_id, b.turn, max(s.turn) AS parent
  FROM m b JOIN m a ON a.conv_id = b.conv_id AND b.turn > 0 AND a.turn = (b.turn - 1) // 2
  JOIN said s ON s.conv_id = b.conv_id AND s.turn < b.turn AND s.norm = lower(trim(regexp_replace(a.text, '[\x20\x09-\x0D]+', ' ', 'g')))
  WHERE s.norm <> '' GROUP BY ALL
), up AS (
  SELECT conv_id, turn, turn AS root FROM (SELECT DISTINCT conv_id, turn FROM m) ANTI JOIN answers USING (conv_id, turn)
  UNION ALL
  SELECT a.conv_id, a.turn, u.root FROM up u JOIN answers a ON a.conv_id = u.conv_id AND a.parent = u.turn
), placed AS (
  SELECT m.*, row_number() OVER (PARTITION BY m.conv_id ORDER BY root, m.turn, text) AS place FROM m JOIN up USING (conv_id, turn)
)
SELECT conv_id, ((place - 1) // 1000)::INT AS part, count(*)::INT AS n_messages, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY place) AS chat
FROM placed GROUP BY ALL
"""


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_held_out(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       (count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
              FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id
"""

def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"), PIECE_BPE)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return topk.top_k(vectors.filter(F.col("id") % 50 == 0), vectors, 5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds, with the least number of edits."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


#: crc32 bit by bit; then the least (cost, audit) per state of the pattern, row by row. One insertion in a gap is as many as pay.
OP11_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), hashed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
             lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 20 AS kind FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again FROM hashed WHERE kind <> 0
), ordered AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS kept,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS pos FROM damaged
), faulty AS (
  SELECT *, CASE WHEN kept = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM ordered
), steps(p, x, q) AS (
  VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')
), starts(p, q, cost, audit, line) AS (
  SELECT p, p, 0, '', '' FROM (VALUES (''), ('s'), ('u'), ('a')) AS t(p)
  UNION ALL SELECT p, q, 2, 'I', chr(10) || CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END FROM steps WHERE x <> 's'
), edits(p, q, x, edit, cost) AS (
  SELECT p, q, x, 'K', 0 FROM steps UNION ALL SELECT p, q, x, 'R', 2 FROM steps WHERE x <> 's'
  UNION ALL SELECT p, p, '', 'D', 3 FROM (VALUES (''), ('s'), ('u'), ('a')) AS t(p)
), best AS (
  SELECT conv_id, 0::BIGINT AS pos, '' AS state, struct_pack(cost := 0::BIGINT, audit := '', lines := '') AS v
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT b.conv_id, b.pos + 1, e.q, min(struct_pack(
           cost := (b.v.cost + s.cost + e.cost + CASE WHEN r.fault = 'truncated' AND e.edit <> 'D' THEN 1 ELSE 0 END)::BIGINT,
           audit := b.v.audit || s.audit || e.edit,
           lines := b.v.lines || s.line || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text
                    ELSE chr(10) || CASE e.x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text END))
  FROM best b JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.pos + 1
  JOIN starts s ON s.p = b.state
  JOIN edits e ON e.p = s.q AND (e.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR e.x = r.initial))
  GROUP BY ALL
), ended AS (
  SELECT conv_id, min(struct_pack(cost := v.cost + CASE state WHEN 'u' THEN 2 ELSE 0 END, audit := v.audit || CASE state WHEN 'u' THEN 'I' ELSE '' END,
                      lines := v.lines || CASE state WHEN 'u' THEN chr(10) || 'assistant:' ELSE '' END)) AS v
  FROM best b JOIN (SELECT conv_id AS c, count(*) AS n FROM faulty GROUP BY 1) ON c IS NOT DISTINCT FROM conv_id AND n = pos
  WHERE state <> 's' GROUP BY 1
), counted AS (
  SELECT conv_id AS c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY 1
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v.cost, 0)::BIGINT AS cost,
       coalesce(v.audit, '') AS audit, sha256(coalesce(substr(v.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted ON c IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


URL_RULES = "VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')"


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM ({URL_RULES}) AS r(host, path, verdict)")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


OP13_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS place FROM cut
), fits AS (
  SELECT place, arg_max(struct_pack(rule := r.host || r.path, verdict), (length(r.host || r.path), length(r.host))) AS best
  FROM parts p JOIN ({URL_RULES}) AS r(host, path, verdict)
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY place
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (place)
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_toxicity, op3_quotation_linking, op4_lm_scoring, op5_quality_classifier, op6_line_dedup, op7_language_id,
        op8_simhash_near_dedup, op9_exact_top_k, op10_benchmark_decontamination, op11_conversation_repair, op12_embedding_whitening, op13_url_filters, quoted_mail_chats,
    )
}
ORACLES = {"op3_quotation_linking": OP3_SQL, "op6_line_dedup": OP6_SQL, "op9_exact_top_k": OP9_SQL, "op11_conversation_repair": OP11_SQL, "op13_url_filters": OP13_SQL, "quoted_mail_chats": CHATS_SQL}
