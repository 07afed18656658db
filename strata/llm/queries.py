"""The registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, jaccard, merkle, mixing, pii, prefs, quality, repair, secret_scan, spm, tokcount, toxicity
from .order import group_key

# The public vocabulary that the registered queries use; the operators take any path.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts under the vocabulary's scores read as unigram scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokcount.token_counts(docs, spm.read_model(spark, VOCABULARY), keep_text=False)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against the same one with its neighbour's last answer; masks as start:end lists."""
    pairs = prefs.preference_pairs(*prefs.with_neighbours_answers(table(spark, sf_dir, "conversations")))
    flat = lambda c: F.expr(f"array_join(transform({c}, m -> concat(m.start, ':', m.end)), ',')")
    return pairs.withColumns({c: flat(c) for c in ("chosen_mask", "rejected_mask")})


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.verified(table(spark, sf_dir, "documents").select("doc_id", "text"), spm.read_model(spark, VOCABULARY))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates with the forest's verdict; the vocabulary's whole words are the dictionary."""
    pieces = spm.parse(spm.read_model(spark, VOCABULARY)).pieces
    words = sorted({w for p in pieces if p.type == spm.NORMAL and len(w := p.piece.lstrip(spm.MARK).lower()) >= 4 and w.isalpha()})
    return secret_scan.scan(table(spark, sf_dir, "documents"), tuple(words), path_col="source")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False).drop("spans")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sources weighted 3, 1, 2 in turn, 150 % of all words, a source twice at most."""
    return mixing.mix(table(spark, sf_dir, "documents"), (3, 1, 2), share=1.5, epochs=2).drop("order_key")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, checked against a copy of the table that has lost line breaks in some texts."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    forged = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle.proofs(table(spark, sf_dir, "documents"), columns, carried={"doc_id": F.col("doc_id"), "forged": merkle.leaf(columns, {"text": forged})})
    siblings = F.expr("array_join(zip_with(left, right, (l, r) -> concat(l, r)), '')")
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), merkle.folded("forged").alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with a fault planted by the hash of ``conv_id:turn``; nulls are one blank."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), draw.alias("draw")).where("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every original conversation: what its damaged turns lack and the cheapest repair."""
    turns = table(spark, sf_dir, "conversations")
    edited, summary = repair.repair(damaged(turns))
    named = turns.select("conv_id").distinct().withColumn("g", group_key("conv_id"))
    rows = named.join(summary, "g", "left").join(repair.digests(edited), "g", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = r"""
WITH own AS (SELECT DISTINCT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT pair_id, max(turn) AS last FROM own WHERE role = 'assistant' GROUP BY pair_id),
answers AS (
  SELECT pair_id, last, max(text) AS answer FROM own JOIN last USING (pair_id) WHERE role = 'assistant' AND turn = last GROUP BY pair_id, last),
sides AS (
  SELECT 'c' AS side, pair_id, turn, role, text FROM own LEFT JOIN last USING (pair_id) WHERE last IS NULL OR turn <= last
  UNION ALL SELECT 'r', pair_id, turn, role, text FROM own JOIN last USING (pair_id) WHERE turn < last
  UNION ALL SELECT 'r', a.pair_id, a.last, 'assistant', b.answer FROM answers a JOIN answers b ON b.pair_id = xor(a.pair_id, 1)),
plain AS (
  SELECT DISTINCT side, pair_id, turn, replace(coalesce(role, ''), '<|im_', '<| im_') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM sides),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY side, pair_id ORDER BY turn, role, text) AS pos,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS part FROM plain),
c AS (SELECT * FROM turns WHERE side = 'c'), r AS (SELECT * FROM turns WHERE side = 'r'),
prefix AS (
  SELECT pair_id, coalesce(min(CASE WHEN c.turn IS DISTINCT FROM r.turn OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text THEN pos END) - 1, count(*)) AS n
  FROM c FULL JOIN r USING (pair_id, pos) GROUP BY pair_id),
placed AS (
  SELECT t.*, n, sum(length(part)) OVER (PARTITION BY side, pair_id, pos > n ORDER BY pos) - length(part) + 13 + length(role) AS opens
  FROM turns t JOIN prefix USING (pair_id)),
done AS (
  SELECT pair_id, CAST(n AS INTEGER) AS n_prompt_turns,
    coalesce(string_agg(part, '' ORDER BY pos) FILTER (side = 'c' AND pos <= n), '') AS prompt,
    coalesce(string_agg(part, '' ORDER BY pos) FILTER (side = 'c' AND pos > n), '') AS chosen,
    coalesce(string_agg(part, '' ORDER BY pos) FILTER (side = 'r' AND pos > n), '') AS rejected,
    coalesce(string_agg(opens || ':' || (opens + length(text) + 10), ',' ORDER BY pos) FILTER (side = 'c' AND pos > n AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg(opens || ':' || (opens + length(text) + 10), ',' ORDER BY pos) FILTER (side = 'r' AND pos > n AND role = 'assistant'), '') AS rejected_mask
  FROM placed GROUP BY pair_id, n)
SELECT *, chosen_mask <> '' AND rejected_mask <> '' AS usable FROM done
"""

OP9_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(r) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id, n
"""

OP10_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS s
  FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(p) WHERE len(w) > 0),
places AS (
  SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM d, (SELECT DISTINCT k FROM windows), unnest(range(1, len(w) - k + 2)) AS t(p)),
found AS (SELECT doc_id, p, k, item_id FROM places JOIN windows USING (k, s)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + k)) AS t(q) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP11_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, 2.0 * source_size AS cap,
    coalesce(sum(2 * source_size) OVER w, 0) AS caps, coalesce(sum(weight) OVER w, 0) AS weights
  FROM sources WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT max((CAST((SELECT sum(source_size) FROM sources) AS DOUBLE) * 1.5 - CAST(caps AS DOUBLE)) / ((SELECT sum(weight) FROM sources) - weights)) AS level FROM ordered),
goals AS (SELECT source, source_size, least(source_size * 2.0, level * weight) AS target FROM sources, level),
cuts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS times FROM goals),
placed AS (
  SELECT doc_id, source, size, coalesce(CAST(sum(size) OVER (
    PARTITION BY source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM sized)
SELECT doc_id, size, source_size, target,
  CAST(times * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - times * source_size - before)) AS BIGINT) AS taken
FROM placed p JOIN cuts c ON p.source IS NOT DISTINCT FROM c.source
"""

_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''),
  lambda c: [CAST(ord(c) AS UBIGINT), 256, 256, 256, 256, 256, 256, 256, 256]))),
  lambda a, x: CASE WHEN x < 256 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * CAST(3988292384 AS UBIGINT)) END))"""

_FIELDS = " || ".join(f"coalesce(CAST(octet_length(encode({v})) AS VARCHAR) || ':' || {v}, '-')" for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{0}"))

OP12_SQL = f"""
WITH RECURSIVE own AS (
  SELECT doc_id, source, sha256({_FIELDS.format('text')}) AS leaf,
    sha256({_FIELDS.format(f"CASE WHEN {_CRC32.format('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS forged FROM documents),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM own),
nodes AS (
  SELECT 0 AS level, tree, rank, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT level + 1, tree, rank // 3, sha256(string_agg(digest, '' ORDER BY rank)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY level, tree, rank // 3),
tops AS (
  SELECT 0 AS level, tree - 1 AS rank, digest AS digest, (SELECT max(tree) FROM leaves) AS n FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, rank // 3, sha256(string_agg(digest, '' ORDER BY rank)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, rank // 3),
steps AS (
  SELECT level, tree, rank, n, coalesce((SELECT string_agg(b.digest, '' ORDER BY b.rank) FROM nodes b WHERE b.level = a.level AND b.tree = a.tree AND b.rank // 3 = a.rank // 3 AND b.rank < a.rank), '') AS l,
    coalesce((SELECT string_agg(b.digest, '' ORDER BY b.rank) FROM nodes b WHERE b.level = a.level AND b.tree = a.tree AND b.rank // 3 = a.rank // 3 AND b.rank > a.rank), '') AS r
  FROM nodes a
  UNION ALL
  SELECT 100 + level, NULL, rank, n, coalesce((SELECT string_agg(b.digest, '' ORDER BY b.rank) FROM tops b WHERE b.level = a.level AND b.rank // 3 = a.rank // 3 AND b.rank < a.rank), ''),
    coalesce((SELECT string_agg(b.digest, '' ORDER BY b.rank) FROM tops b WHERE b.level = a.level AND b.rank // 3 = a.rank // 3 AND b.rank > a.rank), '')
  FROM tops a),
folds AS (
  SELECT 0 AS level, tree, rank AS own, rank, forged AS digest, '' AS proof, false AS done FROM leaves
  UNION ALL
  SELECT CASE WHEN s.n > 1 THEN f.level + 1 ELSE 100 END, f.tree, f.own, CASE WHEN s.n > 1 THEN f.rank // 3 WHEN f.level < 100 THEN f.tree - 1 ELSE f.rank END,
    CASE WHEN s.n > 1 THEN sha256(s.l || f.digest || s.r) ELSE f.digest END, CASE WHEN s.n > 1 THEN f.proof || s.l || s.r ELSE f.proof END, s.n = 1 AND f.level >= 100
  FROM folds f JOIN steps s ON s.level = f.level AND s.rank = f.rank AND (f.level >= 100 OR s.tree = f.tree) WHERE NOT f.done)
SELECT doc_id, leaf, sub.digest AS subroot, top.digest AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root, f.digest = top.digest AS verified
FROM leaves x JOIN (SELECT * FROM folds WHERE done) f ON f.tree = x.tree AND f.own = x.rank JOIN (SELECT * FROM nodes WHERE n = 1) sub ON sub.tree = x.tree, (SELECT digest FROM tops WHERE n = 1) top
"""

QUERIES = {f.__name__: f for f in (op1_projected_neighbours, op2_token_counts, op3_quality, op4_preferences, op5_sentencepiece, op6_secrets, op7_pii, op8_toxicity, op9_ngram_jaccard, op10_decontamination, op11_source_mix, op12_merkle_manifest, op13_conversation_repair)}
ORACLES: dict[str, str] = {"op4_preferences": OP4_SQL, "op9_ngram_jaccard": OP9_SQL, "op10_decontamination": OP10_SQL, "op11_source_mix": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
