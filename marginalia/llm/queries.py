"""One query per operator over its whole table, in the columns its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm import decontamination, host_reputation, language_id, language_model, line_dedup, near_dedup, nearest, personal_data, prefix_trie, repeated_spans, reply_trees, structure_repair, token_codec
from marginalia.llm.oracles import DIALOGUE
from marginalia.llm.storage import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, folds: int):
    """The fold of a document: crc32 of its id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % folds


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; documents of fold 2 of 4 are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.where(~held_out).select("text", "lang"))
    return language_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows, by inner product, of every row whose id is divisible by 20."""
    return nearest.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and the text they decode to, as digests."""
    return token_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=False)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every document, literally or re-parameterised."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontamination.judge(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return judged.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and attention scores of every whole text; documents of fold 2 of 7 are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 7) == 2
    scored = language_model.score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: the patterns' spans, and those the random field adds."""
    model = personal_data.train(personal_data.labelled_table())
    found = personal_data.find(table(spark, sf_dir, "documents"), model)

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = personal_data.listing(F.col("base"))
    return found.select("doc_id", *[count(k) for k in personal_data.KINDS], F.sha2(base, 256).alias("base_sha256"), personal_data.listing(F.col("spans")).alias("spans"))


#: The rules of the contract, (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or reputation verdict of every page; the label of the same number is a page's outcome."""
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return host_reputation.judge(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters that at least 5 documents hold stay in the last document only."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier in the corpus are removed from every document."""
    kept = repeated_spans.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a shingle similarity of 0.75 or more."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that holds the template's own control strings, formatted and read back."""
    ok = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ok).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = reply_trees.format_paths(reply_trees.chains(turns))
    read = reply_trees.read_turns(F.col("formatted"))
    made = made.withColumns({"turns": read, "learned": reply_trees.read_loss(F.col("formatted"), F.col("loss"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another one, as the contract of the trie builds them, and their ids."""
    head = F.crc32(F.col("conv_id").cast("string")) % 4
    in_order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.row_number().over(in_order))
    ids = turns.where("conv_id is not null").select("conv_id").distinct()
    first = rows.where((F.col("conv_id") % 20 == 0) & (F.col("place") <= 3)).withColumnRenamed("conv_id", "source")
    lent = ids.withColumn("source", F.col("conv_id") - F.col("conv_id") % 20).join(first, "source").where(F.col("place") <= head)
    columns = ["conv_id", "place", "role", "text"]
    return rows.where(F.col("place") > head).select(*columns).unionByName(lent.select(*columns)), ids


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shared and single prefix of the rebuilt conversations."""
    turns, ids = rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_trie.prefix_trie(turns, order="place", ids=ids)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with the faults the contract of the repair plants, by a hash of conversation and turn."""
    def text(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    rows = turns.withColumn("fate", F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).where("fate <> 0")
    said = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(text("role")).alias("role"), said.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    whole = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = damaged(whole)
    report = stored(structure_repair.reports(turns, ids=whole), "repairs")
    prints = structure_repair.fingerprints(structure_repair.repaired(turns, report)).withColumnRenamed("conv_id", "conv")
    found = report.join(prints, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_nearest, op3_token_codec, op4_decontamination, op5_language_model, op6_personal_data, op7_host_reputation, op8_line_dedup, op9_repeated_spans, op10_near_dedup, op11_chat_format, op12_prefix_trie, op13_structure_repair)}

ORACLES: dict[str, str] = dict(DIALOGUE)

ORACLES["op8_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
held AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT lines.doc_id, i, l, held.k IS NOT NULL AND lines.doc_id <> held.keeper AS gone FROM lines LEFT JOIN held ON lines.k = held.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

ORACLES["op7_host_reputation"] = r"""
WITH split AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosted AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM split),
outcome AS (
  SELECT doc_id AS page_id, CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NULL OR quality IS NULL THEN NULL ELSE 0 END AS bad FROM labels),
per_host AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
         CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host ELSE regexp_extract(host, '([^.]*\.)?[^.]*$') END AS domain,
         regexp_extract(host, '[^.]*$') AS suffix
  FROM hosted LEFT JOIN outcome USING (page_id) GROUP BY host),
per_domain AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM per_host GROUP BY ALL),
per_suffix AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM per_domain GROUP BY ALL),
corpus AS (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0.5 END AS rate FROM per_suffix),
levels AS (
  SELECT 0 AS level, s.n, s.bad, rate AS parent FROM per_suffix s, corpus
  UNION ALL SELECT 1, d.n, d.bad, CASE WHEN s.n > 0 THEN s.bad / s.n ELSE rate END FROM per_domain d JOIN per_suffix s USING (suffix), corpus
  UNION ALL SELECT 2, h.n, h.bad, CASE WHEN d.n > 0 THEN d.bad / d.n ELSE rate END FROM per_host h JOIN per_domain d USING (domain, suffix), corpus),
moments AS (
  SELECT level, sum(n * (bad / n - parent) * (bad / n - parent)) AS s, sum(parent * (1 - parent)) AS v, sum(parent * (1 - parent) * (n - 1)) AS w
  FROM levels WHERE n > 0 GROUP BY level),
strengths AS (
  SELECT l.level, 1 / CASE WHEN w <> 0 THEN least(0.5, greatest(0.001, (s - v) / w)) ELSE 0.001 END - 1 AS k
  FROM (VALUES (0), (1), (2)) AS l(level) LEFT JOIN moments USING (level)),
k AS (SELECT max(k) FILTER (WHERE level = 0) AS k0, max(k) FILTER (WHERE level = 1) AS k1, max(k) FILTER (WHERE level = 2) AS k2 FROM strengths),
known AS (
  SELECT host, (k2 * (k1 * (k0 * rate + s.bad) / (k0 + s.n) + d.bad) / (k1 + d.n) + h.bad) / (k2 + h.n) AS mean, k2 + h.n AS weight
  FROM per_host h JOIN per_domain d USING (domain, suffix) JOIN per_suffix s USING (suffix), corpus, k),
ruled AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM hosted)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block'
            ELSE CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.25 THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled JOIN known USING (host)
"""
