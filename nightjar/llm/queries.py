"""Registered queries of the training-data operators."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.llm import (chat_format, decontaminate, embedding_dedup, lexical, line_dedup, ngram_lm, packing, quality, secret_scan,
                          simhash, spelling, substring_dedup, token_store)
from nightjar.session import checkpoint_dir
from nightjar.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: its turns and targets, parsed from the windows, which
    come sorted. Only two running digests and three counts are held."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state, done = None, []

    def row(s: dict) -> tuple:
        return s["id"], s["turns"], s["all"].hexdigest(), s["loss"], s["target"].hexdigest(), s["chars"]

    for batch in batches:
        for w in batch.to_pylist():
            if state is None or state["id"] != w["conv_id"]:
                if state is not None:
                    done.append(row(state))
                state = {"id": w["conv_id"], "turns": 0, "all": hashlib.sha256(), "loss": 0,
                         "target": hashlib.sha256(), "chars": 0}
            text = w["text"]
            for role, said in chat_format.parse(text)[w["n_context"]:]:
                state["turns"] += 1
                state["all"].update(f"{role}\n{said}\n".encode())
            for span in w["loss"]:
                target = chat_format.unescape(text[span["start"]:span["end"]])
                state["loss"] += len(target)
                state["target"].update(target.encode())
            state["chars"] += len(text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*done), types)], names=names)
            done = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(row(state)), types)], names=names)


@query("op1_chat_formatting")
def op1_chat_formatting(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') "
                      "AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat_format.format_conversations(turns, vocabulary("byte_bpe_50k.json"))
    # The contract's digests run over a conversation's turns in order, so its windows meet in one
    # task; they stream through it and are never held.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (formatted.select("conv_id", "block", "window", "text", "loss", "n_context").repartition(parts, "conv_id")
            .sortWithinPartitions("conv_id", "block", "window")
            .mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                    "loss_sha256 string, formatted_chars long"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SQL_LINES = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS i FROM parts),
keyed AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                              '{UPPER}', '{LOWER}') AS key FROM lines),
gone AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN gone ON keyed.key = gone.key GROUP BY doc_id"""


@query("op2_line_dedup", _SQL_LINES)
def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_SQL_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
_SQL_DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
pats AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS pat FROM
         (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
          FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM pats),
wins AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS pat FROM
         (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes)),
occ AS (SELECT doc_id, wins.m, i, item_id FROM wins JOIN pats ON wins.pat = pats.pat AND wins.m = pats.m),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM
         (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM
        (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)"""


@query("op3_benchmark_decontamination", _SQL_DECONTAMINATION)
def op3_benchmark_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.search_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


_SQL_SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM
         (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
many AS (SELECT win FROM wins GROUP BY win HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM wins JOIN many USING (win)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT words.doc_id, count(hit.p) AS n_removed,
                coalesce(string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE hit.p IS NULL), '') AS kept
         FROM words LEFT JOIN hit ON words.doc_id = hit.doc_id AND words.p = hit.p GROUP BY words.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@query("op4_substring_dedup", _SQL_SUBSTRINGS)
def op4_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs, window=35).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, k=3, max_distance=2).select(
        "doc_id", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_secret_scans")
def op6_secret_scans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    base = F.filter("findings", lambda f: f.kind != "model")

    def count(kind):
        return F.size(F.filter("findings", lambda f: f.kind == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f.kind, f.start, f.end)), ",")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("findings")).alias("spans"))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


_SQL_EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0
       AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
walk(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM walk GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)"""


@query("op8_embedding_near_dedup", _SQL_EMBEDDINGS)
def op8_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query("op9_lm_scoring")
def op9_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return ngram_lm.score_texts(docs, remainder != 2).select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def quality_training(column: str = "doc_id"):
    """Rows that may be learned from; null ids may not."""
    return F.coalesce(F.expr(f"crc32(cast(cast({column} AS string) AS binary)) % 5 <> 0"), F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality.score(docs, quality.train(docs, labels, quality_training()))


@query("op10_quality_classifier")
def op10_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (~quality_training()).alias("held_out"), "score",
                         F.expr("cast(score >= 0.3 AS int)").alias("predicted"))


def corpus_words(docs: DataFrame, drop_every: int = 199) -> DataFrame:
    """(word, n) of all letter runs of ``docs`` (doc_id, text). Of a run whose
    crc32 with its doc_id (null: empty) ``drop_every`` divides, a code point is gone."""
    runs = spelling.letter_runs(docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.length("run")))
    word = F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("op11_spelling_variants")
def op11_spelling_variants(spark, sf_dir):
    words = corpus_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.group_variants(words, min_length=6, min_count=5, ratio=5).select(
        "word", "form", "root", "n", "n_near", "form_n")


_SQL_TERMS = (f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
              r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
_SQL_RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
asked AS (SELECT DISTINCT term FROM q),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d)
       JOIN asked USING (term) GROUP BY r, doc_id, n, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM tf, s GROUP BY term),
scores AS (SELECT item_id, r, doc_id,
                  CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
           FROM tf JOIN weights USING (term) JOIN q USING (term), s GROUP BY item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""


@query("op12_ranked_search", _SQL_RANKED)
def op12_ranked_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.rank(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)


@query("op13_token_store")
def op13_token_store(spark, sf_dir):
    folder = f"{checkpoint_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    token_store.write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), folder, end_id=1)
    return token_store.read_documents(spark, folder)
