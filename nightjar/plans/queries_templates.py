"""Template-mining queries (T1-T5) over event details and whole document lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import templates as TM
from nightjar.plans.catalog import register, rounded
from nightjar.plans.fixtures import sec_events
from nightjar.plans.oracle_sql import SEC_EVENTS, with_
from nightjar.sources.tables import table

SPLIT_TS = "2024-01-15 00:00:00"


def _mask_sql(x: str) -> str:
    t = x
    t = f"regexp_replace({t}, '{TM.UUID_PATTERN}', '<UUID>', 'g')"
    t = f"regexp_replace({t}, '{TM.TS_PATTERN}', '<TS>', 'g')"
    t = f"regexp_replace({t}, '{TM.IP_PATTERN}', '<IP>', 'g')"
    t = f"regexp_replace({t}, '{TM.NUM_PATTERN}', '<NUM>', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


_TID = "CAST('0x' || substr(md5(template), 1, 15) AS BIGINT)"

_MINED = with_(SEC_EVENTS, f"""
m0 AS (SELECT event_id, ts, {_mask_sql("coalesce(nullif(details, ''), event_type)")} AS template FROM sec),
mined AS (SELECT event_id, ts, template, {_TID} AS template_id FROM m0)""")


def mined_events(spark, sf):
    ev = sec_events(spark, sf)
    return TM.mine(ev, TM.content()).select("event_id", "ts", "template", "template_id")


@register("mask_template", _MINED + "\nSELECT event_id, template, template_id FROM mined")
def q_mask(spark, sf):
    """Masked template and stable id per event."""
    return mined_events(spark, sf).select("event_id", "template", "template_id")


@register("template_stats", _MINED + """
SELECT template_id, template, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen,
       round(count(*) / (SELECT count(*) FROM mined)::DOUBLE, 6) AS share
FROM mined GROUP BY 1, 2""")
def q_template_stats(spark, sf):
    """T4: template catalogue."""
    return rounded(TM.template_stats(mined_events(spark, sf)))


@register("template_new", _MINED + f"""
SELECT template_id, template, count(*) AS n, min(ts) AS first_seen FROM mined
WHERE ts >= TIMESTAMP '{SPLIT_TS}' AND template_id NOT IN
  (SELECT template_id FROM mined WHERE ts < TIMESTAMP '{SPLIT_TS}')
GROUP BY 1, 2""")
def q_template_new(spark, sf):
    """T4 deviations: templates first seen after the split."""
    return TM.new_templates(mined_events(spark, sf), SPLIT_TS)


def _merge_sql(src: str) -> str:
    return f""",
tpl AS (SELECT template, count(*) AS n, string_split(template, ' ') AS toks FROM {src} GROUP BY template),
tk AS (SELECT template, n, len(toks) AS n_tokens, toks[1] AS first_token, unnest(toks) AS tok,
              generate_subscripts(toks, 1) - 1 AS pos FROM tpl),
bp AS (SELECT n_tokens, first_token, pos, CASE WHEN count(DISTINCT tok) > 1 THEN '<*>' ELSE min(tok) END AS tok
       FROM tk GROUP BY 1, 2, 3),
mg AS (SELECT n_tokens, first_token, string_agg(tok, ' ' ORDER BY pos) AS merged_template FROM bp GROUP BY 1, 2),
sz AS (SELECT len(toks) AS n_tokens, toks[1] AS first_token, count(*) AS n_templates, CAST(sum(n) AS BIGINT) AS n_lines
       FROM tpl GROUP BY 1, 2)
SELECT mg.n_tokens, mg.first_token, merged_template, n_templates, n_lines
FROM mg JOIN sz ON sz.n_tokens = mg.n_tokens AND sz.first_token = mg.first_token"""


@register("template_merge", _MINED + _merge_sql("mined"))
def q_template_merge(spark, sf):
    """T5: wildcard merge of similar event templates."""
    out = TM.merge_templates(mined_events(spark, sf))
    return out.select("n_tokens", "first_token", "merged_template", "n_templates", "n_lines")


_DOC_LINES = f"""
WITH dl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
dmined AS (SELECT {_mask_sql("line")} AS template FROM dl),
dm AS (SELECT template, {_TID} AS template_id FROM dmined)"""


def doc_mined(spark, sf):
    ln = TM.lines(table(spark, sf, "documents").select("doc_id", "text"))
    return TM.mine(ln, F.col("line")).select("doc_id", "line_no", "template", "template_id")


@register("doc_template_stats", _DOC_LINES + """
SELECT template_id, count(*) AS n, round(count(*) / (SELECT count(*) FROM dm)::DOUBLE, 6) AS share
FROM dm GROUP BY 1""")
def q_doc_template_stats(spark, sf):
    """T1 + T4 at volume: templates of every line of every document."""
    return rounded(TM.template_stats(doc_mined(spark, sf), ts=None, text=False))


@register("doc_template_merge", _DOC_LINES + _merge_sql("dm"))
def q_doc_template_merge(spark, sf):
    """T5 at volume over document-line templates."""
    out = TM.merge_templates(doc_mined(spark, sf))
    return out.select("n_tokens", "first_token", "merged_template", "n_templates", "n_lines")


def _cluster_sql(src: str) -> str:
    return f""",
ct AS (SELECT template, count(*) AS n_lines, string_split(template, ' ') AS toks FROM {src} GROUP BY template),
cp AS (SELECT template, n_lines, len(toks) AS k, toks[1] AS f, unnest(toks) AS tok,
              generate_subscripts(toks, 1) AS pos FROM ct),
cg AS (SELECT len(toks) AS k, toks[1] AS f, sum(n_lines) AS total FROM ct GROUP BY 1, 2),
cs AS (SELECT k, f, pos, tok, sum(n_lines) AS n FROM cp GROUP BY 1, 2, 3, 4),
cc AS (SELECT cp.template, cp.n_lines, cp.k, cp.pos, cp.tok, cs.n >= 0.2::DOUBLE * cg.total AS const
       FROM cp JOIN cs ON cs.k = cp.k AND cs.f = cp.f AND cs.pos = cp.pos AND cs.tok = cp.tok
       JOIN cg ON cg.k = cp.k AND cg.f = cp.f),
cm AS (SELECT template, n_lines, string_agg(CASE WHEN const THEN tok ELSE '<*>' END, ' ' ORDER BY pos) AS general,
              sum(CASE WHEN const THEN 1 ELSE 0 END) / k::DOUBLE AS similarity FROM cc GROUP BY template, n_lines, k),
cl AS (SELECT template AS own, n_lines, CASE WHEN similarity >= 0.4 THEN general ELSE template END AS template, similarity
       FROM cm),
cf AS (SELECT own, n_lines, template AS cluster_template, similarity, {_TID} AS cluster_id FROM cl)"""


@register("template_cluster", _MINED + _cluster_sql("mined") + """
SELECT event_id, cluster_id, cluster_template, round(similarity, 6) AS similarity
FROM mined JOIN cf ON cf.own = mined.template""")
def q_template_cluster(spark, sf):
    """T5: cluster of every event."""
    mined = mined_events(spark, sf)
    found = TM.cluster_templates(mined)
    return rounded(mined.join(found, "template").select("event_id", "cluster_id", "cluster_template", "similarity"))


@register("doc_template_cluster", _DOC_LINES + _cluster_sql("dm") + """
SELECT cluster_id, count(*) AS n_templates, CAST(sum(n_lines) AS BIGINT) AS n_lines FROM cf GROUP BY 1""")
def q_doc_template_cluster(spark, sf):
    """T5 at volume: clusters of the templates of all document lines."""
    found = TM.cluster_templates(doc_mined(spark, sf))
    return found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_templates"), F.sum("n_lines").alias("n_lines"))
