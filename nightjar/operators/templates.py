"""Log-template mining (T1-T5) with built-in regex and aggregate functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightjar.functions.columns import col, present
from nightjar.session import checkpoint_dir

# ---- fixed values: masking patterns, applied in this order ----------------------
UUID_PATTERN = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
TS_PATTERN = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z"
IP_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
NUM_PATTERN = r"\b\d+\b"
WILDCARD = "<*>"
GROUP_BYTES = 8 << 20           # text of a group beyond which its templates are dealt over many tasks
ROW_BYTES = 32                  # what a line counts besides its text
MAX_BROADCAST_GROUPS = 10_000   # such groups up to which their constants are sent to all tasks
# ----------------------------------------------------------------------------------


def mask(text) -> Column:
    """UUID -> <UUID>, ISO time -> <TS>, dotted quad -> <IP>, integers ->
    <NUM>, whitespace collapsed and trimmed."""
    t = col(text)
    t = F.regexp_replace(t, UUID_PATTERN, "<UUID>")
    t = F.regexp_replace(t, TS_PATTERN, "<TS>")
    t = F.regexp_replace(t, IP_PATTERN, "<IP>")
    t = F.regexp_replace(t, NUM_PATTERN, "<NUM>")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def template_id(template) -> Column:
    """Stable id = first 15 hex digits (60 bits) of md5(template) as a bigint."""
    return F.conv(F.substring(F.md5(col(template)), 1, 15), 16, 10).cast("bigint")


def content(details="details", event_type="event_type") -> Column:
    """The text to mine: details, else the event type."""
    return F.coalesce(present(col(details)), col(event_type))


def mine(df: DataFrame, text: Column) -> DataFrame:
    """T1 + T3 as columns ``template`` and ``template_id``."""
    return df.withColumn("template", mask(text)).withColumn("template_id", template_id("template"))


def lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Whole documents -> one row per line (every line, no prefix)."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def template_stats(mined: DataFrame, ts: str | None = "ts", text: bool = True) -> DataFrame:
    """T4: per template count, first/last seen and share of all rows. Without
    ``text`` rows are grouped by the id alone and no template text is shuffled."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if ts:
        aggs += [F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen")]
    g = mined.groupBy("template_id", *(["template"] if text else [])).agg(*aggs)
    # The total comes from the grouped counts: a scalar subquery, not a global window.
    total = g.agg(F.sum("n")).scalar()
    return g.withColumn("share", F.col("n") / total)


def new_templates(mined: DataFrame, split_ts: str, ts: str = "ts") -> DataFrame:
    """T4 deviations: templates seen at/after ``split_ts`` but never before it."""
    cut = F.lit(split_ts).cast("timestamp_ntz")
    base = mined.filter(F.col(ts) < cut).select("template_id", "template").distinct()
    recent = mined.filter(F.col(ts) >= cut).groupBy("template_id", "template").agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_seen"))
    return recent.join(base, ["template_id", "template"], "left_anti")


def distinct_templates(mined: DataFrame, template: str) -> DataFrame:
    """(``template``, ``n_lines``, ``n_tokens``, ``first_token``) per distinct template."""
    per = mined.where(F.col(template).isNotNull()).groupBy(template).agg(F.count(F.lit(1)).alias("n_lines"))
    tokens = F.split(template, " ")
    return per.select(template, "n_lines", F.size(tokens).cast("bigint").alias("n_tokens"), tokens[0].alias("first_token"))


def merge_templates(mined: DataFrame, template: str = "template") -> DataFrame:
    """T5 (re-aimed similarity clustering): templates with the same token count
    and first token form a group; positions where the group's tokens differ
    become ``<*>``.

    Tokens differ at a position if some template's token there is not that of
    the group's smallest template. Each template meets only that one, and only
    the numbers of differing positions leave the row, once each."""
    by = ["n_tokens", "first_token"]
    per = distinct_templates(mined, template)
    groups = per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_templates"), F.sum("n_lines").alias("n_lines"),
                                  F.min(template).alias("_least"))
    tokens, least = F.split(template, " "), F.split("_least", " ")
    several = groups.where("n_templates > 1").select(*by, "_least")
    pairs = per.where("n_lines > 0").join(several, by).select(*by, F.arrays_zip(tokens.alias("t"), least.alias("l")).alias("_z"))
    differ = F.filter(F.transform("_z", lambda z, i: F.when(z["t"] != z["l"], i)), lambda i: i.isNotNull())
    pos = pairs.select(*by, F.explode(differ).alias("_pos")).distinct()
    pos = pos.groupBy(*by).agg(F.collect_list("_pos").alias("_pos"))
    merged = F.transform(least, lambda t, i: F.when(F.array_contains("_pos", i), F.lit(WILDCARD)).otherwise(t))
    out = groups.join(pos, by, "left")
    return out.select(*by, F.when(F.col("_pos").isNull(), F.col("_least")).otherwise(F.array_join(merged, " "))
                      .alias("merged_template"), "n_templates", "n_lines")


def cluster_templates(mined: DataFrame, template: str = "template", min_share: float = 0.2,
                      min_similarity: float = 0.4, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """T5 with a similarity test: (template, n_lines, cluster_template,
    similarity, cluster_id) per distinct template.

    Templates of equal length and first token form a group. A token is constant
    if at least ``min_share`` of the group's lines have it at its position; the
    others become ``<*>``. A template whose constant share (its similarity to
    the generalised one) is below ``min_similarity`` keeps its own text and is a
    cluster by itself.

    Everything is grouped counting: no order of arrival, no comparison of pairs.
    The lines are dealt once, by group, into partitions of about ``group_bytes``
    of text; tokens are counted, and a group's constants meet its templates,
    where the lines are. Groups of more text than that are counted by token and
    by template instead, in as many tasks as there are."""
    spark = mined.sparkSession
    checkpoint_dir(spark)
    by = ["n_tokens", "first_token"]
    tokens = F.split(template, " ")
    # Never null: the join below would drop nulls on one side only, and the lines would be dealt twice.
    rows = mined.where(F.col(template).isNotNull()).select(
        template, F.coalesce(F.size(tokens), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.coalesce(tokens[0], F.lit("")).alias("first_token"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), F.sum(F.octet_length(template) + ROW_BYTES).alias("_bytes"))
    # One row per large group and one for all others.
    sizes = (sizes.groupBy(F.when(F.col("_bytes") > group_bytes, F.struct(*by)).alias("_large"))
             .agg(F.sum("_all").alias("_all"), F.sum("_bytes").alias("_bytes")).checkpoint())
    rest = sizes.where("_large IS NULL").first()
    n = max(spark.sparkContext.defaultParallelism, -(-rest["_bytes"] // group_bytes) if rest else 0)
    large = sizes.where("_large IS NOT NULL").select("_large.*", "_all")
    n_large = large.count()
    lines = F.count(F.lit(1)).alias("n_lines")

    small = rows
    if n_large:
        large = F.broadcast(large) if n_large <= MAX_BROADCAST_GROUPS else large
        small = rows.join(large, by, "left_anti")
    per = small.repartition(n, *by).groupBy(*by, template).agg(lines)
    all_lines = F.sum("n_lines").over(Window.partitionBy(*by))
    constants = _constant_tokens(per.withColumn("_all", all_lines), by, template, min_share)
    found = _with_constants(per, constants, by, template, min_similarity)
    if n_large:
        per = rows.join(large, by, "left_semi").groupBy(*by, template).agg(lines)
        constants = _constant_tokens(per.join(large, by), by, template, min_share)
        constants = F.broadcast(constants) if n_large <= MAX_BROADCAST_GROUPS else constants
        found = found.unionByName(_with_constants(per, constants, by, template, min_similarity))
    return found.withColumn("cluster_id", template_id("cluster_template"))


def _constant_tokens(per: DataFrame, by: list[str], template: str, min_share: float) -> DataFrame:
    """(*``by``, ``_c``) per group: for each position, the list of its constant
    tokens. Groups are left out in which one line is enough: all is constant."""
    share = F.lit(min_share) * F.col("_all")
    tokens = per.where(share > 1).select(*by, "_all", "n_lines", F.posexplode(F.split(template, " ")).alias("_pos", "_tok"))
    counts = tokens.groupBy(*by, "_all", "_pos", "_tok").agg(F.sum("n_lines").alias("_n")).where(F.col("_n") >= share)
    # The first token is that of all lines: it stands for the group and gives every position a row.
    first = F.col("_pos") == 0
    at = F.when(first, F.sequence(F.lit(0), F.col("n_tokens").cast("int") - 1)).otherwise(F.array("_pos"))
    counts = counts.select(*by, F.when(~first, F.col("_tok")).alias("_tok"), F.explode(at).alias("_pos"))
    at = counts.groupBy(*by, "_pos").agg(F.collect_list("_tok").alias("_c"))
    return at.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_c"))), lambda x: x["_c"]).alias("_c"))


def _with_constants(per: DataFrame, constants: DataFrame, by: list[str], template: str, min_similarity: float) -> DataFrame:
    """The templates of ``per`` generalised by their group's constants."""
    rows = per.join(constants, by, "left").withColumn("_t", F.split(template, " "))
    # Null where a token isn't constant.
    kept = F.transform("_t", lambda t, i: F.when((i == 0) | F.col("_c").isNull() | F.array_contains(F.get("_c", i), t), t))
    rows = rows.select(template, "n_lines", "n_tokens", kept.alias("_t"))
    similarity = F.size(F.filter("_t", lambda t: t.isNotNull())) / F.col("n_tokens")
    general = F.array_join("_t", " ", WILDCARD)
    return rows.select(template, "n_lines", F.when(similarity >= min_similarity, general).otherwise(F.col(template))
                       .alias("cluster_template"), similarity.alias("similarity"))
