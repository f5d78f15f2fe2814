"""Queries over the driver's tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, mixing, quality, role_repair, sanitise, setsketch, spelling, token_counts, top_k
from .blocks import read
from .jaccard import jaccard_groups
from .oracle import OP3_SQL, OP5_SQL, OP6_SQL, OP11_SQL, OP12_SQL, OP13_SQL
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup


def fold(n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = top_k.usable(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    rows = rows.select("id", top_k.scaled(F.col("v")).alias("v"))
    return top_k.top_k(rows.where(F.col("id") % 20 == 0), rows, 20)


OP1_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    ensemble = quality.train(docs, labels.where(fold(5) != 0))
    scored = quality.scored(docs, ensemble, keep=["doc_id"]).withColumn("doc_id", F.col("row.doc_id"))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hits(F.col("spans"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), n_hit).alias("contaminated"),
    )


#: Parts of each domain, language and source; nodes that are not named have 1.
MIX = {("web",): 5, ("books",): 3, ("code",): 2} | {(d, x): w for d in ("web", "books", "code") for x, w in (("en", 6), ("de", 2), ("fr", 2), ("es", 1))}
#: Documents carry no domain; their source's number tells it here.
DOMAIN = "case when source is null then null when cast(substring(source, 4, 9) as int) < 10 then 'web' when cast(substring(source, 4, 9) as int) < 15 then 'books' else 'code' end"
#: The mixture has half as many tokens as there are.
MIX_PARTS = (1, 2)
MIX_SEED, MIX_EPOCHS = 17, 3


def mixed(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    path = {"domain": F.expr(DOMAIN.replace("cast(", "try_cast(")), "lang": F.col("lang"), "source": F.col("source")}
    total = F.expr(f"supply * {MIX_PARTS[0]} div {MIX_PARTS[1]}")
    return mixing.mix(docs, path, MIX, total, mixing.word_count(F.col("text")), seed=MIX_SEED, epochs=MIX_EPOCHS, keep=keep)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep=["doc_id"])
    return rows.select(F.col("row.doc_id").alias("doc_id"), "domain", "lang", "source", "n_tokens", "epoch", "taken")


def _divide_sql(given: str, parent: list[str], own: str, depth: int) -> str:
    """The children of one level: what each is given of its family's budget."""
    family = f"PARTITION BY {', '.join(parent)}" if parent else ""
    node = "[" + ", ".join([*parent, own]) + "]"
    keys = ", ".join([*parent, own])
    return f"""
n{depth} AS (
  SELECT {keys}, sum(supply) * {MIX_EPOCHS} AS capacity FROM leaves GROUP BY {keys}
), w{depth} AS (
  SELECT n{depth}.*, g.budget, coalesce(w.weight, 1)::HUGEINT AS weight FROM n{depth} JOIN {given} g {"USING (" + ", ".join(parent) + ")" if parent else "ON true"}
  LEFT JOIN weights w ON w.node = {node}
), a{depth} AS (
  SELECT *, coalesce(sum(capacity) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER (l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above
  FROM w{depth} WINDOW l AS ({family} ORDER BY capacity::DOUBLE / weight::DOUBLE, {own})
), b{depth} AS (
  SELECT *, capacity * above <= (budget - below) * weight AS filled FROM a{depth}
), c{depth} AS (
  SELECT *, budget - coalesce(sum(CASE WHEN filled THEN capacity END) OVER f, 0) AS rest, sum(CASE WHEN NOT filled THEN weight END) OVER f AS open
  FROM b{depth} WINDOW f AS ({family})
), d{depth} AS (
  SELECT *, CASE WHEN filled THEN capacity ELSE rest * weight // open END AS part FROM c{depth}
), e{depth} AS (
  SELECT *, budget - sum(part) OVER ({family}) AS odd, row_number() OVER ({family} ORDER BY filled, {own}) AS nth FROM d{depth}
), g{depth} AS (
  SELECT {keys}, part + CASE WHEN NOT filled AND nth <= odd THEN 1 ELSE 0 END AS budget FROM e{depth}
)"""


OP4_PATH = ["domain", "lang", "source"]
OP4_SQL = f"""
WITH weights AS (
  SELECT * FROM (VALUES {", ".join(f"([{', '.join(repr(x) for x in k)}], {w})" for k, w in MIX.items())}) AS t(node, weight)
), base AS (
  SELECT doc_id, coalesce({DOMAIN.replace("cast(", "try_cast(")}, '(none)') AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_tokens, md5(coalesce(text, '')) AS text_md5
  FROM documents
), docs AS (SELECT * FROM base WHERE n_tokens > 0
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS supply FROM docs GROUP BY ALL
), g0 AS (
  SELECT least(coalesce(sum(supply), 0) * {MIX_PARTS[0]} // {MIX_PARTS[1]}, coalesce(sum(supply), 0) * {MIX_EPOCHS}) AS budget FROM leaves
), {",".join(_divide_sql(f"g{i}", OP4_PATH[:i], x, i + 1) for i, x in enumerate(OP4_PATH))}
, plan AS (
  SELECT domain, lang, source, budget // supply AS whole, budget % supply AS rest FROM leaves JOIN g3 USING (domain, lang, source)
), keyed AS (
  SELECT docs.*, whole, rest, md5('{MIX_SEED}:' || (whole + 1) || ':' || coalesce(doc_id::VARCHAR, '') || ':' || text_md5) AS key FROM docs JOIN plan USING (domain, lang, source)
), placed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS start FROM keyed
)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, whole::BIGINT + 1))::INTEGER AS epoch, n_tokens AS taken FROM placed WHERE whole > 0
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, (whole + 1)::INTEGER, least(n_tokens, rest - start)::BIGINT FROM placed WHERE start < rest
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"), digests=True)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"), digests=True)


def op8_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.sanitise(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in sanitise.KINDS],
        F.sha2(sanitise.spell(sanitise.KINDS), 256).alias("base_sha256"),
        sanitise.spell((*sanitise.KINDS, "term")).alias("spans"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    counts = token_counts.token_counts(docs, token_counts.head_body_tail(F.col("text")), keep=["doc_id"])
    return counts.select(F.col("row.doc_id").alias("doc_id"), "section", "n_chars", F.col("n_tokens").cast("long").alias("n_tokens"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(3) == 1
    model = language.train(docs.where(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = setsketch.near_duplicates(read(spark, sf_dir, "documents"))
    return groups.withColumn("kept", F.col("doc_id") == F.col("component_id"))


_A_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def misspelt_runs(docs: DataFrame) -> DataFrame:
    """The runs of letters of all texts, A-Z lower-cased; some lose a letter, as crc32(doc_id:run) says."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.translate("text", *_A_Z), F.lit("[A-Za-z\u00c0-\u00ff]+"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = F.pmod("h", F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select("run", h.alias("h")).select(F.when(F.col("h") % 97 == 0, less).otherwise(F.col("run")).alias("word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = misspelt_runs(read(spark, sf_dir, "documents")).where("length(word) >= 5")
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def damaged(turns: DataFrame) -> DataFrame:
    """conversations with faults, told by crc32(conv_id:turn) mod 20; nulls are one space there."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fault")
    return rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault", "copy")


def op13_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    found, edits = role_repair.repair(damaged(turns))
    c = role_repair.conversation_key(F.col("conv_id")).alias("c")
    line = F.struct("place", F.concat("role", F.lit(":"), "text").alias("line"))
    # the contract's digest is over a whole conversation; nothing else gathers one
    lines = edits.where("place is not null").groupBy(c).agg(F.array_sort(F.collect_list(line)).line.alias("lines"))
    every = turns.select("conv_id", c).distinct()
    out = every.join(found.withColumn("c", c).drop("conv_id"), "c", "left").join(lines, "c", "left")
    counts = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce(F.array_join("lines", "\n"), F.lit("")), 256).alias("repaired_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_top_k, op2_quality, op3_decontaminate, op4_mix_sources, op5_substring_dedup, op6_jaccard_join, op7_suffix_dedup, op8_sanitise, op9_token_counts, op10_language, op11_setsketch, op12_spelling, op13_role_repair, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_top_k": OP1_SQL,
        "op3_decontaminate": OP3_SQL,
        "op4_mix_sources": OP4_SQL,
        "op5_substring_dedup": OP5_SQL,
        "op6_jaccard_join": OP6_SQL,
        "op11_setsketch": OP11_SQL,
        "op12_spelling": OP12_SQL,
        "op13_role_repair": OP13_SQL,
    }
