"""The registered queries over the test tables, each with its SQL where there is one."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelcorr.functions import labels as L
from labelcorr.functions import text as X
from labelcorr.functions import tokens as K
from labelcorr.functions.scores import argmax
from labelcorr.operators import counts as C
from labelcorr.operators import label_tables as LT
from labelcorr.operators import matrix as M
from labelcorr.operators import quality as Q
from labelcorr.operators import rows as R
from labelcorr.operators import splits as S
from labelcorr.operators import vocabulary as V
from labelcorr.plans import classify, jobs
from labelcorr.plans import multilabel as ML
from labelcorr.session import scratch_path
from labelcorr.sources import files, models, positions, posts, replay, sinks
from labelcorr.streaming import job

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL it must equal."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Axes of the test tables.
EVENTS = L.LabelAxis(
    "event",
    {"purchase": 0, "click": 1, "signup": 1, "view": 1, "error": 2},
    ("Buy", "Use", "Fail"),
)
SOME_EVENTS = L.LabelAxis(
    "event", {"purchase": 0, "click": 1, "signup": 1}, ("Buy", "Use", "Rest")
)
ROLES = L.LabelAxis("role", {"user": 0, "assistant": 1, "system": 2}, ("User", "Model", "System"))
QUALITY = L.LabelAxis("quality", {"0": 0, "1": 1}, ("Low", "High"))
TOXIC = L.LabelAxis("toxic", {"0": 0, "1": 1}, ("Clean", "Toxic"))
LANGS = {"de": 0, "en": 1, "es": 2, "fr": 3}
LANG = L.LabelAxis("lang", LANGS, tuple(LANGS))

EVENT_CASE = """CASE WHEN event_type = 'purchase' THEN 0
     WHEN event_type IN ('click', 'signup', 'view') THEN 1
     WHEN event_type = 'error' THEN 2 END"""
SOME_EVENT_CASE = """CASE WHEN event_type = 'purchase' THEN 0
     WHEN event_type IN ('click', 'signup') THEN 1 ELSE 2 END"""


# Matrices of two label columns.


@query("""
SELECT quality AS given, toxic AS pred, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 9) AS p
FROM labels GROUP BY quality, toxic
""")
def conditional_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = M.confusion_counts(table(spark, sf_dir, "labels"), "quality", "toxic")
    return M.conditional_distribution(counts).withColumn("p", F.round("p", 9))


@query(f"""
WITH e AS (SELECT {EVENT_CASE} AS given,
                  CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS pred FROM events),
     cells AS (SELECT g AS given, p AS pred FROM range(0, 4) a(g), range(0, 5) b(p)),
     c AS (SELECT given, pred, count(*) AS n FROM e GROUP BY given, pred),
     d AS (SELECT given, pred, coalesce(n, 0) AS n FROM cells LEFT JOIN c USING (given, pred))
SELECT CAST(given AS INTEGER) AS given, CAST(pred AS INTEGER) AS pred, n,
       round(n / nullif(sum(n) OVER (PARTITION BY given), 0), 9) AS p,
       CASE given WHEN 0 THEN 'Buy' WHEN 1 THEN 'Use' WHEN 2 THEN 'Fail' END AS given_name
FROM d
""")
def dense_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell, with a given class and a predicted class that never occur."""
    matrix = M.distribution_matrix(_event_pairs(spark, sf_dir), "given", "pred", range(4), range(5))
    return matrix.withColumn("p", F.round("p", 9)).withColumn(
        "given_name", EVENTS.decode(F.col("given"))
    )


@query(f"""
WITH e AS (SELECT {EVENT_CASE} AS given,
                  CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS pred FROM events)
SELECT given, round(count(*) FILTER (pred = 0) / count(*), 9) AS pred_0,
       round(count(*) FILTER (pred = 1) / count(*), 9) AS pred_1,
       round(count(*) FILTER (pred = 2) / count(*), 9) AS pred_2,
       round(count(*) FILTER (pred = 3) / count(*), 9) AS pred_3
FROM e GROUP BY given
""")
def wide_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _event_pairs(spark, sf_dir)
    matrix = M.distribution_matrix(pairs, "given", "pred", range(3), range(4))
    return M.wide_matrix(matrix.withColumn("p", F.round("p", 9)), range(4))


@query("""
WITH c AS (SELECT l.toxic AS given, CASE d.lang WHEN 'de' THEN 0 WHEN 'en' THEN 1
                  WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END AS pred
           FROM labels l JOIN documents d USING (doc_id)),
     cells AS (SELECT g AS given, p AS pred FROM range(0, 2) a(g), range(0, 4) b(p)),
     n AS (SELECT given, pred, count(*) AS n FROM c GROUP BY given, pred),
     d AS (SELECT given, pred, coalesce(n, 0) AS n FROM cells LEFT JOIN n USING (given, pred))
SELECT CAST(given AS INTEGER) AS given, CAST(pred AS INTEGER) AS pred, n,
       round(n / nullif(sum(n) OVER (PARTITION BY given), 0), 9) AS p
FROM d
""")
def label_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language given toxicity, from two tables with one row per document."""
    toxic = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    lang = table(spark, sf_dir, "documents").select("doc_id", LANG.encode(F.col("lang")).alias("code"))
    found = M.label_association(toxic, lang, "doc_id", "toxic", "code", [0, 1], LANG.classes)
    return found.withColumn("p", F.round("p", 9))


@query(f"""
WITH e AS (SELECT {EVENT_CASE} AS given,
                  CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS pred FROM events),
     o AS (SELECT CASE WHEN given < 2 THEN given ELSE -1 END AS given,
                  CASE WHEN pred < 2 THEN pred ELSE -1 END AS pred FROM e),
     cells AS (SELECT g AS given, p AS pred FROM (VALUES (0), (1), (-1), (NULL)) a(g),
                                                 (VALUES (0), (1), (-1), (NULL)) b(p)),
     c AS (SELECT given, pred, count(*) AS n FROM o GROUP BY given, pred),
     d AS (SELECT cells.given, cells.pred, coalesce(n, 0) AS n FROM cells LEFT JOIN c
           ON c.given IS NOT DISTINCT FROM cells.given AND c.pred IS NOT DISTINCT FROM cells.pred)
SELECT coalesce(CAST(given AS VARCHAR), 'none') AS given, coalesce(CAST(pred AS VARCHAR), 'none') AS pred, n,
       round(coalesce(n / nullif(sum(n) OVER (PARTITION BY given), 0), -1), 9) AS p
FROM d
""")
def dense_matrix_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that are not listed stay in the denominators."""
    found = M.distribution_matrix(
        _event_pairs(spark, sf_dir), "given", "pred", [0, 1], [0, 1], outside="keep"
    )
    return _shown(found)


def _shown(matrix: DataFrame) -> DataFrame:
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("none")).alias(name)

    p = F.round(F.coalesce("p", F.lit(-1.0)), 9).alias("p")
    return matrix.select(text("given"), text("pred"), "n", p)


@query("""
WITH c AS (SELECT l.toxic AS given, CASE d.lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE -1 END AS pred
           FROM labels l JOIN documents d USING (doc_id)),
     cells AS (SELECT g AS given, p AS pred FROM (VALUES (0), (1), (-1), (NULL)) a(g),
                                                 (VALUES (0), (1), (-1), (NULL)) b(p)),
     n AS (SELECT given, pred, count(*) AS n FROM c GROUP BY given, pred),
     d AS (SELECT cells.given, cells.pred, coalesce(n, 0) AS n FROM cells LEFT JOIN n
           ON n.given IS NOT DISTINCT FROM cells.given AND n.pred IS NOT DISTINCT FROM cells.pred)
SELECT coalesce(CAST(given AS VARCHAR), 'none') AS given, coalesce(CAST(pred AS VARCHAR), 'none') AS pred, n,
       round(coalesce(n / nullif(sum(n) OVER (PARTITION BY given), 0), -1), 9) AS p
FROM d
""")
def label_association_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two languages listed, the others kept apart."""
    toxic = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    lang = table(spark, sf_dir, "documents").select("doc_id", LANG.encode(F.col("lang")).alias("code"))
    return _shown(
        M.label_association(toxic, lang, "doc_id", "toxic", "code", [0, 1], [0, 1], outside="keep")
    )


@query(f"""
WITH a AS (SELECT user_id, {EVENT_CASE} AS given FROM events),
     b AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS pred FROM events),
     na AS (SELECT user_id, given, count(*) AS n FROM a GROUP BY ALL),
     nb AS (SELECT user_id, pred, count(*) AS m FROM b GROUP BY ALL),
     c AS (SELECT given, pred, CAST(sum(n * m) AS BIGINT) AS n
           FROM na JOIN nb USING (user_id) GROUP BY given, pred)
SELECT given, CAST(pred AS INTEGER) AS pred, n,
       round(n / sum(n) OVER (PARTITION BY given), 9) AS p
FROM c
""")
def label_association_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two axes on a key with many rows on both sides."""
    events = table(spark, sf_dir, "events")
    bias = events.select("user_id", EVENTS.encode(F.col("event_type")).alias("given"))
    mood = events.select("user_id", (_prop_k() % 4).cast("int").alias("pred"))
    found = M.label_association(
        bias, mood, "user_id", "given", "pred", EVENTS.classes, list(range(4))
    )
    return found.withColumn("p", F.round("p", 9))


def _prop_k() -> Column:
    return F.from_json("props", "k bigint")["k"]


def _event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        EVENTS.encode(F.col("event_type")).alias("given"),
        (_prop_k() % 4).cast("int").alias("pred"),
    )


# Text cleaning. The test texts hold nothing to clean, so a suffix adds it.

SUFFIX_SQL = "' &amp;' || chr(160) || 'x http://t.co/' || doc_id || chr(12288) || 'end'"
# The 29 whitespace code points, listed.
SPACE_SQL = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def _dirty_text() -> Column:
    return F.concat(
        F.col("text"),
        F.lit(" &amp;" + X.NBSP + "x http://t.co/"),
        F.col("doc_id").cast("string"),
        F.lit("\u3000end"),
    )


def _clean_sql(text: str) -> str:
    """SQL of all cleaning steps."""
    plain = f"replace(replace({text}, '&amp;', '&'), chr(160), '')"
    no_urls = f"regexp_replace({plain}, 'http[^{SPACE_SQL}]+', '', 'g')"
    return f"trim(regexp_replace({no_urls}, '[{SPACE_SQL}]+', ' ', 'g'))"


@query(f"""
SELECT doc_id, {_clean_sql("text || " + SUFFIX_SQL)} AS content
FROM documents WHERE text IS NOT NULL
""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.drop_non_text(table(spark, sf_dir, "documents"), "text")
    return docs.select("doc_id", X.normalize_text(_dirty_text()).alias("content"))


@query(f"SELECT doc_id, text || {SUFFIX_SQL} AS content FROM documents WHERE text IS NOT NULL")
def normalize_text_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.drop_non_text(table(spark, sf_dir, "documents"), "text")
    return docs.select("doc_id", X.normalize_text(_dirty_text(), enabled=False).alias("content"))


@query(f"""
SELECT page_id, trim(regexp_replace(replace(html, '&amp;', '&'), '[{SPACE_SQL}]+', ' ', 'g')) AS html,
       regexp_replace('see ' || url || ' now', 'http[^{SPACE_SQL}]+', '', 'g') AS note
FROM pages
""")
def unescape_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    note = X.drop_urls(F.concat(F.lit("see "), F.col("url"), F.lit(" now")))
    html = X.squeeze_space(X.unescape_amp(F.col("html")))
    return pages.select("page_id", html.alias("html"), note.alias("note"))


# Label codes.


@query(f"""
SELECT event_id, event_type AS content, {EVENT_CASE} AS label,
       CASE {EVENT_CASE} WHEN 0 THEN 'Buy' WHEN 1 THEN 'Use' ELSE 'Fail' END AS name
FROM events
""")
def encode_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = R.project(table(spark, sf_dir, "events"), "event_type", "event_type", "event_id")
    coded = events.withColumn("label", EVENTS.encode(F.col("label")))
    return coded.withColumn("name", EVENTS.decode(F.col("label")))


@query(f"SELECT event_id, {SOME_EVENT_CASE} AS label FROM events")
def encode_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = SOME_EVENTS.encode(F.col("event_type"), default=2)
    return table(spark, sf_dir, "events").select("event_id", label.alias("label"))


@query("""
SELECT event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 2 ELSE 1 END AS strict,
       CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 1 ELSE 2 END
           AS lenient,
       CASE event_type WHEN 'purchase' THEN 'Left' WHEN 'error' THEN 'Right' ELSE 'Other' END
           AS merged
FROM events
""")
def encode_political_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bias categories themselves, written onto the event types."""
    kind = F.col("event_type")
    known = _renamed(
        kind,
        {"purchase": "LeftTroll", "click": "NewsFeed", "signup": "Unknown",
         "view": "HashtagGamer", "error": "RightTroll"},
    )
    partly = _renamed(kind, {"purchase": "LeftTroll", "click": "NewsFeed", "signup": "Commercial"})
    merged = _renamed(kind, {"purchase": "LeftTroll", "error": "RightTroll", "view": "Elsewhere"})
    return table(spark, sf_dir, "events").select(
        "event_id",
        L.encode_political_bias(known).alias("strict"),
        L.encode_political_bias(partly, strict=False).alias("lenient"),
        L.merge_category(merged).alias("merged"),
    )


@query("""
SELECT doc_id, CASE l.toxic WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS emotion
FROM documents LEFT JOIN labels l USING (doc_id)
""")
def encode_fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    joined = docs.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    raw = _renamed(F.col("toxic").cast("string"), {"0": "H", "1": "A"})
    filled = R.fill_missing(joined.withColumn("raw", raw), "raw", "N")
    return filled.select("doc_id", L.encode_emotion(F.col("raw")).alias("emotion"))


@query("""
SELECT conv_id, turn,
       CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS sentiment,
       CASE role WHEN 'user' THEN 0 WHEN 'system' THEN 1 ELSE 2 END AS stance,
       CASE role WHEN 'user' THEN 0 ELSE 1 END AS veracity,
       turn % 3 AS conspiracy
FROM conversations
""")
def encode_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    sentiment = _renamed(role, {"system": "neg", "assistant": "neu", "user": "pos"})
    stance = _renamed(role, {"user": "AGAINST", "system": "NONE", "assistant": "FAVOR"})
    misled, fine = L.VERACITY.names
    veracity = _renamed(role, {"user": misled, "system": fine, "assistant": fine})
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        L.encode_sentiment(sentiment).alias("sentiment"),
        L.encode_stance(stance).alias("stance"),
        L.encode_veracity(veracity).alias("veracity"),
        L.pass_label(F.col("turn") % 3).alias("conspiracy"),
    )


@query("""
SELECT event_id, (user_id % 5) || ',' || (event_id % 7) || ',' || 0 AS labels FROM events
""")
def shift_multi_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(F.col("user_id") % 5 + 1, F.col("event_id") % 7 + 1, F.lit(1).cast("bigint"))
    shifted = L.shift_multi_label(raw)
    joined = F.array_join(shifted.cast("array<string>"), ",")
    return table(spark, sf_dir, "events").select("event_id", joined.alias("labels"))


def _renamed(raw: Column, names: dict[str, str]) -> Column:
    branches = F.when(F.lit(False), F.lit(""))
    for old, new in names.items():
        branches = branches.when(raw == old, F.lit(new))
    return branches


# Counts and weights.

EVENT_ORDER = ["view", "signup", "error", "click", "purchase", "refund"]


@query("""
WITH o AS (SELECT unnest(['view', 'signup', 'error', 'click', 'purchase', 'refund']) AS label,
                  unnest(range(6)) AS position)
SELECT CAST(position AS INTEGER) AS position, label,
       (SELECT count(*) FROM events WHERE event_type = label) AS n
FROM o
""")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = C.class_counts(table(spark, sf_dir, "events"), "event_type", EVENT_ORDER)
    return counts.drop("total")


@query("SELECT event_type AS category, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def first_seen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.category_counts(table(spark, sf_dir, "events"), "event_type", "event_id")
    return found.orderBy("first")


@query("SELECT DISTINCT source AS category FROM documents")
def distinct_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.distinct_categories(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("""
SELECT 'Buy' AS name, count(*) FILTER (event_type = 'purchase') AS n FROM events
UNION ALL SELECT 'Use', count(*) FILTER (event_type IN ('click', 'signup')) FROM events
UNION ALL SELECT 'Rest', count(*) FILTER (event_type NOT IN ('purchase', 'click', 'signup'))
FROM events
""")
def merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merged_counts(table(spark, sf_dir, "events"), "event_type", SOME_EVENTS, other=2)


@query("""
SELECT label, count(*) AS n, round(sum(count(*)) OVER () / count(*), 9) AS weight
FROM embeddings GROUP BY label
UNION ALL SELECT 10, 0, NULL
""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a class that has no rows."""
    weights = C.class_weights(table(spark, sf_dir, "embeddings"), "label", range(11))
    return weights.withColumn("weight", F.round("weight", 9))


@query("SELECT count(*) AS examples, CAST(ceil(count(*) / 8) AS BIGINT) AS steps FROM documents")
def example_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.example_and_batch_counts(table(spark, sf_dir, "documents"), 8)


# Predictions and metrics; the 64 floats of an embedding serve as logits.

NLL_SQL = """ln(list_sum(list_transform(embedding, lambda z: exp(CAST(z AS DOUBLE)
        - CAST(list_max(embedding) AS DOUBLE))))) + CAST(list_max(embedding) AS DOUBLE)
        - CAST(embedding[label + 1] AS DOUBLE)"""


@query("""
SELECT vec_id AS ids, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred
FROM embeddings
""")
def argmax_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = Q.prediction_table(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return Q.order_by_id(predictions)


@query(f"""
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
     w AS (SELECT label, (SELECT count(*) FROM embeddings) / n AS weight FROM c),
     r AS (SELECT label, {NLL_SQL} AS nll FROM embeddings)
SELECT round(sum(weight * nll) / sum(weight), 9) AS loss FROM r JOIN w USING (label)
""")
def weighted_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Q.score_counts(table(spark, sf_dir, "embeddings"), "label", "embedding")
    weights = C.weights_of_counts(counts, "given", range(10))
    loss = Q.weighted_cross_entropy(counts, weights)
    return loss.select(F.round("loss", 9).alias("loss"))


@query(f"""
WITH r AS (SELECT vec_id // 8 AS batch, label + 1.0 AS weight, {NLL_SQL} AS nll FROM embeddings),
     b AS (SELECT batch, sum(weight * nll) / sum(weight) AS loss FROM r GROUP BY batch)
SELECT round(avg(loss), 9) AS loss, count(*) AS steps FROM b
""")
def mean_batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = table(spark, sf_dir, "embeddings").withColumn("batch", F.expr("vec_id div 8"))
    weights = [c + 1.0 for c in range(10)]
    found = Q.mean_batch_loss(batched, "batch", weights, "label", "embedding")
    return found.withColumn("loss", F.round("loss", 9))


@query("""
WITH p AS (SELECT (list_position(embedding, list_max(embedding)) - 1) % 10 = label AS ok
           FROM embeddings)
SELECT round(avg(CAST(ok AS INTEGER)), 9) AS accuracy,
       round(2 * count(*) FILTER (ok)
             / (2 * count(*) FILTER (ok) + 2 * count(*) FILTER (NOT ok)), 9) AS micro_f1
FROM p
""")
def accuracy_micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    predictions = Q.prediction_table(embeddings, "vec_id", "embedding")
    truth = Q.attach_truth(predictions, embeddings, "vec_id", "label")
    counts = M.confusion_counts(truth.withColumn("pred", F.col("pred") % 10), "truth", "pred")
    both = Q.evaluate(counts.withColumn("nll", F.lit(0.0)))
    return both.select(
        F.round("accuracy", 9).alias("accuracy"), F.round("micro_f1", 9).alias("micro_f1")
    )


@query(f"""
WITH r AS (SELECT label, list_position(embedding, list_max(embedding)) - 1 = label AS ok,
                  label + 1.0 AS weight, {NLL_SQL} AS nll FROM embeddings)
SELECT count(*) AS examples, round(sum(weight * nll) / sum(weight), 9) AS loss,
       round(avg(CAST(ok AS INTEGER)), 9) AS micro_f1, round(avg(CAST(ok AS INTEGER)), 9) AS accuracy
FROM r
""")
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Q.score_counts(table(spark, sf_dir, "embeddings"), "label", "embedding")
    found = Q.evaluate(counts, [c + 1.0 for c in range(10)])
    return found.select(
        "examples", *[F.round(c, 9).alias(c) for c in ("loss", "micro_f1", "accuracy")]
    )


@query("""
WITH s AS (SELECT vec_id, list_transform(range(0, 10), lambda c: list_sum(list_transform(
                  range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * ((i * (c + 3)) % 7 - 3))))
                  AS logits FROM embeddings)
SELECT vec_id AS ids, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred,
       round(list_max(logits), 6) AS top
FROM s
""")
def predict_with_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer of one's own over NumPy batches: ten weights for each of the 64 values."""

    def make_scorer():
        value, label = np.arange(1, 65)[:, None], np.arange(10)[None, :]
        weights = (value * (label + 3) % 7 - 3).astype("float64")
        return lambda embedding: embedding.astype("float64") @ weights

    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scored = classify.predict_with(embeddings, make_scorer, ["embedding"], input_shapes=[[64]])
    top = F.round(F.array_max("logits"), 6)
    return scored.select(
        F.col("vec_id").alias("ids"), argmax(F.col("logits")).alias("pred"), top.alias("top")
    )


# Splits and folds.


def _sampled_sql(key: str) -> str:
    """True for the keys in a sample of 0.8."""
    return f"CAST('0x' || substr(md5({key} || '|42'), 1, 15) AS BIGINT) < {int(0.8 * (1 << 60))}"


@query(f"""
SELECT doc_id, CASE WHEN {_sampled_sql("doc_id")} THEN 'train' ELSE 'test' END AS side
FROM documents
""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    side = F.when(F.col("in_train"), "train").otherwise("test").alias("side")
    return S.mark_split(docs, "doc_id").select("doc_id", side)


@query(f"""
SELECT user_id, event_type, props FROM events
EXCEPT SELECT user_id, event_type, props FROM events WHERE {_sampled_sql("event_id")}
""")
def split_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set difference: copies collapse, and copies of a train row vanish."""
    columns = ["user_id", "event_type", "props"]
    return S.split_rest(table(spark, sf_dir, "events"), columns, "event_id")


@query("""
SELECT user_id, props FROM events
EXCEPT SELECT user_id, props FROM events WHERE event_type IN ('view', 'click')
""")
def test_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    train = events.filter(F.col("event_type").isin("view", "click"))
    return S.test_rest(events.select("user_id", "props"), train.select("user_id", "props"))


FOLD_SQL = """
WITH c AS (SELECT event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY event_type),
     s AS (SELECT event_type, n, CAST(coalesce(sum(n) OVER (ORDER BY f
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM c),
     a AS (SELECT event_type, m, (s + n - m + 4) // 5 - (s - m + 4) // 5 AS a
           FROM s, range(0, 5) t(m)),
     b AS (SELECT event_type, m, sum(a) OVER (PARTITION BY event_type ORDER BY m) AS upto FROM a),
     j AS (SELECT event_id, event_type,
                  row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS j
           FROM events),
     folds AS (SELECT j.event_id, j.event_type,
                      CAST(count(*) FILTER (j.j >= b.upto) AS INTEGER) AS fold
               FROM j JOIN b ON b.event_type = j.event_type AND b.m < 4
               GROUP BY j.event_id, j.event_type)
"""


@query(FOLD_SQL + "SELECT event_id, event_type, fold FROM folds")
def stratified_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_folds(spark, sf_dir)


@query(FOLD_SQL + "SELECT event_id, event_type FROM folds WHERE fold = 3")
def fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rows_in_fold(_event_folds(spark, sf_dir), 3).drop("fold")


@query(FOLD_SQL + """
SELECT CAST(t.fold AS INTEGER) AS fold, c.event_type AS label,
       count(*) FILTER (f.fold <> t.fold) AS n
FROM range(0, 5) t(fold), (SELECT DISTINCT event_type FROM events) c, folds f
WHERE f.event_type = c.event_type GROUP BY ALL
""")
def fold_train_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [k for k in EVENT_ORDER if k != "refund"]
    return S.fold_train_counts(_event_folds(spark, sf_dir), "event_type", kinds)


@query(FOLD_SQL + """
SELECT fold, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
FROM folds GROUP BY fold, event_type
""")
def fold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds written to one folder each and read back."""
    path = scratch_path(spark, "folds")
    sinks.write_folds(_event_folds(spark, sf_dir), path)
    back = spark.read.schema("event_id bigint, event_type string, fold int")
    rows = back.option("header", True).csv(path)
    return rows.groupBy("fold", "event_type").agg(
        F.count("*").alias("n"), F.sum("event_id").alias("ids")
    )


def _event_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return S.stratified_kfold(events, "event_type", "event_id")


@query("""
WITH k AS (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 1 OFFSET 2)
SELECT doc_id, CASE WHEN source = (SELECT source FROM k) THEN 'test' ELSE 'train' END AS side
FROM documents
UNION ALL SELECT doc_id, 'eval' FROM documents
""")
def holdout_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third source held out; the evaluation set with the train rows as well."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    marked = S.mark_holdout(docs, 2, "source")
    own = F.when(F.col("in_test"), "test").otherwise("train")
    return marked.select("doc_id", F.explode(F.array(own, F.lit("eval"))).alias("side"))


@query("""
WITH k AS (SELECT DISTINCT source FROM documents ORDER BY md5(source || '42'), source LIMIT 2)
SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM k)
""")
def sampled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return files.sample_file_rows(docs, 2, file_col="source")


@query("""
SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS id, source, doc_id FROM documents
""")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    return R.add_row_id(docs, ["source", "doc_id"])


@query("""
SELECT row_number() OVER (ORDER BY event_type) - 1 AS id, event_type FROM events
""")
def row_ids_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the order of a column with few values."""
    events = table(spark, sf_dir, "events").select("event_type")
    return R.add_row_id(events, ["event_type"], unique=False)


# Tokens.

WORDS_SQL = """list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"""
VOCABULARY = 500
MARKERS = (K.PAD, K.UNK, K.CLS, K.SEP)
VOCABULARY_SQL = f"""
WITH t AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
     w AS (SELECT unnest(words) AS token FROM t),
     top AS (SELECT token, count(*) AS n FROM w GROUP BY token
             ORDER BY n DESC, token LIMIT {VOCABULARY}),
     v AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) - 1 AS INTEGER)
                  AS token_id FROM top)
"""


def _document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", K.tokenize(F.col("text")).alias("tokens"))


@query(f"SELECT max(len({WORDS_SQL})) AS max_tokens FROM documents")
def max_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.max_tokens(_document_tokens(spark, sf_dir))
    return found.select(F.col("max_tokens").cast("bigint").alias("max_tokens"))


@query(f"""
WITH t AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
     s AS (SELECT doc_id, ['[CLS]'] || words[1:62] || ['[SEP]'] AS words FROM t)
SELECT doc_id, array_to_string(list_resize(words, 64, '[PAD]'), ' ') AS tokens,
       array_to_string(list_transform(range(1, 65),
           lambda i: CASE WHEN i <= len(words) THEN 1 ELSE 0 END), '') AS mask
FROM s
""")
def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _document_tokens(spark, sf_dir).withColumn(
        "tokens", K.add_special_tokens(F.col("tokens"))
    )
    padded = K.pad_truncate(F.col("tokens"), F.lit(K.PAD))
    mask = K.attention_mask(F.col("tokens")).cast("array<string>")
    return marked.select(
        "doc_id",
        F.array_join(padded, " ").alias("tokens"),
        F.array_join(mask, "").alias("mask"),
    )


@query(VOCABULARY_SQL + "SELECT token, n, token_id FROM v")
def build_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.build_vocabulary(_document_tokens(spark, sf_dir), VOCABULARY)


ENCODED_SQL = VOCABULARY_SQL + """
     , p AS (SELECT doc_id, unnest(words) AS token, unnest(range(len(words))) AS pos FROM t)
     , e AS (SELECT doc_id, string_agg(coalesce(token_id, -1), ' ' ORDER BY pos) AS ids
             FROM p LEFT JOIN v USING (token) GROUP BY doc_id)
SELECT doc_id, coalesce(ids, '') AS ids FROM t LEFT JOIN e USING (doc_id)
"""


@query(ENCODED_SQL)
def encode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of the whole text, by a vocabulary shipped to the tasks."""
    return _encoded(spark, sf_dir, V.MAX_BROADCAST_TOKENS)


@query(ENCODED_SQL)
def encode_tokens_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with only the 50 most frequent tokens shipped, the others joined."""
    return _encoded(spark, sf_dir, 50)


@query(ENCODED_SQL.replace("SELECT doc_id, coalesce(ids, '') AS ids FROM t LEFT JOIN e USING (doc_id)", """
SELECT CAST(t.doc_id % 7 AS BIGINT) AS key, coalesce(ids, '') AS ids FROM t LEFT JOIN e USING (doc_id)"""))
def encode_tokens_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share seven keys, by lookup and join."""
    tokens = _document_tokens(spark, sf_dir)
    vocabulary = V.build_vocabulary(tokens, VOCABULARY)
    keyed = tokens.select(F.pmod("doc_id", F.lit(7)).cast("bigint").alias("key"), "tokens")
    encoded = V.encode_tokens(keyed, vocabulary, -1, max_broadcast=50)
    return encoded.select("key", F.array_join(F.col("token_ids").cast("array<string>"), " ").alias("ids"))


def _encoded(spark: SparkSession, sf_dir: str, max_broadcast: int) -> DataFrame:
    tokens = _document_tokens(spark, sf_dir)
    vocabulary = V.build_vocabulary(tokens, VOCABULARY)
    encoded = V.encode_tokens(tokens, vocabulary, -1, max_broadcast=max_broadcast)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return encoded.select("doc_id", ids.alias("ids"))


@query(VOCABULARY_SQL + """
     , m AS (SELECT doc_id, ['[CLS]'] || words[1:62] || ['[SEP]'] AS words FROM t)
     , p AS (SELECT doc_id, unnest(words) AS token, unnest(range(len(words))) AS pos FROM m)
     , i AS (SELECT doc_id, pos, CASE token WHEN '[CLS]' THEN 2 WHEN '[SEP]' THEN 3
                    ELSE coalesce(token_id + 4, 1) END AS id FROM p LEFT JOIN v USING (token))
     , l AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM i GROUP BY doc_id)
SELECT doc_id, array_to_string(list_resize(ids, 64, 0), ' ') AS input_ids,
       repeat('0', 64) AS token_type_ids,
       repeat('1', len(ids)) || repeat('0', 64 - len(ids)) AS attention_mask
FROM l
""")
def batch_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = V.build_vocabulary(_document_tokens(spark, sf_dir), VOCABULARY, markers=MARKERS)
    rows = V.batch_tokenize(docs, vocabulary, "text", unknown_id=1, pad_id=0)

    def joined(name: str, gap: str) -> Column:
        return F.array_join(F.col(name).cast("array<string>"), gap).alias(name)

    return rows.select(
        "doc_id", joined("input_ids", " "), joined("token_type_ids", ""), joined("attention_mask", "")
    )


# Sources and sinks.


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parse_json(table(spark, sf_dir, "events"), "k bigint", "props", "event_id")


CSV_SQL = "SELECT doc_id, text AS content, lang AS account_category FROM documents"
CSV_SCHEMA = "doc_id bigint, content string, account_category string"


def _write_documents(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "posts")
    docs = table(spark, sf_dir, "documents").select(
        F.col("text").alias("content"), "doc_id", F.col("lang").alias("account_category")
    )
    sinks.write_csv(docs, path)
    return path


@query(CSV_SQL)
def csv_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts written as CSV and read back, line breaks and quotes included."""
    path = _write_documents(spark, sf_dir)
    return posts.read_posts(spark, path, CSV_SCHEMA).drop("file_name")


@query(CSV_SQL)
def csv_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts in files of three layouts, read by name."""
    path = scratch_path(spark, "mixed")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("content"), F.col("lang").alias("account_category"), "n_chars"
    )
    layouts = [
        ["content", "doc_id", "account_category"],
        ["account_category", "content", "doc_id"],
        ["doc_id", "n_chars", "account_category", "content"],
    ]
    for i, columns in enumerate(layouts):
        sinks.write_csv(docs.filter(F.pmod("doc_id", F.lit(3)) == i).select(*columns), f"{path}/{i}")
    return posts.read_posts(spark, [f"{path}/{i}" for i in range(3)], CSV_SCHEMA).drop("file_name")


@query("SELECT event_id, event_type, props FROM events")
def csv_single_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells without line breaks: a large file is read in several splits."""
    path = scratch_path(spark, "events")
    events = table(spark, sf_dir, "events").select("props", "event_id", "event_type")
    sinks.write_csv(events, path)
    schema = "event_id bigint, event_type string, props string"
    return posts.read_posts(spark, path, schema, multi_line=False).drop("file_name")


RAGGED_SQL = """
WITH l AS (SELECT event_id, event_type,
                  CASE event_type WHEN 'error' THEN event_id || ',"' || event_type || '",x,more'
                       WHEN 'signup' THEN event_id || ',' || event_type
                       ELSE event_id || ',' || event_type || ',' || event_id * 2 END AS line
           FROM events)
"""
RAGGED_SCHEMA = "event_id bigint, event_type string, twice bigint"


def _ragged_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as CSV lines, some with a cell too many and some with one too few."""
    path = scratch_path(spark, "ragged")
    events = table(spark, sf_dir, "events")
    line = (
        F.when(F.col("event_type") == "error", F.concat("event_id", F.lit(',"'), "event_type", F.lit('",x,more')))
        .when(F.col("event_type") == "signup", F.concat_ws(",", "event_id", "event_type"))
        .otherwise(F.concat_ws(",", "event_id", "event_type", F.col("event_id") * 2))
    )
    # One column whose name is the header and whose cells are whole lines.
    lines = events.select(line.alias("event_id,event_type,twice"))
    writer = lines.write.option("header", True).option("sep", "\u0001").option("quote", "\u0000")
    writer.option("maxRecordsPerFile", events.count() // 3 + 1).csv(path)
    return posts.read_posts(spark, path, RAGGED_SCHEMA, multi_line=False, refused="keep")


@query(RAGGED_SQL + """
SELECT event_id, event_type, event_id * 2 AS twice FROM events WHERE event_type NOT IN ('error', 'signup')
""")
def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with as many cells as the header; no cell lands under another name."""
    rows = posts.quarantine_posts(_ragged_posts(spark, sf_dir), scratch_path(spark, "refused"))
    return rows.drop("file_name")


@query(RAGGED_SQL + """
SELECT line AS refused, count(*) AS n, (SELECT count(*) FROM events) AS rows
FROM l WHERE event_type IN ('error', 'signup') GROUP BY line
""")
def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refused rows as they stood in the files, and how many rows there were in all."""
    path = scratch_path(spark, "refused")
    rows = _ragged_posts(spark, sf_dir)
    posts.quarantine_posts(rows, path)
    total = posts.refusal_counts(rows).agg(F.sum(F.col("good") + F.col("refused"))).first()[0]
    stored = spark.read.parquet(path).groupBy("refused").agg(F.count("*").alias("n"))
    return stored.withColumn("rows", F.lit(total))


def _numbered_documents(spark: SparkSession, sf_dir: str) -> str:
    """Documents as numbered part files ``part_0`` to ``part_4`` by id; the folder."""
    path = scratch_path(spark, "numbered")
    for number in range(5):
        docs = table(spark, sf_dir, "documents").filter(F.pmod("doc_id", F.lit(5)) == number)
        cells = docs.select(F.col("text").alias("content"), "doc_id", F.col("lang").alias("account_category"))
        sinks.write_csv(cells, f"{path}/part_{number}")
    return path


@query("SELECT doc_id, text AS content, lang AS account_category FROM documents WHERE doc_id % 5 < 2")
def first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two part files by name."""
    path = _numbered_documents(spark, sf_dir)
    chosen = files.select_files([f"{path}/part_{n}" for n in (4, 1, 3, 0, 2)], first=2)
    return posts.read_posts(spark, chosen, CSV_SCHEMA).drop("file_name")


@query("""
WITH p AS (SELECT n FROM range(0, 5) r(n) ORDER BY md5('part_' || n || '42'), n LIMIT 2)
SELECT doc_id, text AS content, lang AS account_category FROM documents
WHERE doc_id % 5 IN (SELECT n FROM p)
""")
def sampled_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two part files drawn by a hash of their names."""
    path = _numbered_documents(spark, sf_dir)
    chosen = files.select_files([f"{path}/part_{n}" for n in range(5)], sample=2)
    return posts.read_posts(spark, chosen, CSV_SCHEMA).drop("file_name")


@query("SELECT doc_id, text AS content, lang AS account_category FROM documents WHERE doc_id % 5 IN (1, 2, 3)")
def numbered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _numbered_documents(spark, sf_dir)
    chosen = files.numbered_files(path + "/part_{}", range(1, 4))
    return posts.read_posts(spark, chosen, CSV_SCHEMA).drop("file_name")


@query("""
SELECT vec_id AS ids, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER)
           AS political_bias
FROM embeddings
""")
def predictions_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "predictions")
    embeddings = table(spark, sf_dir, "embeddings")
    sinks.write_predictions(Q.prediction_table(embeddings, "vec_id", "embedding"), path)
    return spark.read.schema("ids bigint, political_bias int").option("header", True).csv(path)


@query("""
SELECT c_custkey, n_regionkey AS code, r_name AS name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def encode_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as raw labels of an axis of regions, which is data."""
    nations = table(spark, sf_dir, "nation")
    raw = nations.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(raw), "c_nationkey")
    labels = _region_labels(spark, sf_dir)
    found = LT.encode_by_table(customers, "n_name", labels, "region", name_col="name")
    return found.select("c_custkey", "code", "name")


@query("""
SELECT c_custkey, CASE WHEN n_regionkey = 0 THEN -1 ELSE n_regionkey - 1 END AS code
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def encode_by_read_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same axis without its first region, read from the table; that region gets the default."""
    rest = _region_labels(spark, sf_dir).filter("code > 0").withColumn("code", F.col("code") - 1)
    axis = LT.read_axis(rest, "region")
    raw = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customers = table(spark, sf_dir, "customer").join(F.broadcast(raw), "c_nationkey")
    return customers.select("c_custkey", axis.encode(F.col("n_name"), default=-1).alias("code"))


def _region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, sf_dir, "nation").join(F.broadcast(regions), "n_regionkey").select(
        F.lit("region").alias("axis"),
        F.col("n_name").alias("raw"),
        F.col("n_regionkey").cast("int").alias("code"),
        F.col("r_name").alias("name"),
    )


@query("""
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, doc_id, lang, doc_id AS other_id, n_chars FROM documents
""")
def join_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables in the same order but files of other sizes, put side by side."""
    path = scratch_path(spark, "positions")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").orderBy("doc_id")
    sides = {"left": ("doc_id", "lang"), "right": (F.col("doc_id").alias("other_id"), "n_chars")}
    for name, columns in sides.items():
        rows = 97 if name == "left" else 64
        docs.select(*columns).write.option("maxRecordsPerFile", rows * 100).parquet(f"{path}/{name}")
    return positions.join_by_position(spark, f"{path}/left", f"{path}/right")


@query("""
WITH e AS (SELECT list_distinct([user_id % 3, 3 + event_id % 2]) AS labels FROM events),
     u AS (SELECT unnest(labels) AS label FROM e),
     c AS (SELECT label, count(*) AS n FROM u GROUP BY label)
SELECT CAST(label AS INTEGER) AS label, n AS both, 0 AS only_predicted, 0 AS only_true, 1.0 AS micro_f1 FROM c
""")
def multi_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with two labels each, which their texts tell; models that share one TF-IDF."""
    codes = [F.pmod("user_id", F.lit(3)), 3 + F.pmod("event_id", F.lit(2))]
    words = [F.concat(F.lit(w), c) for w, c in zip("ue", codes)]
    rows = table(spark, sf_dir, "events").select(
        F.concat_ws(" ", *words).alias("content"),
        ML.label_sets(codes).cast("array<int>").alias("labels"),
    )
    model = ML.train_multi_label(rows, 5, classify.Settings(features=1 << 10, reg=0.001))
    counters = ML.label_counters(ML.predict_multi_label(rows, model), 5)
    score = ML.multi_label_scores(counters).first()["micro_f1"]
    return counters.withColumn("micro_f1", F.lit(score))


# Model jobs: no SQL equal.


def _labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = R.drop_non_text(docs.join(quality, "doc_id"), "text")
    return joined.select(
        "doc_id",
        X.normalize_text(F.col("text")).alias("content"),
        L.pass_label(F.col("quality")).alias("label"),
    )


@query()
def train_predict_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(predicted | given quality) of the documents held out of training."""
    train, test = S.random_split(_labelled_documents(spark, sf_dir), "doc_id", fraction=0.7)
    model = classify.train_classifier(train, QUALITY.classes)
    return jobs.predicted_matrix(test, model, "label", QUALITY, QUALITY)


@query()
def transfer_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(predicted quality | role): a model of documents applied to conversations."""
    model = classify.train_classifier(_labelled_documents(spark, sf_dir), QUALITY.classes)
    turns = R.drop_non_text(table(spark, sf_dir, "conversations"), "text")
    given = turns.select(
        X.normalize_text(F.col("text")).alias("content"),
        ROLES.encode(F.col("role")).alias("given_role"),
    )
    return jobs.predicted_matrix(given, model, "given_role", ROLES, QUALITY)


@query()
def select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores on held-out documents of three classifiers, and which was chosen."""
    train, test = S.random_split(_labelled_documents(spark, sf_dir), "doc_id", fraction=0.7)
    candidates = [classify.Settings(reg=r) for r in (0.1, 0.01, 0.001)]
    choice = jobs.train_and_evaluate(train, test, QUALITY, candidates)
    chosen = F.col("candidate") == choice.candidate
    return choice.scores(spark).withColumn("chosen", chosen)


# Streaming, fed with the events as JSON lines.

STREAM = job.StreamSettings(axis=EVENTS, default=2)
STREAM_SQL = f"""
WITH e AS (SELECT props AS content, event_type, {EVENT_CASE} AS given,
                  CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS pred
           FROM events
           WHERE NOT ({_sampled_sql("props || '|' || event_type")}))
"""
CELLS_SQL = """
     , cells AS (SELECT g AS given, p AS pred FROM range(0, 3) a(g), range(0, 3) b(p))
     , c AS (SELECT given, pred, count(*) AS n FROM e GROUP BY given, pred)
     , d AS (SELECT given, pred, coalesce(n, 0) AS n FROM cells LEFT JOIN c USING (given, pred))
"""


def _remainder_logits(rows: DataFrame) -> DataFrame:
    """A scorer that favours the number in the text modulo 3."""
    number = F.regexp_extract("content", r"(\d+)", 1)
    favoured = F.when(number != "", number.cast("bigint") % 3)
    logits = [F.when(favoured == c, F.lit(2.0)).otherwise(F.lit(0.5 * c)) for c in range(3)]
    return rows.withColumn("logits", F.array(*logits))


def _feed(spark: SparkSession, sf_dir: str, path: str, rows: str = "true") -> str:
    """The events as files of JSON lines, with lines that are no JSON and no post.

    One CSV line per error event, and per signup a post without a text. The
    files of a partition hold a quarter of all events at most.
    """
    events = table(spark, sf_dir, "events").filter(rows)
    per_file = events.count() // 4 + 1
    posted = events.select(
        F.col("props").alias("content"), F.col("event_type").alias("account_category")
    )
    posts.write_replay(posted, f"{path}/lines", rows_per_file=per_file)
    raw = F.concat_ws(",", "event_id", "event_type")
    no_text = F.to_json(F.struct(F.col("event_type").alias("account_category")))
    other = events.select(
        F.when(F.col("event_type") == "error", raw)
        .when(F.col("event_type") == "signup", no_text)
        .alias("value")
    )
    other = other.filter("value IS NOT NULL").write.mode("append")
    other.option("maxRecordsPerFile", per_file).text(f"{path}/lines")
    return f"{path}/lines"


def _files_per_batch(spark: SparkSession, path: str) -> int:
    """So many that there are four batches or more."""
    return max(1, len(spark.read.text(path).inputFiles()) // 4)


def _run_events(
    spark: SparkSession, sf_dir: str, score=None, settings: job.StreamSettings | None = None
) -> str:
    """Stream the events in batches of files; the folder of the results."""
    path = scratch_path(spark, "stream")
    feed = _feed(spark, sf_dir, path)
    run = job.run_stream(
        posts.replay_stream(spark, feed, max_files=_files_per_batch(spark, feed)),
        score or _remainder_logits,
        f"{path}/counts",
        f"{path}/checkpoint",
        settings or STREAM,
        trigger={"availableNow": True},
    )
    run.awaitTermination()
    return f"{path}/counts"


def _two_feeds(spark: SparkSession, sf_dir: str, path: str, start: Callable) -> DataFrame:
    """Stream half of the events, stop, add the other half and start again.

    ``start`` starts the query on a stream; a row per run with ``results()``.
    """
    whole = None
    for n, rows in enumerate(("event_id % 2 = 0", "event_id % 2 = 1")):
        feed = _feed(spark, sf_dir, f"{path}/{n}", rows)
        files = spark.read.text(feed).write.mode("append")
        files.option("maxRecordsPerFile", 1 + spark.read.text(feed).count() // 3).text(f"{path}/all")
        lines = posts.replay_stream(spark, f"{path}/all", _files_per_batch(spark, f"{path}/all"))
        query, results = start(lines)
        query.awaitTermination()
        # Read now: the next run replaces what is stored.
        found = spark.createDataFrame(results().collect(), "given int, pred int, n bigint")
        found = found.withColumn("run", F.lit(n))
        whole = found if whole is None else whole.unionByName(found)
    return whole


@query(STREAM_SQL + CELLS_SQL + """
SELECT CAST(given AS INTEGER) AS given, CAST(pred AS INTEGER) AS pred, CAST(n AS BIGINT) AS n,
       round(n / nullif(sum(n) OVER (PARTITION BY given), 0), 9) AS p
FROM d
""")
def stream_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _run_events(spark, sf_dir)
    found = job.stream_matrix(spark, counts, EVENTS.classes, range(3))
    return found.withColumn("p", F.round("p", 9))


@query(STREAM_SQL + """
     , z AS (SELECT given, pred, CASE WHEN pred = 0 THEN 2.0 ELSE 0.0 END AS z0,
                    CASE WHEN pred = 1 THEN 2.0 ELSE 0.5 END AS z1,
                    CASE WHEN pred = 2 THEN 2.0 ELSE 1.0 END AS z2 FROM e)
     , r AS (SELECT given = pred AS ok, given + 1.0 AS weight,
                    ln(exp(CAST(z0 AS DOUBLE)) + exp(CAST(z1 AS DOUBLE)) + exp(CAST(z2 AS DOUBLE)))
                    - CAST(CASE given WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END AS DOUBLE) AS nll
             FROM z)
SELECT count(*) AS examples, round(sum(weight * nll) / sum(weight), 9) AS loss,
       round(avg(CAST(ok AS INTEGER)), 9) AS micro_f1,
       round(avg(CAST(ok AS INTEGER)), 9) AS accuracy,
       (SELECT count(*) FROM events WHERE event_type = 'error') AS corrupt,
       (SELECT count(*) FROM events WHERE event_type = 'signup') AS no_text
FROM r
""")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over all batches, and how many lines could not be read."""
    path = _run_events(spark, sf_dir)
    found = job.stream_total(spark, path, [1.0, 2.0, 3.0])
    return found.select(
        "examples",
        *[F.round(c, 9).alias(c) for c in ("loss", "micro_f1", "accuracy")],
        "corrupt",
        "no_text",
    )


@query(STREAM_SQL + """
SELECT given, CAST(pred AS INTEGER) AS pred, count(*) AS n, true AS several FROM e GROUP BY ALL
""")
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of every micro-batch, compacted after the run, and added up."""
    path = _run_events(spark, sf_dir)
    job.compact_stream(spark, path)
    counts = job.stream_counts(spark, path).filter(F.col("given").isNotNull())
    batches = counts.agg(F.count_distinct("batch_id").alias("batches"))
    summed = counts.groupBy("given", "pred").agg(F.sum("n").alias("n"))
    several = batches.select((F.col("batches") >= 3).alias("several"))
    return summed.withColumn("several", F.lit(several.first()["several"]))


@query(f"""
WITH e AS (SELECT DISTINCT props, event_type, {EVENT_CASE} AS given, r.run,
                  CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS pred
           FROM events, range(0, 2) r(run)
           WHERE event_id % 2 <= r.run AND NOT ({_sampled_sql("props || '|' || event_type")}))
SELECT given, CAST(pred AS INTEGER) AS pred, count(*) AS n, CAST(run AS INTEGER) AS run FROM e GROUP BY ALL
""")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set difference: copies in other files and batches, and after a restart, count once."""
    path = scratch_path(spark, "distinct")
    settings = replace(STREAM, distinct_within="1 day")

    def start(lines):
        run = job.run_stream(
            lines, _remainder_logits, f"{path}/counts", f"{path}/checkpoint", settings,
            trigger={"availableNow": True},
        )
        return run, lambda: job.stream_counts(spark, f"{path}/counts").filter(
            "given IS NOT NULL"
        ).groupBy("given", "pred").agg(F.sum("n").alias("n"))

    return _two_feeds(spark, sf_dir, path, start)


@query(f"""
WITH e AS (SELECT {EVENT_CASE} AS given, r.run, CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS pred
           FROM events, range(0, 2) r(run)
           WHERE event_id % 2 <= r.run AND NOT ({_sampled_sql("props || '|' || event_type")}))
SELECT given, CAST(pred AS INTEGER) AS pred, count(*) AS n, CAST(run AS INTEGER) AS run FROM e GROUP BY ALL
""")
def stream_running_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix in the state of the stream, after a first run and after a restart."""
    path = scratch_path(spark, "running")

    def start(lines):
        run = job.run_matrix(
            lines, _remainder_logits, f"{path}/matrix", f"{path}/checkpoint", STREAM,
            trigger={"availableNow": True},
        )
        return run, lambda: job.running_matrix(
            spark, f"{path}/matrix", range(3), range(3)
        ).filter("n > 0").select("given", "pred", "n")

    return _two_feeds(spark, sf_dir, path, start)


@query(STREAM_SQL + """
     , t AS (SELECT count(*) AS examples, count(*) FILTER (given = pred) AS hits FROM e)
SELECT examples, hits, true AS several, 0 AS differing,
       (SELECT count(*) FROM events WHERE event_type = 'error') AS corrupt,
       (SELECT count(*) FROM events WHERE event_type = 'signup') AS no_text
FROM t
""")
def stream_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores observed batch by batch, added up; they differ nowhere from those of the counts."""
    path = scratch_path(spark, "observed")
    weights = [1.0, 2.0, 3.0]
    feed = _feed(spark, sf_dir, path)
    seen = job.BatchMetrics(spark, f"{path}/metrics", weights)
    run = job.run_stream(
        posts.replay_stream(spark, feed, max_files=_files_per_batch(spark, feed)),
        _remainder_logits,
        f"{path}/counts",
        f"{path}/checkpoint",
        STREAM,
        trigger={"availableNow": True},
        metrics=seen,
    )
    run.awaitTermination()
    seen.wait(run)
    observed = job.BatchMetrics.stored(spark, f"{path}/metrics")
    counted = job.stream_metrics(spark, f"{path}/counts", weights).select(
        "batch_id", *[F.col(c).alias(f"_{c}") for c in ("examples", "loss", "accuracy")]
    )
    both = observed.join(counted, "batch_id", "full")
    unlike = [
        ~F.round(c, 9).eqNullSafe(F.round(f"_{c}", 9)) for c in ("examples", "loss", "accuracy")
    ]
    # A batch may hold no test post at all.
    unlike = F.coalesce("_examples", F.lit(0)) + F.coalesce("examples", F.lit(0)) > 0, *unlike
    return both.agg(
        F.sum("examples").alias("examples"),
        F.sum(F.round(F.col("accuracy") * F.col("examples"))).cast("long").alias("hits"),
        (F.count("*") >= 3).alias("several"),
        F.count_if(unlike[0] & (unlike[1] | unlike[2] | unlike[3])).cast("int").alias("differing"),
        F.sum("corrupt").alias("corrupt"),
        F.sum("no_text").alias("no_text"),
    )


@query("SELECT props AS content, event_type AS account_category, count(*) AS n, true AS several FROM events GROUP BY ALL")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events replayed at a pace, with a restart in between: each comes once."""
    path = scratch_path(spark, "replay")
    events = table(spark, sf_dir, "events")
    posted = events.select(F.col("props").alias("content"), F.col("event_type").alias("account_category"))
    rows = posted.count()
    replay.write_replay_table(posted, f"{path}/table", rows_per_file=rows // 5 + 1)
    for upto in (2, None):
        lines = replay.replay_at_pace(spark, f"{path}/table", rows_per_trigger=rows // 7 + 1)

        def write(batch: DataFrame, batch_id: int) -> None:
            sinks.write_batch(batch, f"{path}/lines", batch_id)

        run = lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
        run = run.trigger(processingTime="0 seconds").start()
        while upto and run.isActive and (run.lastProgress or {"batchId": 0})["batchId"] < upto:
            time.sleep(0.05)
        if upto is None:
            run.processAllAvailable()
        run.stop()
    lines = sinks.read_batches(spark, f"{path}/lines", "value string")
    batches = lines.agg(F.count_distinct("batch_id") >= 5).first()[0]
    return R.parse_json(lines, "content string, account_category string", "value").groupBy(
        "content", "account_category"
    ).agg(F.count("*").alias("n")).withColumn("several", F.lit(batches))


# A fitted model on a problem it can solve exactly: the text is the event's name.


def _event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", F.col("event_type").alias("content"), EVENTS.encode(F.col("event_type")).alias("label")
    )


def _event_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return S.random_split(_event_posts(spark, sf_dir), "event_id", fraction=0.8)


EVENT_MODEL = classify.Settings(features=1 << 10, reg=0.001)
HELD_OUT_SQL = f"""
WITH e AS (SELECT {EVENT_CASE} AS given FROM events WHERE NOT ({_sampled_sql("event_id")})),
     cells AS (SELECT g AS given, p AS pred FROM range(0, 3) a(g), range(0, 3) b(p))
SELECT CAST(given AS INTEGER) AS given, CAST(pred AS INTEGER) AS pred,
       CASE WHEN given = pred THEN (SELECT count(*) FROM e WHERE e.given = cells.given) ELSE 0 END AS n
FROM cells
"""


@query(HELD_OUT_SQL)
def train_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier of event names: every held-out event gets its own class."""
    train, test = _event_sides(spark, sf_dir)
    model = classify.train_classifier(train, EVENTS.classes, EVENT_MODEL)
    return jobs.predicted_matrix(test, model, "label", EVENTS, EVENTS).select("given", "pred", "n")


@query(HELD_OUT_SQL)
def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after the model was saved and loaded."""
    train, test = _event_sides(spark, sf_dir)
    model = classify.train_classifier(train, EVENTS.classes, EVENT_MODEL)
    folder = models.save_model(spark, model, scratch_path(spark, "models"), "event", f1=1.0)
    loaded, about = models.load_model(spark, folder)
    assert about["axis"] == "event"
    return jobs.predicted_matrix(test, loaded, "label", EVENTS, EVENTS).select("given", "pred", "n")


@query(f"""
WITH e AS (SELECT count(*) AS n FROM events WHERE NOT ({_sampled_sql("event_id")}))
SELECT CAST(c AS INTEGER) AS candidate, n AS examples, c = 1 AS chosen,
       CASE WHEN c = 0 THEN 'less' ELSE 'all' END AS right
FROM e, range(0, 3) r(c)
""")
def select_best_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature cannot tell the events apart; of the two candidates that can, the first wins."""
    train, test = _event_sides(spark, sf_dir)
    candidates = [
        classify.Settings(features=1),
        classify.Settings(features=1 << 10, reg=0.01),
        EVENT_MODEL,
    ]
    choice = jobs.train_and_evaluate(train, test, EVENTS, candidates)
    right = F.when(F.col("accuracy") == 1.0, "all").otherwise("less")
    return choice.scores(spark).select(
        "candidate", "examples", (F.col("candidate") == choice.candidate).alias("chosen"), right.alias("right")
    )


@query(FOLD_SQL + """
SELECT CAST(c AS INTEGER) AS candidate, 1.0 AS score,
       (SELECT count(*) FROM folds) AS examples, (SELECT count(DISTINCT fold) FROM folds) AS folds
FROM range(0, 2) r(c)
""")
def cross_validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five stratified folds, each scored by models of the other four, which tell all events apart."""
    folds = _event_folds(spark, sf_dir).withColumn("content", F.col("event_type"))
    rows = folds.withColumn("label", EVENTS.encode(F.col("event_type")))
    rows = rows.select("content", "label", "fold")
    model, scores = classify.cross_validate(rows, EVENTS.classes, [0.001, 0.01], 5, EVENT_MODEL)
    sizes = rows.agg(F.count("*").alias("examples"), F.count_distinct("fold").alias("folds"))
    # The model of all rows is that of the better candidate.
    told = jobs.predicted_matrix(rows, model, "label", EVENTS, EVENTS)
    assert told.filter("given <> pred AND n > 0").isEmpty()
    scored = [F.struct(F.lit(i).alias("candidate"), F.lit(x).alias("score")) for i, x in enumerate(scores)]
    candidates = F.inline(F.array(*scored))
    return sizes.select(candidates, "examples", "folds")


@query("""
WITH c AS (SELECT CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS given, count(*) AS n
           FROM conversations WHERE text IS NOT NULL GROUP BY 1),
     cells AS (SELECT g AS given, p AS pred FROM range(0, 3) a(g), range(0, 3) b(p))
SELECT CAST(given AS INTEGER) AS given, CAST(pred AS INTEGER) AS pred,
       CASE WHEN given = pred THEN coalesce((SELECT n FROM c WHERE c.given = cells.given), 0) ELSE 0 END AS n
FROM cells
""")
def transfer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of events applied to turns whose text names the event that stands for their role."""
    model = classify.train_classifier(_event_posts(spark, sf_dir), EVENTS.classes, EVENT_MODEL)
    turns = R.drop_non_text(table(spark, sf_dir, "conversations"), "text")
    role = ROLES.encode(F.col("role"))
    word = F.when(role == 0, "purchase").when(role == 1, "click").otherwise("error")
    given = turns.select(word.alias("content"), role.alias("given_role"))
    return jobs.predicted_matrix(given, model, "given_role", ROLES, EVENTS).select("given", "pred", "n")


@query(f"""
WITH e AS (SELECT {EVENT_CASE} AS given FROM events
           WHERE NOT ({_sampled_sql("event_type || '|' || event_type || '|' || event_id")})),
     cells AS (SELECT g AS given, p AS pred FROM range(0, 3) a(g), range(0, 3) b(p))
SELECT CAST(given AS INTEGER) AS given, CAST(pred AS INTEGER) AS pred,
       CASE WHEN given = pred THEN (SELECT count(*) FROM e WHERE e.given = cells.given) ELSE 0 END AS n
FROM cells
""")
def stream_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same model on the stream; the id tells posts apart but is not in the text."""
    model = classify.train_classifier(_event_posts(spark, sf_dir), EVENTS.classes, EVENT_MODEL)
    path = scratch_path(spark, "stream")
    events = table(spark, sf_dir, "events")
    posted = events.select(
        F.col("event_type").alias("content"),
        F.col("event_type").alias("account_category"),
        F.col("event_id").cast("string").alias("event_id"),
    )
    fields = T.StructType.fromDDL("content string, account_category string, event_id string")
    posts.write_replay(
        posted, f"{path}/lines", rows_per_file=posted.count() // 4 + 1, columns=fields.fieldNames()
    )
    run = job.run_stream(
        posts.replay_stream(spark, f"{path}/lines", _files_per_batch(spark, f"{path}/lines")),
        lambda rows: job.stream_predict(rows, model, len(EVENTS.classes)),
        f"{path}/counts",
        f"{path}/checkpoint",
        replace(STREAM, schema=fields),
        trigger={"availableNow": True},
    )
    run.awaitTermination()
    found = job.stream_matrix(spark, f"{path}/counts", EVENTS.classes, EVENTS.classes)
    return found.select("given", "pred", "n")


# How often the real texts were scored: once each.


def _row_totals(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("given").agg(F.sum("n").alias("n"))


LABELLED_SQL = f"""
WITH l AS (SELECT quality AS given, d.doc_id FROM labels l JOIN documents d USING (doc_id)
           WHERE text IS NOT NULL),
     h AS (SELECT * FROM l WHERE NOT
           (CAST('0x' || substr(md5(doc_id || '|42'), 1, 15) AS BIGINT) < {int(0.7 * (1 << 60))}))
"""


@query(LABELLED_SQL + """
SELECT CAST(g AS INTEGER) AS given, (SELECT count(*) FROM h WHERE h.given = g) AS n FROM range(0, 2) r(g)
""")
def train_predict_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_totals(train_predict_matrix(spark, sf_dir))


@query("""
SELECT CAST(g AS INTEGER) AS given, (SELECT count(*) FROM conversations WHERE text IS NOT NULL
       AND CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 WHEN 'system' THEN 2 END = g) AS n
FROM range(0, 3) r(g)
""")
def transfer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_totals(transfer_matrix(spark, sf_dir))


@query(LABELLED_SQL + """
SELECT CAST(c AS INTEGER) AS candidate, (SELECT count(*) FROM h) AS examples FROM range(0, 3) r(c)
""")
def select_best_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_best(spark, sf_dir).select("candidate", "examples")
