"""The registered queries of the corpus operators, with their SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelcorr.llm.chat import preference_turns, stale_answers
from labelcorr.llm.common import held_out, lower_ascii, table, written
from labelcorr.llm.exact_dedup import exact_duplicates
from labelcorr.llm.fingerprints import fingerprints
from labelcorr.llm.merkle import checked, document_leaves, manifest, proofs
from labelcorr.llm.mixing import document_rates, domain_labels
from labelcorr.llm.near_dedup import near_duplicates
from labelcorr.llm.pieces import round_trips
from labelcorr.llm.quality import fit_rules, quality_scores
from labelcorr.llm.secrets import KINDS, secrets
from labelcorr.llm.spelling import MIN_COUNT, spelling_variants, word_counts
from labelcorr.llm.token_counts import token_counts
from labelcorr.llm.toxicity import fit_toxicity, toxicity_scores
from labelcorr.llm.warc import archive_folder, read_archives, write_archives

# Wanted shares of tokens: clean and good, clean and poor, toxic.
TARGET = (0.85, 0.1, 0.05)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL it must equal."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


@query(f"""
WITH d AS (SELECT doc_id, sha256({LOWER}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256)
    found = exact_duplicates(docs, text_sha256=digest)
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


def _classified(scores: DataFrame, bar: float) -> DataFrame:
    return scores.select(
        F.col("id").alias("doc_id"),
        held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= bar).cast("int").alias("predicted"),
    )


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return _classified(toxicity_scores(docs, model), 0.7)


@query("""
WITH c AS (SELECT DISTINCT conv_id AS pair_id, turn, coalesce(role, '') AS role,
                  coalesce(text, '') AS text FROM conversations),
     answers AS (SELECT pair_id, turn, text,
                        row_number() OVER (PARTITION BY pair_id ORDER BY turn, text) AS nth,
                        count(*) OVER (PARTITION BY pair_id) AS n
                 FROM c WHERE role = 'assistant'),
     ends AS (SELECT a.pair_id, a.turn, a.text,
                     CASE WHEN a.n = 1 THEN '' ELSE f.text END AS stale
              FROM answers a JOIN answers f ON a.pair_id = f.pair_id AND f.nth = 1
              WHERE a.nth = a.n),
     r AS (SELECT DISTINCT c.pair_id, c.turn, c.role,
                  CASE WHEN e.pair_id IS NULL THEN c.text ELSE e.stale END AS text
           FROM c LEFT JOIN ends e ON c.pair_id = e.pair_id AND c.turn = e.turn
                AND c.text = e.text AND c.role = 'assistant'),
     merged AS (SELECT pair_id, turn, role, text, max(chosen) AS chosen, max(rejected) AS rejected
              FROM (SELECT *, 1 AS chosen, 0 AS rejected FROM c
                    UNION ALL SELECT *, 0, 1 FROM r) GROUP BY ALL),
     ordered AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) AS pos
                 FROM merged),
     firsts AS (SELECT pair_id, min(pos) AS first FROM ordered WHERE chosen + rejected = 1
                GROUP BY pair_id),
     parts AS (SELECT o.*, p.part FROM ordered o LEFT JOIN firsts f USING (pair_id),
                      (VALUES ('prompt'), ('chosen'), ('rejected')) AS p(part)
               WHERE CASE p.part WHEN 'prompt' THEN o.pos < coalesce(f.first, o.pos + 1)
                     WHEN 'chosen' THEN o.pos >= f.first AND o.chosen = 1
                     ELSE o.pos >= f.first AND o.rejected = 1 END)
SELECT pair_id AS conv_id, part, turn, role, '<|' || role || '|>' || chr(10) || text || chr(10) AS rendered,
       part <> 'prompt' AND role = 'assistant' AS trained,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 ELSE 0 END AS loss_start,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 + length(text)
            ELSE 0 END AS loss_end
FROM parts
""")
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is preferred to the same one that ends with a stale answer."""
    turns = table(spark, sf_dir, "conversations")
    chosen = turns.withColumnRenamed("conv_id", "pair_id")
    return preference_turns(chosen, stale_answers(turns)).withColumnRenamed("pair_id", "conv_id")


@query()
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    counts = [
        F.expr(f"bigint(size(filter(base, s -> s.kind = '{kind}')))").alias(f"n_{kind}")
        for kind in KINDS[:3]
    ]
    return found.select(
        F.col("id").alias("doc_id"),
        *counts,
        F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"),
        _joined("found").alias("spans"),
    )


def _joined(spans: str) -> Column:
    texts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(texts, ",")


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_rules(docs, table(spark, sf_dir, "labels"))
    return _classified(quality_scores(docs, model), 0.5)


@query()
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes,
                  sha1(html) AS payload_digest FROM p),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END
           AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM g
""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    root = archive_folder(pages)
    index = write_archives(pages, root)
    found = read_archives(index, root, payloads=False)
    return found.drop("url").withColumnRenamed("id", "page_id")


@query(f"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '[\\x20\\x09-\\x0D]+'),
                                 lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []
                WHEN len(words) = 1 THEN [words[1]]
                ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])
                END) AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
u AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
          FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * common >= 80 * (x.n + y.n - common)),
linked AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS seen FROM documents
          UNION SELECT r.id, l.b FROM reach r JOIN linked l ON l.a = r.seen)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT id, min(seen) AS component_id FROM reach GROUP BY id) c ON c.id = n.doc_id
""")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


@query()
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query()
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = domain_labels(table(spark, sf_dir, "labels"))
    found = document_rates(table(spark, sf_dir, "documents"), labelled, TARGET)
    return found.withColumnRenamed("id", "doc_id")


# CRC-32 in SQL: the table of the 256 remainders, and the remainder of a list of bytes.
CRC_SQL = """crc AS (SELECT list(list_reduce([CAST(n AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
                      lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                      ORDER BY n) AS t FROM range(256) r(n))"""


def _crc_sql(bytes_sql: str) -> str:
    rest = f"list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {bytes_sql}), " \
           "lambda c, b: xor(c >> 8, t[CAST(xor(c, b) % 256 AS INTEGER) + 1]))"
    return f"xor({rest}, 4294967295)"


def _field_sql(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode({text})) || ':' || {text} END"


def _leaf_sql(text: str) -> str:
    return f"sha256(concat({', '.join(map(_field_sql, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"


def _run_sql(nodes: str) -> str:
    return f"""SELECT tree, level, idx // 3 AS run, list(digest ORDER BY idx) AS nodes
               FROM {nodes} WHERE n > 1 GROUP BY ALL"""


def _walk_sql(runs: str, start: str, rest: str) -> str:
    """Fold a leaf with its siblings, level by level."""
    return f"""
    SELECT {start}
    UNION ALL
    SELECT {rest}, w.tree, w.level + 1, w.idx // 3,
           sha256(array_to_string(list_transform(r.nodes, lambda x, i:
                  CASE WHEN i = w.idx % 3 + 1 THEN w.digest ELSE x END), '')),
           w.seen || array_to_string(list_filter(r.nodes, lambda x, i: i <> w.idx % 3 + 1), '')
    FROM w_{runs} w JOIN {runs} r ON r.tree = w.tree AND r.level = w.level AND r.run = w.idx // 3"""


@query(f"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT doc_id, coalesce('+' || source, '') AS tree, {_leaf_sql('text')} AS leaf,
             {_leaf_sql("replace(text, chr(10), '')")} AS cut,
             coalesce({_crc_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: unicode(x))")} % 2 = 0, false)
                 AS even FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
             count(*) OVER (PARTITION BY tree) AS n FROM d),
a AS (SELECT tree, 0 AS level, idx, n, leaf AS digest FROM l
      UNION ALL
      SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
      FROM a WHERE n > 1 GROUP BY tree, level, idx // 3, n),
s AS (SELECT tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx,
             count(*) OVER () AS n FROM a WHERE n = 1),
b AS (SELECT '' AS tree, 0 AS level, idx, n, digest FROM s
      UNION ALL
      SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
      FROM b WHERE n > 1 GROUP BY tree, level, idx // 3, n),
in_tree AS ({_run_sql("a")}),
over_trees AS ({_run_sql("b")}),
w_in_tree AS ({_walk_sql("in_tree", "doc_id, tree, 0 AS level, idx, CASE WHEN even THEN cut ELSE leaf END AS digest, '' AS seen FROM l", "w.doc_id")}),
up AS (SELECT w.doc_id, s.tree AS own, s.digest AS subroot, s.idx, w.digest, w.seen
       FROM w_in_tree w JOIN s ON s.tree = w.tree
       WHERE w.level = (SELECT max(a.level) FROM a WHERE a.tree = w.tree)),
w_over_trees AS ({_walk_sql("over_trees", "doc_id, '' AS tree, 0 AS level, idx, digest, seen FROM up", "w.doc_id")}),
top AS (SELECT digest AS root, level FROM b WHERE n = 1)
SELECT l.doc_id, l.leaf, up.subroot, top.root, sha256(w.seen) AS proof_sha256,
       w.digest AS folded_root, w.digest = top.root AS verified
FROM l JOIN up ON up.doc_id = l.doc_id JOIN w_over_trees w ON w.doc_id = l.doc_id
     JOIN top ON w.level = top.level
""")
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = manifest(document_leaves(table(spark, sf_dir, "documents")))
    found = checked(proofs(made), "tampered", made.root)
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified",
    )


_UTF8_SQL = """flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [unicode(x)]
         ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END))"""


@query(f"""
WITH RECURSIVE {CRC_SQL},
r AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-zA-Z\\x{{C0}}-\\x{{FF}}]{{6,}}')) AS run
      FROM documents),
h AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
k AS (SELECT run, n, {_crc_sql(_UTF8_SQL)} AS h FROM h, crc),
c AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INTEGER))
                  || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM k),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 6
      GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT DISTINCT word, left(word, i - 1) || substr(word, i + 1) AS other
        FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
hole AS (SELECT word, left(word, i - 1) || '_' || substr(word, i + 1) AS other
         FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT c.word, w.word AS near FROM cut c JOIN w ON w.word = c.other
         UNION SELECT w.word, c.word FROM cut c JOIN w ON w.word = c.other
         UNION SELECT a.word, b.word FROM hole a JOIN hole b USING (other) WHERE a.word <> b.word),
ranked AS (SELECT near.word, near, w.n, count(*) OVER (PARTITION BY near.word) AS n_near,
                  row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, encode(near)) AS nth
           FROM near JOIN w ON w.word = near.near),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
             CASE WHEN b.n >= 5 * w.n THEN b.near END AS form,
             CASE WHEN b.n >= 5 * w.n THEN b.n END AS form_n
      FROM w LEFT JOIN ranked b ON b.word = w.word AND b.nth = 1),
path AS (SELECT word, word AS root, form AS next FROM f
         UNION ALL SELECT p.word, f.word, f.form FROM path p JOIN f ON f.word = p.next)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n
FROM f JOIN path p ON p.word = f.word AND p.next IS NULL
""")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = word_counts(table(spark, sf_dir, "documents"))
    words = written(counted.filter(F.col("n") >= MIN_COUNT), "words")
    return spelling_variants(words)


@query()
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
