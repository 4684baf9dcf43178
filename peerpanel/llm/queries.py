"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontaminate, embed_dedup, hard_negatives, langid, license_scan, line_dedup, simhash, spelling,
               suffix_dedup, token_output, toxicity, url_filter)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: held-out fold, predicted language and its share."""
    docs = _read(spark, sf_dir, "documents")
    held = F.coalesce(_fold(4) == 2, F.lit(False))
    out = langid.identify(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: bytes, bytes in repeated 200-byte strings, what is left."""
    return suffix_dedup.drop_repeats(_read(spark, sf_dir, "documents"), digest=True)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: lines, lines removed and the text that is left."""
    out = line_dedup.drop_repeated_windows(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
                      F.col("text").alias("kept_text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: words, words hit by benchmark windows, items."""
    return decontaminate.digest(decontaminate.find_matches(_read(spark, sf_dir, "documents"),
                                                           _read(spark, sf_dir, "benchmark")))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: token count, hashes of the ids and of the decoded text."""
    out = bpe.encode_documents(_read(spark, sf_dir, "documents"), tokenizer_path(), digest=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def _fold(divisor: int):
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: held-out fold, score and the decision at 0.7."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    held = F.coalesce(_fold(3) == 1, F.lit(False))
    out = toxicity.toxicity(docs, labels, ~held)
    return out.select("doc_id", held.alias("held_out"), "score",
                      (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def document_path() -> Column:
    """Documents as files: by source, language and length class; every tenth id is
    named as a licence file, as no table has any. A null part reads ``none``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    long = F.coalesce(F.length("text"), F.lit(0))
    kind = F.when(long < 1000, F.lit("")).when(long < 3000, F.concat(text("lang"), F.lit("/"))) \
        .otherwise(F.concat(text("lang"), F.lit("/long/")))
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE-"), text("doc_id"))) \
        .otherwise(F.concat(text("doc_id"), F.lit(".txt")))
    return F.concat(text("source"), F.lit("/"), kind, name)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, taken as a file: its id, path, own licence, its cosine, the
    licence in force and the directory it comes from."""
    files = _read(spark, sf_dir, "documents").select("doc_id", document_path().alias("path"), "text")
    out = license_scan.license_scan(files, keep=("doc_id",))
    return out.select("doc_id", "path", "own", F.round("score", 6).alias("score"), "licence", "from_dir")


def op8_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: fingerprint in hex and smallest linked doc_id."""
    out = simhash.simhash_near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


OP3_SQL = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS win
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS rn
      FROM w WHERE regexp_matches(win, '[^ \t\n\r\f\x0B]')),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM f, (VALUES (0), (1), (2)) v(d) WHERE rn > 1),
each_line AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t
         FROM each_line ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(ls) AS INTEGER) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS INTEGER) AS n_removed,
       coalesce(t, '') AS kept_text
FROM l LEFT JOIN kept USING (doc_id)
"""


OP4_SQL = r"""
WITH lowered AS (
    SELECT 'd' AS side, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
    UNION ALL
    SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(coalesce(t, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
items AS (SELECT id, ws, least(10, len(ws)) AS n FROM w WHERE side = 'b' AND len(ws) > 0),
test AS (SELECT DISTINCT id AS item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win
         FROM (SELECT id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM items)),
train AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
          FROM (SELECT id AS doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i
                FROM (SELECT * FROM w WHERE side = 'd') d, (SELECT DISTINCT n FROM items) s WHERE len(ws) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM train JOIN test USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS list
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM (SELECT * FROM w WHERE side = 'd') d
LEFT JOIN covered ON covered.doc_id = d.id LEFT JOIN found ON found.doc_id = d.id
"""


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of the shards that hold all documents' sequences in training order."""
    return token_output.write_shards(_read(spark, sf_dir, "documents"), tokenizer_path(),
                                     token_output.new_root(spark), key=20240607)


def op10_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: links at cosine >= 0.9, component, kept or not."""
    return embed_dedup.embedding_near_duplicates(_read(spark, sf_dir, "embeddings"))


OP10_SQL = r"""
WITH RECURSIVE cast_up AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
v AS (SELECT vec_id, e FROM cast_up
      WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS node, vec_id AS r FROM embeddings
          UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.node),
comp AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON comp.node = vec_id LEFT JOIN n ON n.a = vec_id
"""

def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (ids divisible by 100) and its first positives."""
    rows, label = _read(spark, sf_dir, "embeddings"), F.col("label").cast("long")
    rows = rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives.hard_negatives(rows, lambda i: i % 100 == 0)


OP11_SQL = r"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE same)
      WHERE k <= 5),
n AS (SELECT p.a, p.b AS p, p.score AS ps, s.b, s.score,
             row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS k
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT a AS anchor_id, p AS positive_id, CAST(k AS INTEGER) AS rank, b AS negative_id, ps AS positive_score,
       score AS negative_score FROM n WHERE k <= 10
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per word of the corpus: its form, root, counts and near words."""
    return spelling.spelling_variants(spelling.corpus_words(_read(spark, sf_dir, "documents")))


URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: host, path, the longest fitting rule and the verdict."""
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def _op13_sql() -> str:
    """The same tree level by level, for the depth that the operator has."""
    u = url_filter
    quoted = lambda t: "'" + t + "'"
    rules = sorted(URL_RULES, key=lambda r: -len(r[0]))
    fits = [(f"((host = '{r[:r.index('/')]}' OR ends_with(host, '.{r[:r.index('/')]}')) AND starts_with(path, '{r[r.index('/'):]}'))", r, v)
            for r, v in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits) + " END"
    decided = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"
    kind = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for k, p in u.KINDS) + " ELSE s END"
    fixed = ", ".join(quoted(k) for k in [*(k for k, _ in u.KINDS), u.TAIL, ""])
    ctes = [f"""a AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{u.URL}', 1), ''), '{u.UPPER}', '{u.LOWER}') AS host,
                 coalesce(regexp_extract(url, '{u.URL}', 2), '') AS path FROM pages)""",
            f"""u AS (SELECT *, {rule} AS rule, {decided} AS decided, CASE WHEN path = '' THEN []
                 ELSE list_transform(string_split(regexp_replace(path, '^/', ''), '/')[1:{u.DEPTH}], lambda s: {kind})
                      || CASE WHEN len(string_split(regexp_replace(path, '^/', ''), '/')) > {u.DEPTH} THEN ['{u.TAIL}'] ELSE [] END
                 END AS segs FROM a)""",
            """c AS (SELECT host, segs, count(*) AS n, count(decided) AS l, count(CASE WHEN decided = 'block' THEN 1 END) AS b FROM u GROUP BY ALL)""",
            f"""v0 AS (SELECT host, segs, n, l, b, '' AS template,
                 (sum(b) OVER h + {u.SMOOTH} * g) / (sum(n) OVER h + {u.SMOOTH}) AS parent,
                 (sum(b) OVER h + {u.SMOOTH} * g) / (sum(l) OVER h + {u.SMOOTH}) AS purity
                 FROM c, (SELECT sum(b) / sum(n) AS g FROM c) WINDOW h AS (PARTITION BY host))"""]
    for d in range(1, u.DEPTH + 2):
        ctes += [f"""s{d} AS (SELECT *, segs[{d}] AS seg, sum(n) OVER (PARTITION BY host, template) AS whole,
                       sum(n) OVER (PARTITION BY host, template, segs[{d}]) AS own FROM v{d - 1} WHERE len(segs) >= {d})""",
                 f"""k{d} AS (SELECT *, CASE WHEN seg NOT IN ({fixed}) AND (own < {u.MIN_PAGES} OR own < {u.MIN_SHARE} * whole) THEN '*'
                       ELSE seg END AS child FROM s{d})""",
                 f"""g{d} AS (SELECT host, template, parent, child, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM k{d} GROUP BY ALL)""",
                 f"""p{d} AS (SELECT *, lag(b) OVER o AS b0, lag(l) OVER o AS l0 FROM g{d} WHERE l > 0
                       WINDOW o AS (PARTITION BY host, template ORDER BY b / l, child))""",
                 f"""x{d} AS (SELECT *, CASE WHEN b / l > b0 / l0 AND b / l - b0 / l0 >= {u.Z} * sqrt((b + b0) / (l + l0)
                       * (1.0 - (b + b0) / (l + l0)) * (1.0 / l + 1.0 / l0)) THEN 1 ELSE 0 END AS cut FROM p{d})""",
                 f"""y{d} AS (SELECT *, sum(cut) OVER (PARTITION BY host, template ORDER BY b / l, child
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS branch FROM x{d})""",
                 f"""z{d} AS (SELECT host, template, unnest(list(child)) AS child, sum(b) AS b, sum(n) AS n, sum(l) AS l, any_value(parent) AS parent,
                       CASE WHEN count(*) > 1 THEN '{{' || string_agg(child, '|' ORDER BY child) || '}}' ELSE min(child) END AS name
                       FROM y{d} GROUP BY host, template, branch
                       UNION ALL SELECT host, template, child, b, n, l, parent, child FROM g{d} WHERE l = 0)""",
                 f"""v{d} AS (SELECT k.host, k.segs, k.n, k.l, k.b, k.template || '/' || z.name AS template,
                       (z.b + {u.SMOOTH} * z.parent) / (z.n + {u.SMOOTH}) AS parent,
                       (z.b + {u.SMOOTH} * z.parent) / (z.l + {u.SMOOTH}) AS purity
                       FROM k{d} k JOIN z{d} z ON z.host = k.host AND z.template = k.template AND z.child = k.child)"""]
    done = " UNION ALL ".join(f"SELECT host, segs, template, purity FROM v{d} WHERE len(segs) = {d}" for d in range(u.DEPTH + 2))
    ctes = [c.replace(" AS (", " AS MATERIALIZED (", 1) for c in ctes]
    return "WITH " + ",\n".join([*ctes, f"t AS ({done})"]) + f"""
SELECT page_id, u.host, path, rule, coalesce(decided, CASE WHEN purity >= {u.REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
       template, round(purity, 6) AS purity FROM u JOIN t ON t.host = u.host AND t.segs = u.segs"""


# the passages, weights and choices of license_scan
OP7_SQL = r"""
WITH templates(k, name, text, need) AS (VALUES {templates}),
files AS (SELECT row_number() OVER () AS f, doc_id, coalesce(text, '') AS text,
                 coalesce(source, 'none') || CASE WHEN coalesce(length(text), 0) < 1000 THEN ''
                     WHEN length(text) < 3000 THEN '/' || coalesce(lang, 'none') ELSE '/' || coalesce(lang, 'none') || '/long' END AS home,
                 CASE WHEN doc_id % 10 = 0 THEN 'LICENSE-' || doc_id ELSE coalesce(CAST(doc_id AS VARCHAR), 'none') || '.txt' END AS name
          FROM documents),
lines AS (SELECT f, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line
          FROM (SELECT f, string_split(text, chr(10)) AS ls FROM files)),
words AS MATERIALIZED (SELECT f, i, unnest(regexp_extract_all(
              translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM lines),
term_lines AS (SELECT DISTINCT f, i FROM words),
breaks AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY f ORDER BY i) = 1 THEN 0 ELSE 1 END AS new FROM term_lines),
paras AS (SELECT f, i, sum(new) OVER (PARTITION BY f ORDER BY i) AS para FROM breaks),
spans AS (SELECT f, para, min(i) AS lo, max(i) AS hi FROM paras GROUP BY ALL),
pass AS (SELECT f, 1 AS kind, i AS lo, i AS hi FROM paras
         UNION ALL SELECT f, size, unnest(range(lo, hi - size + 2)), NULL FROM spans, (VALUES {windows}) v(size)
         UNION ALL SELECT f, 0, lo, hi FROM spans WHERE hi > lo
         UNION ALL SELECT f, -1, 0, 1000000000 FROM files WHERE doc_id % 10 = 0),
numbered AS MATERIALIZED (SELECT row_number() OVER () AS p, f, kind, lo, coalesce(hi, lo + kind - 1) AS hi FROM pass),
pw AS MATERIALIZED (SELECT p, w, count(*) AS tf FROM numbered JOIN words ON words.f = numbered.f AND i BETWEEN lo AND hi
                    GROUP BY p, w),
needed AS (SELECT k, len(need) AS size, unnest(need) AS w FROM templates),
fits AS (SELECT p, k FROM pw JOIN needed USING (w) GROUP BY p, k, size HAVING count(*) = size),
n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT w, count(DISTINCT f) AS df FROM words GROUP BY w),
twords AS (SELECT k, unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS w FROM templates),
tv AS (SELECT k, w, count(*) * ln((any_value(n) + 1) / (coalesce(any_value(df), 0) + 1)) AS x
       FROM twords LEFT JOIN df USING (w), n GROUP BY k, w),
tn AS (SELECT k, sqrt(sum(x * x)) AS norm FROM tv GROUP BY k HAVING norm > 0),
px AS (SELECT p, w, tf * ln((n + 1) / (df + 1)) AS x FROM pw JOIN df USING (w), n WHERE p IN (SELECT p FROM fits)),
pn AS (SELECT p, sqrt(sum(x * x)) AS norm FROM px GROUP BY p),
dot AS (SELECT p, k, round(sum(px.x * tv.x) / any_value(tn.norm), 9) AS dot
        FROM fits JOIN tn USING (k) JOIN px USING (p) JOIN tv USING (k, w) GROUP BY p, k),
top AS (SELECT p, name, dot FROM (SELECT p, name, dot, row_number() OVER (PARTITION BY p ORDER BY dot DESC, k) AS rn
        FROM dot JOIN templates USING (k)) WHERE rn = 1 AND name <> ''),
scored AS (SELECT f, kind, name AS own, least(1.0, round(dot / norm, 9)) AS score
           FROM top JOIN pn USING (p) JOIN numbered USING (p) WHERE norm > 0),
best AS (SELECT f, own, score FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY kind >= 0, score DESC, own) AS rn
         FROM scored WHERE score >= 0.6) WHERE rn = 1),
found AS (SELECT files.*, own, coalesce(score, 0.0) AS score FROM files LEFT JOIN best USING (f)),
votes AS (SELECT home AS dir, own, count(*) AS c FROM found WHERE own IS NOT NULL AND starts_with(name, 'LICENSE-') GROUP BY ALL),
dirs AS (SELECT dir, own AS licence FROM (
             SELECT *, row_number() OVER (PARTITION BY dir ORDER BY c DESC, own) AS rn FROM votes) WHERE rn = 1),
up AS (SELECT f, dir, licence, row_number() OVER (PARTITION BY f ORDER BY length(dir) DESC) AS rn
       FROM found JOIN dirs ON home = dir OR starts_with(home, dir || '/') WHERE own IS NULL)
SELECT doc_id, home || '/' || name AS path, own, round(score, 6) AS score, coalesce(own, licence) AS licence, dir AS from_dir
FROM found LEFT JOIN (SELECT * FROM up WHERE rn = 1) USING (f)
"""


def _op7_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(n)}, {quoted(t)}, [{', '.join(map(quoted, need))}])"
                     for i, (n, t, need) in enumerate(license_scan.TEMPLATES))
    return OP7_SQL.replace("{templates}", rows).replace("{windows}", ", ".join(f"({w})" for w in license_scan.WINDOWS))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_suffix_dedup, op3_line_dedup, op4_decontamination, op5_bpe,
                                   op6_toxicity, op7_license_scan, op8_simhash_near_dup, op9_token_output,
                                   op10_embedding_near_dup, op11_hard_negatives, op12_spelling_variants,
                                   op13_url_filter)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op4_decontamination": OP4_SQL,
            "op7_license_scan": _op7_sql(), "op10_embedding_near_dup": OP10_SQL,
            "op11_hard_negatives": OP11_SQL, "op13_url_filter": _op13_sql()}
