"""Line dedup by a log-template tree of fixed depth (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, row_key, stage, unstage

#: What stands for a variable field (a fixed value).
FIELD = "<*>"
#: The share of a leaf's lines that hold a token where it is constant however large the leaf is.
MAIN = 0.5


def tokens_of(text: Column) -> Column:
    """The tokens of each line of a text: what stands between white space."""
    plain = F.regexp_replace(text, r"[\t\x0B\f\r]", " ")
    return F.transform(F.split(plain, "\n"), lambda line: F.array_remove(F.split(line, " "), ""))


def masked(tokens: Column) -> Column:
    """Tokens with a digit are variable fields."""
    return F.transform(tokens, lambda t: F.when(F.regexp_like(t, F.lit("[0-9]")), FIELD).otherwise(t))


def leaf_of(tokens: Column, depth: int) -> Column:
    """The leaf a line is parsed to: its token count, then its leading tokens; null without tokens."""
    return F.when(F.size(tokens) > 0, F.xxhash64(F.size(tokens), F.array_join(masked(F.slice(tokens, 1, depth)), " ")))


def recurring_lines(docs: DataFrame, min_docs: int, depth: int, similar: float) -> DataFrame:
    """``ln_key, ln_doc, ln_at, ln_first``: every line of a recurring template, and the least doc_id that
    has the template; a line of several such templates is there several times.

    The tree's upper levels are the leaf key, for which only the leading tokens are looked at; only lines of
    leaves with ``min_docs`` documents carry their tokens on, and equal lines are counted before their
    positions are opened: no group grows with a hot line. A line is matched to three templates of its leaf:

    1. A token stays in the template where its position holds it in at least ``min_docs`` documents' lines, else the
       position becomes a variable field; the share ``similar`` of the positions must be constant.
    2. The same with the tokens that stand in the share MAIN of the leaf's lines, one of them after the leading tokens,
       which all lines of a leaf have. A count alone makes every value of a field constant once there are lines enough.
    3. A line with digits as it is: equal lines recur whatever share of their tokens has a digit.

    Leaves, lines and tokens are told apart by 64-bit hashes, lines and tokens within their leaf, so by 128 bits.
    """
    parsed = docs.select(row_key(docs).alias("ln_key"), docs["doc_id"].alias("ln_doc"), tokens_of(docs["text"]).alias("ln_lines"))
    leaves = parsed.select("ln_key", F.explode(F.array_compact(F.array_distinct(F.transform("ln_lines", lambda t: leaf_of(t, depth))))).alias("ln_leaf"))
    often = stage(leaves.groupBy("ln_leaf").count().where(F.col("count") >= min_docs).select("ln_leaf"))
    opened = parsed.select("ln_key", "ln_doc", F.posexplode("ln_lines").alias("ln_at", "ln_tokens")).withColumn("ln_leaf", leaf_of(F.col("ln_tokens"), depth))
    line = F.array_join(masked(F.col("ln_tokens")), " ")
    found = opened.where(F.col("ln_leaf").isNotNull()).join(broadcast_if_small(often, often.count()), "ln_leaf", "left_semi").withColumn("ln_line", line)
    whole = F.when(F.contains("ln_line", F.lit(FIELD)), F.xxhash64(F.array_join("ln_tokens", " ")))
    held = stage(found.select("ln_leaf", F.xxhash64("ln_line").alias("ln_id"), "ln_line", whole.alias("ln_whole"), "ln_key", "ln_doc", "ln_at"))

    one = ["ln_leaf", "ln_id"]
    times = held.select(*one, "ln_key").distinct().groupBy(*one).agg(F.count(F.lit(1)).alias("ln_n"))
    distinct = stage(held.groupBy(*one).agg(F.first("ln_line").alias("ln_line")).join(times, one))
    token = F.when(F.col("ln_token") != FIELD, F.xxhash64("ln_token")).otherwise(F.lit(0)).alias("ln_token")
    places = distinct.select(*one, "ln_n", F.posexplode(F.split("ln_line", " ")).alias("ln_pos", "ln_token")).select(*one, "ln_n", "ln_pos", token)
    sizes = distinct.groupBy("ln_leaf").agg(F.sum("ln_n").alias("ln_all"))
    frequent = places.where("ln_token <> 0").groupBy("ln_leaf", "ln_pos", "ln_token").agg(F.sum("ln_n").alias("ln_df")).where(F.col("ln_df") >= min_docs)
    main = (F.col("ln_df") >= MAIN * F.col("ln_all")).alias("ln_main")
    constant = frequent.join(sizes, "ln_leaf").select("ln_leaf", "ln_pos", "ln_token", F.lit(True).alias("ln_same"), main)
    filled = places.join(constant, ["ln_leaf", "ln_pos", "ln_token"], "left").groupBy(*one).agg(
        F.array_sort(F.collect_list(F.struct("ln_pos", F.coalesce("ln_same", F.lit(False)).alias("by_count"), F.coalesce("ln_main", F.lit(False)).alias("by_share"), "ln_token"))).alias("ln_places")
    )

    def template(kind: int, rule: str) -> Column:
        shown = F.xxhash64(F.array_join(F.transform("ln_places", lambda p: F.when(p[rule], p["ln_token"]).otherwise(0).cast("string")), " "))
        constants = F.size(F.filter("ln_places", lambda p: p[rule]))
        evident = F.lit(True) if kind == 1 else F.exists("ln_places", lambda p: p[rule] & (p["ln_pos"] >= depth))
        return F.when((constants >= similar * F.size("ln_places")) & evident, F.struct(F.lit(kind).alias("ln_kind"), shown.alias("ln_template")))

    both = F.explode(F.array_compact(F.array(template(1, "by_count"), template(2, "by_share"))))
    # Written first, so that a hot line's rows meet them in a join that Spark can split.
    templates = stage(filled.select(*one, both.alias("ln_t")).select(*one, "ln_t.*"))
    by_template = held.join(templates, one).select("ln_leaf", "ln_kind", "ln_template", "ln_key", "ln_doc", "ln_at")
    as_it_is = held.where("ln_whole IS NOT NULL").select("ln_leaf", F.lit(3).alias("ln_kind"), F.col("ln_whole").alias("ln_template"), "ln_key", "ln_doc", "ln_at")
    matched, group = stage(by_template.unionByName(as_it_is)), ["ln_leaf", "ln_kind", "ln_template"]
    unstage(often, held, distinct, templates)
    by_doc = matched.groupBy(*group, "ln_key").agg(F.min("ln_doc").alias("ln_doc"))
    counts = stage(by_doc.groupBy(*group).agg(F.count(F.lit(1)).alias("ln_docs"), F.min("ln_doc").alias("ln_first")).where(F.col("ln_docs") >= min_docs))
    return matched.join(counts, group).select("ln_key", "ln_doc", "ln_at", "ln_first")


def drop_recurring_lines(docs: DataFrame, min_docs: int = 10, depth: int = 3, similar: float = 0.6) -> DataFrame:
    """``docs`` without the lines whose template recurs in ``min_docs`` documents, kept in the first one.

    All columns stay; ``text`` is cut, ``ln_lines`` and ``ln_dropped`` count its lines. Of a recurring
    template, the lines in the document with the least doc_id stay (null comes last). Lines end at
    ``\\n``; empty ones stay. A null text stays null with 0 lines, an empty text has 0 lines. Rows of
    one doc_id and one text count as one document and are cut alike. No rows give no rows. Columns named
    ``ln_key``, ``ln_at``, ``ln_lines`` or ``ln_dropped`` give way to this operator's own.
    """
    docs = docs.drop("ln_key", "ln_at", "ln_lines", "ln_dropped")
    dropped = recurring_lines(docs, min_docs, depth, similar).where(~F.col("ln_doc").eqNullSafe(F.col("ln_first")))
    by_row = dropped.groupBy("ln_key").agg(F.collect_set("ln_at").alias("ln_at"))
    joined = docs.withColumn("ln_key", row_key(docs)).join(by_row, "ln_key", "left")
    n_lines = F.size(F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("ln_at"))
    # The text is split once: the array's one element is bound to a name.
    kept = F.get(F.transform(F.array(F.split("text", "\n")), lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")), F.lit(0))
    return joined.select(
        *(F.when(F.col("ln_at").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else joined[c] for c in docs.columns),
        F.when(F.length("text") > 0, n_lines).otherwise(0).cast("long").alias("ln_lines"),
        F.coalesce(F.size(F.when(F.col("ln_at").isNotNull(), F.col("ln_at"))), F.lit(0)).cast("long").alias("ln_dropped"),
    )


#: The same by DuckDB, with strings in place of hashes; {documents} is the table.
LINES_SQL = r"""
WITH docs AS (
  SELECT doc_id, text, md5(COALESCE(doc_id::VARCHAR, '~') || '|' || COALESCE(text, '~')) AS k, string_split(text, chr(10)) AS lines FROM {documents}
), distinct_docs AS (
  SELECT DISTINCT ON (k) doc_id, k, lines FROM docs
), opened AS (
  SELECT doc_id, k, i - 1 AS line_no, list_filter(string_split_regex(lines[i], '[\x20\x09-\x0D]+'), lambda t: t <> '') AS raw
  FROM distinct_docs, UNNEST(range(1, len(lines) + 1)) AS u(i)
), parsed AS (
  SELECT *, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens FROM opened WHERE len(raw) > 0
), held AS (
  SELECT *, len(tokens)::VARCHAR || '|' || array_to_string(tokens[1:3], ' ') AS leaf, array_to_string(tokens, ' ') AS line FROM parsed
), counted AS (
  SELECT leaf, line, tokens, COUNT(DISTINCT k) AS n FROM held GROUP BY ALL
), places AS (
  SELECT leaf, line, n, i AS pos, tokens[i] AS token FROM counted, UNNEST(range(1, len(tokens) + 1)) AS u(i)
  WHERE leaf IN (SELECT leaf FROM held GROUP BY leaf HAVING COUNT(DISTINCT k) >= 10)
), sizes AS (
  SELECT leaf, SUM(n) AS total FROM counted GROUP BY leaf
), frequent AS (
  SELECT p.leaf, pos, token, SUM(n) >= 0.5 * ANY_VALUE(total) AS main FROM places p JOIN sizes s ON p.leaf = s.leaf WHERE token <> '<*>' GROUP BY ALL HAVING SUM(n) >= 10
), templates AS (
  SELECT p.leaf, p.line, kind, string_agg(CASE WHEN COALESCE(CASE WHEN kind = 1 THEN f.token IS NOT NULL ELSE f.main END, false) THEN p.token ELSE '<*>' END, ' ' ORDER BY p.pos) AS template,
         AVG(CASE WHEN COALESCE(CASE WHEN kind = 1 THEN f.token IS NOT NULL ELSE f.main END, false) THEN 1 ELSE 0 END) AS share,
         bool_or(kind = 1 OR (p.pos > 3 AND COALESCE(f.main, false))) AS evident
  FROM places p CROSS JOIN (VALUES (1), (2)) kinds(kind) LEFT JOIN frequent f ON p.leaf = f.leaf AND p.pos = f.pos AND p.token = f.token GROUP BY p.leaf, p.line, kind
), matched AS (
  SELECT h.leaf, kind, template, k, doc_id, line_no FROM held h JOIN templates t ON h.leaf = t.leaf AND h.line = t.line WHERE share >= 0.6 AND evident
  UNION ALL SELECT leaf, 3, array_to_string(raw, ' '), k, doc_id, line_no FROM held WHERE line LIKE '%<*>%'
), recurring AS (
  SELECT leaf, kind, template, MIN(doc_id) AS first FROM matched GROUP BY ALL HAVING COUNT(DISTINCT k) >= 10
), dropped AS (
  SELECT k, list(DISTINCT line_no) AS ats FROM matched m JOIN recurring r ON m.leaf = r.leaf AND m.kind = r.kind AND m.template = r.template
  WHERE m.doc_id IS DISTINCT FROM r.first GROUP BY k
)
SELECT {columns} FROM (
  SELECT d.*, COALESCE(len(ats), 0)::BIGINT AS ln_dropped, CASE WHEN length(text) > 0 THEN len(lines) ELSE 0 END::BIGINT AS ln_lines,
         CASE WHEN ats IS NULL THEN text
              ELSE array_to_string(list_filter(lines, lambda x, i: NOT list_contains(ats, i - 1)), chr(10)) END AS kept
  FROM docs d LEFT JOIN dropped USING (k)
)
"""
