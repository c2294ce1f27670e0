"""Fill-in-middle examples: texts cut at ranked units and put together again around marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: The sign that is injected after each unit, the sign that escapes, and how each of the two is written where a text holds it itself.
DELIMITER, ESCAPE = "\x02", "\x01"
ESCAPED = {ESCAPE: ESCAPE + "1", DELIMITER: ESCAPE + "2"}
#: A unit of an escaped text: a run of letters, or any other code point, an escaped sign being one.
UNIT = f"[A-Za-z]+|{ESCAPE}[12]|[^A-Za-z]"


def escaped(text: Column) -> Column:
    for sign, written in ESCAPED.items():
        text = F.replace(text, F.lit(sign), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    """Without injected delimiters, the escaped signs as they were."""
    text = F.replace(text, F.lit(DELIMITER), F.lit(""))
    for sign, written in reversed(ESCAPED.items()):
        text = F.replace(text, F.lit(written), F.lit(sign))
    return text


def draws(doc_id: Column, seed: int = 1, n: int = 4) -> Column:
    """``n`` unsigned 32-bit numbers of a document: the 8-digit groups of the digest of its seed and number. A null number counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)))


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix, middle, suffix, output``: each text cut at two drawn places between its units, the middle moved to the end.

    The delimiter is escaped in the text, injected after each unit, and counted; the parts up to the k-th
    delimiter, and between two of them, are ranked substrings of the marked text, unescaped again. No Python, no shuffle,
    no array of units; each row by itself.

    ``form`` is ``plain`` (the text itself: empty texts, texts that hold a mark, and shares from ``plain_from`` in a hundred on), ``spm``
    (suffix first, for shares below ``spm_below``) or ``psm``. Prefix, middle and suffix are null in plain rows. A null text
    counts as empty; a null doc_id draws as if it had no digits; rows of one doc_id draw alike, each on its own text; no rows give no rows. Other columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = rows.withColumn("marked", F.regexp_replace(escaped(F.col("text")), UNIT, f"$0{DELIMITER}")).withColumn("h", draws(F.col("doc_id"), seed))
    counted = marked.withColumn("n", (F.length("marked") - F.length(F.replace(F.col("marked"), F.lit(DELIMITER), F.lit("")))).cast("long"))
    held = F.lit(False)
    for m in MARKS:
        held = held | F.contains(F.col("text"), F.lit(m))
    h = lambda k: F.get("h", F.lit(k))
    first, second = F.pmod(h(0), F.col("n") + 1), F.pmod(h(1), F.col("n") + 1)
    plain = (F.col("n") == 0) | held | (h(2) % 100 >= plain_from)
    form = F.when(plain, "plain").when(h(3) % 100 < spm_below, "spm").otherwise("psm")
    drawn = counted.select("doc_id", "text", "marked", "n", form.alias("form"), F.least(first, second).cast("int").alias("a"), F.greatest(first, second).cast("int").alias("b"))
    ranked = lambda whole, count: F.expr(f"substring_index({whole}, '\\u{ord(DELIMITER):04x}', {count})")
    # Up to the b-th delimiter; of that, what comes before the a-th, and the last b - a units.
    parts = drawn.withColumn("head", ranked("marked", "b"))
    cut = parts.select(
        "doc_id", "text", "n", "form", unescaped(ranked("marked", "a")).alias("prefix"), unescaped(ranked("head", "a - b")).alias("middle"),
        unescaped(ranked("marked", "cast(b - n - 1 AS int)")).alias("suffix"),
    )
    p, s, m = (F.lit(x) for x in MARKS)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", spm).otherwise(psm)
    shown = [F.when(F.col("form") != "plain", F.col(c)).alias(c) for c in ("prefix", "middle", "suffix")]
    return cut.select("doc_id", "n", "form", *shown, output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text, from nothing but an output and its form: no part holds a mark, and no mark arises where a part meets one."""
    before = lambda x, mark: F.substring_index(x, mark, 1)
    after = lambda x, mark: F.substring_index(x, mark, -1)
    p, s, m = MARKS
    prefix = F.when(form == "psm", before(after(output, p), s)).otherwise(before(after(output, p), m))
    suffix = F.when(form == "psm", before(after(output, s), m)).otherwise(before(after(output, s), p))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, after(output, m), suffix))


#: The same cuts from lists of units.
FILL_IN_MIDDLE_SQL = """
WITH units AS (
    SELECT doc_id, coalesce("text", '') AS body, regexp_extract_all(coalesce("text", ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
    FROM {documents}
), drawn AS (
    SELECT doc_id, body, u, len(u) AS n, [CAST('0x' || substr(d, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS h FROM units
), placed AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
             WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), cut AS (
    SELECT doc_id, body, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM placed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN body WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
    sha256(body) AS restored_sha256
FROM cut
"""
