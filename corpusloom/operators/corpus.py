"""From texts to sentences and tokens, and what is read off a tokens table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rows import let, opened


def sentences_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sid, text``: each text's sentences, numbered from 0."""
    return opened(docs, (F.col(id_col).alias("doc_id"),), T.sentences(F.col(text_col)), "text", at="sid").withColumn("sid", F.col("sid").cast("long"))


def tokens_of(sentences: DataFrame) -> DataFrame:
    """``doc_id, sid, tid, form``: each sentence's tokens, numbered from 0. Row by row, without a shuffle."""
    return opened(sentences, ("doc_id", "sid"), T.tokens(F.col("text")), "form", at="tid")


def nested(sentences: DataFrame) -> DataFrame:
    """``doc_id, sid, forms``: the tokens kept in the sentence's row, so that what looks around needs no shuffle."""
    return sentences.select("doc_id", "sid", T.tokens(F.col("text")).alias("forms"))


def tiles_of(docs: DataFrame) -> DataFrame:
    """``doc_id, at, part, start``: a text's tiles and where they start, the sum of the lengths before them. Row by row."""
    cut = docs.select("doc_id", T.tiles(F.col("text")).alias("parts")).withColumn("starts", T.starts(F.col("parts")))
    placed = opened(cut, ("doc_id",), F.arrays_zip(F.col("parts").alias("part"), F.col("starts").alias("start")), "p", at="at")
    return placed.select("doc_id", "at", "p.part", "p.start")


def numbered(tokens: DataFrame) -> DataFrame:
    """Adds ``gtid``, a token's number in its document: its sentence's running start plus ``tid``."""
    sizes = tokens.groupBy("doc_id", "sid").agg(F.count(F.lit(1)).alias("n_tok"))
    before = Window.partitionBy("doc_id").orderBy("sid")
    starts = sizes.withColumn("first_tok", F.sum("n_tok").over(before) - F.col("n_tok")).drop("n_tok")
    return tokens.join(starts, ["doc_id", "sid"]).withColumn("gtid", F.col("first_tok") + F.col("tid")).drop("first_tok")


def sentence_starts(sentences: DataFrame) -> DataFrame:
    """``doc_id, sid, first_tok, n_tok``: the number in its document of each nested sentence's first token. One row a sentence is shuffled, no token."""
    sizes = sentences.select("doc_id", "sid", F.size("forms").cast("long").alias("n_tok")).where("n_tok > 0")
    before = F.sum("n_tok").over(Window.partitionBy("doc_id").orderBy("sid")) - F.col("n_tok")
    return sizes.select("doc_id", "sid", before.alias("first_tok"), "n_tok")


def appended(corpus: DataFrame, more: DataFrame) -> DataFrame:
    """Two sentence tables as one; in each document the second one's sentences follow the first one's."""
    ends = corpus.groupBy("doc_id").agg((F.max("sid") + 1).alias("shift"))
    moved = more.join(ends, "doc_id", "left").withColumn("sid", F.col("sid") + F.coalesce("shift", F.lit(0))).drop("shift")
    return corpus.unionByName(moved)


def context(tokens: DataFrame, width: int = 2, value: str = "form") -> DataFrame:
    """Adds the neighbours of each token in its sentence: p, pp, n, nn; ``*SB*`` and ``*SE*`` stand beyond its ends."""
    w = Window.partitionBy("doc_id", "sid").orderBy("tid")
    for k in range(1, width + 1):
        tokens = tokens.withColumn("p" * k, F.lag(value, k, "*SB*").over(w)).withColumn("n" * k, F.lead(value, k, "*SE*").over(w))
    return tokens


def context_of(sentences: DataFrame, width: int = 2) -> DataFrame:
    """``doc_id, sid, tid, form`` and the neighbours p, pp, n, nn as ``context`` gives them, from nested sentences: shifted copies of the array, no shuffle."""
    begin, end = (F.array_repeat(F.lit(m), width) for m in ("*SB*", "*SE*"))
    n = F.size("forms")
    columns = [F.col("forms").alias("form")]
    for k in range(1, width + 1):
        columns += [F.slice(F.concat(begin, "forms"), F.lit(width - k + 1), n).alias("p" * k), F.slice(F.concat("forms", end), F.lit(k + 1), n).alias("n" * k)]
    zipped = sentences.select("doc_id", "sid", F.arrays_zip(*columns).alias("z"))
    return opened(zipped, ("doc_id", "sid"), "z", "z", at="tid").select("doc_id", "sid", "tid", "z.*")


def even_samples(rows: DataFrame, order: str, most: int = 50) -> DataFrame:
    """At most ``most`` rows at even distances by the row number column ``order`` (from 0): numbers i * rows / most, rounded down."""
    n = rows.agg(F.count(F.lit(1)).alias("n_all")).withColumn("n_kept", F.least("n_all", F.lit(most)))
    i = F.ceil(F.col(order) * F.col("n_kept") / F.col("n_all"))
    chosen = (i < F.col("n_kept")) & (F.expr(f"ceil({order} * n_kept / n_all) * n_all div n_kept") == F.col(order))
    return rows.crossJoin(F.broadcast(n)).where(chosen).drop("n_all", "n_kept")


def with_range(positions: Column, first: Column, last: Column, value: bool = True) -> Column:
    """A sorted set of positions with all of a range (both ends inclusive) set, or cleared."""
    span = F.sequence(first, last)
    return F.array_sort(F.array_union(positions, span) if value else F.array_except(positions, span))


def next_set(positions: Column, at: Column) -> Column:
    """The least position from ``at`` on that is set; null without one."""
    return F.array_min(F.filter(positions, lambda p: p >= at))


def same_sequences(rows: DataFrame, examples: DataFrame, key: str) -> DataFrame:
    """Rows whose sequence, one string in ``key``, is one of the examples'."""
    return rows.join(examples.select(key).distinct(), key, "left_semi")


def kwic(sentences: DataFrame, hit: Column, left: int = 3, right: int = 7) -> DataFrame:
    """``doc_id, sid, tid, left, key, right``: each token for which ``hit`` (of the column ``form``) holds, in its context.

    ``sentences`` is nested; the context is a slice of the sentence's own row.
    """
    hits = opened(sentences, ("doc_id", "sid", "forms"), "forms", "form", at="tid").where(hit)
    start = F.greatest(F.col("tid") - left, F.lit(0))
    return hits.select(
        "doc_id", "sid", "tid", F.array_join(F.slice("forms", start + 1, F.col("tid") - start), " ").alias("left"), F.col("form").alias("key"),
        F.array_join(F.slice("forms", F.col("tid") + 2, F.lit(right)), " ").alias("right"),
    )


def islands(tokens: DataFrame, label: str, by: tuple[str, ...] = ("doc_id", "sid"), order: str = "tid") -> DataFrame:
    """Runs of neighbouring tokens with one label: ``*by, label, start, end``; tokens with a null label are in none."""
    w = Window.partitionBy(*by).orderBy(order)
    changed = ~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)
    runs = tokens.withColumn("run", F.sum(changed.cast("int")).over(w)).where(F.col(label).isNotNull())
    return runs.groupBy(*by, "run", label).agg(F.min(order).alias("start"), F.max(order).alias("end")).drop("run")


def runs(labels: Column) -> Column:
    """``label, start, end`` of the runs of equal labels in an array, in order; null labels are in none. No shuffle: for nested sentences."""

    def cut(values: Column) -> Column:
        n = F.size(values)
        edge = lambda i: (i == 0) | (i == n) | ~F.get(values, i).eqNullSafe(F.get(values, i - 1))
        edges = F.when(n > 0, F.filter(F.sequence(F.lit(0), n), edge)).otherwise(F.array().cast("array<int>"))
        held = let(edges, lambda es: F.transform(F.slice(es, F.lit(1), F.greatest(F.size(es) - 1, F.lit(0))), lambda e, k: F.struct(F.get(values, e).alias("label"), e.alias("start"), (F.get(es, k + 1) - 1).alias("end"))))
        return F.filter(held, lambda r: r["label"].isNotNull())

    return let(labels, cut)


def carried(rows: DataFrame, value: Column, by: tuple[str, ...], order: str) -> Column:
    """The last ``value`` that is not null up to each row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def distinct_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``attribute, n_values``: how many values each attribute has, in one pass."""
    entries = F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns))).alias("e")
    return rows.select(entries).select("e.*").groupBy("attribute").agg(F.countDistinct("value").alias("n_values"))


def nearest_attribute(counts: DataFrame, target: int) -> DataFrame:
    """The attribute whose number of values is nearest to ``target``; ties go to the first name."""
    return counts.agg(F.min_by("attribute", F.struct(F.abs(F.col("n_values") - target), "attribute")).alias("attribute"))


def fingerprint(rows: DataFrame, value: str) -> DataFrame:
    """One number for a set of strings, whatever their order: the exclusive or of 32 bits of their digests."""
    return rows.agg(F.bit_xor(F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def attribute_names(tokens: DataFrame) -> DataFrame:
    return tokens.select(F.explode(F.map_keys("features")).alias("name")).distinct()


def shifted(flags: DataFrame, column: str, by: int) -> Column:
    """The flag of the token ``by`` places before (after, if negative) in the same sentence; false beyond its ends."""
    w = Window.partitionBy("doc_id", "sid").orderBy("tid")
    return F.lag(column, by, False).over(w) if by >= 0 else F.lead(column, -by, False).over(w)


def shifted_in(flags: Column, by: int) -> Column:
    """The same on a sentence's own array of flags, without a shuffle."""
    beyond = F.array_repeat(F.lit(False), abs(by))
    return F.slice(F.concat(beyond, flags), F.lit(1), F.size(flags)) if by >= 0 else F.slice(F.concat(flags, beyond), F.lit(1 - by), F.size(flags))
