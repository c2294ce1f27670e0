"""Secret scans by multipart credential linking (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# The patterns of the base kinds. The last group of ``assign`` holds its value. Runs of
# ``access`` and ``hex`` are bounded below in the pattern itself: a run that is too short for it
# has no longer run inside, so this equals matching all runs and dropping the short ones.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Weak parts, each too common to report alone.
#: An access identifier: a short upper-case code with a digit after a word that names one.
WEAK_ID = r"(?:(?:[Aa]ccess|[Cc]lient|[Uu]ser|[Aa]ccount|ACCESS|CLIENT)[_ -]?(?:[Kk]ey[_ -]?)?(?:[Ii][Dd]|[Nn]ame|KEY)|[Ll]ogin)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}"
#: A secret: a run of 20 or more characters that mixes cases and digits.
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}"
#: An endpoint: an address with a scheme, or host and port.
ENDPOINT = r"(?:[a-z][a-z0-9+]{1,9}://[^\s\"'<>]{4,}|(?<![A-Za-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}(?![0-9]))"
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, WEAK_ID, WEAK_SECRET, ENDPOINT), strict=True))

_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def spans_of(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Spans of all leftmost matches, in code points: gaps between matches and their lengths add up.

    ``keep``: an array of booleans, one for each match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    widths = F.transform(found, lambda m: F.length(m).cast("bigint"))
    kept = F.transform(found, lambda m: F.lit(True)) if keep is None else keep
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + x["width"]
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["kept"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), widths.alias("width"), kept.alias("kept"))
    # Texts without a match, most of them, skip the array work.
    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(zipped, state, step)["spans"]).otherwise(F.array().cast(_SPANS))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and, for each kind, the spans of its matches in the whole text."""
    text = F.coalesce("text", F.lit(""))
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)
    columns = [spans_of(text, PATTERNS[k], n, long_enough if k == "assign" else None).alias(f"sc_{k}") for n, k in enumerate(KINDS)]
    return docs.select("doc_id", *columns)


def link_credentials(docs: DataFrame, scope: int = 400) -> DataFrame:
    """``doc_id, base, linked``: the strong spans of each text, and the weak ones that are linked.

    ``base`` holds (start, kind, end) of assignments, access keys and hex runs. Weak parts are
    identifiers, secrets and endpoints; ``linked`` holds each weak part that has a part of
    another role within its scope, the ``scope`` code points before and after it: a weak secret needs an
    identifier (weak, or an access key) or an endpoint, a weak identifier or endpoint needs a
    secret (weak, an assignment or a hex run). Parts that overlap do not give evidence for each other.

    The scopes are joined as intervals: each part opens an interval around itself, both sides are
    cut to all bins of the scope's length that they touch, and a semi join by document and bin keeps a part once
    however many partners it has; no pairs come out. Only parts of texts that hold a weak part
    are shuffled, and none holds text.

    A null text is an empty one. Rows count one by one, also with equal or null doc_id. Very long
    texts are scanned whole. No rows give no rows.
    """
    found = stage(scan(docs).withColumn("sc_row", F.monotonically_increasing_id()))
    base = F.array_sort(F.concat("sc_assign", "sc_access", "sc_hex"))
    weak = F.concat("sc_id", "sc_secret", "sc_endpoint")
    both = found.where(F.size(weak) > 0).select("sc_row", F.explode(F.concat(base, weak)).alias("p")).select("sc_row", "p.*")
    secretive = F.col("kind").isin(KINDS.index("assign"), KINDS.index("hex"), KINDS.index("secret"))
    named = F.col("kind").isin(KINDS.index("access"), KINDS.index("id"), KINDS.index("endpoint"))
    # A weak secret is not its own partner where an assignment covers it.
    parts = both.withColumn("secretive", secretive).withColumn("named", named)
    bins = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    asking = parts.where(F.col("kind") >= 3).withColumn("bin", F.explode(bins)).alias("a")
    giving = parts.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)))).alias("b")
    near = (F.col("b.start") < F.col("a.end") + scope) & (F.col("b.end") > F.col("a.start") - scope)
    other = (F.col("a.secretive") & F.col("b.named")) | (F.col("a.named") & F.col("b.secretive"))
    apart = (F.col("b.start") >= F.col("a.end")) | (F.col("b.end") <= F.col("a.start"))
    match = (F.col("a.sc_row") == F.col("b.sc_row")) & (F.col("a.bin") == F.col("b.bin")) & near & other & apart
    kept = asking.join(giving, match, "left_semi").select("sc_row", "start", "kind", "end").distinct()
    linked = kept.groupBy("sc_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))
    return found.withColumn("base", base).join(linked, "sc_row", "left").select(
        "doc_id", "base", F.coalesce("linked", F.array().cast(_SPANS)).alias("linked"),
    )


def digest(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
