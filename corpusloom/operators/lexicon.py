"""Dictionary operators: ``word, msd, lemma, extra`` entries joined to tokens."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def with_stripped(entries: DataFrame, twins: bool = True) -> DataFrame:
    """Entries under their canonical word, and a twin without diacritics for each that has some (``is_stripped``); without ``twins`` where ``policy`` would drop them anyway."""
    keyed = entries.withColumn("word_key", T.canonical_word(F.col("word"))).withColumn("is_stripped", F.lit(False))
    if not twins:
        return keyed.dropDuplicates(["word_key", "word", "msd", "lemma"])
    bare = keyed.withColumn("word", T.stripped_diacritics(F.col("word"))).withColumn("word_key", T.stripped_diacritics(F.col("word_key"))).withColumn("is_stripped", F.lit(True))
    twins = bare.join(keyed.select("word_key", "msd", "lemma"), ["word_key", "msd", "lemma"], "left_anti")
    return keyed.unionByName(twins).dropDuplicates(["word_key", "word", "msd", "lemma"])


def policy(lexicon: DataFrame, diacritics: str = "never_stripped") -> DataFrame:
    """``only_stripped``, ``never_stripped`` or ``both``."""
    return lexicon if diacritics == "both" else lexicon.where(F.col("is_stripped") == (diacritics == "only_stripped"))


def looked_up(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens with their entries, by canonical word, else by the word without hyphens; unknown ones have a null ``msd``.

    The two keys of a token are joined in one pass and the better one's entries kept, so the tokens are shuffled
    once at most; Spark broadcasts the lexicon where it measures it as small.
    """
    key = T.canonical_word(F.col("form"))
    entries = lexicon.groupBy("word_key").agg(F.array_sort(F.collect_set(F.struct("msd", "lemma"))).alias("entries"))
    second = entries.withColumnsRenamed({"word_key": "second_key", "entries": "second"})
    bare = F.when(F.instr("form", "-") > 0, F.regexp_replace(key, "-", ""))
    # Words without a second key (nearly all) meet nothing under their first one: under a null they would all go to one task.
    asked = tokens.withColumn("word_key", key).withColumn("bare", bare).withColumn("asked_key", F.coalesce("bare", "word_key"))
    met = (F.col("asked_key") == F.col("second_key")) & F.col("bare").isNotNull()
    found = asked.join(entries, "word_key", "left").join(second, met, "left")
    return found.withColumn("entries", F.coalesce("entries", "second")).drop("second", "second_key", "word_key", "asked_key", "bare")


def most_frequent_lemma(candidates: DataFrame, frequency: DataFrame, keys: list[str]) -> DataFrame:
    """One lemma for each group: that of the highest frequency, ties by name; lemmas without one count as -100."""
    known = candidates.join(frequency, "lemma", "left").withColumn("freq", F.coalesce("freq", F.lit(-100)))
    best = F.min(F.struct((-F.col("freq")).alias("order"), "lemma"))
    return known.groupBy(*keys).agg(best.alias("m")).select(*keys, F.col("m.lemma").alias("lemma"))


def invalid_tags(entries: DataFrame, tagset: DataFrame) -> DataFrame:
    """``msd, n``: tags that the tagset does not have, with their entries' number."""
    return entries.join(tagset, "msd", "left_anti").groupBy("msd").agg(F.count(F.lit(1)).alias("n"))


#: A set of tags holds no more; beyond it something else was given.
MOST_TAGS = 20_000


def best_tags(tags: DataFrame, tagset: DataFrame) -> DataFrame:
    """``msd, best``: for each distinct tag the tag of the set that fits best, ties by name.

    Tags with the same first place are compared, since one that differs there scores less than any that does not; a tag
    whose first place no tag of the set has is compared with them all. Both sides are distinct tags; a set of more than ``MOST_TAGS`` is an error.
    """
    head = lambda t: F.left(T.comparable_tag(F.col(t)), F.lit(1))
    asked = tags.select("msd").distinct().withColumn("head", head("msd"))
    known = tagset.select(F.col("msd").alias("tag")).distinct().withColumn("head", head("tag"))
    score = T.tag_score(F.col("msd"), F.col("tag")).alias("score")
    alike = asked.join(known, "head").select("msd", "tag", score)
    if (n := known.limit(MOST_TAGS + 1).count()) > MOST_TAGS:
        raise ValueError(f"a set of {n} tags or more")
    alone = asked.join(known, "head", "left_anti").crossJoin(F.broadcast(known.select("tag"))).select("msd", "tag", score)
    scored = alike.unionByName(alone).groupBy("msd").agg(F.min(F.struct((-F.col("score")).alias("order"), "tag")).alias("m"))
    return scored.select("msd", F.col("m.tag").alias("best"))


def corrected_tags(rows: DataFrame, lexicon: DataFrame, tagset: DataFrame) -> DataFrame:
    """``word, msd, corrected`` of each distinct ``word, msd``: the word's own tag that equals it but for case; else M for digits; else
    the best of the word's tags, or for an unknown word of the whole set."""
    asked = rows.select("word", "msd").distinct().withColumn("word_key", T.canonical_word(F.col("word")))
    held = lexicon.select("word_key", F.col("msd").alias("tag")).distinct()
    own = asked.join(held, "word_key").withColumn("score", T.tag_score(F.col("msd"), F.col("tag")))
    same = F.min(F.when(F.lower("tag") == F.lower("msd"), F.col("tag"))).alias("same")
    chosen = own.groupBy("word", "msd").agg(same, F.min(F.struct((-F.col("score")).alias("order"), "tag")).alias("m"))
    open_tags = best_tags(asked.join(held, "word_key", "left_anti"), tagset)
    found = asked.join(chosen, ["word", "msd"], "left").join(open_tags, "msd", "left")
    digits = F.when(F.col("word_key").rlike(r"\A[0-9]+\z"), "M")
    return found.select("word", "msd", F.coalesce("same", digits, F.col("m.tag"), "best").alias("corrected"))


def negated_verbs(entries: DataFrame, prefix: str = "ne") -> DataFrame:
    """Entries whose word is the prefix and a known positive form with the same first three places of the tag."""
    positive = entries.select(F.col("word").alias("rest"), F.col("lemma").alias("positive_lemma"), F.left("msd", F.lit(3)).alias("head")).distinct()
    asked = entries.where(F.col("word").startswith(prefix)).withColumn("rest", F.substr("word", F.lit(len(prefix) + 1))).withColumn("head", F.left("msd", F.lit(3)))
    return asked.join(positive, ["rest", "head"]).drop("rest", "head")


def longest_units(tokens: DataFrame, units: tuple[str, ...]) -> DataFrame:
    """``doc_id, sid, tid, unit, n``: multiword units, from the left the longest at each place, going on after it.

    ``tokens`` is nested (``forms``), ``units`` a bounded list of keys of two or more tokens with a blank between. Each
    sentence is searched once, in its own row, by one expression of all units, the longest first.
    """
    longest = "|".join(re.escape(u) for u in sorted({u.lower() for u in units}, key=lambda u: (-u.count(" "), u)))
    joined = tokens.select("doc_id", "sid", F.concat(F.lit(" "), F.lower(F.array_join("forms", " ")), F.lit(" ")).alias("line"))
    parts = joined.select("doc_id", "sid", F.split(F.regexp_replace("line", f"(?<= )(?:{longest})(?= )", "\uf8ff$0\uf8ff"), "\uf8ff").alias("parts"))
    opened = parts.where(F.size("parts") > 1).select("doc_id", "sid", "parts", F.posexplode("parts").alias("k", "unit")).where("k % 2 = 1")
    # Each token before a unit ends with a blank; the line begins with one.
    before = F.array_join(F.slice("parts", F.lit(1), F.col("k")), "")
    tid = (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))) - 1).alias("tid")
    return opened.select("doc_id", "sid", tid, "unit", (F.length("unit") - F.length(F.replace("unit", F.lit(" "), F.lit(""))) + 1).alias("n"))


ENTRY = ["word", "msd", "lemma"]


def contained(entries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Entries that the dictionary has, by word, tag and lemma."""
    return entries.join(dictionary.select(ENTRY).distinct(), ENTRY, "left_semi")


def missing(entries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Distinct entries whose tag and cleaned lemma the dictionary does not have."""
    key = lambda: F.lower(T.corrected_diacritics(F.col("lemma")))
    known = dictionary.select("msd", key().alias("lemma_key")).distinct()
    return entries.withColumn("lemma_key", key()).join(known, ["msd", "lemma_key"], "left_anti").drop("lemma_key").distinct()


def removed(lexicon: DataFrame, entries: DataFrame) -> DataFrame:
    """A lexicon (``with_stripped``) without the given entries and their twins."""
    own = entries.select(T.canonical_word(F.col("word")).alias("word_key"), "msd", "lemma")
    twins = own.withColumn("word_key", T.stripped_diacritics(F.col("word_key")))
    gone = own.withColumn("is_stripped", F.lit(False)).unionByName(twins.withColumn("is_stripped", F.lit(True))).distinct()
    return lexicon.join(gone, ["word_key", "msd", "lemma", "is_stripped"], "left_anti")


def by_lemma(entries: DataFrame) -> DataFrame:
    """``lemma, forms``: the distinct forms and tags of each lemma, in order."""
    return entries.groupBy("lemma").agg(F.array_sort(F.collect_set(F.struct("word", "msd"))).alias("forms"))


def value_lists(entries: DataFrame) -> DataFrame:
    """``list, value``: the distinct tags, lemmas, extras and abbreviations (words tagged Y)."""
    each = F.array(
        F.struct(F.lit("msd").alias("list"), F.col("msd").alias("value")), F.struct(F.lit("lemma").alias("list"), F.col("lemma").alias("value")),
        F.struct(F.lit("extra").alias("list"), F.col("extra").alias("value")), F.struct(F.lit("abbreviation").alias("list"), F.when(F.col("msd").startswith("Y"), F.col("word")).alias("value")),
    )
    return entries.select(F.explode(each).alias("e")).select("e.*").where("value IS NOT NULL").distinct()


def sure_heads(entries: DataFrame) -> DataFrame:
    """``word, head``: the first two places of a word's tag where all its entries agree on them."""
    heads = entries.groupBy("word").agg(F.min(F.left("msd", F.lit(2))).alias("head"), F.max(F.left("msd", F.lit(2))).alias("other"))
    return heads.where("head = other").select("word", "head")


def abbreviated(tokens: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Tokens that are abbreviations (``word``), as they are or without a full stop at the end."""
    known = abbreviations.select(T.canonical_word(F.col("word")).alias("key")).distinct()
    whole = T.canonical_word(F.col("form"))
    # Only a form that ends with a full stop has a second key.
    stopped = F.array_distinct(F.array(whole, T.canonical_word(F.regexp_replace("form", r"\.$", ""))))
    keys = F.when(F.col("form").rlike(r"\.$"), stopped).otherwise(F.array(whole))
    return tokens.withColumn("key", F.explode(keys)).join(known, "key", "left_semi").drop("key").distinct()


def lemma_priorities(frequencies: DataFrame) -> DataFrame:
    """``lemma, freq``: the canonical lemma and a hundred times its frequency, cut to a whole number; of equal lemmas the highest."""
    whole = (F.lit(100).cast("float") * F.col("frequency").cast("float")).cast("int")
    return frequencies.groupBy(T.canonical_spelling(F.col("lemma")).alias("lemma")).agg(F.max(whole).alias("freq"))


def enriched(entries: DataFrame) -> DataFrame:
    """Entries and those that follow from them: participles and gerunds with -u, vocatives, and clitic forms of words with î."""
    word, msd, other = F.col("word"), F.col("msd"), F.col("lemma") != F.col("word")
    add = lambda w, m: F.struct(w.alias("word"), m.alias("msd"))
    stem = F.when(word.endswith("ă") | word.endswith("ie"), F.left(word, F.length(word) - 1)).otherwise(word)
    made = (
        F.when(msd.isin("Vmp", "Vmg"), add(F.concat(word, F.lit("u")), msd)).when(msd == "Ncfsrn", add(F.concat(stem, F.lit("o")), F.lit("Ncfsvy")))
        .when((msd == "Ncmsry") & other, add(F.concat(word, F.lit("e")), F.lit("Ncmsvy"))).when((msd == "Ncfpoy") & other, add(word, F.lit("Ncfpvy")))
        .when((msd == "Ncmpoy") & other, add(word, F.lit("Ncmpvy")))
    )
    more = entries.withColumn("made", made).where("made IS NOT NULL").withColumn("word", F.col("made.word")).withColumn("msd", F.col("made.msd")).drop("made")
    whole = entries.unionByName(more).distinct()
    clitic = whole.where((F.length("word") > 2) & F.col("word").startswith("î")).withColumn("word", F.concat(F.lit("-"), F.expr("substr(word, 2)")))
    return whole.unionByName(clitic).distinct()


#: What an adjective's tag becomes where it is a participle.
PARTICIPLES = {
    "Afpfsrn": "Vmp--sf----r", "Afpfprn": "Vmp--pf", "Afpmsrn": "Vmp--sm", "Afpmprn": "Vmp--pm",
    "Afpfson": "Vmp--sf----o", "Afpfpon": "Vmp--pf", "Afpmson": "Vmp--sm", "Afpmpon": "Vmp--pm",
}


def participles(entries: DataFrame, retag: bool = False) -> DataFrame:
    """Entries whose adjectives (Afp) are marked where their lemma has a form (Afpmsrn) that is also a participle (Vmp).

    The mark names the participle's lemma in ``extra``, once; with ``retag`` the entries take the participle's tag and lemma instead. Of several
    participles the least lemma counts. Other entries, and those with a null lemma, stay as they are.
    """
    verbs = entries.where(F.col("msd").startswith("Vmp")).groupBy("word").agg(F.min("lemma").alias("verb"))
    found = entries.where(F.col("msd").startswith("Afpmsrn")).join(verbs, "word").groupBy("lemma").agg(F.min("verb").alias("verb"))
    held = entries.join(found, "lemma", "left")
    if retag:
        tags = F.create_map(*(F.lit(x) for pair in PARTICIPLES.items() for x in pair))
        tag = F.when(F.col("verb").isNotNull(), F.try_element_at(tags, F.col("msd")))
        return held.withColumn("lemma", F.when(tag.isNotNull(), F.col("verb")).otherwise(F.col("lemma"))).withColumn("msd", F.coalesce(tag, "msd")).select(entries.columns)
    own = F.coalesce(F.trim("extra"), F.lit(""))
    mark = F.concat(own, F.when(own != "", "|").otherwise(""), F.lit("ParticipleLemma:"), F.col("verb"))
    wanted = F.col("verb").isNotNull() & F.col("msd").startswith("Afp") & ~own.contains("ParticipleLemma")
    return held.withColumn("extra", F.when(wanted, mark).otherwise(F.col("extra"))).select(entries.columns)
