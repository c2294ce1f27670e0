"""Tagged sentences as XML, plain and told in two languages."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import tags
from corpusloom.operators import render

DDL = "doc_id long, sid long, tid int, form string, lemma string, postag string, extra string, start int"


@pytest.mark.parametrize("language", [None, "en", "ro"])
def test_words_and_what_their_tags_say(spark, language):
    rows = [(1, 0, 1, 'a"<b>&', "l&", "Ncms", "x|y", 9), (1, 0, 0, "Om", "om", "Np", None, 4), (1, 1, 0, None, None, None, None, None), (1, 2, 0, "știe", "ști", "Vmip3s", None, 20)]
    got = {r.sid: r.xml for r in render.tagged_xml(spark.createDataFrame(rows, DDL), language).collect()}
    first = ET.fromstring(got[0])
    assert first.attrib == {"id": "0", "offset": "4"} and [w.text for w in first] == ["Om", 'a"<b>&']
    assert {k: first[1].attrib[k] for k in ("LEMMA", "MSD", "EXTRA", "offset")} == {"LEMMA": "l&", "MSD": "Ncms", "EXTRA": "x|y", "offset": "9"} and "EXTRA" not in first[0].attrib
    assert got[1] == '<S id="1"><W></W></S>'
    said = {k: v for k, v in ET.fromstring(got[2])[0].attrib.items() if k not in ("LEMMA", "MSD", "offset")}
    assert said == {None: {}, "en": {"Mood": "indicative", "Number": "singular", "POS": "VERB", "Person": "third", "Tense": "present", "Type": "predicative"},
                    "ro": {"Mod": "indicativ", "Număr": "singular", "POS": "Verb", "Persoana": "a treia", "Timp": "prezent", "Tip": "predicativ"}}[language]


def test_without_the_optional_columns(spark):
    rows = spark.createDataFrame([(1, 0, 0, "a", "a", "Nc"), (1, 0, 0, "a", "a", "Nc")], "doc_id long, sid long, tid int, form string, lemma string, postag string")
    assert render.tagged_xml(rows).first().xml == '<S id="0"><W LEMMA="a" MSD="Nc">a</W><W LEMMA="a" MSD="Nc">a</W></S>'
    assert render.tagged_xml(rows.limit(0)).collect() == []


def test_words_tell_all_that_tags_say_without_sorting(spark):
    kinds = ["Vmip3s----y", "Afpmsrn", "Ncfpvy", "Ncfpry", "Pp3fsr--s", "Np", "N", "NC", "Zx", "", "Qz-y", "X", None]
    rows = [(1, k, 0, 'a"<', None if k == 0 else "b&", t, None, None) for k, t in enumerate(kinds)]
    for language in tags.LANGUAGES:
        made = render.tagged_xml(spark.createDataFrame(rows, DDL), language)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "map_from_entries" not in plan and "array_sort" not in plan
        said = spark.createDataFrame([(k, t) for k, t in enumerate(kinds)], "sid long, tag string").select("sid", "tag", tags.described(F.col("tag"), language).alias("m")).collect()
        got = {r.sid: r.xml for r in made.collect()}
        for r in said:
            named = {**(r.m or {}), **({} if r.sid == 0 else {"LEMMA": "b&amp;"})}
            assert got[r.sid] == f'<S id="{r.sid}"><W' + "".join(f' {k}="{named[k]}"' for k in sorted(named)) + '>a&quot;&lt;</W></S>'
