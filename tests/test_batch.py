"""A folder of files in, one output a file."""

import xml.etree.ElementTree as ET

from corpusloom.plans import grammar as G
from corpusloom.sources import batch


def test_each_file_keeps_its_name(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, words in (("a.xml", ["the", "dog", "ran"]), ("b c.xml", ["the", "cat"]), ("none.xml", ["it", "rains"])):
        tokens = "".join(f'<W LEMMA="{w}" MSD="{"D" if w == "the" else "N"}">{w}</W>' for w in words)
        (folder / name).write_text(f"<D><S>{tokens}</S><S>{tokens}</S></D>")
    (folder / "broken.xml").write_text("<D><S><W>x</S>")
    phrase = G.Grammar({"Main": G.sequence(("<+WORD=the>", '<NP +type="d"'), ("<+MSD=N>", "<HEAD>"), ("<E>", ">"))})
    found = batch.annotated_files(spark, f"file://{folder}", phrase, "S").cache()
    rows = {r.name.replace("%20", " "): r for r in found.collect()}
    assert set(rows) == {"a.xml", "b c.xml", "none.xml", "broken.xml"} and rows["broken.xml"].xml is None and rows["broken.xml"].error
    shape = lambda n: [[(x.tag, [w.text for w in x.iter("W")]) for x in s.iter() if x.tag not in ("S", "W")] for s in ET.fromstring(rows[n].xml).iter("S")]
    assert shape("a.xml") == [[("NP", ["the", "dog"]), ("HEAD", ["dog"])]] * 2 and shape("none.xml") == [[], []]
    batch.write_files(found, f"file://{tmp_path}/out")
    assert {p.name for p in (tmp_path / "out").glob("name=*")} == {f"name={n}" for n in ("a.xml", "b c.xml", "none.xml")} or len(list((tmp_path / "out").glob("name=*"))) == 3
    assert spark.read.text(f"file://{tmp_path}/out").where("name = 'a.xml'").count() >= 1 and spark.read.json(f"file://{tmp_path}/out_errors").count() == 1
