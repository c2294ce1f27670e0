"""Column layouts of an annotated corpus: four tables keyed by (doc_id, sid)."""

SENTENCES = "doc_id long, sid long, first_tok long, n_tok int, features map<string,string>"
TOKENS = "doc_id long, sid long, tid int, gtid long, char_start int, char_end int, form string, lemma string, postag string, features map<string,string>"
#: ``start`` and ``end`` are token numbers in the sentence, both inclusive.
SPANS = "doc_id long, sid long, span_id long, name string, start int, end int, features map<string,string>, prefer_inline boolean"
LEXICON = "word string, msd string, lemma string, extra string"
#: Names and roles of the ten columns of a CoNLL-U line (fixed values).
CONLLU = ["id", "form", "lemma", "upostag", "xpostag", "feats", "head", "deprel", "deps", "misc"]
