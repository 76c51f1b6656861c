"""S1-S4 round trips and the XML edge table."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from quire.operators.patients import patient_documents
from quire.sources.articles import read_articles, read_articles_quarantined
from quire.sources.codes import read_code_table
from quire.sources.notes import read_notes
from quire.sources.patients import read_patients

NOTES_CSV = (
    'note_id,subject_id,hadm_id,note_type,text\n'
    '1,S1,H1,DS,"He said ""hi"", then left.\nSecond   line"\n'
    '2,S2,H2,DS,NA\n'
    '3,S3,H3,DS,null\n'
    '4,S4,H4,DS,None\n'
    '5,S5,H5,DS,\n'
    '6,S6,H6,DS," NA "\n'
    '7,S7,H7,DS,"a, b ,c"\n'
)


def test_notes_csv_quotes_newlines_na(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "discharge.csv.gz")
    with gzip.open(p, "wt", encoding="utf-8") as f:
        f.write(NOTES_CSV)
    df = read_notes(spark, p, "discharge")
    assert set(df.columns) == {"doc_id", "clinical_text", "source", "file", "row"}  # metadata dropped (P1)
    got = {r.doc_id: r.clinical_text for r in df.collect()}
    assert got == {1: 'He said "hi", then left. Second line', 2: None, 3: None, 4: None,
                   5: None, 6: "NA", 7: "a, b ,c"}
    raw = {r.doc_id: r.clinical_text for r in read_notes(spark, p, "d", clean=False).collect()}
    assert raw[1] == 'He said "hi", then left.\nSecond   line' and raw[6] == " NA "


def test_files_of_one_source_keep_their_own_headers(spark, tmpdir_path):
    for name, body in (("a.csv", 'note_id,subject_id,text\n7,S7,seven\n007,S8,"double, oh\nseven"\n'),
                       ("b.csv", 'subject_id,text,note_id\nS9,nine,77\n'), ("c.csv", 'text\nfirst\nsecond\n')):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(body)
    rows = read_notes(spark, tmpdir_path, "notes").collect()
    by = {r.clinical_text: r for r in rows}
    assert set(by) == {"seven", "double, oh seven", "nine", "first", "second"}
    assert by["seven"].doc_id == 7 and by["nine"].doc_id == 77 and len({r.doc_id for r in rows}) == 5
    assert [by[t].row for t in ("seven", "double, oh seven", "nine", "first", "second")] == [0, 1, 0, 0, 1]
    with open(os.path.join(tmpdir_path, "d.csv"), "w") as f:
        f.write("note_id,body\n1,x\n")
    with pytest.raises(Exception, match="no column 'text'"):
        read_notes(spark, tmpdir_path, "notes").collect()


def test_codes_of_two_versions_and_leading_zeros(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "icd.csv")
    with open(p, "w") as f:
        f.write("version,code,text\n9,10,a\n9,010,b\n10,10,c\n")
    assert sorted(r.code_key for r in read_code_table(spark, p, "diagnosis").collect()) == ["10:10", "9:010", "9:10"]


def test_code_table_copies_text(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "icd.csv")
    with open(p, "w") as f:
        f.write('version,code,description,text\n9,250.00,Diabetes,"ICD 9 code for 250.00: Diabetes"\n'
                '10,17,"Two  spaces","ICD 10 code for 17: Two  spaces"\n9,1,x,NA\n')
    rows = read_code_table(spark, p, "diagnosis").collect()
    texts = sorted((r.clinical_text or "<null>") for r in rows)
    assert texts == ["<null>", "ICD 10 code for 17: Two  spaces", "ICD 9 code for 250.00: Diabetes"]
    assert len({r.doc_id for r in rows}) == 3


XML = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE PubmedArticleSet>
<!-- header comment -->
<PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">1</PMID><Article>
  <ArticleTitle>Plain title</ArticleTitle>
  <Abstract><AbstractText>First.</AbstractText><AbstractText Label="R">  Second  </AbstractText></Abstract>
</Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>2</PMID><Article>
  <ArticleTitle>Mixed <i>inline</i> tail</ArticleTitle>
  <Abstract><AbstractText><b>x</b>child first</AbstractText><AbstractText>caf&#233; &amp; co</AbstractText></Abstract>
  <OtherAbstract><AbstractText>excluded</AbstractText></OtherAbstract>
</Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>3</PMID><Article>
  <ArticleTitle></ArticleTitle>
  <Abstract><AbstractText>   </AbstractText><AbstractText>   </AbstractText></Abstract>
</Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>4</PMID><Article>
  <ArticleTitle>   </ArticleTitle>
  <Abstract><AbstractText>only abstract</AbstractText></Abstract>
</Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>5</PMID><Article>
  <ArticleTitle><!-- c -->after comment</ArticleTitle>
</Article></MedlineCitation></PubmedArticle>
<PubmedBookArticle><BookDocument><PMID>6</PMID><ArticleTitle>Book</ArticleTitle></BookDocument></PubmedBookArticle>
<PubmedArticle><MedlineCitation><PMID>7</PMID><Article>
  <ArticleTitle>ab<![CDATA[cd]]>ef</ArticleTitle>
</Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>
"""

EXPECTED = {1: "Plain title First. Second", 2: "Mixed café & co", 3: " ", 4: "only abstract"}


@pytest.mark.parametrize("parser", ["python", "xpath"])
def test_article_xml_edges(spark, tmpdir_path, parser):
    p = os.path.join(tmpdir_path, "a.xml")
    with open(p, "w") as f:
        f.write(XML)
    got = {r.doc_id: r.clinical_text for r in read_articles(spark, p, parser=parser).collect()}
    cdata = got.pop(7)
    assert got == EXPECTED   # 5 (title after a comment) and 6 (book) excluded
    assert cdata == ("abcdef" if parser == "python" else "ab")


def test_article_gz_and_split_files(spark, tmpdir_path):
    def recs(base):
        return "".join(f"<PubmedArticle><PMID>{base + i}</PMID><ArticleTitle>t{i}</ArticleTitle>"
                       f"</PubmedArticle>\n" for i in range(3000))
    with gzip.open(os.path.join(tmpdir_path, "a.xml.gz"), "wt") as f:
        f.write(recs(0))
    with open(os.path.join(tmpdir_path, "b.xml"), "w") as f:
        f.write(recs(100000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_articles(spark, tmpdir_path + "/*")
        assert df.count() == 6000 and df.select("doc_id").distinct().count() == 6000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_malformed_record_strict_and_quarantine(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "bad.xml")
    with open(p, "w") as f:
        f.write("<PubmedArticle><PMID>1</PMID><ArticleTitle>ok</ArticleTitle></PubmedArticle>\n"
                "<PubmedArticle><PMID>2</PMID><ArticleTitle>broken<b></ArticleTitle></PubmedArticle>\n")
    good, errors = read_articles_quarantined(spark, p)
    assert [r.doc_id for r in good.collect()] == [1]
    assert [("<PMID>2<" in r.xml, "mismatched" in r.error) for r in errors.collect()] == [(True, True)]
    with pytest.raises(Exception):
        read_articles(spark, p).collect()


def test_patients_object_layout(spark, tmpdir_path):
    data = {
        "p1": {"arrival": "A. ", "triage": "T. ", "codes": None, "vitals": "V. ", "pyxis": None,
               "medrecon": "M. ", "eddischarge": "ADMITTED to ward", "admission": "x",
               "discharge": "y", "eddischarge_category": "z"},
        "p2": {"arrival": None, "triage": "T2. ", "eddischarge": "Home"},
        "p3": {"arrival": "A3. ", "triage": "T3. ", "eddischarge": None},
    }
    p = os.path.join(tmpdir_path, "patients.json")
    with open(p, "w") as f:
        json.dump(data, f)
    df = patient_documents(read_patients(spark, p, layout="object"))
    assert df.columns == ["patient_id", "info", "eddischarge"]
    got = {r.patient_id: (r.info, r.eddischarge) for r in df.collect()}
    assert got["p1"] == ("A. The patient received no diagnostic codesT. V. "
                         "The patient did not receive any medications.M. ", 1)
    assert got["p2"] == (None, 0)          # null arrival -> null info
    assert got["p3"][1] == 0               # null disposition -> 0
    assert got["p3"][0].startswith("A3. The patient received no diagnostic codesT3. ")


def test_string_note_ids_get_stable_keys(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "n.csv")
    with open(p, "w") as f:
        f.write('note_id,text\n10000032-DS-21,"a"\n10000032-DS-22,"b"\n7,"c"\n')
    ids = {r.clinical_text: r.doc_id for r in read_notes(spark, p, "d").collect()}
    again = {r.clinical_text: r.doc_id for r in read_notes(spark, p, "d").collect()}
    assert ids == again and ids["c"] == 7 and None not in ids.values() and len(set(ids.values())) == 3
