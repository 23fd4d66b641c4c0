import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lantern.sources import files
from lantern.sources.encodings import decoded, detect, like_text

TEXTS = {
    "gb18030": "中华人民共和国民法典第一条为了保护民事主体的合法权益，调整民事关系，维护社会和经济秩序。",
    "big5": "為了保護民事主體的合法權益，調整民事關係，維護社會和經濟秩序，適應中國特色社會主義發展要求。",
    "shift_jis": "これは日本語の文章です。カタカナとひらがなが入っています、漢字もあります。",
    "euc_kr": "모든 국민은 인간으로서의 존엄과 가치를 가지며 행복을 추구할 권리를 가진다.",
    "cp1251": "Все люди рождаются свободными и равными в своём достоинстве и правах.",
    "koi8_r": "Все люди рождаются свободными и равными в своём достоинстве и правах.",
    "cp1252": "Être né libre, après l'été, où ça? Für die Größe müßte man schön übersetzen.",
    "utf-8": "Être né libre 中华 これ",
    "utf-16": "Être né libre 中华 これ",
    "utf-8-sig": "plain é",
}


@pytest.mark.parametrize("codec", TEXTS)
def test_each_encoding_is_told_apart(codec):
    assert detect(TEXTS[codec].encode(codec)) == codec
    assert detect((TEXTS[codec] * 50).encode(codec)) == codec


WESTERN = (
    "Euxvi, ççpa. Aiauxan éle éêè ai de.", "De anque re éè en auxrepa que oureque, auxqueque la enç.", "ÑÑUEAR!! RRAR!! ÑASCI!! CIÓNÓOS!! ADOQUETA!!",
    "loweiig Te auunger von ö beberte.", "La é, é, é, é, é, la et.", "Of erlysh er thedtion esou èê, thnth atlyre.", "un Çèen de la",
)


@pytest.mark.parametrize("text", WESTERN)
def test_accented_letters_that_stand_alone_or_together_stay_western(text):
    assert detect(text.encode("cp1252")) == "cp1252"


SHORT = ("Anaieux éé èçou éç ê.lisr", "le éç. éé", "Üä Üä Üä Üä", "Éç Éç Éç Éç Éç", "ñ ñ ñ ñ ñ ñ", "èéê la ê", "une une çè è", "Íí Íí Íí jallie jallie", "Licensed.\nÈèç Èèç Èèç Èèç")


@pytest.mark.parametrize("text", SHORT)
def test_few_accented_letters_are_no_proof_of_another_script(text):
    assert detect(text.encode("cp1252")) == "cp1252"


@pytest.mark.parametrize("codec,text", [("cp1251", "и суд решил"), ("koi8_r", "решение суда"), ("gb18030", "合同生效"), ("big5", "今天天氣"), ("shift_jis", "東京です"), ("euc_kr", "서울에 살고"), ("gb18030", "the contract 合同自双方签字之日起生效 of both")])
def test_a_few_words_of_other_scripts_are_enough(codec, text):
    assert detect(text.encode(codec)) == codec


@pytest.mark.parametrize("codec,text", [("cp1251", "The word привет means hello in Russian"), ("koi8_r", "п. 5 и ст. 6 закона о правах")])
def test_words_of_other_letters_among_latin_ones_are_still_found(codec, text):
    assert detect(text.encode(codec)) == codec


def test_columns_nulls_and_empty_files(spark):
    rows = [(k, v.encode(k)) for k, v in TEXTS.items()] + [("none", None), ("empty", b"")]
    got = {r["k"]: (r["x"]["codec"], r["x"]["text"]) for r in spark.createDataFrame(rows, "k string, c binary").select("k", decoded("c").alias("x")).collect() if r["x"] is not None}
    assert all(got[k] == (k, v) for k, v in TEXTS.items()) and got["empty"] == ("utf-8", "") and got.get("none", (None, None)) == (None, None)


def test_what_is_like_text(spark):
    rows = [("gbk", "论语有云".encode("gbk") + b"\xd0\x0a"), ("nul", b"text with \x00 inside"), ("late nul", b"x" * 10_000 + b"\x00"), ("control", b"\x01\x02abc"), ("few", b"\x01" + b"a" * 20), ("lines", b"a\tb\r\n\x0c")]
    got = {r["k"]: r["t"] for r in spark.createDataFrame(rows, "k string, c binary").select("k", like_text(F.col("c")).alias("t")).collect()}
    assert got == {"gbk": True, "nul": False, "late nul": False, "control": False, "few": True, "lines": True}


def test_nested_tables_are_said_once():
    cell = lambda x: f"<w:tc>{x}</w:tc>"
    word = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    inner = f"<w:tbl><w:tr>{cell(word('in'))}</w:tr></w:tbl>"
    xml = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:tbl><w:tr>{cell(word("out") + inner)}{cell(word("b"))}</w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    assert files.docx_paragraphs(out.getvalue()) == ["<table><tr><td>outin</td><td>b</td></tr></table>"]
