"""Encodings without a mark: each text alone, a sentence long."""

import pytest
from lexforest.sources import charsets

RUSSIAN = "Сегодня утром мы вышли из дома и пошли к реке, где нас ждали друзья."
CHINESE = "今天早上我们从家里出来，到河边去见朋友。他们说天气很好，可以一起走路。"
TAIWAN = "今天早上我們從家裡出來，到河邊去見朋友。他們說天氣很好，可以一起走路。"
JAPANESE = "今日の朝、私たちは家を出て川へ行きました。友だちがそこで待っていました。"
KOREAN = "오늘 아침에 우리는 집을 나와 강으로 갔습니다. 친구들이 거기에서 기다리고 있었습니다."
LABELLED = [
    ("cp1252", "Größe und Maß sind für die Prüfung wichtig, sagte das Mädchen."),
    ("cp1252", "L'été dernier, nous avons mangé des crêpes près de la forêt."),
    ("cp1252", "El niño comió una manzana y después salió con su mamá."),
    ("cp1250", "Zażółć gęślą jaźń, powiedział chłopiec i poszedł spać."),
    ("cp1250", "Příliš žluťoučký kůň úpěl ďábelské ódy."),
    ("cp1254", "Bugün hava çok güzel, arkadaşlarımla dışarı çıkıyoruz."),
    *((e, RUSSIAN) for e in ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")),
    ("koi8_u", "Сьогодні вранці ми вийшли з дому і пішли до річки, де нас чекали друзі."),
    ("cp1253", "Σήμερα το πρωί βγήκαμε από το σπίτι και πήγαμε στο ποτάμι."),
    ("gb18030", CHINESE), ("big5", TAIWAN), ("cp932", JAPANESE), ("euc_jp", JAPANESE), ("cp949", KOREAN),
    *((e, t) for e in ("utf_16_le", "utf_16_be") for t in ("Plain words only.", "Größe und Maß", RUSSIAN, CHINESE, TAIWAN, JAPANESE, KOREAN)),
]


@pytest.mark.parametrize(("encoding", "text"), LABELLED)
def test_each_text_alone(encoding, text):
    assert charsets.decode(text.encode(encoding)) == text


def test_marks_utf8_and_edges():
    assert charsets.decode(b"") == "" and charsets.decode(b"plain") == "plain"
    assert charsets.decode("Größe".encode()) == "Größe" and charsets.decode("Größe".encode("utf-8-sig")) == "Größe"
    assert charsets.decode("Größe".encode("utf-16")) == "Größe"
    assert charsets.decode(b"a\x00long text with one zero byte") == "a\x00long text with one zero byte"
    long = RUSSIAN * 20000
    assert charsets.decode(long.encode("koi8_r")) == long
    assert isinstance(charsets.decode(bytes(range(256))), str)
