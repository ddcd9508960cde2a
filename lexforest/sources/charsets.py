"""Encodings of texts without a mark, by likelihood.

A candidate is an encoding and a model of the writing that it serves. A text that the encoding's own rules cannot read
is out; of the others the one that makes the whole text likeliest wins. A model has kinds of characters, how likely one
kind follows another, and how likely a character is within its kind. Linear in the text; each text is decided alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

ASCII_LETTER, ASCII_OTHER, LOW, HIGH, MARK, STRANGE = range(6)

# Letters that no ASCII text has, the frequent ones first, and marks.
LETTERS = {
    "western": "éèàüäöáíóñçßêôåæøúîâûùëïœãõìòÿ",
    "central": "áíéěšžčřýůęąłóżćśńźúöüőűäťďňôľĺŕ",
    "turkish": "ışğüöçâîû",
    "russian": "оеаинтсрвлкмдпуяыгзбчйьжхшюцщэфъё",
    "ukrainian": "оанівиеткрслдмупяьзбйгхчцжюїєшщфґ",
    "greek": "αοιετσνηυρπκμλςδγθωάίόέήύώχφβξζψϊϋΐΰ",
}
MARKS = "’‘“”–—…«»„¿¡°€§№、。，；：？！「」『』（）《》・·〜ー　"
FREQUENT = {
    "simplified": "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可她里后小么心多天而能好都然没日于起还发成事只作当想看文无开手十用主行方又如前所本见经头面公同三已老从动两长",
    "traditional": "的一是不了人我在有他這中大來上國個到說們為子和你地出道也時年得就那要下以生會自著去之過家學對可她裡後小麼心多天而能好都然沒日於起還發成事只作當想看文無開手十用主行方又如前所本見經頭面公同三已老從動兩長",
    "korean": "이다의에는을가고하지은를로서도기사어나리자한대시있인아해그정일라수들으부장제보과여스게면전주조상원구유것만세치비성안우국오적모동소마않습니없",
}
JAPANESE_KANJI = "日一人年大中出本国時上会生事分者前行見私今何言"
#: Encodings in the order in which ties are decided.
ENCODINGS = {
    "cp1252": "western", "cp1250": "central", "iso8859_2": "central", "cp1254": "turkish", "cp1251": ("russian", "ukrainian"), "koi8_r": "russian", "koi8_u": "ukrainian",
    "cp866": "russian", "iso8859_5": "russian", "mac_cyrillic": "russian", "cp1253": "greek", "iso8859_7": "greek", "gb18030": "simplified", "big5": "traditional", "cp932": "japanese", "euc_jp": "japanese", "cp949": "korean",
    "utf_16_le": ("western", "central", "turkish", "russian", "ukrainian", "greek", "simplified", "traditional", "japanese", "korean"), "utf_16_be": ("western", "central", "turkish", "russian", "ukrainian", "greek", "simplified", "traditional", "japanese", "korean"),
}

# How likely a kind follows another, by row in the order of the kinds: letters among ASCII ones; an alphabet of its own; signs for words or syllables.
AMONG = ((.700, .200, .080, .002, .010, 1e-6), (.600, .300, .030, .020, .040, 1e-6), (.800, .150, .030, .001, .020, 1e-6), (.700, .100, .050, .080, .020, 1e-6), (.400, .400, .050, .050, .100, 1e-6), (.100, .100, .010, .010, .010, .100))
OWN = ((.700, .250, .002, .002, .010, 1e-6), (.050, .300, .400, .200, .040, 1e-6), (.001, .200, .780, .002, .015, 1e-6), (.005, .100, .600, .280, .010, 1e-6), (.050, .400, .200, .200, .100, 1e-6), (.010, .050, .010, .010, .010, .100))
SIGNS = ((.700, .200, .050, .005, .030, 1e-6), (.200, .300, .350, .030, .100, 1e-6), (.010, .050, .800, .050, .090, 1e-6), (.010, .050, .750, .050, .130, 1e-6), (.050, .100, .700, .050, .100, 1e-6), (.010, .050, .010, .010, .010, .100))


@dataclass(frozen=True)
class Model:
    kinds: np.ndarray  # of every code point below 2^16
    within: np.ndarray  # log of the share in its kind
    follows: np.ndarray  # log of the rows above

    def likelihood(self, text: str) -> float:
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
        kinds = self.kinds[codes]
        # a text begins as after a blank
        before = np.concatenate(([ASCII_OTHER], kinds[:-1]))
        return float(self.within[codes].sum(dtype=np.float64) + self.follows[before, kinds].sum(dtype=np.float64))


def _block(encoding: str, first: range, second: range) -> str:
    """Characters of a range of two-byte codes."""
    return "".join(bytes((a, b)).decode(encoding, "ignore") for a in first for b in second)


def _shares(*weighted: tuple[str, float]) -> dict[str, float]:
    """Character -> share: each string's characters share its weight, one in several strings has the sum."""
    out: dict[str, float] = {}
    for characters, weight in weighted:
        for c in characters:
            out[c] = out.get(c, 0.0) + weight / len(characters)
    return out


@cache
def model(writing: str) -> Model:
    if writing in LETTERS:
        letters = LETTERS[writing]
        ranked = {c: 1 / (i + 3) for i, c in enumerate(letters)}
        low = {c: w / sum(ranked.values()) for c, w in ranked.items()}
        high = {c.upper(): w for c, w in low.items() if len(c.upper()) == 1}
        follows = AMONG if writing in ("western", "central", "turkish") else OWN
    else:
        follows = SIGNS
        second = range(0xA1, 0xFF)
        if writing == "simplified":
            low, high = (FREQUENT[writing], 0.4), (_block("gb2312", range(0xB0, 0xD8), second), 0.6)
            rare = _block("gb2312", range(0xD8, 0xF8), second)
        elif writing == "traditional":
            low, high = (FREQUENT[writing], 0.4), (_block("big5", range(0xA4, 0xC7), range(0x40, 0xFF)), 0.6)
            rare = _block("big5", range(0xC9, 0xFA), range(0x40, 0xFF))
        elif writing == "korean":
            low, high = (FREQUENT[writing], 0.4), (_block("euc_kr", range(0xB0, 0xC9), second), 0.6)
            rare = _block("euc_kr", range(0xCA, 0xFE), second)
        else:
            kana = [_block("euc_jp", range(a, a + 1), second) for a in (0xA4, 0xA5)]
            kanji = _block("euc_jp", range(0xB0, 0xD0), second)
            low = _shares((kana[0], 0.55), (kana[1], 0.12), (JAPANESE_KANJI, 0.08), (kanji, 0.25))
            high = None
            rare = _block("euc_jp", range(0xD0, 0xF5), second)
        low = low if high is None else _shares(low, high)
        high = _shares((rare, 1.0))
    kinds = np.full(1 << 16, STRANGE, np.int8)
    within = np.full(1 << 16, np.log(1 / 20000))
    other = [*range(32, 127), 9, 10, 13]
    kinds[other], within[other] = ASCII_OTHER, np.log(1 / 40)
    ascii_letters = [c for c in other if chr(c).isalpha()]
    kinds[ascii_letters], within[ascii_letters] = ASCII_LETTER, np.log(1 / 52)
    within[32] = np.log(0.5)
    for kind, shares in ((MARK, _shares((MARKS, 1.0))), (HIGH, high), (LOW, low)):
        for c, share in shares.items():
            if ord(c) > 127:
                kinds[ord(c)], within[ord(c)] = kind, np.log(share)
    return Model(kinds, within, np.log(np.array(follows)))


def ranked(content: bytes) -> list[tuple[float, str, str]]:
    """(log likelihood, encoding, writing) of all readings of a text, best first; ties in the order of ENCODINGS."""
    found = []
    for encoding, writings in ENCODINGS.items():
        try:
            text = content.decode(encoding)
        except UnicodeDecodeError:
            continue
        for w in (writings,) if isinstance(writings, str) else writings:
            found.append((model(w).likelihood(text), encoding, w))
    return sorted(found, key=lambda f: -f[0])


def decode(content: bytes) -> str:
    """The text: by its mark (UTF-8, UTF-16), else as UTF-8 if it is that and has no zero bytes, else by likelihood.

    Bytes that nothing can read are read as Latin-1. An empty text is empty.
    """
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace")
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = None
    if text is not None and "\0" not in text:
        return text
    best = ranked(content)
    if text is not None and not (best and best[0][1].startswith("utf_16")):
        return text
    return content.decode(best[0][1]) if best else content.decode("latin-1")
