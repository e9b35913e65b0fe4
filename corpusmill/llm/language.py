"""Language of a text by script and function words: en, de, fr, es, zh."""

from __future__ import annotations

import re
from collections import Counter

#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and a an to in is was that it for on with as at by be are this from which not or but have has had were they their its when so than then been can will would you your what how why",
    "de": "der die das und ist nicht ein eine einen einem den dem des zu mit auf für von im am war sich auch es dass wie was man ob wenn dann aber oder bei nach seit über ich sie wird werden kann hat sind weder noch nur zum zur",
    "fr": "le la les de des du un une et est pas que qui dans pour sur au aux ce cette il elle ne se son sa ses par avec plus mais ou où sans sont à c'est n'est l'on était été ont on quand trop si ni leur très en",
    "es": "el la los las de del un una y es no que en por para con se su sus al lo como más pero o sin son cuando demasiado si qué muy este esta fue ha han desde hace ni entre sobre también está porque sí",
}
_CODES = tuple(FUNCTION_WORDS)
#: Word -> bits of the languages it is a function word of.
_MASKS: dict[str, int] = {}
for _i, _v in enumerate(FUNCTION_WORDS.values()):
    for _w in _v.split():
        _MASKS[_w] = _MASKS.get(_w, 0) | 1 << _i
_FR = 1 << _CODES.index("fr")
_DE, _ES, _FRENCH = re.compile("[ßäöü]"), re.compile("[ñ¿¡]"), re.compile("[èêçœùîô]")
_HAN = re.compile("[㐀-鿿]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def scores(text: str) -> dict[str, float]:
    """Evidence for each language: function words, for Chinese two characters count as one."""
    low = text.lower().replace("’", "'")
    hits: list[int] = []
    for w in _WORD.findall(low):
        m = _MASKS.get(w, 0)
        if "'" in w:
            for p in w.split("'"):  # an elided article is one letter
                m |= _MASKS.get(p, 0) | (_FR if len(p) == 1 and p in "lcdnsj" else 0)
        if m:
            hits.append(m)
    many = Counter(hits)
    out = {c: float(sum(n for m, n in many.items() if m >> i & 1)) for i, c in enumerate(_CODES)}
    out["zh"] = 0.0
    if not low.isascii():
        if _DE.search(low):
            out["de"] += 0.5
        if _ES.search(low):
            out["es"] += 1
        if _FRENCH.search(low):
            out["fr"] += 0.5
        out["zh"] = len(_HAN.findall(text)) / 2
    return out


def detect(text: str, least: float = 2.0, margin: float = 1.3) -> str | None:
    """The language with the most evidence; None if there is little or it is not clear."""
    s = scores(text)
    (a, first), (_, second) = sorted(s.items(), key=lambda kv: -kv[1])[:2]
    return a if first >= least and first >= margin * second else None
