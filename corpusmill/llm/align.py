"""Alignment of tokens: longest common subsequences, and templates with gaps.

A template is a row of places, each of which takes one of several words. A sentence aligns with a
template by the best row of its own words that fill places in order: each filled place counts 1,
each word passed over between two of them costs a little. The score is the share of the places
that the best alignment keeps.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

#: What a word between two filled places costs, beyond those that are free.
GAP, FREE = 0.08, 1
#: Least score of an aligned sentence.
ALIKE = 0.8


def common_length(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence, exact, by bits: one whole-number step a token of x."""
    places: dict[str, int] = {}
    for i, t in enumerate(y):
        places[t] = places.get(t, 0) | 1 << i
    whole = (1 << len(y)) - 1
    row = whole
    for t in x:
        if hit := row & places.get(t, 0):
            row = ((row + hit) | (row - hit)) & whole
    return len(y) - row.bit_count()


class Templates:
    """Templates by the words that they hold, so that a sentence meets only those it may align with."""

    def __init__(self, rows: Iterable[str]) -> None:
        """rows: places apart by blanks, the words of a place by |."""
        self.sizes: list[int] = []
        self.at: dict[str, list[tuple[int, int]]] = {}
        for k, row in enumerate(rows):
            places = row.split()
            self.sizes.append(len(places))
            for p, words in enumerate(places):
                for w in words.split("|"):
                    self.at.setdefault(w, []).append((k, p))
        han = sorted((w for w in self.at if w[0] > "㐀"), key=len, reverse=True)
        self.token = re.compile("|".join([*map(re.escape, han), "[㐀-鿿]", r"\w+(?:['’-]\w+)*"]))

    def tokens(self, sentence: str) -> list[str]:
        """Words in lower case; of Chinese those that stand in templates, else single characters."""
        return self.token.findall(unicodedata.normalize("NFKC", sentence).lower().replace("’", "'"))

    def score(self, sentence: str) -> float:
        """The greatest score of all templates."""
        met: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(self.tokens(sentence)):
            for k, p in self.at.get(t, ()):
                met.setdefault(k, []).append((i, p))
        best = 0.0
        for k, fits in met.items():
            size = self.sizes[k]
            if len({p for _, p in fits}) < ALIKE * size:
                continue
            ends: list[tuple[int, int, float]] = []
            for i, p in fits:
                value = 1.0
                for j, q, v in ends:
                    if q < p and j < i:
                        value = max(value, v + 1 - GAP * max(0, i - j - 1 - FREE))
                ends.append((i, p, value))
            best = max(best, max(v for _, _, v in ends) / size)
        return best


_SAY = "help|answer|answering|discuss|discussing|comment|write|tell|say|talk|speak|provide|assist|respond|share|disclose|handle|process|fulfil|fulfill|comply|continue|go|do|offer|give|complete|explain|describe|advise|reply|support|engage|look|proceed"
_SAGEN = "sagen|helfen|schreiben|antworten|beantworten|sprechen|reden|geben|äußern|erklären|eingehen|bearbeiten|unterstützen|erfüllen|bereitstellen|behandeln|anbieten|erzählen|auskunft|weiterhelfen|mitteilen|dienen|erledigen"
_DIRE = "dire|répondre|parler|aider|écrire|fournir|donner|commenter|discuter|traiter|aborder|assister|expliquer|partager|accéder|satisfaire|entrer|faire"
_DECIR = "decir|responder|hablar|ayudar|escribir|dar|proporcionar|comentar|discutir|tratar|atender|explicar|compartir|contestar|facilitar|ofrecer|cumplir|hacer|opinar"
_SHUO = "回答|作答|提供|协助|处理|讨论|透露|帮助|答复|谈论|评论|写|说|解释|满足|完成|参与|告诉|继续|支持|涉及"
_NOT = "cannot|can't|couldn't|won't|shouldn't|mustn't"
#: What refusing sentences say, by language, as templates.
REFUSALS = Templates((
    f"i|we {_NOT} {_SAY}",
    f"i|we must|can|could|will|may|should|do|would not {_SAY}",
    f"i|we|i'm|we're am|are|i'm|we're not|unable able|allowed|permitted|free|unable|willing|comfortable|authorized|authorised|equipped {_SAY}",
    f"i|i'm|we|we're am|are|i'm|we're unable to {_SAY}",
    f"i|we don't|not feel comfortable {_SAY}",
    f"i'd|we'd|rather|prefer rather|to not {_SAY}",
    f"i|we have|see no way to {_SAY}",
    "i|we|therefore must|have|need|to|will|shall decline|refuse",
    "i|we decline|refuse to",
    "i'm|am|i|we're afraid|sorry|afraid|apologise cannot|can't|won't|unable",
    "no answer|help|information|comment can|will|may be given|provided|made|offered",
    "guidelines|rules|policy|policies|instructions|principles do|does|don't|doesn't not|don't|doesn't allow|permit|let",
    "not a|something topic|subject|something|that i|i'm can|am|will|may|able",
    "request|question|topic|this falls|is|lies|goes outside|beyond what|my|of",
    "change|leave|drop the subject|topic",
    "don't|not have enough|the|any access|information|knowledge",
    "not able|allowed|permitted to discuss|answer|talk|speak|help|say",
    # German: verb, subject, negation, then what isn't done
    f"kann|darf|möchte|will|werde|könnte ich|wir nicht|nichts|keine|kein|keinen {_SAGEN}",
    f"ich|wir kann|darf|möchte|will|werde|können|dürfen nicht|nichts|keine|kein|keinen {_SAGEN}",
    "muss ich|wir ablehnen|verweigern",
    "ich|wir muss|müssen ablehnen|passen|verweigern",
    "lehne|verweigere ich ab",
    "ich lehne ab",
    "mir|uns nicht möglich|erlaubt|gestattet",
    "bin|ich ich|bin nicht befugt|berechtigt|lage|imstande",
    "leider|bedaure tut|leider mir leid|nicht aber|nicht|helfen",
    # French
    f"je n|ne|n'en|n'y peux|puis|dois|veux|souhaite|saurais|vais pas|rien|plus|point|en {_DIRE}",
    f"je ne peux|puis|dois|veux|souhaite|saurais|répondrai|parlerai {_DIRE}|pas|rien",
    f"je ne|n' suis pas mesure|autorisé|autorisée|capable|habilité {_DIRE}",
    f"m'est|nous impossible|interdit de|d'aider|d'en|d'y|d'entrer {_DIRE}|d'aider|d'en|d'y",
    "m'est impossible|interdit d'aider|d'y|d'en|d'écrire|d'aborder",
    f"préfère|préférerais ne|n'en rien|pas|point {_DIRE}",
    "je|dois|devons dois|me|de refuse|refuser|décline|décliner",
    "n'ai|pas pas|le le|droit droit|de",
    "ne m'est pas permis|possible|autorisé",
    # Spanish
    f"no puedo|podemos|debo|voy|quiero|deseo|podré|podría|puede {_DECIR}",
    f"no me|nos está|es|resulta permitido|posible {_DECIR}",
    f"prefiero|preferiría no {_DECIR}",
    f"me niego|niego a {_DECIR}",
    "debo|tengo|que que|rechazar|declinar rechazar|declinar",
    f"me es|resulta imposible {_DECIR}",
    f"no tengo permitido|permiso|autorización {_DECIR}",
    # Chinese
    f"不能|无法|不便|没法|不会|不想|不愿|没有办法|不予|不可以|难以 {_SHUO}",
    f"拒绝 {_SHUO}",
    "超出 范围|能力",
    "话题|问题 不谈",
    "恕我|恕 不能|无法|不便|难以",
    "恕不 作答|回答|奉告",
    "请求|问题 不能|无法|没法 处理|回答",
))
#: Sentences that go with a refusal without refusing themselves.
COMPANIONS = Templates((
    "i hope|trust you understand",
    "please contact|ask|consult|try|see",
    "is there anything else",
    "i'm|am sorry|afraid",
    "sorry", "désolé|désolée", "disculpa|disculpe", "抱歉|对不起|很遗憾", "请谅解", "建议 咨询", "换个 问题",
    "es tut mir leid", "frag|bitte|wende bitte|frag|dich jemand|an", "je suis désolé", "lo siento",
))
