"""Frequent function words, by which running text of a language is told from other text."""

from __future__ import annotations

# Frequent function words by language.
FUNCTION = {
    "en": "the of and to in is that it for was on with as by this at from our one each near under before after because which has have are be an a my your was there them you before until although",
    "de": "der die das und ist nicht ein eine einen einer mit von zu auf für diese dieser diesen jede keine weil während nachdem obwohl bevor über neben hinter vor sich auch",
    "es": "el la los las de y que en un una por con para esta este cada ninguna aunque mientras porque cuando sobre desde hacia sin su del se",
    "fr": "le la les de et que en un une pour avec cette chaque aucune parce quand alors dans vers chez sans sur sous des du qui ne pas au aux est",
    "it": "il lo la gli le di e che un una per con non della nel sono questo ogni",
    "nl": "de het een en van ik te dat die in is niet zijn op aan met voor er maar om deze elke",
    "pt": "o a os as de e que em um uma para com não por mais esta cada sobre do da",
}
ALL = frozenset(w for words in FUNCTION.values() for w in words.split())
