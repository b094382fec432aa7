"""The published Snowball algorithm for Russian, as Spark SQL expressions.

Endings are removed from the part of a word after its first vowel (RV), the derivational ones also only where they lie
in R2. Each step is one anchored regular expression whose alternatives are tried at the leftmost place, so the longest
ending wins, and every step stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

VOWELS = "аеиоуыэюя"

# The ending classes of the algorithm. A `*` class needs а or я before it.
GERUND = "ившись|ывшись|ивши|ывши|ив|ыв"
GERUND_AFTER = "вшись|вши|в"
REFLEXIVE = "ся|сь"
ADJECTIVE = "ими|ыми|его|ого|ему|ому|ее|ие|ые|ое|ей|ий|ый|ой|ем|им|ым|ом|их|ых|ую|юю|ая|яя|ою|ею"
PARTICIPLE = "ивш|ывш|ующ"
PARTICIPLE_AFTER = "ем|нн|вш|ющ|щ"
VERB = "ейте|уйте|ила|ыла|ена|ите|или|ыли|ило|ыло|ено|ует|уют|ены|ить|ыть|ишь|ей|уй|ил|ыл|им|ым|ен|ят|ит|ыт|ую|ю"
VERB_AFTER = "ешь|нно|ете|йте|ла|на|ли|ло|но|ет|ют|ны|ть|й|л|ем|н"
NOUN = "иями|ями|ами|ией|иям|ием|иях|ев|ов|ие|ье|еи|ии|ей|ой|ий|ям|ем|ам|ом|ах|ях|ию|ью|ия|ья|а|е|и|й|о|у|ы|ь|ю|я"
DERIVED = "ость|ост"
SUPERLATIVE = "ейше|ейш"

#: (pattern on RV, replacement) of the steps; the plans' SQL is built from the same values.
GERUND_STEP = (f"([ая])(?:{GERUND_AFTER})$|(?:{GERUND})$", "$1")
REFLEXIVE_STEP = (f"(?:{REFLEXIVE})$", "")
ADJECTIVE_STEP = (f"(?:{ADJECTIVE})$", "")
PARTICIPLE_STEP = (f"([ая])(?:{PARTICIPLE_AFTER})$|(?:{PARTICIPLE})$", "$1")
VERB_STEP = (f"([ая])(?:{VERB_AFTER})$|(?:{VERB})$", "$1")
NOUN_STEP = (f"(?:{NOUN})$", "")
#: A word up to the start of R2: vowel, consonant, vowel, consonant.
R2 = f"^[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]+[{VOWELS}]+[^{VOWELS}]"


def stem_ru(word: Column) -> Column:
    """The stem of a word in lower case; words without a Russian vowel stay as they are."""
    step = lambda c, s: F.regexp_replace(c, *s)

    def inflection(rv: Column) -> Column:
        """RV without its gerund ending, or without what an adjective, verb or noun ends in."""
        other = let(step(rv, REFLEXIVE_STEP), lambda plain: let(step(plain, ADJECTIVE_STEP), lambda adjective: F.when(adjective != plain, step(adjective, PARTICIPLE_STEP)).otherwise(
            let(step(plain, VERB_STEP), lambda verb: F.when(verb != plain, verb).otherwise(step(plain, NOUN_STEP))))))
        return let(step(rv, GERUND_STEP), lambda gerund: F.when(gerund != rv, gerund).otherwise(other))

    def derivation(w: Column, two: Column) -> Column:
        """two without a derivational ending that lies in R2 of the word."""
        ending = F.regexp_extract(two, f"(?:{DERIVED})$", 0)
        start = F.length(F.regexp_extract(w, R2, 0))
        return let(F.struct(ending.alias("e"), start.alias("s")), lambda x: F.when((x["e"] != "") & (x["s"] > 0) & (F.length(two) - F.length(x["e"]) >= x["s"]), F.substr(two, F.lit(1), F.length(two) - F.length(x["e"]))).otherwise(two))

    def finish(tail: Column) -> Column:
        """Without a superlative ending, a doubled н or a soft sign."""
        return let(F.regexp_replace(tail, f"(?:{SUPERLATIVE})$", ""), lambda s: F.when(tail.endswith("нн"), F.regexp_replace(tail, "н$", "")).when(s != tail, F.regexp_replace(s, "нн$", "н")).otherwise(F.regexp_replace(tail, "ь$", "")))

    def whole(x: Column) -> Column:
        head, w = x["head"], x["w"]
        rv = F.substr(w, F.length(head) + 1, F.length(w))
        two = F.concat(head, F.regexp_replace(let(rv, inflection), "и$", ""))
        tail = let(two, lambda t: let(derivation(w, t), lambda d: F.substr(d, F.length(head) + 1, F.length(d))))
        return F.when(head == "", w).otherwise(F.concat(head, let(tail, finish)))

    clean = F.regexp_replace(word, "ё", "е")
    return let(F.struct(clean.alias("w"), F.regexp_extract(clean, f"^[^{VOWELS}]*[{VOWELS}]", 0).alias("head")), whole)


def stems(tokens: Column) -> Column:
    return F.transform(tokens, stem_ru)
