"""The Porter2 (English) stemming algorithm, written from its published description."""

from __future__ import annotations

import functools
import re

VOWELS = "aeiouy"
#: Fixed values of the algorithm.
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), key=len, reverse=True)
R1_PREFIXES = ("gener", "commun", "arsen")

REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")


def _region(word: str, start: int) -> int:
    found = REGION.search(word, start)
    return found.end() if found else len(word)


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def _short_end(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


@functools.lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters or with other characters than a-z and ' stay."""
    if len(word) <= 2 or not all("a" <= c <= "z" or c == "'" for c in word):
        return word
    word = word.removeprefix("'")
    if word in WHOLE:
        return WHOLE[word]
    if word.startswith("y"):
        word = "Y" + word[1:]
    word = re.sub(f"(?<=[{VOWELS}])y", "Y", word)
    prefix = next((p for p in R1_PREFIXES if word.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(word, 0)
    r2 = _region(word, r1)
    # step 0
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    # step 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith(("us", "ss")):
        pass
    elif word.endswith("s") and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    # step 1b
    if end := next((e for e in ("eedly", "eed") if word.endswith(e)), None):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif (end := next((e for e in ("ingly", "edly", "ing", "ed") if word.endswith(e)), None)) and _has_vowel(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    # step 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # step 2
    for end, new in STEP_2:
        if word.endswith(end):
            head = word[: -len(end)]
            if len(head) >= r1 and (end != "ogi" or head.endswith("l")) and (end != "li" or head[-1:] in LI_ENDINGS and head):
                word = head + new
            break
    # step 3
    for end, new in STEP_3:
        if word.endswith(end):
            if len(word) - len(end) >= (r2 if end == "ative" else r1):
                word = word[: -len(end)] + new
            break
    # step 4
    for end in STEP_4:
        if word.endswith(end):
            head = word[: -len(end)]
            if len(head) >= r2 and (end != "ion" or head.endswith(("s", "t"))):
                word = head
            break
    # step 5
    if word.endswith("e"):
        head = word[:-1]
        if len(head) >= r2 or len(head) >= r1 and not _short_end(head):
            word = head
    elif word.endswith("l") and len(word) - 1 >= r2 and word[-2:-1] == "l":
        word = word[:-1]
    return word.replace("Y", "y")
