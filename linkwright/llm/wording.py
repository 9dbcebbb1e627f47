"""Fixed values for reading hand-typed names and addresses, and small string tools."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Kinds of streets with their written forms.
KINDS = {
    "street": "street st str strt", "road": "road rd", "avenue": "avenue ave av avn", "boulevard": "boulevard blvd bvd boul", "drive": "drive dr drv",
    "lane": "lane ln", "highway": "highway hwy hway hgwy", "parkway": "parkway pkwy pky pkway", "marg": "marg mrg mg", "nagar": "nagar ngr nagr",
    "colony": "colony clny col colny", "bazar": "bazar bazaar bzr", "chowk": "chowk chk chauk", "gali": "gali galli gully gly", "court": "court ct",
    "place": "place pl", "terrace": "terrace ter", "square": "square sq", "circle": "circle cir", "way": "way",
}
DIRECTIONS = {"north": "n", "south": "s", "east": "e", "west": "w", "n": "n", "s": "s", "e": "e", "w": "w"}
# Words before a number that is not the house number, and words that lead to it.
UNIT_WORDS = {"suite", "ste", "shop", "office", "unit", "floor", "fl", "sector", "sec", "apt", "apartment", "room", "flat", "block", "phase"}
HOUSE_WORDS = {"plot", "house", "door", "h", "d", "no", "num", "number", "hno", "dno", "ho", "building", "bldg"}
LANDMARK_LEADS = {"near", "nr", "opp", "opposite", "behind", "beside", "next"}
ORDINALS = {"first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "sixth": "6th", "seventh": "7th", "eighth": "8th", "ninth": "9th", "tenth": "10th", "eleventh": "11th", "twelfth": "12th"}
# Legal forms and fillers of business names.
LEGAL = set("limited ltd llc llp incorporated inc corporation corp corpn company co private pvt pvtltd plc gmbh pty".split())
FAMILY = set("sons daughters brothers bros and the".split())
# Given names with their short forms.
NICKNAMES = {
    "alexander": "alex sandy sasha xander", "katherine": "kate kathy katie kat kathryn catherine", "victoria": "vicky vicki tori", "margaret": "peg peggy maggie meg",
    "saraswati": "saru sarasvathi saraswathi sarasvati", "lakshmi": "laxmi lakshmy laxmy lachmi", "elizabeth": "liz beth betty eliza lizzie", "robert": "bob rob bobby robbie", "william": "bill will billy liam willie",
    "richard": "rich rick dick ricky", "james": "jim jimmy jamie", "charles": "charlie chuck chas", "theodore": "ted theo teddy", "samuel": "sam sammy", "benjamin": "ben benny benji",
    "dorothy": "dot dottie dolly", "venkatesh": "venky venkat venkatesan venkateshwar", "mohammed": "mohd md mohammad muhammad mohamed", "narayan": "narain narayanan nari", "krishnan": "kris krishna krish",
    "rajendra": "raj rajinder raju rajender", "jayanthi": "jaya jayanti jayanthy",
}

FORM_OF_KIND = {form: kind for kind, forms in KINDS.items() for form in forms.split()}
FORMAL_NAME = {short: name for name, shorts in NICKNAMES.items() for short in [name, *shorts.split()]}


def plain(text: str) -> str:
    """Lower case without accents, compatibility forms resolved."""
    if text.isascii():
        return text.lower()
    s = unicodedata.normalize("NFKD", text)
    return "".join(c for c in s if not unicodedata.combining(c)).lower()


@lru_cache(maxsize=1 << 16)
def distance(a: str, b: str, most: int = 3) -> int:
    """Optimal string alignment distance (a transposition is one edit), most + 1 if larger than `most`."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    x, y = set(a), set(b)
    if len(x - y) > most or len(y - x) > most:  # every letter of one side only takes an edit
        return most + 1
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if not a or not b:
        return len(a) + len(b)
    old: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, old, row = old, row, [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


# Spellings that sound alike, in the order they are replaced.
SOUNDS = [("ee", "i"), ("oo", "u"), ("ph", "f"), ("ks", "x"), ("v", "b"), ("z", "j"), ("c", "k"), ("q", "k"), ("0", "o"), ("1", "l"), ("5", "s"), ("th", "t")]


@lru_cache(maxsize=1 << 16)
def sound(word: str) -> str:
    """The word with letters that are often confused made one, repeated letters once."""
    for a, b in SOUNDS:
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


@lru_cache(maxsize=1 << 16)
def is_short_for(short: str, word: str) -> bool:
    """`short` begins like `word`, is shorter and its letters come in `word` in that order."""
    if len(short) >= len(word) or len(short) < 2 or short[0] != word[0]:
        return False
    it = iter(word)
    return all(c in it for c in short)


@lru_cache(maxsize=1 << 16)
def singular(word: str) -> str:
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    return word[:-1] if word.endswith("s") and not word.endswith("ss") and len(word) > 3 else word


# Endings that make words of one stem.
_ENDINGS = {"", "s", "es", "y", "ies", "ing", "er", "ers", "or", "ors", "ant", "ants", "ed", "ment", "e", "age", "aging"}


@lru_cache(maxsize=1 << 16)
def same_stem(a: str, b: str) -> bool:
    """The words share a stem of four letters or more and differ in a usual ending (trading, traders)."""
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return any(a[j:] in _ENDINGS and b[j:] in _ENDINGS for j in range(k, 3, -1))


def variant_cost(word: str, of: str) -> float | None:
    """What the channel charges for `word` written for the common word `of`; None if it can't be."""
    if word == of or singular(word) == singular(of):
        return 0.1
    if same_stem(word, of):
        return 0.3
    for whole in (of, singular(of)):
        if is_short_for(word, whole) and not (len(word) > 5 and len(whole) - len(word) > 6):
            return (0.4 if whole.startswith(word) else 0.9) - (0.1 if word[-1] == whole[-1] else 0.0)
    if len(word) >= 5 and abs(len(word) - len(of)) <= 2:
        most = 2 if len(of) >= 7 else 1
        d = distance(word, of, most)
        if d <= most:
            return float(d)
    return None
