"""Hand-typed names and addresses as words and fields: Column expressions only, nothing leaves the JVM."""

from __future__ import annotations

import unicodedata
from functools import partial, reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.wording import DIRECTIONS, FAMILY, FORM_OF_KIND, FORMAL_NAME, HOUSE_WORDS, KINDS, LANDMARK_LEADS, LEGAL, ORDINALS, SOUNDS, UNIT_WORDS


def _accents() -> tuple[str, str]:
    """Latin letters with accents and their bare letters, by the canonical decomposition."""
    marked = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFKD", c)) > 1 and d[0].isascii() and d[0].isalpha()]
    return "".join(marked), "".join(unicodedata.normalize("NFKD", c)[0] for c in marked)


ACCENTED, BARE = _accents()


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def plain(text: Column) -> Column:
    """Lower case without accents."""
    folded = F.lower(F.translate(text, ACCENTED, BARE))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.regexp_replace(folded, r"\p{M}+", ""))


def _has(column: str, *marks: str) -> Column:
    """Any of the marks is in the column: spares a search by expression where there is nothing to find."""
    return reduce(Column.__or__, [F.col(column).contains(m) for m in marks])


def sounding(text: Column) -> Column:
    """The text with letters that are often confused made one, repeated letters once."""
    for single, run in groupby(SOUNDS, key=lambda x: len(x[0]) == 1):
        pairs = list(run)
        if single:
            text = F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
        else:
            for a, b in pairs:
                text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, r"([a-z0-9])\1+", "$1")


# Names

_OTHER_NAME = r"(?s)^.*\b(?:d/b/a|dba|d\.b\.a\.?|doing business as|trading as|t/a)\b(?=.*[a-z0-9])"
# Here and below, a look at the next letter spares trying each alternative at every place of a text.
_NO_NAME = r"(?s)^\W*(?:m/s|messrs)\b\.?|(?=[(\sfep.'])(?:\(?\s*\b(?:f[o0]rmerly|f/k/a|fka|earlier|previously)\b.*|\(p\)|\bp\.?(?=\s*(?:ltd|limited)\b)|(?<=\b[a-z])\.\s?(?=[a-z]\b)|')"
# A name without any of these has nothing that _NO_NAME finds.
_NO_NAME_MARKS = ["m/s", "messrs", "rmerly", "f/k/a", "fka", "earlier", "previously", "(p)", "ltd", "limited", ".", "'"]


def with_words(df: DataFrame, name: str) -> DataFrame:
    """`df` with `words`, the distinct words of a name, in order: what follows `dba`, without a former name, title, legal
    form and `& Sons`; digits among letters are read as the letters they look like. Null and blank have none.

    What a step uses more than once is a column of its own, or it would be computed as often.
    """
    read = df.withColumn("__n", F.replace(plain(F.coalesce(df[name], F.lit(""))), F.lit("'n'"), F.lit(" ")))
    n, has = F.col("__n"), partial(_has, "__n")
    n = F.when(has("dba", "d/b/a", "d.b.a", "doing business as", "trading as", "t/a"), F.regexp_replace(n, _OTHER_NAME, "")).otherwise(n)
    read = read.withColumn("__n", F.when(has(*_NO_NAME_MARKS), F.regexp_replace(n, _NO_NAME, "")).otherwise(n))
    words = F.split("__n", "[^a-z0-9]+")
    letters = F.transform(words, lambda w: F.when(w.rlike("[a-z]"), F.translate(w, "015", "ols")).otherwise(w))
    words = F.when(has("0", "1", "5"), letters).otherwise(words)
    return read.withColumn("words", F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(sorted(LEGAL | FAMILY))))).drop("__n")


def given_name(words: Column) -> Column:
    """The formal form of the given name among the words; '' if there is none that is known."""
    first = F.get(F.filter(words, lambda w: w.isin(sorted(FORMAL_NAME))), F.lit(0))  # a set is asked, a map is searched from end to end
    return F.coalesce(F.try_element_at(literal_map(FORMAL_NAME), first), F.lit(""))


# Addresses

_FORMS = "|".join(sorted(FORM_OF_KIND, key=len, reverse=True))
_TO = "north|south|east|west|[nsew]"
_HOUSE = "|".join(sorted(HOUSE_WORDS, key=len, reverse=True))
_UNITS = "|".join(sorted(UNIT_WORDS, key=len, reverse=True))
# A word made of the letters of `suite`, `office`, `sector` only is one of them, mistyped.
_UNIT = rf" (?=[{''.join(sorted({w[0] for w in UNIT_WORDS}))}])(?:(?:{_UNITS}|s[uite]{{3,5}}|o[fice]{{4,6}}|s[ector]{{4,6}})(?: no| num| number)? \d+[a-z]?|(?:ste|sec|fl|shop|unit|suite|sector)\d+)(?= )"
_LANDMARK = rf" (?=[{''.join(sorted({w[0] for w in LANDMARK_LEADS}))}])(?:{'|'.join(sorted(LANDMARK_LEADS, key=len, reverse=True))})(?: old)?(?: [a-z0-9]+)?(?: old)?(?: [a-z0-9]+)?(?= )"
# A house number of five or six digits: a street and its kind follow, or it comes first and a code comes later.
_LONG_HOUSE = rf" (?=\d)(?<! pin )(?<! zip )(\d{{5,6}})(?=(?: [a-d])?(?: ,)?(?: (?:{_TO}))? [a-z][a-z0-9]* (?:{_FORMS}) )|^((?: ,)?(?: (?:{_HOUSE})){{0,3}}) (\d{{5,6}})(?= [a-z](?:.* )?(?:\d{{5,6}}|\d{{3}} \d{{3}}) )"
_PLACE = rf"^(.*?) (\d{{1,4}}|x\d{{5,6}})(?:([a-z])| ([a-d]))?(?= )(?: ,){{0,9}}(?: ({_TO})(?= [a-z0-9]))? ([a-z0-9]+)(?= )(.*)$"
# What is no name of a town or state: signs, single letters, words with a digit first, words that lead to numbers.
_FILLER = rf" (?:,|[a-z]|x\d+|\d[a-z0-9]*|{'|'.join(sorted(HOUSE_WORDS | UNIT_WORDS | {'pin', 'zip', *DIRECTIONS}, key=len, reverse=True))})(?= )"
PARTS = ["number", "letter", "direction", "street", "street_sound", "kind", "rest", "code"]


def _swapped(a: Column, b: Column) -> Column:
    return F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))


def kind_of(word: Column) -> Column:
    """The kind of street that `word` writes, typos in the longer forms included; null if none."""
    close = F.lit(None).cast("string")
    for kind in reversed([k for k in KINDS if len(k) >= 4]):
        d = F.levenshtein(word, F.lit(kind), 2)
        near = (d == 1) | ((d == 2) & (F.lit(len(kind) >= 6) | _swapped(word, F.lit(kind))))
        close = F.when(word.startswith(kind[0]) & near, kind).otherwise(close)
    return F.coalesce(F.try_element_at(literal_map(FORM_OF_KIND), word), F.when(word.rlike("^[a-z]{3,11}$"), close))


def with_address(df: DataFrame, address: str) -> DataFrame:
    """`df` with number, letter, direction, street, street_sound, kind, rest and code of an address.

    Suites, shops, floors, sectors and landmarks are left out. Missing parts are empty strings; `rest`
    holds the other words (town, state) in their order. `number` is null where no house number with a
    street can be read, for null and empty texts too. Each step is used more than once by the next, so
    that the optimiser keeps them apart; filters belong behind a written table.
    """
    read = df.withColumn("__t", F.replace(F.replace(plain(F.coalesce(df[address], F.lit(""))), F.lit("#"), F.lit(" no ")), F.lit(" - "), F.lit(",")))
    s = F.col("__t")
    s = F.when(_has("__t", "-", "."), F.regexp_replace(s, r"(\d{5})-\d{4}\b|(?<=\b[a-z])\.(?=[a-z]\b)", "$1")).otherwise(s)
    read = read.withColumn("__t", F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(s, r"[;,\r\n]+ *", " , "), F.lit(" ")), r"[^\w,]{2,}|[^\w ,]", " "))
    read = read.withColumn("__t", F.regexp_replace("__t", _UNIT, " ,"))
    s = F.when(_has("__t", *[f" {w} " for w in sorted(LANDMARK_LEADS)]), F.regexp_replace("__t", _LANDMARK, " ,")).otherwise(F.col("__t"))
    s = F.regexp_replace(F.regexp_replace(s, _LONG_HOUSE, "$2 x$1$3"), r" (\d{3}) (\d{3})(?= )", " $1$2")
    read = read.withColumn("__p", F.split(F.regexp_replace(s, _PLACE, "$2|$3$4|$5|$6|$1|$7"), r"\|")).drop("__t")
    part = lambda i: F.get("__p", F.lit(i))
    ordinal = F.coalesce(F.try_element_at(literal_map(ORDINALS), part(3)), part(3))
    read = read.withColumns({"__found": F.size("__p") == 6, "street": F.when(F.size("__p") == 6, ordinal), "__tail": F.split(part(5), " ")})
    read = read.withColumn("kind", F.when(F.col("__found"), F.coalesce(kind_of(F.get("__tail", F.lit(1))), F.lit(""))))
    after = F.get("__tail", F.when(F.col("kind") != "", 2).otherwise(1))
    to = literal_map(DIRECTIONS)
    turned = F.when(F.col("__found") & (part(2) == ""), F.try_element_at(to, after))
    words = F.concat_ws(" ", F.lit(""), part(4), F.array_join(F.slice("__tail", F.when(F.col("kind") != "", 3).otherwise(2), F.lit(1 << 30)), " "), F.lit(""))
    digits = F.regexp_replace(part(0), "^x?0*(?=.)", "")
    read = read.withColumns({"__words": F.when(F.col("__found"), words), "direction": F.when(F.col("__found"), F.coalesce(F.try_element_at(to, part(2)), turned, F.lit(""))), "number": F.when(F.col("__found"), digits), "letter": F.when(F.col("__found"), part(1)), "street_sound": sounding(F.col("street"))})
    rest = F.filter(F.split(F.regexp_replace("__words", _FILLER, ""), " "), lambda w: w != "")
    code = F.regexp_extract("__words", r" x?(\d{5,6}) ", 1)
    return read.withColumns({"rest": rest, "code": code}).drop("__p", "__found", "__tail", "__words")
