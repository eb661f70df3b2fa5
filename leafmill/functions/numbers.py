"""Numbers written in words, and years whose words and digits can be compared.

Words are looked up in a table of forms; a number is the fold of its words' values.  Tokens are taken in their lenient
form, so vowel marks, tatweel, and the forms of alef and ta marbuta do not matter.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from . import text as T

#: Forms of units, tens, hundreds and thousands by value.
UNITS = {1: "واحد واحده احد احدي", 2: "اثنين اثنتين اثنان اثنتان اثني اثنتي", 3: "ثلاث ثلاثه ثلث ثلثه", 4: "اربع اربعه", 5: "خمس خمسه", 6: "ست سته", 7: "سبع سبعه", 8: "ثمان ثماني ثمانيه", 9: "تسع تسعه"}
TENS = {10: "عشر عشره", 20: "عشرين عشرون", 30: "ثلاثين ثلثين ثلاثون ثلثون", 40: "اربعين اربعون", 50: "خمسين خمسون", 60: "ستين ستون", 70: "سبعين سبعون", 80: "ثمانين ثمانون", 90: "تسعين تسعون"}
HUNDRED, TWO_HUNDRED = "مايه ماءه ميه مئه", "مايتين ماءتين مايتان ميتين مئتين"
THOUSAND, TWO_THOUSAND, THOUSANDS = "الف", "الفين الفان", "الاف"
#: Words of a number at most, tokens between digits and words at most, and the least value that is evidence.
MOST, GAP, LEAST = 8, 3, 3
CHECK = Y.ArrayType(Y.StructType([Y.StructField("i", Y.IntegerType()), Y.StructField("digits", Y.LongType()), Y.StructField("value", Y.LongType()), Y.StructField("words", Y.IntegerType()), Y.StructField("verdict", Y.StringType()), Y.StructField("suggestion", Y.StringType())]))


def forms() -> dict[str, tuple[str, int]]:
    """``(kind, value)`` by lenient form: u units, t tens, h hundreds, k thousands, K what multiplies by a thousand."""
    of = lambda kind, table: {w: (kind, v) for v, words in table.items() for w in words.split()}
    out = of("h", {100: HUNDRED, 200: TWO_HUNDRED}) | of("k", {1000: THOUSAND, 2000: TWO_THOUSAND}) | of("K", {1000: THOUSANDS})
    # Hundreds in one word: a unit, with or without its last letter, before the hundred.
    for v, words in UNITS.items():
        for unit in words.split():
            for hundred in HUNDRED.split():
                for stem in (unit, unit.removesuffix("ه")):
                    out.setdefault(stem + hundred, ("h", 100 * v))
    return out | of("t", TENS) | of("u", UNITS)


def number_word(word: Column) -> Column:
    """``struct<kind, value>`` of one word, "and" before it allowed; null for any other word."""
    table = F.create_map(*[x for w, (kind, v) in forms().items() for x in (F.lit(w), F.struct(F.lit(kind).alias("kind"), F.lit(v).alias("value")))])
    key = T.lenient(word)
    return F.coalesce(F.try_element_at(table, key), F.when(key.startswith("و"), F.try_element_at(table, F.substr(key, F.lit(2)))))


def value_of(found: list[tuple[str, int] | None]) -> tuple[int, int] | None:
    """``(value, words)`` of the number words that a list begins with; None where it begins with another."""
    total = n = 0
    for x in found[:MOST]:
        if x is None:
            break
        total = (total or 1) * 1000 if x[0] == "K" else total + x[1]
        n += 1
    return (total, n) if n else None


#: A number with brackets, marks or an era's sign; what may stand between it and its words.
_NUMBER = re.compile(r"^[(\[«“\"]*([0-9٠-٩۰-۹]+)(?:ـ?(?:م|هـ|ه))?[)\]»”\".،:؛]*$")
_EDGES, _ERAS = "()[]«»“”\"'.,،؛:-–—", {"م", "ه", ""}
_MARKS = re.compile("[ؐ-ًؚ-ٰٟۖ-ۭ]")


def checks(tokens: list[str], found: list[tuple[str, int] | None]) -> list[dict]:
    """Numbers followed by number words, with the verdict on them.

    ``agree``: both have one value; ``differ``: ``suggestion`` has the words' value in the number's own digits;
    ``short``: the words' value is only the end of the digits, no evidence.  Words worth less than three are none.
    """
    out = []
    for i, token in enumerate(tokens):
        m = _NUMBER.match(_MARKS.sub("", token))
        if not m:
            continue
        j = i + 1
        while j < len(tokens) and j - i <= GAP and tokens[j].strip(_EDGES).replace("ـ", "") in _ERAS:
            j += 1
        read = value_of(found[j : j + MOST])
        if read is None or read[0] < LEAST:
            continue
        digits = int(m.group(1))
        verdict = "agree" if digits == read[0] else "short" if read[0] < digits and str(digits).endswith(str(read[0])) else "differ"
        own = str(read[0]).translate(str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")) if re.search("[٠-٩]", token) else str(read[0])
        out.append({"i": i, "digits": digits, "value": read[0], "words": read[1], "verdict": verdict, "suggestion": re.sub("[0-9٠-٩۰-۹]+", own, token, count=1) if verdict == "differ" else None})
    return out


@F.pandas_udf(CHECK)
def _checks(tokens: pd.Series, found: pd.Series) -> pd.Series:
    pairs = lambda x: [None if v is None else (v["kind"], int(v["value"])) for v in x]
    return pd.Series([[] if t is None else checks(list(t), pairs(f)) for t, f in zip(tokens, found)])


def year_checks(tokens: Column) -> Column:
    """``array<struct<i, digits, value, words, verdict, suggestion>>`` of an array of tokens; empty for a null one."""
    return _checks(tokens, F.transform(tokens, number_word))


def register(spark: SparkSession) -> None:
    """SQL name of the check over tokens and their number words."""
    spark.udf.register("number_checks", _checks)
