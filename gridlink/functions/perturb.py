"""Name perturbations as column expressions: each turns a name into the right-hand side of a labelled pair."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ABBREVIATIONS = {"Company": "Co", "Limited": "Ltd", "Brothers": "Bros", "Associates": "Assoc", "Enterprises": "Ent", "Corporation": "Corp"}
ACCENTED, PLAIN = "áâåçéèêëîïñöøü", "aaaceeeeiinoou"

_LETTERS = string.ascii_lowercase + string.ascii_uppercase
_NEXT = string.ascii_lowercase[1:] + "a" + string.ascii_uppercase[1:] + "A"


def formatting(name: Column, style: Column) -> Column:
    """Upper case, lower case, a full stop at the end or doubled spaces, by style 0 to 3."""
    return F.when(style == 0, F.upper(name)).when(style == 1, F.lower(name)).when(style == 2, F.concat(name, F.lit("."))).otherwise(F.replace(name, F.lit(" "), F.lit("  ")))


def word_order(name: Column) -> Column:
    """The words the other way round."""
    return F.array_join(F.reverse(F.split(name, " ")), " ")


def abbreviate(name: Column) -> Column:
    """The last word by its abbreviation, where it has one."""
    known = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    last = F.element_at(F.split(name, " "), -1)
    return F.concat(F.substring(name, F.lit(1), F.length(name) - F.length(last)), F.coalesce(known[last], last))


def noise(name: Column) -> Column:
    """Every second character, from the first of each word on, by the next letter of the alphabet."""
    def word(w: Column) -> Column:
        return F.array_join(F.transform(F.split(w, ""), lambda c, i: F.when(i % 2 == 0, F.translate(c, _LETTERS, _NEXT)).otherwise(c)), "")

    return F.array_join(F.transform(F.split(name, " "), word), " ")


def transliterate(name: Column) -> Column:
    """Accented letters by plain ones, in either case."""
    return F.translate(name, ACCENTED + ACCENTED.upper(), PLAIN + PLAIN.upper())


def slug(family: Column) -> Column:
    return F.replace(family, F.lit(" "), F.lit("-"))
