"""The labelled pairs behind the published accuracy figures: 360 for each seed, drawn one after the other.

corpus.generate() draws by hashes, so that any partition can draw its own rows. The published figures rest on one stream
of pseudo-random numbers for each seed instead, in which every draw moves all later ones; here a seed is one task, and
many seeds are drawn side by side. A family is a row of a table: the names it begins with, how many, what they become.

Defined cases: a seed gives the same pairs wherever it is drawn; seeds that repeat give repeated rows; no seeds, no rows.
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from gridlink.sources.corpus import ROLES, SEEDS

SCHEMA = "pair_id string, left_name string, right_name string, label int, category string, role string, seed int"

# The published word lists, tables and sizes, in their order.
QUALIFIERS = "Acacia Copper Savannah Highland Riverside Crescent Baobab Lakeside Nile Silver Cedar Ironwood Golden Amber Driftwood Thornwood Emerald Sunset Meadow Cypress Juniper Marble Frost Coral Willow Granite Sandstone Bluebell Foxglove Ebony Maple Birch".split()
FEATURES = "Ridge Hill Grove Bay Reef Valley Basin Cove Marsh Delta Cliff Hollow Mist Star Palm Point Glen Bend Vale Crossing Landing Terrace Heights Springs Junction".split()
NOUNS = "Bakery Traders Carpentry Warehouse Electricals Textiles Grocery Pharmacy Cleaners Motors Hardware Logistics".split()
OTHER_NOUNS = "Bistro Deli Clinic Tailors Autos Studio Depot Outfitters Foundry Garage Boutique Stationers".split()
SYNONYMS = {
    "Bakery": ("Bread House", "Bake Shop"),
    "Grocery": ("Supermarket", "Food Mart"),
    "Pharmacy": ("Chemist", "Drug Store"),
    "Cleaners": ("Laundry Service", "Wash House"),
    "Motors": ("Automotive", "Auto Works"),
    "Hardware": ("Tool Supply", "Building Supplies"),
}
ALIAS_LEFT = ("Sunrise Timberline Falcon Harborview Windmere Oakhaven Brambleton Silvercreek Fernwood Wolfsbane".split(), "Court Corner Way Row Path Yard Green Square Trail Loop".split())
ALIAS_RIGHT = ("Moonrise Ashgrove Kestrel Pinehollow Stormcrest Larkspur Ravenswood Goldbrook Hazelmere Thistledown".split(), "Close Walk Passage Circle Mews Parade Esplanade Promenade Arcade Wharf".split())
ABBREVIATIONS = {"Company": "Co", "Limited": "Ltd", "Brothers": "Bros", "Associates": "Assoc", "Enterprises": "Ent", "Corporation": "Corp"}
ACCENTED = "Café Château Señor Île Möwe Zürich Öresund Björk Ångström Élan Façade Røstvik".split()
PLAIN = str.maketrans("áâåçéèêëîïñöøüÁÂÅÇÉÈÊËÎÏÑÖØÜ", "aaaceeeeiinoouAAACEEEEIINOOU")
FEW, MANY = 30, 90


def _joined(first: list[str], second: list[str]) -> list[str]:
    return [f"{a} {b}" for a in first for b in second]


class Stream:
    """One seed's pseudo-random numbers, and what is drawn from them."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def noun(self, prefix: str, nouns: list[str] = NOUNS) -> str:
        return f"{prefix} {self.rng.choice(nouns)}"

    def restyled(self, name: str) -> str:
        return self.rng.choice([name.upper(), name.lower(), f"{name}.", name.replace(" ", "  ")])

    def reordered(self, name: str) -> str:
        order = name.split()
        while " ".join(order) == name:
            self.rng.shuffle(order)
        return " ".join(order)

    def scrambled(self, name: str) -> str:
        """About half of each word's letters, replaced by others of their case."""
        out = []
        for word in name.split():
            letters = [i for i, c in enumerate(word) if c.isalpha()]
            new = dict(enumerate(word))
            for i in self.rng.sample(letters, max(1, len(letters) // 2)) if letters else ():
                other = self.rng.choice(string.ascii_lowercase.replace(word[i].lower(), ""))
                new[i] = other.upper() if word[i].isupper() else other
            out.append("".join(new.values()))
        return " ".join(out)

    def alias(self, prefixes: tuple[str, str]) -> tuple[str, str]:
        noun = self.rng.choice(list(SYNONYMS))
        return f"{prefixes[0]} {noun}", f"{prefixes[1]} {self.rng.choice(SYNONYMS[noun])}"

    def abbreviated(self, prefix: str) -> tuple[str, str]:
        word = self.rng.choice(list(ABBREVIATIONS))
        return f"{prefix} {word}", f"{prefix} {ABBREVIATIONS[word]}"


@dataclass(frozen=True)
class Family:
    """pools: one sample of `size` is drawn from each; pair: what a drawn element becomes."""

    name: str
    label: int
    size: int
    pools: tuple[list[str], ...]
    pair: Callable[[Stream, str | tuple], tuple[str, str]]


def _with_noun(change: Callable[[Stream, str], str]) -> Callable[[Stream, str], tuple[str, str]]:
    def pair(s: Stream, prefix: str) -> tuple[str, str]:
        name = s.noun(prefix)
        return name, change(s, name)

    return pair


_PREFIXES = _joined(QUALIFIERS, FEATURES)
FAMILIES = (
    Family("exact", 1, FEW, (_PREFIXES[:70],), _with_noun(lambda s, name: name)),
    Family("formatting", 1, FEW, (_PREFIXES[70:140],), _with_noun(Stream.restyled)),
    Family("word order", 1, FEW, (_PREFIXES[140:210],), _with_noun(Stream.reordered)),
    Family("abbreviation", 1, FEW, (_PREFIXES[210:280],), Stream.abbreviated),
    Family("character noise", 1, FEW, (_PREFIXES[280:350],), _with_noun(Stream.scrambled)),
    Family("semantic alias", 0, MANY, (_joined(*ALIAS_LEFT), _joined(*ALIAS_RIGHT)), Stream.alias),
    Family("transliteration", 1, FEW, (_joined(ACCENTED, NOUNS),), lambda s, name: (name, name.translate(PLAIN))),
    Family("near-miss negative", 0, MANY, (_PREFIXES[350:550],), lambda s, prefix: (s.noun(prefix), s.noun(prefix, OTHER_NOUNS))),
)


def draw(seed: int) -> list[tuple]:
    """Rows of SCHEMA for one seed: all pairs first, then each family's roles."""
    stream, rows, families = Stream(seed), [], []
    for family in FAMILIES:
        drawn = [stream.rng.sample(pool, family.size) for pool in family.pools]
        own = [family.pair(stream, x) for x in (drawn[0] if len(drawn) == 1 else zip(*drawn, strict=True))]
        families.append((family, [(f"{seed:04d}-{family.name.replace(' ', '-')}-{k:03d}", *pair) for k, pair in enumerate(own)]))
    for family, pairs in families:
        order = [p[0] for p in pairs]
        stream.rng.shuffle(order)
        first = (len(order) + 1) // 2
        second = first + (len(order) - first) // 2
        role = {i: ROLES[(k >= first) + (k >= second)] for k, i in enumerate(order)}
        rows += [(*p, family.label, family.name, role[p[0]], seed) for p in pairs]
    return rows


def generate(spark: SparkSession, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """pair_id, left_name, right_name, label, category, role, seed."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for seed in batch["seed"]:
                yield pd.DataFrame(draw(int(seed)), columns=names)

    return spark.createDataFrame([(s,) for s in seeds], "seed int").mapInPandas(rows, SCHEMA)
