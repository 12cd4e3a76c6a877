"""Synthetic labelled pairs: eight families for each seed, split into roles within each family.

Draws are ranks and remainders of md5 over (seed, family, element), so a corpus is a plan without state: every partition
draws its own rows, any engine that has md5 draws the same, and a seed always gives the same pairs. The words are invented.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlink.functions import perturb

#: Family: label and pairs for each seed, in report order.
FAMILIES = {"exact": (1, 30), "formatting": (1, 30), "word order": (1, 30), "abbreviation": (1, 30), "character noise": (1, 30), "semantic alias": (0, 90), "transliteration": (1, 30), "near-miss negative": (0, 90)}
SEEDS = (1, 2, 3, 4, 5)
ROLES = ("development", "calibration", "sealed test")

FIRST = "Amber Bracken Cinder Dapple Ember Fallow Gannet Heather Indigo Juniper Kelp Linden Marsh Nettle Ochre Pebble Quarry Rowan Sable Thicket Umber Verdant Willow Yarrow Zephyr Basalt Clover Dusk Flint Gorse Hollow Ivory".split()
SECOND = "Ridge Ford Moor Glen Fell Tarn Weir Dene Crag Holm Beck Shaw Lea Combe Strand Reach Bight Ness Firth Knoll Spinney Copse Garth Wold Cairn".split()
NOUNS = "Bindery Creamery Foundry Tannery Joinery Pottery Brewery Nursery Smithy Orchard".split()
OTHER_NOUNS = "Tailors Florist Optician Cobbler Stables Framers".split()
ALIAS_LEFT = ("Dawnlight Fenwater Gullwing Hartwell Ironvale Jadecroft Kingsmere Larchway Mistfell Northolt".split(), "Bend Rise Drove Gate Lane Quay Steps Terrace Vale Yardarm".split())
ALIAS_RIGHT = ("Duskmantle Elmstead Foxbarrow Greywick Highlow Inkberry Jetstone Knapweed Lochend Maplin".split(), "Alley Bower Crossing Drift Embankment Flats Gardens Heights Inlet Junction".split())
SYNONYMS = {"Bakery": ("Bread Oven", "Loaf Kitchen"), "Grocery": ("Provisions", "Food Store"), "Garage": ("Car Repairs", "Vehicle Works"), "Bookshop": ("Volume Sellers", "Reading Room")}
ACCENTED = "Fjördsen Çelik Ñandú Brûlée Håkon Søndre Grünwald Mañana Noël Crème Île Épinal".split()

#: The pool of two-word prefixes is cut into one span for each family that draws from it: no name occurs in two families.
_SPANS = {"exact": (0, 70), "formatting": (70, 140), "word order": (140, 210), "abbreviation": (210, 280), "character noise": (280, 350), "near-miss negative": (350, 550)}


def _array(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def drawn(what: str, *parts: Column, of: int) -> Column:
    """A number below `of` that the parts decide."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(what), *parts)), 1, 8), 16, 10).cast("long") % of


def _two_words(one: list[str], two: list[str]) -> list[str]:
    return [f"{a} {b}" for a in one for b in two]


def _pools() -> dict[str, list[str]]:
    prefixes = _two_words(FIRST, SECOND)
    return {f: prefixes[a:b] for f, (a, b) in _SPANS.items()} | {"semantic alias": _two_words(*ALIAS_LEFT), "transliteration": _two_words(ACCENTED, NOUNS)}


def _sampled(base: DataFrame, family: str, pool: list[str], n: int, salt: str) -> DataFrame:
    """seed, place, prefix: n elements of the pool for each seed, without replacement."""
    rows = base.select("seed", F.explode(_array(pool)).alias("prefix"))
    order = Window.partitionBy("seed").orderBy(F.md5(F.concat_ws("|", F.lit(salt), F.lit(family), "seed", "prefix")), "prefix")
    return rows.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < n)


def _family(base: DataFrame, family: str, pool: list[str]) -> DataFrame:
    label, n = FAMILIES[family]
    rows = _sampled(base, family, pool, n, "draw")
    key = (F.lit(family), F.col("seed"), F.col("prefix"))

    def one_of(what: str, words) -> Column:
        return F.element_at(_array(words), (drawn(what, *key, of=len(words)) + 1).cast("int"))

    left = F.concat_ws(" ", "prefix", one_of("noun", NOUNS))
    if family == "exact":
        pair = left, left
    elif family == "formatting":
        pair = left, perturb.formatting(left, drawn("style", *key, of=4))
    elif family == "word order":
        pair = left, perturb.word_order(left)
    elif family == "abbreviation":
        left = F.concat_ws(" ", "prefix", one_of("suffix", list(perturb.ABBREVIATIONS)))
        pair = left, perturb.abbreviate(left)
    elif family == "character noise":
        pair = left, perturb.noise(left)
    elif family == "transliteration":
        pair = F.col("prefix"), perturb.transliterate(F.col("prefix"))
    elif family == "near-miss negative":
        pair = left, F.concat_ws(" ", "prefix", one_of("other", OTHER_NOUNS))
    else:
        other = _sampled(base, family, _two_words(*ALIAS_RIGHT), n, "other").withColumnRenamed("prefix", "other")
        rows = rows.join(other, ["seed", "place"])
        nouns = [(k, v) for k, some in SYNONYMS.items() for v in some]
        at = (drawn("alias", *key, of=len(nouns)) + 1).cast("int")
        pair = tuple(F.concat_ws(" ", p, F.element_at(_array([x[i] for x in nouns]), at)) for i, p in enumerate(("prefix", "other")))
    return rows.select("seed", F.lit(family).alias("category"), "place", pair[0].alias("left_name"), pair[1].alias("right_name"), F.lit(label).alias("label"))


def split_roles(pairs: DataFrame, id_col: str = "pair_id", family_col: str = "category", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds role: within each family, in md5 order of the ids, half (rounded up) is development, half of the rest
    (rounded down) calibration, what is left sealed test. A null id counts as empty; equal ids are ordered alike."""
    part = Window.partitionBy(*by, family_col)
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    n = F.count("*").over(part)
    rank = F.row_number().over(part.orderBy(F.md5(text), text))
    first = F.ceil(n / 2)
    second = first + F.floor((n - first) / 2)
    return pairs.withColumn("role", F.when(rank <= first, ROLES[0]).when(rank <= second, ROLES[1]).otherwise(ROLES[2]))


def generate(spark: SparkSession, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """pair_id, left_name, right_name, label, category, role, seed: 360 pairs for each seed, half of them label 1."""
    base = spark.createDataFrame([(s,) for s in seeds], "seed int")
    out = None
    for family, pool in _pools().items():
        rows = _family(base, family, pool)
        out = rows if out is None else out.unionByName(rows)
    named = out.withColumn("pair_id", F.format_string("%04d-%s-%03d", "seed", perturb.slug(F.col("category")), "place"))
    return split_roles(named, by=("seed",)).select("pair_id", "left_name", "right_name", "label", "category", "role", "seed")


def repeated_ids(pairs: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """Each id that is given more than once, and how often."""
    return pairs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def coverage(pairs: DataFrame, roles: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """id, problem: ids without a role (missing), and roles of no pair (extra)."""
    sides = (("missing", pairs, roles), ("extra", roles, pairs))
    found = [a.select(id_col).join(b.select(id_col), id_col, "left_anti").withColumn("problem", F.lit(why)) for why, a, b in sides]
    return found[0].unionByName(found[1])


def case_mixture(pairs: DataFrame) -> DataFrame:
    """category, n, seeds: pairs of each family, and the seeds they were drawn with, sorted."""
    return pairs.groupBy("category").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("seed")).alias("seeds"))


def problems(pairs: DataFrame) -> DataFrame:
    """pair_id, problem: repeated ids, unknown roles and labels outside 0 and 1; empty for a valid set."""
    twice = repeated_ids(pairs).select("pair_id", F.lit("repeated pair id").alias("problem"))
    role = pairs.where(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))).select("pair_id", F.lit("unknown role").alias("problem"))
    label = pairs.where(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).select("pair_id", F.lit("label is not 0 or 1").alias("problem"))
    return twice.unionByName(role).unionByName(label)
