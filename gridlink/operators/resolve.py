"""Resolution of two record sets: grid candidates, scores, best match, merge, and everything left with its reason.

A record has side, source, ordinal, name, latitude, longitude, fields; (side, source, ordinal) is its key, since both
sides may carry one source name and a side may have several sources. The grid join is an equi-join on the cell, for
which the left side's distinct places and names alone are repeated nine times; a dense cell is dealt to several tasks. A
pair meets at exactly one offset, so nothing is deduplicated. Records of one place and name are compared once. Of the
candidates of each left place and name only the best one leaves a task, so what is shuffled after the join is bounded by
the left side. Whole records are joined to the links alone, which pairs, what is left, and the merged view share. No side of these joins
is bounded, and computed columns make a file look smaller than its rows are: all are merge joins, none is broadcast.

Defined cases: records without both coordinates meet nothing; null names score 0; of equally good candidates the nearer
one, then the one with the lesser record id; an empty side leaves the other one unmatched; more columns than the named
ones are ignored in results. Records of one side that repeat a (source, ordinal) are an error of the input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridlink.functions import identity, text

CELL_SIZE = 0.01
#: What a pair's score and distance are made of.
PLACED = ("latitude", "longitude", "name")
SHARES = 4
GROUP = 1024
# The reasons that results state.
NO_COORDINATES = "no coordinates: a record without them can never enter a candidate set (FR-3)"
NO_CANDIDATES = "no candidate record shares its nine-cell grid neighbourhood"
BELOW_THRESHOLD = "no candidate's score met the matcher's threshold"
NOT_SELECTED = "not chosen as any left record's best-scoring candidate"


@dataclass(frozen=True)
class Scorer:
    """prepare: once for each record, before the join; score: over two prepared columns."""

    name: str
    prepare: Callable[[Column], Column]
    score: Callable[[Column, Column], Column]


SCORERS = {s.name: s for s in (Scorer("overlap", text.tokens, text.overlap), Scorer("fuzzy", text.normalise, text.fuzzy))}


class ScorerUnavailable(RuntimeError):
    def __init__(self, name: str, reason: str):
        super().__init__(f"scorer {name!r} is unavailable: {reason}")
        self.name, self.reason = name, reason


#: Scorers that need something beyond the library: a probe that says why not, or None, and a maker.
OPTIONAL: dict[str, tuple[Callable[[], str | None], Callable[[], Scorer]]] = {}


def register(scorer: Scorer) -> None:
    """Makes a scorer of one's own known by its name; a name is given once."""
    if scorer.name in known_scorers():
        raise ValueError(f"a scorer named {scorer.name!r} is registered already")
    SCORERS[scorer.name] = scorer


def register_optional(name: str, probe: Callable[[], str | None], make: Callable[[], Scorer]) -> None:
    OPTIONAL[name] = probe, make


def known_scorers() -> list[str]:
    from gridlink.operators import embedding  # noqa: F401  registers the optional ones

    return sorted([*SCORERS, *OPTIONAL])


def get_scorer(name: str) -> Scorer:
    """Unknown: a ValueError that lists the names. Known, but not to be had here: ScorerUnavailable with the reason."""
    known = known_scorers()
    if name in OPTIONAL:
        probe, make = OPTIONAL[name]
        if reason := probe():
            raise ScorerUnavailable(name, reason)
        return make()
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; known: {', '.join(known)}")
    return SCORERS[name]


def with_identity(records: DataFrame) -> DataFrame:
    r = F.col
    canon = identity.canonical(r("fields"), r("latitude"), r("longitude"), r("name"))
    return records.withColumn("record_id", identity.record_id(r("source"), canon, r("ordinal")))


def with_cell(records: DataFrame, cell_size: float = CELL_SIZE) -> DataFrame:
    lat, lon = F.col("latitude"), F.col("longitude")
    return records.withColumns({"cell_row": identity.cell(lat, lon, cell_size), "cell_col": identity.cell(lon, lat, cell_size)})


def bucket_occupancy(records: DataFrame, cell_size: float = CELL_SIZE) -> DataFrame:
    return with_cell(records, cell_size).where("cell_row IS NOT NULL AND cell_col IS NOT NULL").groupBy("cell_row", "cell_col").agg(F.count("*").alias("n"))


def candidate_pairs(left: DataFrame, right: DataFrame, cell_size: float = CELL_SIZE) -> DataFrame:
    """Every left and right record in the same or a neighbouring cell, as structs l and r."""
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    near = with_cell(left, cell_size).where("cell_row IS NOT NULL").select(F.struct(*left.columns).alias("l"), "cell_row", "cell_col", F.explode(offsets).alias("o"))
    near = near.select("l", (F.col("cell_row") + F.col("o.i")).alias("cell_row"), (F.col("cell_col") + F.col("o.j")).alias("cell_col"))
    there = with_cell(right, cell_size).where("cell_row IS NOT NULL").select(F.struct(*right.columns).alias("r"), "cell_row", "cell_col")
    return near.join(there, ["cell_row", "cell_col"]).select("l", "r")


def prepared(records: DataFrame, scorer: Scorer) -> DataFrame:
    return records.withColumn("prepared", scorer.prepare(F.col("name")))


def prepared_once(records: DataFrame, scorer: Scorer) -> DataFrame:
    """prepared(), with each distinct name prepared once and looked up: for scorers whose preparation is dear."""
    names = records.select(F.col("name").alias("_name")).distinct().withColumn("prepared", scorer.prepare(F.col("_name")))
    return records.join(names, F.col("name").eqNullSafe(F.col("_name")), "left").drop("_name")


def scored_pairs(left: DataFrame, right: DataFrame, scorer: Scorer, cell_size: float = CELL_SIZE) -> DataFrame:
    """Candidates with score and distance; names are prepared once for each record, not for each comparison."""
    pairs = candidate_pairs(prepared(with_identity(left), scorer), prepared(with_identity(right), scorer), cell_size)
    distance = identity.haversine_km(F.col("l.latitude"), F.col("l.longitude"), F.col("r.latitude"), F.col("r.longitude"))
    return pairs.withColumns({"score": scorer.score(F.col("l.prepared"), F.col("r.prepared")), "distance": distance})


def matches(score: Column, threshold: float) -> Column:
    """The one place where a threshold decides."""
    return score >= F.lit(float(threshold))


def best_matches(scored: DataFrame, threshold: float) -> DataFrame:
    """For each left record its best candidate: highest score, then least distance, then least record id."""
    order = W.partitionBy(F.col("l.source"), F.col("l.ordinal")).orderBy(F.desc("score"), "distance", F.col("r.record_id"))
    return scored.where(matches(F.col("score"), threshold)).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def _near(rows: DataFrame) -> DataFrame:
    """Each row nine times: with the cell it lies in and the eight around it."""
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    rows = rows.withColumn("o", F.explode(offsets))
    return rows.withColumns({"cell_row": F.col("cell_row") + F.col("o.i"), "cell_col": F.col("cell_col") + F.col("o.j")}).drop("o")


def _meet(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """The equi-join on the cell, left's rows at their neighbours too. The rows are few and their pairs are many: the
    number of tasks is held, and a cell's left rows are dealt to SHARES tasks by their key."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    on = ["cell_row", "cell_col", "share"]
    left = _near(left.withColumn("share", F.pmod(F.xxhash64(*key), F.lit(SHARES)).cast("int"))).repartition(n, *on)
    right = right.withColumn("share", F.explode(F.array(*map(F.lit, range(SHARES))))).repartition(n, *on)
    return left.join(right.hint("shuffle_hash"), on).drop(*on)


def best_links(left: DataFrame, right: DataFrame, scorer: Scorer, threshold: float, cell_size: float = CELL_SIZE) -> DataFrame:
    """l_source, l_ordinal and, where a candidate meets the threshold, score, distance, r_source, r_ordinal of the best
    one: a row for each left record that has candidates. Records of one place and name are alike in score and distance,
    so each such class is compared once, the right ones by their least record id; the links are then given to all."""
    kinds = []
    for side, rows in (("l", left), ("r", right)):
        rows = rows.where(identity.has_coordinates(F.col("latitude"), F.col("longitude")))
        if side == "r":
            rows = with_identity(rows).groupBy(*PLACED).agg(F.min(F.struct(F.col("record_id").alias("id"), "source", "ordinal")).alias("first"))
        else:
            rows = rows.select(*PLACED).distinct()
        rows = with_cell(prepared(rows, scorer), cell_size).where("cell_row IS NOT NULL AND cell_col IS NOT NULL")
        kinds.append(rows.select(*(F.col(c).alias(f"{side}_{c}") for c in (*PLACED, "prepared")), *(["first"] if side == "r" else []), "cell_row", "cell_col"))
    key = [f"l_{c}" for c in PLACED]
    pairs = _meet(*kinds, key).withColumn("score", scorer.score(F.col("l_prepared"), F.col("r_prepared")))
    distance = identity.haversine_km(*(F.col(c) for c in ("l_latitude", "l_longitude", "r_latitude", "r_longitude")))
    ranked = F.struct((-F.col("score")).alias("down"), distance.alias("distance"), F.col("first.id").alias("id"), F.col("first.source").alias("source"), F.col("first.ordinal").alias("ordinal"))
    best = pairs.where(matches(F.col("score"), threshold)).groupBy(*key).agg(F.min(ranked).alias("best"))
    reach = _near(kinds[1].select("cell_row", "cell_col").distinct()).distinct()
    met = kinds[0].join(reach.hint("merge"), ["cell_row", "cell_col"], "left_semi").select(*(F.col(c).alias(f"m_{c[2:]}") for c in key))

    def same(one: str, other: str) -> Column:
        return (F.col(f"{one}latitude") == F.col(f"{other}latitude")) & (F.col(f"{one}longitude") == F.col(f"{other}longitude")) & F.col(f"{one}name").eqNullSafe(F.col(f"{other}name"))

    of = left.select("source", "ordinal", *PLACED).join(met.join(best.hint("merge"), same("m_", "l_"), "left").hint("merge"), same("", "m_"))
    return of.select(F.col("source").alias("l_source"), F.col("ordinal").alias("l_ordinal"), (-F.col("best.down")).alias("score"), "best.distance", F.col("best.source").alias("r_source"), F.col("best.ordinal").alias("r_ordinal"))


def candidate_scores(left: DataFrame, right: DataFrame, score: Callable[[Column, Column], Column], cell_size: float = CELL_SIZE) -> DataFrame:
    """l and r, the (source, ordinal) of every candidate pair, and the score of their names, which is computed once for
    each two names of two cells and given to all pairs of their records. What shares a cell and a name goes through the
    join in groups of about GROUP records."""
    groups = []
    for side, rows in (("l", left), ("r", right)):
        rows = with_cell(rows, cell_size).where("cell_row IS NOT NULL AND cell_col IS NOT NULL").select(F.struct("source", "ordinal").alias("key"), "name", "cell_row", "cell_col")
        many = rows.groupBy("cell_row", "cell_col", "name").agg(F.count("*").alias("n")).where(F.col("n") > GROUP)
        many = many.select(F.col("cell_row").alias("i"), F.col("cell_col").alias("j"), F.col("name").alias("of"), F.ceil(F.col("n") / GROUP).alias("parts"))
        rows = rows.join(many.hint("merge"), (F.col("cell_row") == F.col("i")) & (F.col("cell_col") == F.col("j")) & F.col("name").eqNullSafe(F.col("of")), "left")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))))
        rows = rows.groupBy("cell_row", "cell_col", "name", "part").agg(F.collect_list("key").alias("keys"))
        groups.append(rows.select("cell_row", "cell_col", *(F.col(c).alias(f"{side}_{c}") for c in ("name", "part", "keys"))))
    pairs = _meet(*groups, ["l_name", "l_part"]).select("l_keys", "r_keys", score(F.col("l_name"), F.col("r_name")).alias("score"))
    return pairs.select(F.explode("l_keys").alias("l"), "r_keys", "score").select("l", F.explode("r_keys").alias("r"), "score")


def merged(l: Column, r: Column) -> Column:  # noqa: E741
    """The better filled record's values first; of equally filled ones the lesser id's. Both sides' sources."""
    fill = [identity.populatedness(x["fields"], x["name"], x["latitude"], x["longitude"]) for x in (l, r)]
    first = F.when(fill[0] != fill[1], fill[0] > fill[1]).otherwise(l["record_id"] <= r["record_id"])

    def pick(column: str, winner: bool = True) -> Column:
        return F.when(first == F.lit(winner), l[column]).otherwise(r[column])

    own = {s: identity.has_coordinates(x["latitude"], x["longitude"]) for s, x in (("l", l), ("r", r))}
    left_place = F.when(own["l"] & own["r"], first).otherwise(own["l"])
    return F.struct(
        pick("name").alias("name"),
        F.when(left_place, l["latitude"]).otherwise(r["latitude"]).alias("latitude"),
        F.when(left_place, l["longitude"]).otherwise(r["longitude"]).alias("longitude"),
        F.map_zip_with(pick("fields"), pick("fields", False), lambda _, a, b: F.coalesce(a, b)).alias("fields"),
        F.array_sort(F.array_distinct(F.array(l["source"], r["source"]))).alias("sources"),
    )


@dataclass(frozen=True)
class Resolution:
    """pairs: l, r, score, distance, merged; unmatched: the records and a reason; occupancy: of the right side; links:
    what all of them are made of. One plan computes the links once, as its branches share their exchange; who runs
    several calls keep() first and close() at the end."""

    pairs: DataFrame
    unmatched: DataFrame
    occupancy: DataFrame
    links: DataFrame

    @property
    def merged(self) -> DataFrame:
        single = self.unmatched.select("name", "latitude", "longitude", "fields", F.array("source").alias("sources"))
        return self.pairs.select("merged.*").unionByName(single)

    def keep(self) -> Resolution:
        """Keeps the links, a row for each left record with candidates; lost parts are computed anew."""
        self.links.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def close(self) -> None:
        self.links.unpersist()


RECORD = ("side", "source", "ordinal", "name", "latitude", "longitude", "fields")


def resolve(left: DataFrame, right: DataFrame, scorer: Scorer, threshold: float, cell_size: float = CELL_SIZE) -> Resolution:
    links = best_links(left, right, scorer, threshold, cell_size)
    left, right = left.select(*RECORD), right.select(*RECORD)
    found = links.where("r_ordinal IS NOT NULL")
    wide = [with_identity(rows).select(F.struct(*RECORD, "record_id").alias(side), F.col("source").alias(f"{side}_source"), F.col("ordinal").alias(f"{side}_ordinal")) for side, rows in (("l", left), ("r", right))]
    pairs = found.join(wide[0].hint("merge"), ["l_source", "l_ordinal"]).join(wide[1].hint("merge"), ["r_source", "r_ordinal"]).select("l", "r", "score", "distance")
    pairs = pairs.withColumn("merged", merged(F.col("l"), F.col("r")))
    coords = identity.has_coordinates(F.col("latitude"), F.col("longitude"))
    met = links.select(F.col("l_source").alias("source"), F.col("l_ordinal").alias("ordinal"), F.col("r_ordinal").isNotNull().alias("matched"))
    lefts = left.join(met.hint("merge"), ["source", "ordinal"], "left").where(~F.coalesce("matched", F.lit(False)))
    lefts = lefts.withColumn("reason", F.when(~coords, NO_COORDINATES).when(F.col("matched").isNull(), NO_CANDIDATES).otherwise(BELOW_THRESHOLD))
    taken = found.select(F.col("r_source").alias("source"), F.col("r_ordinal").alias("ordinal")).distinct()
    rights = right.join(taken.hint("merge"), ["source", "ordinal"], "left_anti").withColumn("reason", F.when(coords, NOT_SELECTED).otherwise(NO_COORDINATES))
    return Resolution(pairs, lefts.select(*RECORD, "reason").unionByName(rights.select(*RECORD, "reason")), bucket_occupancy(right, cell_size), links)
