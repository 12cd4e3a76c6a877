"""Every registered query of the library's own operators, with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlink.functions import identity, metrics, text, vectors
from gridlink.operators import evaluation as ev
from gridlink.operators import ranks
from gridlink.operators import resolve as rs
from gridlink.plans import fixtures as fx
from gridlink.sources import corpus

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Oracle fragments; the test tables are ASCII.
_NORM = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_TOKENS = f"list_distinct(list_filter(string_split({_NORM}, ' '), lambda x: x <> ''))"
_SIZE = "cast(0.0625 as double)"
_CANON = """'{"fields":{"brand":"' || f_brand || CASE WHEN side = 'right' THEN '","size":"' || f_size ELSE '' END || '","type":"' || f_type || '"},"latitude":'
 || coalesce(latitude::VARCHAR, 'null') || ',"longitude":' || coalesce(longitude::VARCHAR, 'null') || ',"name":' || coalesce('"' || name || '"', 'null') || '}'"""
_REC = f"rec AS ({fx.RECORDS}), recs AS (SELECT *, {_CANON} AS canon, {_TOKENS.format('name')} AS toks, CASE WHEN longitude IS NOT NULL THEN floor(latitude / {_SIZE})::BIGINT END AS cr, CASE WHEN latitude IS NOT NULL THEN floor(longitude / {_SIZE})::BIGINT END AS cc FROM rec), ids AS (SELECT *, sha256(source || chr(0) || canon || chr(0) || ordinal) AS rid FROM recs)"
_DIST = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(r.latitude - l.latitude) / 2), 2) + cos(radians(l.latitude)) * cos(radians(r.latitude)) * pow(sin(radians(r.longitude - l.longitude) / 2), 2))))"
_OVERLAP = "CASE WHEN least(len({0}), len({1})) > 0 THEN len(list_intersect({0}, {1})) / least(len({0}), len({1})) ELSE 0.0 END"
_CAND = f"{_REC}, cand AS (SELECT l.ordinal AS lo, r.ordinal AS ro, r.rid AS rid, {_OVERLAP.format('l.toks', 'r.toks')} AS score, {_DIST} AS dist FROM ids l JOIN ids r ON l.side = 'left' AND r.side = 'right' AND abs(l.cr - r.cr) <= 1 AND abs(l.cc - r.cc) <= 1)"
_BEST = f"{_CAND}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lo ORDER BY score DESC, dist, rid) AS rk FROM cand WHERE score >= 0.5) WHERE rk = 1)"


def _resolution(spark: SparkSession, sf_dir: str) -> rs.Resolution:
    left, right = fx.sides(spark, sf_dir)
    return rs.resolve(left, right, rs.get_scorer("overlap"), fx.THRESHOLD, fx.CELL)


@query(f"WITH {_BEST} SELECT lo AS left_ordinal, ro AS right_ordinal, score, round(dist, 6) AS distance_km FROM best")
def resolve(spark, sf_dir) -> DataFrame:
    return _resolution(spark, sf_dir).pairs.select(F.col("l.ordinal").alias("left_ordinal"), F.col("r.ordinal").alias("right_ordinal"), "score", F.round("distance", 6).alias("distance_km"))


@query(f"""WITH {_BEST}, pop AS (SELECT *, (f_brand <> '')::INT + (f_type <> '')::INT + CASE WHEN side = 'right' THEN (f_size <> '')::INT ELSE 0 END + coalesce((name <> '')::INT, 0) + (latitude IS NOT NULL AND longitude IS NOT NULL)::INT AS p FROM ids),
m AS (SELECT lo, ro, l.p > r.p OR (l.p = r.p AND l.rid <= r.rid) AS w, l.name AS ln, r.name AS rn, l.latitude AS la, r.latitude AS ra, l.longitude AS lx, r.longitude AS rx, l.f_brand AS lb, r.f_brand AS rb, l.f_type AS lt, r.f_type AS rt, r.f_size AS sz
 FROM best JOIN pop l ON l.side = 'left' AND l.ordinal = lo JOIN pop r ON r.side = 'right' AND r.ordinal = ro)
SELECT lo AS left_ordinal, CASE WHEN w THEN ln ELSE rn END AS name, CASE WHEN w THEN la ELSE ra END AS latitude, CASE WHEN w THEN lx ELSE rx END AS longitude, CASE WHEN w THEN lb ELSE rb END AS brand, CASE WHEN w THEN lt ELSE rt END AS type, sz AS size, 'left,right' AS sources FROM m""")
def prj_merge(spark, sf_dir) -> DataFrame:
    m = F.col("merged")
    return _resolution(spark, sf_dir).pairs.select(F.col("l.ordinal").alias("left_ordinal"), m["name"].alias("name"), m["latitude"].alias("latitude"), m["longitude"].alias("longitude"), *(m["fields"][k].alias(k) for k in ("brand", "type", "size")), F.array_join(m["sources"], ",").alias("sources"))


_UNMATCHED = f"""WITH {_BEST}, n AS (SELECT lo FROM cand GROUP BY lo)
SELECT side, ordinal, CASE WHEN latitude IS NULL OR longitude IS NULL THEN '{rs.NO_COORDINATES}' WHEN n.lo IS NULL THEN '{rs.NO_CANDIDATES}' ELSE '{rs.BELOW_THRESHOLD.replace("'", "''")}' END AS reason
FROM ids LEFT JOIN n ON n.lo = ordinal WHERE side = 'left' AND ordinal NOT IN (SELECT lo FROM best)
UNION ALL SELECT side, ordinal, CASE WHEN latitude IS NULL OR longitude IS NULL THEN '{rs.NO_COORDINATES}' ELSE '{rs.NOT_SELECTED.replace("'", "''")}' END FROM ids WHERE side = 'right' AND ordinal NOT IN (SELECT ro FROM best)"""


@query(_UNMATCHED)
def join_unmatched(spark, sf_dir) -> DataFrame:
    return _resolution(spark, sf_dir).unmatched.select("side", "ordinal", "reason")


@query(f"WITH {_BEST} SELECT ordinal FROM ids WHERE side = 'right' AND ordinal IN (SELECT ro FROM best)")
def join_semi_matched(spark, sf_dir) -> DataFrame:
    left, right = fx.sides(spark, sf_dir)
    best = _resolution(spark, sf_dir).pairs.select(F.col("r.ordinal").alias("ordinal"))
    return right.join(best.hint("merge"), "ordinal", "left_semi").select("ordinal")


@query(f"WITH {_BEST}, used AS (SELECT ordinal, side FROM ids WHERE (side = 'left' AND ordinal IN (SELECT lo FROM best)) OR (side = 'right' AND ordinal IN (SELECT ro FROM best))) SELECT (SELECT count(*) FROM best) + (SELECT count(*) FROM ids) - (SELECT count(*) FROM used) AS n")
def set_merged(spark, sf_dir) -> DataFrame:
    return _resolution(spark, sf_dir).merged.agg(F.count("*").alias("n"))


@query(f"WITH {_CAND} SELECT lo AS left_ordinal, ro AS right_ordinal, score FROM cand")
def join_grid(spark, sf_dir) -> DataFrame:
    left, right = fx.sides(spark, sf_dir)
    rows = rs.scored_pairs(left, right, rs.get_scorer("overlap"), fx.CELL)
    return rows.select(F.col("l.ordinal").alias("left_ordinal"), F.col("r.ordinal").alias("right_ordinal"), "score")


@query(f"WITH {_CAND} SELECT lo AS left_ordinal, ro AS right_ordinal, round(dist, 6) AS km FROM cand")
def geo_haversine(spark, sf_dir) -> DataFrame:
    left, right = fx.sides(spark, sf_dir)
    km = identity.haversine_km(F.col("l.latitude"), F.col("l.longitude"), F.col("r.latitude"), F.col("r.longitude"))
    return rs.candidate_pairs(left, right, fx.CELL).select(F.col("l.ordinal").alias("left_ordinal"), F.col("r.ordinal").alias("right_ordinal"), F.round(km, 6).alias("km"))


@query(f"WITH {_CAND} SELECT lo AS left_ordinal, ro AS right_ordinal, score FROM cand")
def udf_prep_paths(spark, sf_dir) -> DataFrame:
    """The naive path: names prepared in the comparison itself; equal to the hoisted one."""
    left, right = fx.sides(spark, sf_dir)
    rows = rs.candidate_scores(left, right, lambda a, b: text.overlap(text.tokens(a), text.tokens(b)), fx.CELL)
    return rows.select(F.col("l.ordinal").alias("left_ordinal"), F.col("r.ordinal").alias("right_ordinal"), "score")


def _records_query(name: str, sql: str, *columns):
    def run(spark, sf_dir) -> DataFrame:
        return rs.with_cell(fx.records(spark, sf_dir), fx.CELL).select("side", "ordinal", *(c() for c in columns))

    run.__name__ = name
    query(f"WITH {_REC} SELECT side, ordinal, {sql} FROM ids")(run)


def _canon():
    return identity.canonical(F.col("fields"), F.col("latitude"), F.col("longitude"), F.col("name"))


_records_query("prj_canonical", "canon", lambda: _canon().alias("canon"))
_records_query("prj_content_id", "sha256(source || chr(0) || canon) AS content_id", lambda: identity.content_id(F.col("source"), _canon()).alias("content_id"))
_records_query("prj_record_id", "rid AS record_id", lambda: identity.record_id(F.col("source"), _canon(), F.col("ordinal")).alias("record_id"))
_records_query("prj_cell", "cr AS cell_row, cc AS cell_col", lambda: F.col("cell_row"), lambda: F.col("cell_col"))
_records_query("prj_populatedness", "(f_brand <> '')::INT + (f_type <> '')::INT + CASE WHEN side = 'right' THEN (f_size <> '')::INT ELSE 0 END + coalesce((name <> '')::INT, 0) + (latitude IS NOT NULL AND longitude IS NOT NULL)::INT AS populatedness", lambda: identity.populatedness(F.col("fields"), F.col("name"), F.col("latitude"), F.col("longitude")).alias("populatedness"))
_records_query("flt_coords", "latitude IS NOT NULL AND longitude IS NOT NULL AS located", lambda: identity.has_coordinates(F.col("latitude"), F.col("longitude")).alias("located"))
_records_query("str_normalise", _NORM.format("name") + " AS normal", lambda: text.normalise(F.col("name")).alias("normal"))
_records_query("str_tokens", "array_to_string(list_sort(toks), ' ') AS tokens", lambda: F.array_join(F.array_sort(text.tokens(F.col("name"))), " ").alias("tokens"))
_records_query("flt_blank", "nullif(trim(name), '') AS cleaned", lambda: text.clean(F.col("name")).alias("cleaned"))


@query(f"WITH {_REC} SELECT cr AS cell_row, cc AS cell_col, count(*) AS n FROM ids WHERE side = 'right' AND cr IS NOT NULL AND cc IS NOT NULL GROUP BY ALL")
def agg_occupancy(spark, sf_dir) -> DataFrame:
    return rs.bucket_occupancy(fx.sides(spark, sf_dir)[1], fx.CELL)


@query(f"WITH {_REC}, o AS (SELECT count(*) AS n FROM ids WHERE side = 'right' AND cr IS NOT NULL AND cc IS NOT NULL GROUP BY cr, cc) SELECT count(*) AS cells, max(n) AS most, sum(n)::BIGINT AS records FROM o")
def agg_max_occupancy(spark, sf_dir) -> DataFrame:
    return rs.bucket_occupancy(fx.sides(spark, sf_dir)[1], fx.CELL).agg(F.count("*").alias("cells"), F.max("n").alias("most"), F.sum("n").alias("records"))


_SCORED = f"pairs AS ({fx.PAIRS}), tk AS (SELECT *, {_TOKENS.format('left_name')} AS a, {_TOKENS.format('right_name')} AS b FROM pairs), scored AS (SELECT *, {_OVERLAP.format('a', 'b')} AS score FROM tk)"
_RATES = "tp / nullif(pp, 0) AS p, tp / nullif(ap, 0) AS r"
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END"


def _counted(where: str, by: str, threshold: str = "0.5") -> str:
    group = f"GROUP BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return f"SELECT {cols}sum(CASE WHEN score >= {threshold} THEN label ELSE 0 END)::BIGINT AS tp, sum((score >= {threshold})::INT)::BIGINT AS pp, sum(label)::BIGINT AS ap, count(*) AS n FROM scored {where} {group}"


def _scored(spark, sf_dir, role: str | None = None) -> DataFrame:
    rows = fx.pairs(spark, sf_dir)
    return ev.score_pairs(rows.where(F.col("role") == role) if role else rows, rs.get_scorer("overlap"))


def _flat(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, "tp", "pp", "ap", "n", "false_positives", *(F.col(f"{m}.value").alias(m) for m in ("precision", "recall", "f1")), *(F.col(f"{m}.undefined_reason").alias(f"{m}_reason") for m in ("precision", "recall")))


_FLAT_SQL = f"tp, pp, ap, n, pp - tp AS false_positives, p AS precision, r AS recall, {_F1} AS f1, CASE WHEN p IS NULL THEN '{metrics.NO_PREDICTED}' END AS precision_reason, CASE WHEN r IS NULL THEN '{metrics.NO_ACTUAL}' END AS recall_reason"


@query(f"WITH {_SCORED} SELECT pair_no, score FROM scored")
def sim_overlap(spark, sf_dir) -> DataFrame:
    return _scored(spark, sf_dir).select("pair_no", "score")


@query(f"WITH {_SCORED} SELECT pair_no, round(jaro_winkler_similarity({_NORM.format('left_name')}, {_NORM.format('right_name')}), 6) AS score FROM scored")
def sim_jw(spark, sf_dir) -> DataFrame:
    a, b = (text.normalise(F.col(c)) for c in ("left_name", "right_name"))
    return fx.pairs(spark, sf_dir).select("pair_no", F.round(text.jaro_winkler_column(a, b), 6).alias("score"))


@query()
def sim_fuzzy(spark, sf_dir) -> DataFrame:
    return ev.score_pairs(fx.pairs(spark, sf_dir), rs.get_scorer("fuzzy")).select("pair_no", "score")


@query(f"WITH {_SCORED} SELECT pair_no FROM scored WHERE score >= 0.5")
def flt_threshold(spark, sf_dir) -> DataFrame:
    return _scored(spark, sf_dir).where(rs.matches(F.col("score"), 0.5)).select("pair_no")


@query(f"WITH {_SCORED} SELECT pair_no FROM scored WHERE role = 'calibration'")
def flt_role(spark, sf_dir) -> DataFrame:
    return fx.pairs(spark, sf_dir).where(F.col("role") == ev.CALIBRATION).select("pair_no")


@query(f"WITH {_SCORED}, c AS ({_counted('', 'category')}), m AS (SELECT *, {_RATES} FROM c) SELECT category AS family, {_FLAT_SQL} FROM m")
def agg_family(spark, sf_dir) -> DataFrame:
    return _flat(ev.per_family(_scored(spark, sf_dir), 0.5), "family")


@query(f"WITH {_SCORED}, c AS ({_counted('', '')}), m AS (SELECT *, {_RATES} FROM c) SELECT {_FLAT_SQL} FROM m")
def agg_aggregate(spark, sf_dir) -> DataFrame:
    return _flat(ev.aggregate(ev.per_family(_scored(spark, sf_dir), 0.5)))


_SWEEP = """each AS (SELECT score, sum(label) AS t, count(*) AS c FROM scored WHERE role = 'calibration' GROUP BY score),
run AS (SELECT score, (sum(t) OVER d)::BIGINT AS tp, (sum(c) OVER d)::BIGINT AS pp, (sum(t) OVER ())::BIGINT AS ap FROM each WINDOW d AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, tp / nullif(pp, 0) AS p, tp / nullif(ap, 0) AS r FROM run), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END AS f1 FROM m)"""


@query(f"WITH {_SCORED}, {_SWEEP} SELECT score, tp, pp, ap, f1 FROM f")
def win_sweep(spark, sf_dir) -> DataFrame:
    return ev.threshold_sweep(_scored(spark, sf_dir, ev.CALIBRATION))


@query(f"WITH {_SCORED}, {_SWEEP} SELECT score AS threshold, f1 FROM f ORDER BY f1 DESC NULLS LAST, score LIMIT 1")
def agg_threshold(spark, sf_dir) -> DataFrame:
    return ev.select_threshold(_scored(spark, sf_dir, ev.CALIBRATION))


_SEALED = _counted("WHERE role = 'sealed test'", "category", "(SELECT score FROM f ORDER BY f1 DESC NULLS LAST, score LIMIT 1)")


@query(f"WITH {_SCORED}, {_SWEEP}, c AS ({_SEALED}), m2 AS (SELECT *, {_RATES} FROM c) SELECT category AS family, {_FLAT_SQL} FROM m2")
def ev_sealed(spark, sf_dir) -> DataFrame:
    """The threshold comes from the calibration split and is frozen; the sealed split is judged by it."""
    pairs, scorer = fx.pairs(spark, sf_dir), rs.get_scorer("overlap")
    return _flat(ev.evaluate_sealed(pairs, scorer, ev.freeze(ev.choose_threshold(pairs, scorer))), "family")


_BY_SEED = f"c AS ({_counted('', 'category, seed')}), m AS (SELECT *, {_RATES} FROM c), s AS (SELECT *, {_F1} AS f1 FROM m)"


@query(f"WITH {_SCORED}, {_BY_SEED} SELECT category AS family, round(stddev_samp(p), 6) AS precision_stdev, round(stddev_samp(r), 6) AS recall_stdev, round(stddev_samp(f1), 6) AS f1_stdev, CASE WHEN count(f1) < 2 THEN 'only ' || count(f1) || ' of ' || count(*) || ' seed(s) produced a defined F1 for this family' END AS f1_reason, count(DISTINCT seed) AS seeds FROM s GROUP BY category")
def agg_variation(spark, sf_dir) -> DataFrame:
    rows = ev.variation(ev.per_family(_scored(spark, sf_dir), 0.5, ("seed",)))
    return rows.select("family", *(F.round(f"{m}_stdev.value", 6).alias(f"{m}_stdev") for m in ev.METRICS), F.col("f1_stdev.undefined_reason").alias("f1_reason"), "seeds")


@query(f"WITH {_SCORED}, a AS ({_counted('', 'category')}), b AS ({_counted('', 'category', '0.6')}), am AS (SELECT *, {_RATES} FROM a), bm AS (SELECT *, {_RATES} FROM b) SELECT am.category AS family, round(bm.p - am.p, 9) AS precision_delta, round(bm.r - am.r, 9) AS recall_delta FROM am JOIN bm USING (category)")
def join_divergence(spark, sf_dir) -> DataFrame:
    scored = _scored(spark, sf_dir)
    rows = ev.divergence(ev.per_family(scored, 0.5), ev.per_family(scored, 0.6))
    return rows.select("family", *(F.round(f"{m}_delta.value", 9).alias(f"{m}_delta") for m in ("precision", "recall")))


_ARMS = fx.arms_sql()
_BEATEN = f"""pts AS (SELECT * FROM {_ARMS}), live AS (SELECT *, count(*) FILTER (f1 IS NULL) OVER (PARTITION BY family) = 0 AS whole FROM pts),
d AS (SELECT a.family, a.arm, arg_min(b.arm, b.position) AS dominated_by FROM live a JOIN live b ON a.family = b.family AND b.fp <= a.fp AND b.rss <= a.rss AND b.p50 <= a.p50 AND (NOT a.whole OR b.f1 >= a.f1)
 AND (b.fp < a.fp OR b.rss < a.rss OR b.p50 < a.p50 OR (a.whole AND b.f1 > a.f1)) GROUP BY a.family, a.arm)"""


@query(f"WITH {_BEATEN} SELECT pts.family, pts.arm, dominated_by, CASE WHEN dominated_by IS NULL THEN 'frontier' ELSE 'dominated' END AS status FROM pts LEFT JOIN d USING (family, arm)")
def frontier(spark, sf_dir) -> DataFrame:
    return ev.frontier(fx.arms(spark)).select("family", "arm", "dominated_by", "status")


@query(f"""SELECT family, arm, CASE WHEN f1 IS NULL THEN 'F1 is undefined for ''' || family || ''': no value — cannot be compared against the stated accuracy floor' WHEN f1 < 0.76 THEN 'F1 ' || printf('%.3f', f1) || ' is below the stated floor 0.760'
 WHEN rss > 250e6 THEN 'peak RSS ' || printf('%.0f', rss) || ' bytes exceeds the stated ceiling 250000000 bytes' WHEN p50 > 2e-5 THEN 'warm p50 ' || printf('%.9f', p50) || 's exceeds the stated ceiling 0.000020000s'
 WHEN fp > 100 THEN 'false positives ' || fp::BIGINT || ' exceeds the stated ceiling 100' END AS excluded_reason FROM {_ARMS}""")
def flt_constraints(spark, sf_dir) -> DataFrame:
    return ev.frontier(fx.arms(spark), min_f1=0.76, max_rss=250e6, max_p50=2e-5, max_fp=100).select("family", "arm", "excluded_reason")


_EXPECTED = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in fx.EXPECTED) + ") e(family, expected)"


@query(f"WITH k AS (SELECT * FROM {_ARMS} WHERE f1 IS NOT NULL), t AS (SELECT family, max(f1) AS top FROM k GROUP BY family HAVING count(*) > 1) SELECT e.family, e.expected, string_agg(w.arm, ',' ORDER BY w.arm) AS actual_winners FROM {_EXPECTED} JOIN k ON k.family = e.family AND k.arm = e.expected JOIN t ON t.family = e.family JOIN k w ON w.family = e.family AND w.f1 = top WHERE k.f1 < top GROUP BY e.family, e.expected")
def join_contradictions(spark, sf_dir) -> DataFrame:
    return ev.contradictions(fx.expected(spark), fx.arms(spark)).withColumn("actual_winners", F.array_join("actual_winners", ","))


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, v[least(len(v) - 1, floor(0.5 * len(v))::BIGINT) + 1] AS p50, v[least(len(v) - 1, floor(0.99 * len(v))::BIGINT) + 1] AS p99 FROM l")
def agg_percentile(spark, sf_dir) -> DataFrame:
    """By running totals: a type's values are never in one task."""
    places = {name: (F.least(F.col("n") - 1, F.floor(F.lit(f) * F.col("n"))),) for name, f in (("p50", 0.5), ("p99", 0.99))}
    return ranks.order_statistics(_events(spark, sf_dir), "value", ("event_type",), places).drop("n")


@query("SELECT event_type, count(value) AS n, round(median(value), 6) AS median, min(value) AS least, max(value) AS most FROM events WHERE value IS NOT NULL GROUP BY event_type")
def agg_latency_summary(spark, sf_dir) -> DataFrame:
    places = {"median": (F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)), "least": (F.lit(0),), "most": (F.col("n") - 1,)}
    return ranks.order_statistics(_events(spark, sf_dir), "value", ("event_type",), places).withColumn("median", F.round("median", 6))


_VEC = "v AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), d AS (SELECT vec_id, list_dot_product(x, y) AS xy, sqrt(list_dot_product(x, x)) AS nx, sqrt(list_dot_product(y, y)) AS ny FROM v)"


def _vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query(f"WITH {_VEC} SELECT vec_id, round(xy / (nx * ny), 6) AS cosine FROM d")
def vec_cosine(spark, sf_dir) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.round(vectors.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(f"WITH {_VEC} SELECT vec_id, round(greatest(0, least(1, (xy / (nx * ny) + 1) / 2)), 6) AS score FROM d")
def sim_cosine01(spark, sf_dir) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.round(vectors.cosine01(F.col("x"), F.col("y")), 6).alias("score"))


@query(f"WITH {_VEC} SELECT v.vec_id, round(v.x[1] / nx, 6) AS first, round(v.x[64] / nx, 6) AS last FROM v JOIN d USING (vec_id)")
def vec_l2(spark, sf_dir) -> DataFrame:
    unit = vectors.l2_normalise(F.col("x"))
    return _vectors(spark, sf_dir).select("vec_id", F.round(unit[0], 6).alias("first"), F.round(unit[63], 6).alias("last"))


@query("SELECT label, i AS place, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE vec_id % 3 <> 0) GROUP BY label, i")
def agg_mean_pool(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", (F.col("vec_id") % 3 != 0).cast("int").alias("mask"), F.posexplode("embedding").alias("place", "x"))
    held = F.when(F.col("mask") == 1, F.col("x").cast("double"))
    pooled = rows.groupBy("label", "place").agg(F.round(F.avg(held), 6).alias("mean"), F.sum("mask").alias("n"))
    return pooled.where("n > 0").drop("n")


@query(f"WITH pairs AS ({fx.PAIRS}) SELECT category, count(*) AS n, string_agg(DISTINCT seed, ',' ORDER BY seed) AS seeds FROM pairs GROUP BY category")
def agg_case_mixture(spark, sf_dir) -> DataFrame:
    return corpus.case_mixture(fx.pairs(spark, sf_dir)).withColumn("seeds", F.array_join("seeds", ","))


@query(f"WITH pairs AS ({fx.PAIRS}), twice AS (SELECT pair_no FROM pairs UNION ALL SELECT pair_no FROM pairs WHERE pair_no % 7 = 0) SELECT pair_no, count(*) AS n FROM twice GROUP BY pair_no HAVING count(*) > 1")
def set_dup_ids(spark, sf_dir) -> DataFrame:
    rows = fx.pairs(spark, sf_dir).select("pair_no")
    return corpus.repeated_ids(rows.unionByName(rows.where("pair_no % 7 = 0")), "pair_no")


@query(f"WITH pairs AS ({fx.PAIRS}) SELECT pair_no, 'missing' AS problem FROM pairs WHERE pair_no % 9 = 0 UNION ALL SELECT -1 - pair_no, 'extra' FROM pairs WHERE pair_no % 11 = 0")
def set_roles_cover(spark, sf_dir) -> DataFrame:
    ids = fx.pairs(spark, sf_dir).select("pair_no")
    roles = ids.where("pair_no % 9 <> 0").unionByName(ids.where("pair_no % 11 = 0").select((-1 - F.col("pair_no")).alias("pair_no")))
    return corpus.coverage(ids, roles, "pair_no")


@query(f"WITH pairs AS ({fx.PAIRS}) SELECT format('{{:04d}}-{{}}-{{:03d}}', seed, replace(lower(category), ' ', '-'), pair_no) AS pair_id FROM pairs")
def src_pairs_build(spark, sf_dir) -> DataFrame:
    slug = F.replace(F.lower("category"), F.lit(" "), F.lit("-"))
    return fx.pairs(spark, sf_dir).select(F.format_string("%04d-%s-%03d", "seed", slug, "pair_no").alias("pair_id"))
