"""Registered queries of formats, refusals, embeddings, model files, reports and record sets of several sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlink.functions import formats, identity, vectors
from gridlink.operators import embedding
from gridlink.operators import evaluation as ev
from gridlink.operators import ranks
from gridlink.operators import resolve as rs
from gridlink.plans import fixtures as fx
from gridlink.plans import registry as base
from gridlink.reports import benchmark, measure
from gridlink.sources import artifacts, published

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- record sets of several sources, whose ordinals meet -----------------------------------------------------------

_SOURCES = f"""rec AS ({fx.RECORDS}), src AS (SELECT side, source || (p.n % 4)::INT::VARCHAR AS source, (p.n - p.n % 4) // 4 AS ordinal, name, latitude, longitude, f_brand, f_type, f_size
 FROM (SELECT *, ordinal AS n FROM rec) p)"""
_IDS = f"""{_SOURCES}, recs AS (SELECT *, {base._CANON} AS canon, {base._TOKENS.format('name')} AS toks, CASE WHEN longitude IS NOT NULL THEN floor(latitude / {base._SIZE})::BIGINT END AS cr,
 CASE WHEN latitude IS NOT NULL THEN floor(longitude / {base._SIZE})::BIGINT END AS cc FROM src), ids AS (SELECT *, sha256(source || chr(0) || canon || chr(0) || ordinal) AS rid FROM recs)"""
_LINKS = f"""{_IDS}, cand AS (SELECT l.source AS ls, l.ordinal AS lo, r.source AS rs, r.ordinal AS ro, r.rid AS rid, {base._OVERLAP.format('l.toks', 'r.toks')} AS score, {base._DIST} AS dist
 FROM ids l JOIN ids r ON l.side = 'left' AND r.side = 'right' AND abs(l.cr - r.cr) <= 1 AND abs(l.cc - r.cc) <= 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ls, lo ORDER BY score DESC, dist, rid) AS rk FROM cand WHERE score >= 0.5) WHERE rk = 1)"""


def _several(spark, sf_dir) -> rs.Resolution:
    n = F.col("ordinal") % 4
    rows = fx.records(spark, sf_dir).withColumns({"source": F.concat("source", n.cast("string")), "ordinal": F.floor(F.col("ordinal") / 4)})
    return rs.resolve(rows.where("side = 'left'"), rows.where("side = 'right'"), rs.get_scorer("overlap"), fx.THRESHOLD, fx.CELL)


@query(f"WITH {_LINKS} SELECT ls AS left_source, lo AS left_ordinal, rs AS right_source, ro AS right_ordinal, score, round(dist, 6) AS distance_km FROM best")
def resolve_sources(spark, sf_dir) -> DataFrame:
    pairs = _several(spark, sf_dir).pairs
    return pairs.select(F.col("l.source").alias("left_source"), F.col("l.ordinal").alias("left_ordinal"), F.col("r.source").alias("right_source"), F.col("r.ordinal").alias("right_ordinal"), "score", F.round("distance", 6).alias("distance_km"))


@query(f"""WITH {_LINKS}, n AS (SELECT DISTINCT ls, lo FROM cand)
SELECT side, source, ordinal, CASE WHEN latitude IS NULL OR longitude IS NULL THEN '{rs.NO_COORDINATES}' WHEN n.lo IS NULL THEN '{rs.NO_CANDIDATES}' ELSE '{rs.BELOW_THRESHOLD.replace("'", "''")}' END AS reason
FROM ids LEFT JOIN n ON n.lo = ordinal AND n.ls = source WHERE side = 'left' AND NOT EXISTS (SELECT 1 FROM best WHERE ls = source AND lo = ordinal)
UNION ALL SELECT side, source, ordinal, CASE WHEN latitude IS NULL OR longitude IS NULL THEN '{rs.NO_COORDINATES}' ELSE '{rs.NOT_SELECTED.replace("'", "''")}' END
FROM ids WHERE side = 'right' AND NOT EXISTS (SELECT 1 FROM best b WHERE b.rs = source AND b.ro = ordinal)""")
def join_unmatched_sources(spark, sf_dir) -> DataFrame:
    return _several(spark, sf_dir).unmatched.select("side", "source", "ordinal", "reason")


@query(f"""WITH {_LINKS}, pop AS (SELECT *, (f_brand <> '')::INT + (f_type <> '')::INT + CASE WHEN side = 'right' THEN (f_size <> '')::INT ELSE 0 END + coalesce((name <> '')::INT, 0) + (latitude IS NOT NULL AND longitude IS NOT NULL)::INT AS p FROM ids),
m AS (SELECT l.p > r.p OR (l.p = r.p AND l.rid <= r.rid) AS w, l.name AS ln, r.name AS rn, l.latitude AS la, r.latitude AS ra, l.longitude AS lx, r.longitude AS rx, ls, rs
 FROM best JOIN pop l ON l.side = 'left' AND l.source = ls AND l.ordinal = lo JOIN pop r ON r.side = 'right' AND r.source = rs AND r.ordinal = ro)
SELECT CASE WHEN w THEN ln ELSE rn END AS name, CASE WHEN w THEN la ELSE ra END AS latitude, CASE WHEN w THEN lx ELSE rx END AS longitude, array_to_string(list_sort([ls, rs]), ',') AS sources FROM m
UNION ALL SELECT name, latitude, longitude, source FROM ids WHERE side = 'left' AND NOT EXISTS (SELECT 1 FROM best WHERE ls = source AND lo = ordinal)
UNION ALL SELECT name, latitude, longitude, source FROM ids WHERE side = 'right' AND NOT EXISTS (SELECT 1 FROM best b WHERE b.rs = source AND b.ro = ordinal)""")
def prj_merged_view(spark, sf_dir) -> DataFrame:
    """Every record of both sides, once or merged."""
    return _several(spark, sf_dir).merged.select("name", "latitude", "longitude", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {base._REC} SELECT side, ordinal, array_to_string(list_sort(toks), ' ') AS prepared FROM ids")
def join_prepared(spark, sf_dir) -> DataFrame:
    """Each distinct name prepared once and looked up by its records."""
    rows = rs.prepared_once(fx.records(spark, sf_dir), rs.get_scorer("overlap"))
    return rows.select("side", "ordinal", F.array_join(F.array_sort("prepared"), " ").alias("prepared"))


@query(f"WITH pairs AS ({fx.PAIRS}), f AS (SELECT left_name, right_name, pair_no, (row_number() OVER (ORDER BY pair_no) - 1) AS i FROM pairs ORDER BY pair_no LIMIT 10), g AS (SELECT *, CASE WHEN i < 1 THEN 0 WHEN i < 3 THEN 1 WHEN i < 6 THEN 2 ELSE 3 END AS cell FROM f) SELECT a.i AS left_ordinal, b.i AS right_ordinal, a.left_name, b.right_name FROM g a JOIN g b USING (cell)")
def prep_sample(spark, sf_dir) -> DataFrame:
    named = fx.pairs(spark, sf_dir).withColumn("pair_id", F.format_string("%09d", "pair_no"))
    got = benchmark.preparation_sample(spark, named)
    return spark.createDataFrame([(i, j, got["lefts"][i], got["rights"][j]) for i, j in got["pairs"]], "left_ordinal long, right_ordinal long, left_name string, right_name string")


@query(f"WITH {base._SCORED} SELECT left_name, right_name, label, category, pair_no AS pair_id FROM pairs")
def prj_as_record(spark, sf_dir) -> DataFrame:
    return fx.pairs(spark, sf_dir).select("left_name", "right_name", "label", "category", F.col("pair_no").alias("pair_id"))


# --- evaluation ----------------------------------------------------------------------------------------------------


@query(f"WITH {base._SCORED} SELECT sum(CASE WHEN score >= 0.5 THEN label ELSE 0 END)::BIGINT AS tp, sum((score >= 0.5)::INT)::BIGINT AS pp, sum(label)::BIGINT AS ap, count(*) AS n FROM scored")
def agg_counts(spark, sf_dir) -> DataFrame:
    scored = base._scored(spark, sf_dir)
    return scored.agg(*ev.counts(rs.matches(F.col("score"), 0.5), F.col("label")))


@query(f"WITH k AS (SELECT * FROM {base._ARMS} WHERE f1 IS NOT NULL) SELECT family, max(f1) AS top, string_agg(arm, ',' ORDER BY arm) FILTER (f1 = m) AS arms FROM (SELECT *, max(f1) OVER (PARTITION BY family) AS m FROM k) GROUP BY family")
def agg_family_max(spark, sf_dir) -> DataFrame:
    rows = fx.arms(spark).where("f1 IS NOT NULL")
    return ev.family_winners(rows).select("family", "top", F.array_join("winners", ",").alias("arms"))


@query(f"""WITH {base._SCORED}, r AS (SELECT * FROM scored WHERE NOT (seed = 2 AND category LIKE 'S%')), f AS (SELECT DISTINCT seed, category AS family FROM r),
a AS (SELECT seed, family FROM (SELECT DISTINCT seed FROM f), (SELECT DISTINCT family FROM f)) SELECT seed, family FROM a EXCEPT SELECT seed, family FROM f""")
def set_family_equal(spark, sf_dir) -> DataFrame:
    """Families that some seed's report lacks."""
    rows = base._scored(spark, sf_dir).where("NOT (seed = 2 AND category LIKE 'S%')")
    return ev.family_gaps(ev.per_family(rows, 0.5, ("seed",))).select("seed", "family")


@query(f"""WITH {base._SCORED}, {base._SWEEP}, t AS (SELECT score AS th FROM f ORDER BY f1 DESC NULLS LAST, score LIMIT 1),
c AS (SELECT category, seed, sum(CASE WHEN score >= th THEN label ELSE 0 END)::BIGINT AS tp, sum((score >= th)::INT)::BIGINT AS pp, sum(label)::BIGINT AS ap FROM scored, t WHERE role = 'sealed test' GROUP BY ALL),
s AS (SELECT *, tp / nullif(pp, 0) AS p, tp / nullif(ap, 0) AS r FROM c), s2 AS (SELECT *, {base._F1} AS f1 FROM s),
v AS (SELECT category AS family, round(stddev_samp(f1), 6) AS f1_stdev, CASE WHEN count(f1) < 2 THEN 'only ' || count(f1) || ' of ' || count(*) || ' seed(s) produced a defined F1 for this family' END AS f1_reason FROM s2 GROUP BY category),
q AS (SELECT category AS family, sum(tp)::BIGINT AS tp, sum(pp)::BIGINT AS pp, sum(ap)::BIGINT AS ap FROM c GROUP BY category)
SELECT q.family, tp, pp, ap, CASE WHEN v.f1_reason IS NULL THEN f1_stdev END AS f1_stdev, f1_reason FROM q JOIN v USING (family)""")
def ev_sealed_var(spark, sf_dir) -> DataFrame:
    """The pooled sealed test beside its deviation over seeds, under one frozen threshold."""
    pairs, scorer = fx.pairs(spark, sf_dir), rs.get_scorer("overlap")
    got = ev.evaluate_sealed_with_variation(pairs, scorer, ev.freeze(ev.choose_threshold(pairs, scorer)))
    spread = got["variation"].select("family", F.round("f1_stdev.value", 6).alias("f1_stdev"), F.col("f1_stdev.undefined_reason").alias("f1_reason"))
    return got["pooled"].select("family", "tp", "pp", "ap").join(spread, "family")


@query(f"WITH {base._SCORED} SELECT 'threshold selection read role ''sealed test'', not ''calibration'' — the sealed test is not scored with a threshold that may have seen it' AS reason")
def ev_freeze(spark, sf_dir) -> DataFrame:
    """A threshold that was found on the sealed test is refused."""
    selected = ev.SelectedThreshold("overlap", 0.5, ev.PROCEDURE, ev.SEALED, 1)
    got = ev.evaluate_sealed(fx.pairs(spark, sf_dir), rs.get_scorer("overlap"), ev.freeze(selected))
    return spark.createDataFrame([(got.reason,)], "reason string")


@query(f"WITH a AS (SELECT *, CASE WHEN f1 IS NULL THEN 'F1 is undefined for ''' || family || ''': no value — cannot be compared against the stated accuracy floor' WHEN f1 < 0.99 THEN 'F1 ' || printf('%.3f', f1) || ' is below the stated floor 0.990' WHEN rss > 250e6 THEN 'peak RSS ' || printf('%.0f', rss) || ' bytes exceeds the stated ceiling 250000000 bytes' END AS why FROM {base._ARMS}) SELECT family, string_agg(arm || ' (' || why || ')', '; ' ORDER BY position) AS reason FROM a GROUP BY family HAVING count(*) FILTER (why IS NULL) = 0")
def frontier_none(spark, sf_dir) -> DataFrame:
    """Families in which no arm qualifies, and why."""
    return ev.without_candidates(ev.frontier(fx.arms(spark), min_f1=0.99, max_rss=250e6))


@query(f"""WITH {base._BEATEN} SELECT d.family, d.arm, 'dominated by ''' || dominated_by || ''' (' || CASE WHEN whole THEN 'f1=' || printf('%.3f', l.f1) || ', ' ELSE '' END || 'false_positives=' || l.fp::BIGINT || ', peak RSS=' || printf('%.1f', l.rss / 1e6) || ' MB, warm p50=' || printf('%.2f', l.p50 * 1e6) || 'µs)' AS reason
FROM d JOIN live l ON l.family = d.family AND l.arm = d.dominated_by""")
def fmt_describe(spark, sf_dir) -> DataFrame:
    """Why an arm is off the frontier: the dominating point, described."""
    return ev.frontier(fx.arms(spark)).where("status = 'dominated'").select("family", "arm", "reason")


@query(f"SELECT family, round(c.f1 - b.f1, 9) AS delta, CASE WHEN b.f1 IS NULL THEN 'baseline F1 is undefined: no predicted positives' END AS reason FROM (SELECT * FROM {base._ARMS}) b JOIN (SELECT * FROM {base._ARMS}) c USING (family) WHERE b.arm = 'fp32' AND c.arm = 'int8'")
def int8_div(spark, sf_dir) -> DataFrame:
    """F1 of the quantized arm less that of the other."""
    def side(arm):
        own = F.struct(F.col("f1").alias("value"), F.when(F.col("f1").isNull(), "no predicted positives").alias("undefined_reason"))
        return fx.arms(spark).where(F.col("arm") == arm).select("family", *(own.alias(m) for m in ev.METRICS))

    return ev.divergence(side("fp32"), side("int8")).select("family", F.round("f1_delta.value", 9).alias("delta"), F.col("f1_delta.undefined_reason").alias("reason"))


@query("SELECT arm, grp, CASE WHEN hoisted > 0 THEN round(naive / hoisted, 6) END AS speedup, CASE WHEN hoisted <= 0 THEN 'hoisted preparation measured at 0 seconds' END AS reason FROM (VALUES ('overlap', 'classical', 3.0, 2.0), ('fuzzy', 'classical', 5.0, 0.0), ('embed-fp32', 'neural', 9.0, 3.0)) v(arm, grp, naive, hoisted)")
def asym(spark, sf_dir) -> DataFrame:
    """Speed-up by preparing names once, by group of arms."""
    costs = {"overlap": (3.0, 2.0), "fuzzy": (5.0, 0.0), "embed-fp32": (9.0, 3.0)}
    results = {a: {"preparation_cost": {"naive_p50_seconds": n, "hoisted_p50_seconds": h}} for a, (n, h) in costs.items()}
    got = benchmark.asymmetry(results, {})
    rows = [(a, grp, m.value, m.undefined_reason) for grp in ("classical", "neural") for a, m in got[f"{grp}_speedups"].items()]
    return spark.createDataFrame(rows, "arm string, grp string, speedup double, reason string").withColumn("speedup", F.round("speedup", 6))


# The published accuracy, to the digits that are published.
@query("""SELECT arm, threshold::DOUBLE AS threshold, n_calibration, n_sealed, precision::DOUBLE AS precision, recall::DOUBLE AS recall, f1::DOUBLE AS f1
FROM (VALUES ('overlap', 0.5, 430, 470, 0.6349, 0.8333, 0.7207207207), ('fuzzy', 0.9333333333, 430, 470, 0.975, 0.8125, 0.8863636364)) v(arm, threshold, n_calibration, n_sealed, precision, recall, f1)""")
def published_accuracy(spark, sf_dir) -> DataFrame:
    """Thresholds and pooled sealed accuracy of the classical arms, on the published pairs."""
    pairs, rows = published.generate(spark), None
    for arm in benchmark.CLASSICAL:
        scorer = rs.get_scorer(arm)
        chosen = ev.choose_threshold(pairs, scorer)
        total = ev.aggregate(ev.evaluate_sealed(pairs, scorer, ev.freeze(chosen)))
        row = total.select(F.lit(arm).alias("arm"), F.round(F.lit(chosen.value), 10).alias("threshold"), F.lit(chosen.n_pairs).alias("n_calibration"), F.col("n").cast("int").alias("n_sealed"), F.round("precision.value", 4).alias("precision"), F.round("recall.value", 4).alias("recall"), F.round("f1.value", 10).alias("f1"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query("""SELECT family, overlap::DOUBLE AS overlap, fuzzy::DOUBLE AS fuzzy FROM (VALUES ('abbreviation', 1.0, 0.974), ('exact', 1.0, 1.0), ('formatting', 1.0, 1.0), ('word order', 1.0, 1.0), ('transliteration', 1.0, 0.961), ('character noise', NULL, NULL), ('semantic alias', NULL, NULL), ('near-miss negative', NULL, NULL)) v(family, overlap, fuzzy)""")
def published_families(spark, sf_dir) -> DataFrame:
    """F1 by family of the classical arms, on the published pairs."""
    pairs, out = published.generate(spark), None
    for arm in benchmark.CLASSICAL:
        scorer = rs.get_scorer(arm)
        own = ev.evaluate_sealed(pairs, scorer, ev.freeze(ev.choose_threshold(pairs, scorer))).select("family", F.round("f1.value", 3).alias(arm))
        out = own if out is None else out.join(own, "family")
    return out


@query("WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, len(v) AS n, v[1] AS least, v[len(v)] AS most FROM l")
def ranks_ends(spark, sf_dir) -> DataFrame:
    """Order statistics at both ends, by running totals over buckets."""
    ends = {"least": (F.lit(0),), "most": (F.col("n") - 1,)}
    return ranks.order_statistics(_table(spark, sf_dir, "events"), "value", ("event_type",), ends)


# --- formats and facts ---------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, printf('%.1f MB', o_totalprice * 1000 / 1e6) AS mb FROM orders")
def fmt_mb(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", formats.megabytes(F.col("o_totalprice") * 1000).alias("mb"))


@query("SELECT o_orderkey, printf('%.2fµs', o_totalprice / 1e9 * 1e6) AS us FROM orders")
def fmt_us(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", formats.microseconds(F.col("o_totalprice") / 1e9).alias("us"))


@query("SELECT event_id, CASE WHEN value > 50 THEN printf('%.3f', value / 7) ELSE 'null (no predicted positives)' END AS metric FROM events")
def fmt_metric(spark, sf_dir) -> DataFrame:
    value = F.when(F.col("value") > 50, F.col("value") / 7)
    return _table(spark, sf_dir, "events").select("event_id", formats.metric_text(value, F.lit("no predicted positives")).alias("metric"))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') || '-benchmark.json' AS record_id FROM events")
def snk_record_id(spark, sf_dir) -> DataFrame:
    ts = F.to_utc_timestamp("ts", "UTC") if dict(_table(spark, sf_dir, "events").dtypes)["ts"] == "timestamp" else F.from_utc_timestamp(F.col("ts").cast("timestamp"), "UTC")
    return _table(spark, sf_dir, "events").select("event_id", formats.record_name(ts).alias("record_id"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'ac' WHEN 'signup' THEN 'battery' ELSE 'unknown' END AS battery_report, CASE event_type WHEN 'error' THEN 'ac' WHEN 'signup' THEN 'battery' ELSE 'unknown' END AS supply FROM events")
def pwr_parse(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    report = F.concat(F.lit("Now drawing from '"), F.when(kind == "error", "AC Power").when(kind == "signup", "Battery Power").otherwise("UPS"), F.lit("'"))
    status = F.when(kind == "error", "Charging\n").when(kind == "signup", " Discharging").otherwise("Unknown")
    return _table(spark, sf_dir, "events").select("event_id", formats.power_of_battery_report(report).alias("battery_report"), formats.power_of_supply_status(status).alias("supply"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS seconds, CASE WHEN event_type = 'error' THEN 'classical arms construct no session' END AS reason FROM events")
def phase_reason(spark, sf_dir) -> DataFrame:
    got = formats.phase(F.when(F.col("event_type") != "error", F.col("value")), measure.NO_SESSION)
    return _table(spark, sf_dir, "events").select("event_id", got["value"].alias("seconds"), got["undefined_reason"].alias("reason"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size::BIGINT ELSE p_size::BIGINT * 1024 END AS bytes FROM part")
def spike_rss(spark, sf_dir) -> DataFrame:
    platform = F.when(F.col("p_partkey") % 2 == 0, "Darwin").otherwise("linux")
    return _table(spark, sf_dir, "part").select("p_partkey", formats.peak_bytes(F.col("p_size").cast("long"), platform).alias("bytes"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN 'unresolved-see-model-card' ELSE p_type END AS license, CASE p_partkey % 4 WHEN 0 THEN 'cardData.license' WHEN 1 THEN 'tag' WHEN 2 THEN 'unresolved' ELSE 'tag' END AS source,
 CASE WHEN p_partkey % 3 = 0 THEN 'model.safetensors' ELSE 'pytorch_model.bin' END AS weights FROM part""")
def spike_license(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey") % 4
    card = F.when(k == 0, F.col("p_brand")).when(k == 3, F.lit(""))
    tag = F.when((k == 1) | (k == 3), F.concat(F.lit("license:"), F.col("p_type"))).otherwise("license:")
    got = formats.license_of(card, F.array(F.lit("en"), F.lit("license:"), tag))
    names = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("pytorch_model.bin"), F.lit("model.safetensors"))).otherwise(F.array(F.lit("README.md"), F.lit("pytorch_model.bin")))
    return _table(spark, sf_dir, "part").select("p_partkey", got["license"].alias("license"), got["source"].alias("source"), artifacts.weights_file(names).alias("weights"))


@query("SELECT * FROM (VALUES ('fp32', 'sentence-transformers/all-MiniLM-L6-v2', '1110a243fdf4706b3f48f1d95db1a4f5529b4d41', 'apache-2.0'), ('int8', 'sentence-transformers/all-MiniLM-L6-v2', '1110a243fdf4706b3f48f1d95db1a4f5529b4d41', 'apache-2.0')) v(arm, model_id, revision, license)")
def prj_model_identity(spark, sf_dir) -> DataFrame:
    rows = [(k, *(embedding.model_identity(k)[f] for f in ("model_id", "revision", "license"))) for k in ("fp32", "int8")]
    return spark.createDataFrame(rows, "arm string, model_id string, revision string, license string")


@query(f"WITH {base._REC} SELECT side, ordinal, '{{\"lat\":' || coalesce((latitude / 1000000)::VARCHAR, 'null') || ',\"lon\":' || coalesce((longitude * 10000000)::VARCHAR, 'null') || '}}' AS text FROM ids")
def prj_numbers(spark, sf_dir) -> DataFrame:
    """Very small and very large numbers in their canonical form."""
    lat, lon = (F.coalesce(identity.number_text(x), F.lit("null")) for x in (F.col("latitude") / 1000000, F.col("longitude") * 10000000))
    return fx.records(spark, sf_dir).select("side", "ordinal", F.concat(F.lit('{"lat":'), lat, F.lit(',"lon":'), lon, F.lit("}")).alias("text"))


# --- embeddings and model files ------------------------------------------------------------------------------------


class LetterEncoder:
    """Stands for a model: a token's vector is its length, its vowels, and whether it begins beyond m; a last token is masked."""

    def encode(self, texts):
        words = [t.split(" ") for t in texts]
        wide = max(map(len, words)) + 1
        tokens, mask = np.zeros((len(texts), wide, 3)), np.zeros((len(texts), wide), np.int64)
        for i, row in enumerate(words):
            for j, w in enumerate(row):
                tokens[i, j] = len(w), sum(w.count(v) for v in "aeiou"), float(w > "m")
                mask[i, j] = 1
            tokens[i, len(row) :] = 9.0
        return tokens, mask


_EMBEDDED = """w AS (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS w FROM part), t AS (SELECT p_partkey, avg(length(w)) AS a, avg(length(regexp_replace(w, '[^aeiou]', '', 'g'))) AS b, avg((w > 'm')::INT) AS c FROM w GROUP BY p_partkey),
e AS (SELECT p_partkey, a / n AS x, b / n AS y, c / n AS z FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM t))"""


def _embedded(rows: DataFrame) -> DataFrame:
    at = [F.round(F.col("prepared")[i], 6).alias(c) for i, c in enumerate("xyz")]
    return rows.select("p_partkey", *at)


@query(f"WITH {_EMBEDDED} SELECT p_partkey, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM e")
def emb_embed(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "part")
    return _embedded(rows.withColumn("prepared", embedding.embedder(LetterEncoder())(F.col("p_name"))))


@query(f"WITH {_EMBEDDED} SELECT p_partkey, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM e")
def emb_prepare_all(spark, sf_dir) -> DataFrame:
    """Each distinct name of the table encoded once."""
    return _embedded(embedding.embed_distinct(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), LetterEncoder(), "p_name"))


@query(f"WITH {_EMBEDDED} SELECT a.p_partkey, round(greatest(0, least(1, (a.x * b.x + a.y * b.y + a.z * b.z + 1) / 2)), 6) AS score FROM e a JOIN e b ON b.p_partkey = a.p_partkey + 1")
def emb_score(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    scorer = embedding.scorer("letters", LetterEncoder())
    both = rows.join(rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")
    return both.select("p_partkey", F.round(scorer.score(scorer.prepare(F.col("p_name")), scorer.prepare(F.col("other"))), 6).alias("score"))


@query("WITH v AS (SELECT a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), d AS (SELECT list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) AS c FROM v) SELECT round(1 - min(c), 6) AS max_divergence FROM d")
def agg_divergence_max(spark, sf_dir) -> DataFrame:
    return base._vectors(spark, sf_dir).agg(F.round(1 - F.min(vectors.cosine(F.col("x"), F.col("y"))), 6).alias("max_divergence"))


_OPS = "(SELECT CASE l_linenumber WHEN 1 THEN 'MatMul' WHEN 2 THEN 'MatMulInteger' WHEN 3 THEN 'QGemm' WHEN 4 THEN 'Add' ELSE 'DynamicQuantizeLinear' END AS op_type, count(*) AS n FROM lineitem GROUP BY 1)"


def _ops(spark, sf_dir) -> DataFrame:
    k = F.col("l_linenumber")
    kind = F.when(k == 1, "MatMul").when(k == 2, "MatMulInteger").when(k == 3, "QGemm").when(k == 4, "Add").otherwise("DynamicQuantizeLinear")
    return _table(spark, sf_dir, "lineitem").groupBy(kind.alias("op_type")).agg(F.count("*").alias("n"))


@query(f"WITH o AS {_OPS}, c(op_type, repl) AS (VALUES ('Gemm', 'QGemm'), ('MatMul', 'MatMulInteger')) SELECT c.op_type, coalesce(r.n, 0) AS converted, coalesce(o.n, 0) AS remaining, coalesce(r.n, 0) + coalesce(o.n, 0) AS fp32 FROM c LEFT JOIN o ON o.op_type = c.op_type LEFT JOIN o r ON r.op_type = c.repl")
def agg_matmul_census(spark, sf_dir) -> DataFrame:
    return embedding.conversion_census(_ops(spark, sf_dir))


@query(f"SELECT string_agg(op_type, ',' ORDER BY op_type) AS present FROM {_OPS} WHERE op_type IN ('DynamicQuantizeLinear', 'MatMulInteger', 'QGemm', 'QLinearMatMul')")
def flt_ops_present(spark, sf_dir) -> DataFrame:
    return embedding.operators_present(_ops(spark, sf_dir)).select(F.array_join("present", ",").alias("present"))


@query("SELECT sum(p_size)::DOUBLE AS value, NULL::VARCHAR AS undefined_reason FROM part")
def agg_artifact_size(spark, sf_dir) -> DataFrame:
    return artifacts.total_size(_table(spark, sf_dir, "part").select(F.col("p_size").alias("size")))


@query("""WITH a AS (SELECT p_partkey::VARCHAR AS name, p_size::VARCHAR AS shape, p_type AS dtype FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey::VARCHAR AS name, CASE WHEN p_partkey % 7 = 0 THEN '?' ELSE p_size::VARCHAR END AS shape, CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE p_type END AS dtype FROM part WHERE p_partkey % 5 <> 0),
j AS (SELECT coalesce(a.name, b.name) AS n, a.name AS an, b.name AS bn, a.shape AS ash, b.shape AS bsh, a.dtype AS ad, b.dtype AS bd FROM a FULL JOIN b ON a.name = b.name)
SELECT 'input ''' || n || ''' present in fp32 graph, absent from int8 graph' AS difference FROM j WHERE bn IS NULL UNION ALL SELECT 'input ''' || n || ''' present in int8 graph, absent from fp32 graph' FROM j WHERE an IS NULL
UNION ALL SELECT 'input ''' || n || ''' shape differs: fp32=' || ash || ' int8=' || bsh FROM j WHERE ash <> bsh UNION ALL SELECT 'input ''' || n || ''' dtype differs: fp32=' || ad || ' int8=' || bd FROM j WHERE ad <> bd""")
def set_sig_diff(spark, sf_dir) -> DataFrame:
    p = _table(spark, sf_dir, "part").select(F.lit("input").alias("kind"), F.col("p_partkey").cast("string").alias("name"), F.col("p_size").cast("string").alias("shape"), F.col("p_type").alias("dtype"), "p_partkey")
    new = p.where("p_partkey % 5 <> 0").withColumns({"shape": F.when(F.col("p_partkey") % 7 == 0, "?").otherwise(F.col("shape")), "dtype": F.when(F.col("p_partkey") % 11 == 0, "x").otherwise(F.col("dtype"))})
    return artifacts.signature_differences(p.where("p_partkey % 3 <> 0"), new)
