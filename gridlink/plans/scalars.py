"""Registered queries of perturbations, roles, formats, defined-or-not sums and set differences, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlink.functions import perturb
from gridlink.plans import fixtures as fx
from gridlink.sources import artifacts, corpus

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _named(spark, sf_dir, expression) -> DataFrame:
    return fx.part(spark, sf_dir).select("p_partkey", expression.alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN lower(p_name) WHEN 2 THEN p_name || '.' ELSE replace(p_name, ' ', '  ') END AS name FROM part")
def pert_formatting(spark, sf_dir) -> DataFrame:
    return _named(spark, sf_dir, perturb.formatting(F.col("p_name"), F.col("p_partkey") % 4))


@query("SELECT p_partkey, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS name FROM part")
def pert_word_order(spark, sf_dir) -> DataFrame:
    return _named(spark, sf_dir, perturb.word_order(F.col("p_name")))


@query("SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' Bros' ELSE ' Trust' END AS name FROM part")
def pert_abbrev(spark, sf_dir) -> DataFrame:
    suffix = F.when(F.col("p_partkey") % 3 == 0, " Limited").when(F.col("p_partkey") % 3 == 1, " Brothers").otherwise(" Trust")
    return _named(spark, sf_dir, perturb.abbreviate(F.concat("p_name", suffix)))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: array_to_string(list_transform(range(len(w)), lambda i: CASE WHEN i % 2 = 0 THEN translate(w[i + 1], 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'bcdefghijklmnopqrstuvwxyzaBCDEFGHIJKLMNOPQRSTUVWXYZA') ELSE w[i + 1] END), '')), ' ') AS name FROM part")
def pert_noise(spark, sf_dir) -> DataFrame:
    return _named(spark, sf_dir, perturb.noise(F.col("p_name")))


@query("SELECT p_partkey, translate(translate(p_name, 'aeiou', 'áéîöü'), 'áéîöü', 'aeiou') AS name FROM part")
def pert_translit(spark, sf_dir) -> DataFrame:
    return _named(spark, sf_dir, perturb.transliterate(F.translate("p_name", "aeiou", "áéîöü")))


@query(f"""WITH p AS ({fx.PAIRS}), r AS (SELECT pair_no, category, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY md5(pair_no::VARCHAR), pair_no::VARCHAR) AS k FROM p)
SELECT pair_no, category, CASE WHEN k <= (n + 1) // 2 THEN 'development' WHEN k <= (n + 1) // 2 + (n - (n + 1) // 2) // 2 THEN 'calibration' ELSE 'sealed test' END AS role FROM r""")
def split_roles(spark, sf_dir) -> DataFrame:
    return corpus.split_roles(fx.pairs(spark, sf_dir), "pair_no").select("pair_no", "category", "role")


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _corpus_sql() -> str:
    """corpus.generate() in SQL: the same md5 ranks and remainders over the same words."""
    def drawn(what: str, of: int) -> str:
        return f"('0x' || substr(md5(concat_ws('|', '{what}', category, seed::VARCHAR, prefix)), 1, 8))::BIGINT % {of}"

    def one_of(what: str, words) -> str:
        return f"{_list(words)}[{drawn(what, len(words))} + 1]"

    def sampled(family: str, words, salt: str) -> str:
        size = corpus.FAMILIES[family][1]
        return f"SELECT * FROM (SELECT seed, '{family}' AS category, prefix, row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws('|', '{salt}', '{family}', seed::VARCHAR, prefix)), prefix) - 1 AS place FROM range(1, 6) s(seed), (SELECT unnest({_list(words)}) AS prefix)) WHERE place < {size}"

    noun, pools = f"prefix || ' ' || {one_of('noun', corpus.NOUNS)}", corpus._pools()
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'bcdefghijklmnopqrstuvwxyzaBCDEFGHIJKLMNOPQRSTUVWXYZA"
    noise = f"array_to_string(list_transform(string_split(l, ' '), lambda w: array_to_string(list_transform(range(len(w)), lambda i: CASE WHEN i % 2 = 0 THEN translate(w[i + 1], '{letters}') ELSE w[i + 1] END), '')), ' ')"
    short = "CASE split_part(l, ' ', -1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in perturb.ABBREVIATIONS.items()) + " ELSE split_part(l, ' ', -1) END"
    nouns = [(k, v) for k, some in corpus.SYNONYMS.items() for v in some]
    right = {
        "exact": "l",
        "formatting": f"CASE {drawn('style', 4)} WHEN 0 THEN upper(l) WHEN 1 THEN lower(l) WHEN 2 THEN l || '.' ELSE replace(l, ' ', '  ') END",
        "word order": "array_to_string(list_reverse(string_split(l, ' ')), ' ')",
        "abbreviation": f"regexp_replace(l, '[^ ]+$', '') || {short}",
        "character noise": noise,
        "transliteration": f"translate(l, '{perturb.ACCENTED + perturb.ACCENTED.upper()}', '{perturb.PLAIN + perturb.PLAIN.upper()}')",
        "near-miss negative": f"prefix || ' ' || {one_of('other', corpus.OTHER_NOUNS)}",
    }
    left = dict.fromkeys(right, noun) | {"abbreviation": f"prefix || ' ' || {one_of('suffix', list(perturb.ABBREVIATIONS))}", "transliteration": "prefix"}
    parts = [f"SELECT seed, category, place, l AS left_name, {right[f]} AS right_name FROM (SELECT *, {left[f]} AS l FROM ({sampled(f, pools[f], 'draw')}))" for f in right]
    alias, at = "semantic alias", drawn("alias", len(nouns))
    others = corpus._two_words(*corpus.ALIAS_RIGHT)
    parts.append(f"SELECT a.seed, category, a.place, prefix || ' ' || {_list(k for k, _ in nouns)}[{at} + 1], other || ' ' || {_list(v for _, v in nouns)}[{at} + 1] FROM ({sampled(alias, pools[alias], 'draw')}) a JOIN (SELECT seed, place, prefix AS other FROM ({sampled(alias, others, 'other')})) b ON a.seed = b.seed AND a.place = b.place".replace("seed::VARCHAR, prefix)), 1, 8", "a.seed::VARCHAR, prefix)), 1, 8"))
    label = "CASE WHEN category IN ('semantic alias', 'near-miss negative') THEN 0 ELSE 1 END"
    return f"""WITH p AS ({' UNION ALL '.join(parts)}), i AS (SELECT *, format('{{:04d}}-{{}}-{{:03d}}', seed, replace(category, ' ', '-'), place) AS pair_id FROM p),
r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY seed, category ORDER BY md5(pair_id), pair_id) AS k FROM i WINDOW w AS (PARTITION BY seed, category))
SELECT pair_id, left_name, right_name, {label} AS label, category, CASE WHEN k <= (n + 1) // 2 THEN 'development' WHEN k <= (n + 1) // 2 + (n - (n + 1) // 2) // 2 THEN 'calibration' ELSE 'sealed test' END AS role, seed::INT AS seed FROM r"""


@query(_corpus_sql())
def src_corpora(spark, sf_dir) -> DataFrame:
    return corpus.generate(spark)


@query("""SELECT category, role, n * 5 AS n FROM (VALUES ('exact'), ('formatting'), ('word order'), ('abbreviation'), ('character noise'), ('transliteration')) f(category), (VALUES ('development', 15), ('calibration', 7), ('sealed test', 8)) r(role, n)
UNION ALL SELECT category, role, n * 5 FROM (VALUES ('semantic alias'), ('near-miss negative')) f(category), (VALUES ('development', 45), ('calibration', 22), ('sealed test', 23)) r(role, n)""")
def src_corpus_sizes(spark, sf_dir) -> DataFrame:
    return corpus.generate(spark).groupBy("category", "role").agg(F.count("*").cast("int").alias("n"))


@query(f"WITH p AS ({fx.PAIRS}) SELECT pair_no, 'repeated pair id' AS problem FROM (SELECT pair_no FROM (SELECT pair_no FROM p UNION ALL SELECT pair_no FROM p WHERE pair_no % 7 = 0) GROUP BY pair_no HAVING count(*) > 1) UNION ALL SELECT pair_no, 'unknown role' FROM (SELECT pair_no, role FROM p UNION ALL SELECT pair_no, 'other' FROM p WHERE pair_no % 7 = 0) WHERE role = 'other'")
def set_role_domain(spark, sf_dir) -> DataFrame:
    p = fx.pairs(spark, sf_dir).withColumnRenamed("pair_no", "pair_id")
    return corpus.problems(p.unionByName(p.where("pair_id % 7 = 0").withColumn("role", F.lit("other")))).withColumnRenamed("pair_id", "pair_no")


@query("SELECT event_type, CASE WHEN count(value) FILTER (WHERE value > 50) = 0 THEN NULL ELSE round(sum(value) FILTER (WHERE value > 50), 4) END AS total, CASE WHEN count(value) FILTER (WHERE value > 50) = 0 THEN 'no defined value' END AS reason FROM events GROUP BY event_type")
def agg_sum_defined(spark, sf_dir) -> DataFrame:
    defined = F.when(F.col("value") > 50, F.col("value"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.round(F.sum(defined), 4).alias("total"))
    return rows.withColumn("reason", F.when(F.col("total").isNull(), "no defined value"))


@query("WITH a AS (SELECT p_type AS name, count(*) AS n FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), b AS (SELECT p_type AS name, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1) SELECT name, a.n AS old_n, b.n AS new_n, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (name) WHERE a.n IS DISTINCT FROM b.n")
def set_op_diff(spark, sf_dir) -> DataFrame:
    p = fx.part(spark, sf_dir).withColumnRenamed("p_type", "name")
    a = p.where("p_partkey % 3 <> 0").groupBy("name").agg(F.count("*").alias("n"))
    b = p.where("p_size > 10").groupBy("name").agg(F.count("*").alias("n"))
    return artifacts.operator_differences(a, b, "name")


@query(f"WITH p AS ({fx.PAIRS}) SELECT pair_no, left_name, right_name FROM p ORDER BY pair_no LIMIT 10")
def lim_sample(spark, sf_dir) -> DataFrame:
    return fx.pairs(spark, sf_dir).select("pair_no", "left_name", "right_name").orderBy("pair_no").limit(10)


@query(f"WITH p AS ({fx.PAIRS}) SELECT DISTINCT category, replace(category, ' ', '-') AS slug FROM p")
def slug(spark, sf_dir) -> DataFrame:
    return fx.pairs(spark, sf_dir).select("category", perturb.slug(F.col("category")).alias("slug")).distinct()


@query("SELECT arm, family, CASE WHEN p50 > 0 THEN round(rss / p50, 6) END AS speedup, CASE WHEN f1 IS NULL THEN 'null' ELSE printf('%.3f', f1) END AS f1_text FROM " + fx.arms_sql())
def num_speedup(spark, sf_dir) -> DataFrame:
    text = F.when(F.col("f1").isNull(), "null").otherwise(F.format_string("%.3f", "f1"))
    return fx.arms(spark).select("arm", "family", F.when(F.col("p50") > 0, F.round(F.col("rss") / F.col("p50"), 6)).alias("speedup"), text.alias("f1_text"))
