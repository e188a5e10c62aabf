"""Driver queries over the standard tables, each with its SQL for the oracle.

Tables stand in for CSV inputs: document texts and part names for raw point names, languages, brands
and types for targets, embeddings for logits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointprep.functions import text as T
from pointprep.operators import dedup, match, metrics, profile, split, vocab
from pointprep.sources import profiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


@query("SELECT doc_id, md5(replace(text, ' ', '')) AS cleaned_md5, length(replace(text, ' ', '')) AS cleaned_len, replace(lang, ' ', '') AS lang FROM documents")
def clean_strip_spaces(spark, sf_dir):
    d = profile.clean_strings(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return d.select("doc_id", F.md5("text").alias("cleaned_md5"), F.length("text").cast("long").alias("cleaned_len"), "lang")


@query(r"""SELECT count(*) AS n_rows, count(*) FILTER (text IS NOT NULL AND lang IS NOT NULL AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0 AND length(trim(lang)) > 0) AS n_kept,
count(*) - count(*) FILTER (text IS NOT NULL AND lang IS NOT NULL AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0 AND length(trim(lang)) > 0) AS n_removed FROM documents""")
def nonempty_filter(spark, sf_dir):
    return profile.removal_summary(read(spark, sf_dir, "documents"), ("text", "lang"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_md5, regexp_replace(lang, '^\s+|\s+$', '', 'g') AS lang FROM documents
WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0 AND length(regexp_replace(lang, '^\s+|\s+$', '', 'g')) > 0""")
def complete_rows(spark, sf_dir):
    d = profile.complete(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ("text", "lang"))
    return d.select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("SELECT p_type AS label, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY 1")
def label_distribution(spark, sf_dir):
    return profile.label_distribution(read(spark, sf_dir, "part"), "p_type")


@query("SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM (SELECT DISTINCT p_brand AS label FROM part WHERE p_brand IS NOT NULL)")
def label_vocab(spark, sf_dir):
    return vocab.vocabulary(read(spark, sf_dir, "part"), "p_brand")


@query("SELECT source AS label, count(*) AS n, min(doc_id) AS first_pos FROM documents WHERE source IS NOT NULL GROUP BY 1")
def class_distribution(spark, sf_dir):
    return profile.class_counts(read(spark, sf_dir, "documents"), "source", "doc_id")


@query("SELECT min(length(text)) AS min_len, max(length(text)) AS max_len, round(avg(length(text)), 6) AS mean_len, median(length(text)) AS median_len FROM documents")
def text_length_summary(spark, sf_dir):
    return profile.length_summary(read(spark, sf_dir, "documents")).withColumns({"mean_len": r6("mean_len"), "min_len": F.col("min_len").cast("long"), "max_len": F.col("max_len").cast("long")})


HELD = """WITH c AS (SELECT {label} AS l, count(*) AS c FROM {rows} GROUP BY 1), n AS (SELECT sum(c)::BIGINT AS n, CAST(ceil({share} * sum(c)) AS BIGINT) AS t FROM c),
q0 AS (SELECT l, (t * c) // n AS f, (t * c) % n AS m, t FROM c, n), q AS (SELECT l, f + CASE WHEN row_number() OVER (ORDER BY m DESC, l) <= t - sum(f) OVER () THEN 1 ELSE 0 END AS quota FROM q0),
r AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('42:' || CAST({key} AS VARCHAR)), {key}) AS rn FROM {rows})"""


@query(HELD.format(label="lang", rows="(SELECT doc_id, lang FROM documents)", share="0.2::DOUBLE", key="doc_id") + " SELECT doc_id, lang, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM r JOIN q ON r.lang = q.l")
def split_two_way(spark, sf_dir):
    return split.two_way(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(
    "WITH first AS (" + HELD.format(label="p_type", rows="(SELECT p_partkey, p_type FROM part)", share="0.1::DOUBLE", key="p_partkey") + " SELECT p_partkey, p_type, rn <= quota AS held FROM r JOIN q ON r.p_type = q.l), second AS ("
    + HELD.format(label="p_type", rows="(SELECT p_partkey, p_type FROM first WHERE NOT held)", share="(0.1::DOUBLE / (0.8::DOUBLE + 0.1::DOUBLE))", key="p_partkey") + " SELECT p_partkey, p_type, rn <= quota AS held FROM r JOIN q ON r.p_type = q.l) "
    "SELECT p_partkey, p_type, 'test' AS split FROM first WHERE held UNION ALL SELECT p_partkey, p_type, CASE WHEN held THEN 'validation' ELSE 'train' END FROM second"
)
def split_three_way(spark, sf_dir):
    return split.three_way(read(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "p_partkey")


DATASET = SQL["split_three_way"]


@query(f"""SELECT count(*) AS total_samples, CAST(count(DISTINCT s.p_type) AS INTEGER) AS num_classes, count(*) FILTER (split = 'train') AS train_samples, count(*) FILTER (split = 'validation') AS validation_samples,
count(*) FILTER (split = 'test') AS test_samples, min(length(p_name)) AS min_len, max(length(p_name)) AS max_len, round(avg(length(p_name)), 6) AS mean_len, median(length(p_name)) AS median_len,
CAST(max(k) AS BIGINT) AS largest_class FROM ({DATASET}) s JOIN part p ON s.p_partkey = p.p_partkey JOIN (SELECT p_type, count(*) AS k FROM part GROUP BY 1) c ON c.p_type = s.p_type""")
def dataset_summary(spark, sf_dir):
    rows = split.three_way(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_type", "p_partkey")
    s = profile.dataset_summary(rows, "p_name", "p_type")
    stats = [F.col(f"text_length_stats.{x}").cast("double" if x == "median" else "long").alias(f"{x}_len") for x in ("min", "max", "median")]
    return s.select("total_samples", "num_classes", "train_samples", "validation_samples", "test_samples", *stats, r6("text_length_stats.mean").alias("mean_len"), F.array_max(F.map_values("class_distribution")).alias("largest_class"))


@query(r"SELECT page_id, trim(regexp_replace(lower(url), '[-_:\s]+', ' ', 'g')) AS norm FROM pages")
def normalize_point_name(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.normalize(F.col("url")).alias("norm"))


CAMEL = "split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)"


def camel(c: str = "p_name"):
    second = F.split_part(c, F.lit(" "), F.lit(2))
    return F.concat(F.split_part(c, F.lit(" "), F.lit(1)), F.upper(F.substring(second, 1, 1)), F.substring(second, 2, 100))


@query(f"SELECT p_partkey, {CAMEL} AS label, lower(regexp_replace({CAMEL}, '([a-z])([A-Z])', '\\1 \\2', 'g')) AS words FROM part")
def camel_split(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", camel().alias("label"), T.camel_split(camel()).alias("words"))


@query("SELECT page_id, regexp_replace(url || CASE page_id % 3 WHEN 0 THEN ':present-value' WHEN 1 THEN ':PRESENT-VALUE' ELSE ':present-value:x' END, ':present-value$', '', 'i') AS clean_name FROM pages")
def strip_suffix(spark, sf_dir):
    end = F.when(F.col("page_id") % 3 == 0, ":present-value").when(F.col("page_id") % 3 == 1, ":PRESENT-VALUE").otherwise(":present-value:x")
    return read(spark, sf_dir, "pages").select("page_id", T.strip_suffix(F.concat("url", end)).alias("clean_name"))


# Points for matching: a quarter each meets the lookup, the rules, token sets, nothing.
NOUNS = ["bolt", "gear", "gizmo", "plate"]
PLACES = ["red", "blue", "small", "large", "cold", "hot", "new", "old"]
RULES = [([n], [(p, p + n.capitalize()) for p in PLACES], None if n != "plate" else "smallPlate") for n in NOUNS]
VOCAB = f"(SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM (SELECT DISTINCT {CAMEL} AS label FROM part WHERE p_name NOT LIKE 'old g%'))"
POINTS = f"""(SELECT p_partkey, p_brand AS profile_name, CASE p_partkey % 4 WHEN 0 THEN replace(upper(p_name), ' ', '_') WHEN 1 THEN p_name || '-' || p_type
WHEN 2 THEN lower(p_type) || ' ' || lower({CAMEL}) ELSE p_brand END AS clean_name FROM part)"""
NORM = r"trim(regexp_replace(lower({}), '[-_:\s]+', ' ', 'g'))"
LOOKUP = f"""(SELECT key, arg_max(label, ord) AS label FROM (SELECT {NORM.format('label')} AS key, label, label_id * 2 AS ord FROM {VOCAB}
UNION ALL SELECT lower(regexp_replace(label, '([a-z])([A-Z])', '\\1 \\2', 'g')), label, label_id * 2 + 1 FROM {VOCAB}) GROUP BY key)"""
LABELS = {p + n.capitalize() for p in PLACES for n in ["anvil", "ring", "rod", "widget", *NOUNS]} - {"oldGear", "oldGizmo"}


def rule_sql(what: str) -> str:
    out = []
    for (noun,), places, default in vocab.rules_in(LABELS, RULES):
        for place, label in places:
            out.append(f"WHEN contains(norm, '{noun}') AND contains(norm, '{place}') THEN " + (f"'{label}'" if what == "label" else "0.85::DOUBLE"))
        if default:
            out.append(f"WHEN contains(norm, '{noun}') THEN " + (f"'{default}'" if what == "label" else "0.6::DOUBLE"))
    return "CASE " + " ".join(out) + " END"


NAMED = f"(SELECT *, {NORM.format('clean_name')} AS norm FROM {POINTS})"
JACCARD = f"""(SELECT norm, label, least(score, 0.7::DOUBLE) AS confidence FROM (SELECT norm, label, score, row_number() OVER (PARTITION BY norm ORDER BY score DESC, label_id) AS rn FROM (
SELECT norm, label, label_id, count(*)::DOUBLE / (any_value(na) + any_value(nb) - count(*)) AS score FROM
(SELECT norm, len(t) AS na, unnest(t) AS token FROM (SELECT DISTINCT norm, list_distinct(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS t FROM {{names}})) a JOIN
(SELECT label, label_id, len(t) AS nb, unnest(t) AS token FROM (SELECT label, label_id, list_distinct(list_filter(string_split({NORM.format('label')}, ' '), lambda x: x <> '')) AS t FROM {{vocab}})) b USING (token)
GROUP BY norm, label, label_id) WHERE score >= 0.3) WHERE rn = 1)"""
CASCADE = f"""SELECT p_partkey, clean_name, profile_name, label, coalesce(label_id, -1) AS label_id, coalesce(confidence, 0.0::DOUBLE) AS confidence FROM (SELECT n.*, coalesce(k.label, {rule_sql('label')}, j.l3) AS label,
coalesce(CASE WHEN k.label IS NOT NULL THEN 1.0::DOUBLE END, {rule_sql('confidence')}, j.c3) AS confidence
FROM {NAMED} n LEFT JOIN {LOOKUP} k ON k.key = n.norm LEFT JOIN {JACCARD.format(names=NAMED, vocab=VOCAB)} j(jn, l3, c3) ON j.jn = n.norm) LEFT JOIN {VOCAB} v USING (label)"""


def points(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part")
    key = F.col("p_partkey") % 4
    name = F.when(key == 0, F.replace(F.upper("p_name"), F.lit(" "), F.lit("_"))).when(key == 1, F.concat_ws("-", "p_name", "p_type")).when(key == 2, F.concat_ws(" ", F.lower("p_type"), F.lower(camel()))).otherwise(F.col("p_brand"))
    labels = vocab.vocabulary(part.where("p_name NOT LIKE 'old g%'").select(camel().alias("label")), "label")
    return part.select("p_partkey", F.col("p_brand").alias("profile_name"), name.alias("clean_name")), labels


@query(f"SELECT p_partkey, k.label, coalesce(label_id, -1) AS label_id, CASE WHEN k.label IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0 END AS confidence FROM {NAMED} n LEFT JOIN {LOOKUP} k ON k.key = n.norm LEFT JOIN {VOCAB} v ON v.label = k.label")
def exact_match(spark, sf_dir):
    p, labels = points(spark, sf_dir)
    named = p.select("p_partkey", T.normalize(F.col("clean_name")).alias("norm"))
    n = labels.count()
    out = match.exact(named, labels, n).join(match.sized(labels, n), "label", "left")
    return out.select("p_partkey", "label", F.coalesce("label_id", F.lit(-1)).alias("label_id"), F.when(F.col("label").isNotNull(), 1.0).otherwise(0.0).alias("confidence"))


@query(f"SELECT p_partkey, {rule_sql('label')} AS label, coalesce({rule_sql('confidence')}, 0.0::DOUBLE) AS confidence FROM {NAMED}")
def rule_match(spark, sf_dir):
    p, _ = points(spark, sf_dir)
    return p.withColumn("r", match.rule(T.normalize(F.col("clean_name")), vocab.rules_in(LABELS, RULES))).select("p_partkey", "r.label", F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"))


NAMES = "(SELECT DISTINCT lower(p_type) || ' ' || p_name AS norm FROM part)"
PAIRED = "(SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM (SELECT DISTINCT p_name AS label FROM part WHERE p_name NOT LIKE 'old g%'))"


@query(f"SELECT norm, label, round(confidence, 6) AS confidence FROM {JACCARD.format(names=NAMES, vocab=PAIRED)}")
def jaccard_match(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    labels = vocab.vocabulary(part.where("p_name NOT LIKE 'old g%'"), "p_name")
    names = part.select(F.concat_ws(" ", F.lower("p_type"), "p_name").alias("norm")).distinct()
    return match.jaccard(names, labels, labels.count()).withColumn("confidence", r6("confidence"))


KEYWORDS = {"bolt": ["Bolt", "small"], "gear": ["Gear"], "plate": ["Plate", "plate"], "promo": ["red"], "rod": ["Rod"]}
ADD = " + ".join(f"CASE WHEN contains(word, '{k}') AND contains(lower(label), '{p.lower()}') THEN 0.5 ELSE 0 END" for k, ps in KEYWORDS.items() for p in ps)


@query(f"""WITH m AS (SELECT n.p_partkey, n.norm, k.label AS l FROM {NAMED} n LEFT JOIN {LOOKUP} k ON k.key = n.norm), w AS (SELECT norm, len(t) AS n, unnest(t) AS word FROM
(SELECT DISTINCT norm, list_filter(string_split(norm, ' '), lambda x: x <> '') AS t FROM m WHERE l IS NULL)), s AS (SELECT norm, label, label_id, sum(CASE WHEN contains(lower(label), word) THEN 1 ELSE 0 END + {ADD})::DOUBLE / any_value(n) AS score
FROM w, {VOCAB} v GROUP BY norm, label, label_id), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, label_id) AS rn FROM s) WHERE rn = 1 AND score >= 0.5)
SELECT p_partkey, coalesce(l, label) AS label, round(CASE WHEN l IS NOT NULL THEN 1.0::DOUBLE WHEN score IS NOT NULL THEN least(score, 0.9)::DOUBLE ELSE 0.0::DOUBLE END, 6) AS confidence FROM m LEFT JOIN b USING (norm)""")
def additive_match(spark, sf_dir):
    p, labels = points(spark, sf_dir)
    return match.additive(p.select("p_partkey", "clean_name"), labels, keywords=KEYWORDS).select("p_partkey", "label", r6("confidence").alias("confidence"))


@query(CASCADE)
def match_cascade(spark, sf_dir):
    p, labels = points(spark, sf_dir)
    # Unmatched rows show id -1, so that both engines' integers compare.
    return match.cascade(p, labels, rules=RULES).withColumn("label_id", F.coalesce("label_id", F.lit(-1)))


@query(f"""SELECT count(*) AS total, count(*) FILTER (confidence >= 0.6) AS matched, count(*) FILTER (confidence < 0.6) AS unmatched, printf('%.1f%%', 100.0::DOUBLE * count(*) FILTER (confidence >= 0.6) / count(*)) AS matched_pct,
printf('%.1f%%', 100.0::DOUBLE * count(*) FILTER (confidence < 0.6) / count(*)) AS unmatched_pct, count(DISTINCT CASE WHEN confidence < 0.6 THEN clean_name END) AS distinct_unmatched FROM ({CASCADE})""")
def analyze_summary(spark, sf_dir):
    p, labels = points(spark, sf_dir)
    return profile.match_summary(match.cascade(p, labels, rules=RULES, min_confidence=0.6))


@query(f"SELECT label, count(*) AS n, min(p_partkey) AS first_pos FROM ({CASCADE}) WHERE confidence >= 0.6 GROUP BY 1 ORDER BY n DESC, first_pos LIMIT 15")
def top_matched_labels(spark, sf_dir):
    p, labels = points(spark, sf_dir)
    return profile.top_labels(match.cascade(p, labels, rules=RULES, min_confidence=0.6), "label", "p_partkey")


@query(f"SELECT clean_name AS text, label, label_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(clean_name)) ORDER BY p_partkey) AS rn FROM ({CASCADE})) WHERE rn = 1 AND confidence >= 0.6")
def generate_training(spark, sf_dir):
    from .ingest import generate

    p, labels = points(spark, sf_dir)
    return generate(p, labels, ["p_partkey"], 0.6, RULES)


@query(f"SELECT clean_name AS point_name, count(*) AS occurrence_count, count(DISTINCT coalesce(profile_name, '')) AS num_profiles, CAST(NULL AS VARCHAR) AS suggested_label FROM ({CASCADE}) WHERE confidence < 0.6 GROUP BY 1")
def unmatched_report(spark, sf_dir):
    p, labels = points(spark, sf_dir)
    return profile.unmatched_report(match.cascade(p, labels, rules=RULES, min_confidence=0.6), order="p_partkey")


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS pos, md5(text) AS raw_md5, md5(regexp_replace(text, ':present-value$', '', 'i')) AS clean_md5,
'conversation ' || CAST(conv_id AS VARCHAR) AS profile_name, 'c/' || CAST(conv_id AS VARCHAR) AS source_file, coalesce(CASE WHEN turn % 2 = 0 THEN role END, 'unknown') AS value_type FROM conversations WHERE text IS NOT NULL AND text <> ''""")
def unnest_resources(spark, sf_dir):
    """Conversations stand for parsed files, turns for their points."""
    c = read(spark, sf_dir, "conversations").where("text is not null and text <> ''")
    point = F.struct("turn", "role", F.col("text").alias("name"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("unknown").alias("value_type"))
    files = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(point)).alias("p")).select(
        F.concat(F.lit("store/c/"), F.col("conv_id").cast("string")).alias("path"), F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("profile_name"), F.lit(None).cast("string").alias("error"),
        F.transform("p", lambda x: F.struct(x["name"].alias("name"), x["value_type"].alias("value_type"))).alias("points"),
    )
    each = profiles.points(files, "store")
    return each.select(F.substring_index("path", "/", -1).cast("long").alias("conv_id"), "pos", F.md5("raw_name").alias("raw_md5"), F.md5("clean_name").alias("clean_md5"), "profile_name", "source_file", "value_type")


KEY = r"lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))"
FRESH = f"""(SELECT doc_id FROM (SELECT doc_id, md5({KEY}) AS k, row_number() OVER (PARTITION BY md5({KEY}) ORDER BY doc_id) AS rn FROM documents WHERE source >= 'src15') WHERE rn = 1
AND k NOT IN (SELECT md5({KEY}) FROM documents WHERE source < 'src15'))"""


def fresh(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    # Only a digest of the text goes through the shuffles.
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.md5(T.dedup_key(F.col("text"))).alias("text"))
    return d.where("source < 'src15'"), d.where("source >= 'src15'"), d


@query(f"SELECT doc_id FROM {FRESH}")
def merge_anti_dedup(spark, sf_dir):
    old, new, _ = fresh(spark, sf_dir)
    return dedup.new_entries(old, new, "text", ["doc_id"]).select("doc_id")


@query(f"""SELECT n.n AS n_new, u.n AS n_unique, n.n - u.n AS n_duplicates FROM (SELECT count(*) AS n FROM documents WHERE source >= 'src15') n, (SELECT count(*) AS n FROM {FRESH}) u""")
def merge_counters(spark, sf_dir):
    from pointprep.operators.merge import counters

    old, new, _ = fresh(spark, sf_dir)
    return counters(old.where("doc_id % 10 <> 0"), old.where("doc_id % 10 = 0"), new, "doc_id")


@query(f"""WITH f AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM {FRESH})
SELECT doc_id, CASE WHEN rn <= floor((SELECT count(*) FROM f) * 0.1::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM f
UNION ALL SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END FROM documents WHERE source < 'src15'""")
def merge_split(spark, sf_dir):
    from pointprep.operators.merge import merge

    old, new, _ = fresh(spark, sf_dir)
    out = merge(old.where("doc_id % 10 <> 0"), old.where("doc_id % 10 = 0"), new, "doc_id")
    return (out if out is not None else old.withColumn("split", F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train"))).select("doc_id", "split")


SUPPLIED = "(SELECT s_name, s_nationkey + CASE WHEN s_suppkey % 7 = 0 THEN 100 ELSE 0 END AS k, CAST(s_suppkey % 30 AS INTEGER) AS top FROM supplier)"


@query(f"""SELECT s_name AS text, k AS actual_id, coalesce(a.n_name, 'unknown_' || CAST(k AS VARCHAR)) AS actual_label, top AS predicted_id, coalesce(p.n_name, 'unknown_' || CAST(top AS VARCHAR)) AS predicted_label,
round(1.0 / (1.0 + 29.0 * exp(-2.0)), 6) AS confidence, k = top AS correct FROM {SUPPLIED} LEFT JOIN nation a ON a.n_nationkey = k LEFT JOIN nation p ON p.n_nationkey = top""")
def id_to_label(spark, sf_dir):
    """Prediction rows: of 30 logits one is 2 and the others 0."""
    top = (F.col("s_suppkey") % 30).cast("int")
    logits = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.when(i == top, 2.0).otherwise(0.0))
    scored = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("text"), (F.col("s_nationkey") + F.when(F.col("s_suppkey") % 7 == 0, 100).otherwise(0)).alias("label_id"), logits.alias("logits"))
    names = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("label_id"), F.col("n_name").alias("label"))
    return metrics.predictions(scored, names).withColumn("confidence", r6("confidence"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS predicted_id, round(1.0 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))), 6) AS confidence FROM embeddings")
def argmax_softmax(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", T.argmax(F.col("embedding")).alias("predicted_id"), r6(T.softmax_max(F.col("embedding"))).alias("confidence"))


PAIRS = "(SELECT quality AS a, CASE WHEN n_chars % 7 = 0 THEN 2 WHEN n_chars % 5 = 0 THEN 0 ELSE 1 END AS p FROM labels JOIN documents USING (doc_id))"
CLASSES = f"""(SELECT label, tp, pred - tp AS fp, support - tp AS fn, support, CASE WHEN pred > 0 THEN tp / pred ELSE 0 END::DOUBLE AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END::DOUBLE AS recall,
CASE WHEN pred + support > 0 THEN 2 * tp / (pred + support) ELSE 0 END::DOUBLE AS f1 FROM (SELECT label, sum(tp)::BIGINT AS tp, sum(pred)::BIGINT AS pred, sum(support)::BIGINT AS support FROM
(SELECT a AS label, (a = p)::INT AS tp, 0 AS pred, 1 AS support FROM {PAIRS} UNION ALL SELECT p, 0, 1, 0 FROM {PAIRS}) GROUP BY 1))"""


def pairs(spark, sf_dir) -> DataFrame:
    n = F.col("n_chars")
    p = F.when(n % 7 == 0, 2).when(n % 5 == 0, 0).otherwise(1)
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("a"), p.alias("p"))


@query(f"SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(avg(f1), 6) AS f1_macro, round(sum(tp) / sum(support), 6) AS f1_micro FROM {CLASSES}")
def eval_metrics(spark, sf_dir):
    s = metrics.summary(pairs(spark, sf_dir), "a", "p")
    return s.select("n", *[r6(c).alias(c) for c in s.columns[1:]])


ROUNDED = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


@query(f"""SELECT CAST(label AS VARCHAR) AS label, {ROUNDED}, support FROM {CLASSES} UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM {CLASSES}
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM {CLASSES}""")
def classification_report(spark, sf_dir):
    s = metrics.report(pairs(spark, sf_dir), "a", "p")
    return s.select("label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("SELECT epoch, f1_weighted FROM (SELECT CAST(day(ts) AS INTEGER) AS epoch, count(*) FILTER (event_type = 'click') AS f1_weighted FROM events GROUP BY 1) ORDER BY f1_weighted DESC, epoch LIMIT 1")
def best_checkpoint(spark, sf_dir):
    days = read(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").alias("epoch")).agg(F.count_if(F.col("event_type") == "click").alias("f1_weighted"))
    return metrics.best_checkpoint(days, patience=1000).where("best").select("epoch", "f1_weighted")


DAYS = "(SELECT CAST(day(ts) AS INTEGER) AS epoch, count(*) FILTER (event_type = 'click') AS f1_weighted FROM events GROUP BY 1)"


@query(f"""WITH g AS (SELECT *, row_number() OVER (ORDER BY epoch) AS i, f1_weighted > coalesce(max(f1_weighted) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS gain FROM {DAYS}),
l AS (SELECT *, i - max(CASE WHEN gain THEN i END) OVER (ORDER BY epoch) AS idle FROM g), s AS (SELECT *, coalesce(max((idle >= 3)::INT) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM l),
t AS (SELECT (SELECT i FROM s WHERE NOT stopped ORDER BY f1_weighted DESC, i LIMIT 1) AS b, (SELECT max(i) FROM s WHERE NOT stopped) AS e)
SELECT epoch, f1_weighted, i = b AS best, stopped, NOT stopped AND (i = b OR i > e - 1) AS kept FROM s, t""")
def early_stopping(spark, sf_dir):
    days = read(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").alias("epoch")).agg(F.count_if(F.col("event_type") == "click").alias("f1_weighted"))
    return metrics.best_checkpoint(days)
