"""Queries over embeddings, samples, vocabularies and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import arrays as A
from parley.functions import budget, signal
from parley.functions import text as T
from parley.operators import audio, catalogs, speakers, vocabulary
from parley.sources.driver_tables import table, turns

SIMILAR = 0.2
KNOWN = 0.4
BUDGET = 400
LEAST_TERM = 9


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), "label")


def cosine_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most alike label centroid of each vector."""
    rows = _embeddings(spark, sf_dir)
    prints = speakers.centroids(rows, "label").select(F.concat(F.lit("spk_"), "label").alias("speaker_id"), F.col("label").alias("rank"), F.concat(F.lit("Speaker "), "label").alias("label"), "centroid")
    best = speakers.best_prints(rows.withColumnRenamed("vec_id", "idx"), prints, SIMILAR)
    return best.select(F.col("idx").alias("vec_id"), "speaker_id", F.round("score", 6).alias("score"), "label")


def centroid_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = speakers.centroids(_embeddings(spark, sf_dir), "label")
    return found.select("label", F.posexplode("centroid").alias("pos", "x"), "n").select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"), "n")


def centroid_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of the first half of the vectors, updated by the second half: the mean of all."""
    rows = _embeddings(spark, sf_dir)
    old = speakers.centroids(rows.where("vec_id % 2 = 0"), "label").select(F.col("label").cast("string").alias("speaker_id"), F.lit(None).cast("string").alias("label"), "centroid", F.col("n").alias("sample_count"))
    added = speakers.centroids(rows.where("vec_id % 2 = 1"), "label").select(F.col("label").cast("string").alias("speaker_id"), F.col("centroid").alias("mean"), "n")
    return speakers.updated_prints(old, added).select("speaker_id", "sample_count", F.round(A.total(F.col("centroid")), 6).alias("total"))


def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir).select((F.floor(F.col("vec_id") / 25)).alias("session_id"), F.col("vec_id").alias("idx"), "embedding")
    return speakers.session_clusters(rows, SIMILAR)


def speakers_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of even number as known voices by label; the others, in sessions of fifty numbers, as voices that are clustered,
    identified and folded into the known ones."""
    rows = _embeddings(spark, sf_dir)
    prints = speakers.centroids(rows.where("vec_id % 2 = 0"), "label").select(F.concat(F.lit("spk_"), "label").alias("speaker_id"), F.col("label").alias("rank"), F.lit(None).cast("string").alias("label"), "centroid", F.col("n").alias("sample_count"))
    heard = rows.where("vec_id % 2 = 1").select(F.floor(F.col("vec_id") / 50).alias("session_id"), F.col("vec_id").alias("idx"), "embedding")
    clusters = speakers.centroids(heard.join(speakers.session_clusters(heard, SIMILAR), ["session_id", "idx"]), "session_id", "cluster")
    out = speakers.folded(prints.drop("rank"), speakers.identified(clusters, prints, KNOWN))
    return out.select("speaker_id", "sample_count", F.round(A.total(F.col("centroid")), 6).alias("total"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words of the benchmark as a vocabulary; the rank is the order of the alphabet."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")).where(F.length("term") >= LEAST_TERM).distinct()
    return words.withColumn("rank", F.col("term"))


def fuzzy_vocab_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = turns(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token")).distinct()
    return vocabulary.matches(tokens, _terms(spark, sf_dir)).select("token", "term", F.round("score", 6).alias("score"))


def vocab_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = turns(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    return vocabulary.corrected(texts, _terms(spark, sf_dir))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit samples from embeddings, and the vector's reverse as a second signal."""
    rows = _embeddings(spark, sf_dir)
    pcm = A.to_pcm(F.transform("embedding", lambda x: x * 4))
    return rows.select("vec_id", pcm.alias("a")).withColumn("b", F.reverse("a"))


def pcm_mix_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).withColumn("mixed", A.mixed(F.col("a"), F.col("b")))
    total = F.aggregate("mixed", F.lit(0).cast("long"), lambda t, x: t + x)
    return rows.select("vec_id", total.alias("total"), F.array_max("mixed").alias("top"), F.round(A.rms(A.from_pcm(F.col("mixed"))), 6).alias("rms"), A.argmax(F.col("mixed")).alias("peak"))


def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir).withColumn("down", A.resampled(F.col("embedding"), 48_000, 16_000)).withColumn("up", A.resampled(F.col("embedding"), 16_000, 44_100))
    return rows.select("vec_id", F.size("down").alias("n_down"), F.size("up").alias("n_up"), F.round(A.total(F.col("down")), 6).alias("sum_down"), F.round(A.total(F.col("up")), 6).alias("sum_up"))


def downmix_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir).withColumn("mono", A.downmixed(F.col("embedding"), 2)).withColumn("later", A.shifted(F.col("mono"), 3))
    return rows.select("vec_id", F.size("mono").alias("n"), F.round(A.total(F.col("mono")), 6).alias("total"), F.round(A.total(F.col("later")), 6).alias("later_total"), F.round(A.total(A.channel(F.col("embedding"), 1, 2)), 6).alias("right_total"))


def feature_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each position of the vectors of a label normalised by mean and sample deviation."""
    cells = _embeddings(spark, sf_dir).select("vec_id", "label", F.posexplode("embedding").alias("pos", "x"))
    return audio.normalised(cells, "label", "pos").select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("z", 6).alias("z"))


def chunk_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "documents").select("doc_id", budget.within_budget(F.col("text"), BUDGET).alias("b"))
    return cut.select("doc_id", "b.text", "b.cut")


def mel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute normalised log-mel value of every fifty vectors joined."""
    rows = _embeddings(spark, sf_dir).withColumn("label", F.floor(F.col("vec_id") / 50)).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    joined = rows.select("label", F.flatten(F.transform("v", lambda v: v["embedding"])).alias("samples"))
    mel = joined.select("label", F.size("samples").alias("n_samples"), signal.log_mel_of("samples").alias("mel"))
    level = F.aggregate(F.flatten("mel"), F.lit(0.0), lambda t, x: t + F.abs(x)) / F.greatest(F.size(F.flatten("mel")), F.lit(1))
    return mel.select("label", "n_samples", F.size("mel").alias("n_frames"), level.alias("level"))


def shard_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as model files: one repository per brand, quantisation by size, three shards for some."""
    base: Column = F.concat_ws("/", F.lit("models"), F.concat(F.lit("m-"), F.col("p_size"), F.when(F.col("p_size") % 4 == 0, "-Q4_K_M").otherwise("-Q8")))
    path = F.concat(base, F.when(F.col("p_partkey") % 3 == 0, F.format_string("-%05d-of-00003", F.col("p_partkey") % 3 + 1)).otherwise(F.lit("")), F.when(F.col("p_partkey") % 11 == 0, ".bin").otherwise(".gguf"))
    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), path.alias("path")).distinct()
    return catalogs.model_files(files).select("repo", "base", F.array_join("shards", ",").alias("shards"))


def catalog_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalogs of three locales and a namespace for each brand, keys nested by kind; Polish and French ones lack, add and
    change some, and one brand each has no French and no English catalog. A document has the parts of 20,000 numbers at most."""
    parts = table(spark, sf_dir, "part").crossJoin(F.broadcast(spark.createDataFrame([("en",), ("fr",), ("pl",)], "locale string")))
    n, locale = F.col("p_partkey"), F.col("locale")
    other = locale != "en"
    kept = parts.where(~(other & (n % 12 == 0)) & ~((locale == "en") & (n % 10 == 0))).where(~((locale == "fr") & (F.col("p_brand") == "Brand#11")) & ~((locale == "en") & (F.col("p_brand") == "Brand#22")))
    text = F.when(other & (n % 13 == 0), " ").otherwise(F.concat(F.lit("{{count}} of {{ "), F.when(other & (n % 7 == 0), "other").otherwise("name"), F.lit(" }} in <b>"), F.col("p_size"), F.when(other & (n % 11 == 0), "</i>").otherwise("</b>")))
    forms = F.when(n % 5 != 0, F.array(F.lit(""))).when(locale != "pl", F.array(F.lit("_one"), F.lit("_other"))).when(n % 15 == 0, F.array(F.lit("_one"), F.lit("_few"), F.lit("_other"))).otherwise(F.array(F.lit("_one"), F.lit("_few"), F.lit("_many"), F.lit("_other")))
    keyed = kept.select("locale", F.col("p_brand").alias("namespace"), F.concat(F.lit("kind"), n % 3).alias("kind"), F.explode(forms).alias("form"), n.alias("n"), F.floor(n / 20_000).alias("file"), text.alias("text"))
    inner = keyed.groupBy("locale", "namespace", "file", "kind").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("k"), "n", "form").alias("k"), "text"))).alias("texts"))
    documents = inner.groupBy("locale", "namespace", "file").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("kind", "texts"))).alias("parts"), F.lit(1).alias("version"))).alias("document"))
    return catalogs.catalog_problems(documents)


def catalog_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    left = parts.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("key"), F.concat("p_name", F.lit(" {count} <b>x</b>")).alias("text"))
    right = parts.where("p_partkey % 12 <> 0").select(F.col("p_partkey").alias("key"), F.concat(F.when(F.col("p_size") % 2 == 0, "<b>y</b> {count} ").otherwise("{counts} <b>y</b>"), "p_name").alias("text"))
    return catalogs.catalog_parity(left, right)


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small string functions over page addresses and part names."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", T.joined_url(url, F.lit("/api")).alias("api"), T.folder_name(url).alias("folder"), T.is_safe_path(url).alias("safe"), T.locale_of(F.concat(F.when(F.col("page_id") % 3 == 0, "pl").when(F.col("page_id") % 3 == 1, "EN").otherwise("de"), F.lit("-XX"))).alias("locale"),
        T.continuation(F.left(url, F.lit(8)), url).alias("rest"), T.cased_like(F.lit("word"), F.when(F.col("page_id") % 3 == 0, "LOUD").when(F.col("page_id") % 3 == 1, "Loud").otherwise("loud")).alias("cased"),
        T.line_kind(F.concat(F.element_at(F.split(F.lit("- [x] ,- ,### ,## ,# ,"), ","), (F.col("page_id") % 6 + 1).cast("int")), url)).alias("kind"), F.size(T.marked_spans(F.concat(F.lit("a **b** `"), url, F.lit("` **c**")))).cast("long").alias("n_spans"),
    )


_LERP = "list_sum(list_transform(range(0, CAST(ceil(len({v}) * {to} / {of}) AS BIGINT)), lambda i: {v}[least((i * {of}) // {to} + 1, len({v}))] + ({v}[least((i * {of}) // {to} + 2, len({v}))] - {v}[least((i * {of}) // {to} + 1, len({v}))]) * ((i * {of}) % {to}) / CAST({to} AS DOUBLE)))"
SQL_EMB = "(SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings)"
SQL_TERMS = f"(SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark) WHERE length(term) >= {LEAST_TERM})"
SQL_CENTROIDS = f"(SELECT label, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(v[pos]) AS x FROM {SQL_EMB}, range(1, 65) r(pos) GROUP BY label, pos) GROUP BY label)"

SQL = {
    "cosine_top1": f"""SELECT vec_id, 'spk_' || label AS speaker_id, round(s, 6) AS score, CASE WHEN s >= 0.85 THEN 'Speaker ' || label END AS label FROM (
  SELECT e.vec_id, c.label, list_cosine_similarity(e.v, c.c) AS s FROM {SQL_EMB} e, {SQL_CENTROIDS} c QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY s DESC, c.label) = 1) WHERE s >= {SIMILAR}""",
    "centroid_mean": f"SELECT label, pos - 1 AS pos, round(avg(v[pos]), 6) AS x, count(*) AS n FROM {SQL_EMB}, range(1, 65) r(pos) GROUP BY label, pos",
    "centroid_update": f"SELECT CAST(label AS VARCHAR) AS speaker_id, count(*) AS sample_count, round(sum(list_sum(v)) / count(*), 6) AS total FROM {SQL_EMB} GROUP BY label",
    "speakers_end_to_end": f"""WITH RECURSIVE e AS (SELECT vec_id // 50 AS session_id, vec_id AS idx, v, row_number() OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS k FROM {SQL_EMB} WHERE vec_id % 2 = 1),
f(session_id, k, idx, cluster, sums) AS (SELECT session_id, k, idx, CAST(0 AS BIGINT), [v] FROM e WHERE k = 1
  UNION ALL SELECT session_id, k, idx, coalesce(best - 1, len(sums)), CASE WHEN best IS NULL THEN list_append(sums, v) ELSE list_transform(sums, lambda s, i: CASE WHEN i = best THEN list_transform(s, lambda x, j: x + v[j]) ELSE s END) END
  FROM (SELECT *, CASE WHEN list_max(scores) >= {SIMILAR} THEN list_position(scores, list_max(scores)) END AS best FROM (
    SELECT e.*, f.sums, list_transform(f.sums, lambda s: list_cosine_similarity(s, e.v)) AS scores FROM f JOIN e ON e.session_id = f.session_id AND e.k = f.k + 1))),
m AS (SELECT session_id, cluster, count(*) AS n FROM f GROUP BY ALL), z AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY k DESC) = 1),
l AS (SELECT session_id, unnest(sums) AS s, unnest(range(0, len(sums))) AS cluster FROM z),
p AS (SELECT 'spk_' || label AS speaker_id, label, c, n FROM {SQL_CENTROIDS.replace(SQL_EMB, f"(SELECT * FROM {SQL_EMB} WHERE vec_id % 2 = 0)")} JOIN (SELECT label, count(*) AS n FROM {SQL_EMB} WHERE vec_id % 2 = 0 GROUP BY label) USING (label)),
b AS (SELECT l.session_id, l.cluster, l.s, m.n, p.speaker_id, list_cosine_similarity(l.s, p.c) AS score FROM l JOIN m ON m.session_id = l.session_id AND m.cluster = l.cluster, p QUALIFY row_number() OVER (PARTITION BY l.session_id, l.cluster ORDER BY list_cosine_similarity(l.s, p.c) DESC, label) = 1),
w AS (SELECT CASE WHEN score >= {KNOWN} THEN speaker_id ELSE 'new:' || session_id || ':' || cluster END AS speaker_id, sum(n) AS k, sum(list_sum(s)) AS total FROM b GROUP BY 1)
SELECT coalesce(w.speaker_id, p.speaker_id) AS speaker_id, CAST(coalesce(n, 0) + coalesce(k, 0) AS BIGINT) AS sample_count, round((coalesce(list_sum(c) * n, 0) + coalesce(total, 0)) / (coalesce(n, 0) + coalesce(k, 0)), 6) AS total
FROM p FULL JOIN w ON w.speaker_id = p.speaker_id""",
    "leader_clusters": f"""WITH RECURSIVE e AS (SELECT vec_id // 25 AS session_id, vec_id AS idx, v, row_number() OVER (PARTITION BY vec_id // 25 ORDER BY vec_id) AS k FROM {SQL_EMB}),
f(session_id, k, idx, cluster, sums) AS (SELECT session_id, k, idx, CAST(0 AS BIGINT), [v] FROM e WHERE k = 1
  UNION ALL SELECT session_id, k, idx, coalesce(best - 1, len(sums)), CASE WHEN best IS NULL THEN list_append(sums, v) ELSE list_transform(sums, lambda s, i: CASE WHEN i = best THEN list_transform(s, lambda x, j: x + v[j]) ELSE s END) END
  FROM (SELECT *, CASE WHEN list_max(scores) >= {SIMILAR} THEN list_position(scores, list_max(scores)) END AS best FROM (
    SELECT e.*, f.sums, list_transform(f.sums, lambda s: list_cosine_similarity(s, e.v)) AS scores FROM f JOIN e ON e.session_id = f.session_id AND e.k = f.k + 1)))
SELECT session_id, idx, cluster FROM f""",
    "fuzzy_vocab_match": f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM conversations), k AS (SELECT term FROM {SQL_TERMS}),
s AS (SELECT token, term, jaro_winkler_similarity(token, term) AS score FROM t JOIN k ON abs(length(token) - length(term)) <= 2 WHERE length(token) >= 4 AND token NOT IN (SELECT term FROM k))
SELECT token, term, round(score, 6) AS score FROM s WHERE score >= 0.86 QUALIFY row_number() OVER (PARTITION BY token ORDER BY score DESC, term) = 1""",
    "pcm_mix_clip": f"""WITH s AS (SELECT vec_id, list_transform(v, lambda x: CAST(trunc(greatest(least(x * 4, 1), -1) * 32767) AS INTEGER)) AS a FROM {SQL_EMB}),
m AS (SELECT vec_id, list_transform(range(1, len(a) + 1), lambda i: greatest(least(a[i] + a[len(a) + 1 - i], 32767), -32768)) AS m FROM s)
SELECT vec_id, CAST(list_sum(m) AS BIGINT) AS total, CAST(list_max(m) AS INTEGER) AS top, round(sqrt(list_sum(list_transform(m, lambda x: (x / 32768.0::DOUBLE) * (x / 32768.0::DOUBLE))) / len(m)), 6) AS rms, CAST(list_position(m, list_max(m)) - 1 AS INTEGER) AS peak FROM m""",
    "resample_linear": f"""SELECT vec_id, CAST(ceil(len(v) * 16000 / 48000) AS INTEGER) AS n_down, CAST(ceil(len(v) * 44100 / 16000) AS INTEGER) AS n_up, round({_LERP.format(v="v", to=16000, of=48000)}, 6) AS sum_down, round({_LERP.format(v="v", to=44100, of=16000)}, 6) AS sum_up FROM {SQL_EMB}""",
    "downmix_shift": f"""WITH m AS (SELECT vec_id, v, list_transform(range(0, len(v) // 2), lambda i: (v[i * 2 + 1] + v[i * 2 + 2]) / 2) AS mono FROM {SQL_EMB})
SELECT vec_id, CAST(len(mono) AS INTEGER) AS n, round(list_sum(mono), 6) AS total, round(list_sum(mono[1:len(mono) - 3]), 6) AS later_total, round(list_sum(list_transform(range(1, len(v) // 2 + 1), lambda i: v[i * 2])), 6) AS right_total FROM m""",
    "feature_normalise": f"""WITH c AS (SELECT vec_id, label, pos - 1 AS pos, v[pos] AS x FROM {SQL_EMB}, range(1, 65) r(pos)), s AS (SELECT label, pos, avg(x) AS mean, stddev_samp(x) AS sd, count(*) AS n FROM c GROUP BY label, pos)
SELECT vec_id, c.pos AS pos, round(CASE WHEN n > 1 THEN (x - mean) / (sd + 1e-5) ELSE x END, 6) AS z FROM c JOIN s ON s.label = c.label AND s.pos = c.pos""",
    "shard_grouping": """WITH f AS (SELECT DISTINCT p_brand AS repo, 'models/m-' || p_size || CASE WHEN p_size % 4 = 0 THEN '-Q4_K_M' ELSE '-Q8' END AS base, CASE WHEN p_partkey % 3 = 0 THEN '-00001-of-00003' ELSE '' END AS part FROM part WHERE p_partkey % 11 <> 0),
g AS (SELECT repo, base, string_agg(base || part || '.gguf', ',' ORDER BY base || part || '.gguf') AS shards FROM f GROUP BY repo, base)
SELECT repo, base, shards FROM g QUALIFY row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN contains(lower(base), 'q4_k_m') THEN 0 ELSE 1 END, base) = 1""",
    "catalog_problems": """WITH p AS (SELECT *, locale <> 'en' AS o FROM part, (VALUES ('en'), ('fr'), ('pl')) l(locale)),
k AS (SELECT * FROM p WHERE NOT (o AND p_partkey % 12 = 0) AND NOT (NOT o AND p_partkey % 10 = 0) AND NOT (locale = 'fr' AND p_brand = 'Brand#11') AND NOT (locale = 'en' AND p_brand = 'Brand#22')),
h AS (SELECT DISTINCT locale, p_brand AS namespace FROM k), s AS (SELECT namespace FROM h WHERE locale = 'en'),
b AS (SELECT a.p_brand AS namespace, 'parts.kind' || (a.p_partkey % 3) || '.k' || a.p_partkey AS key, a.p_partkey AS n, l.locale, e.p_partkey IS NOT NULL AS ours, t.p_partkey IS NOT NULL AS theirs
  FROM part a, (SELECT DISTINCT locale FROM h WHERE locale <> 'en') l LEFT JOIN k e ON e.locale = 'en' AND e.p_partkey = a.p_partkey LEFT JOIN k t ON t.locale = l.locale AND t.p_partkey = a.p_partkey),
c AS (SELECT * FROM b WHERE namespace IN (SELECT namespace FROM s) AND (locale, namespace) IN (SELECT (locale, namespace) FROM h))
SELECT l.locale, s.namespace, NULL AS key, 'missing namespace' AS problem, NULL AS detail FROM s, (SELECT DISTINCT locale FROM h WHERE locale <> 'en') l WHERE (l.locale, s.namespace) NOT IN (SELECT (locale, namespace) FROM h)
UNION ALL SELECT locale, namespace, NULL, 'namespace without source', NULL FROM h WHERE locale <> 'en' AND namespace NOT IN (SELECT namespace FROM s)
UNION ALL SELECT locale, namespace, key || f, 'empty', NULL FROM (SELECT *, unnest(CASE WHEN n % 5 <> 0 THEN [''] WHEN locale <> 'pl' THEN ['_one', '_other'] WHEN n % 15 = 0 THEN ['_one', '_few', '_other'] ELSE ['_one', '_few', '_many', '_other'] END) AS f FROM c WHERE theirs AND n % 13 = 0)
UNION ALL SELECT locale, namespace, key, 'missing', NULL FROM c WHERE ours AND NOT theirs UNION ALL SELECT locale, namespace, key, 'extra', NULL FROM c WHERE theirs AND NOT ours
UNION ALL SELECT locale, namespace, key, 'placeholders', NULL FROM c WHERE ours AND theirs AND (n % 7 = 0 OR n % 13 = 0)
UNION ALL SELECT locale, namespace, key, 'tags', NULL FROM c WHERE ours AND theirs AND (n % 11 = 0 OR n % 13 = 0)
UNION ALL SELECT locale, namespace, key, 'plural forms', 'many' FROM c WHERE ours AND theirs AND locale = 'pl' AND n % 15 = 0""",
    "catalog_parity": """SELECT p_partkey AS key, CASE WHEN p_partkey % 12 = 0 THEN 'missing right' WHEN p_partkey % 10 = 0 THEN 'missing left' ELSE 'other marks' END AS problem
FROM part WHERE (p_partkey % 10 <> 0 OR p_partkey % 12 <> 0) AND (p_partkey % 10 = 0 OR p_partkey % 12 = 0 OR p_size % 2 <> 0)""",
    "text_helpers": """SELECT page_id, CASE WHEN regexp_matches(u, '^https?://[^/]') THEN u END AS api, regexp_replace(url, '[/\\\\]', '__', 'g') AS folder, NOT contains(url, ':') AND NOT contains(url, chr(92)) AND NOT list_has_any(string_split(url, '/'), ['', '.', '..']) AS safe,
  CASE WHEN page_id % 3 = 0 THEN 'pl' ELSE 'en' END AS locale, substr(url, 9) AS rest, CASE page_id % 3 WHEN 0 THEN 'WORD' WHEN 1 THEN 'Word' ELSE 'word' END AS cased, (['checkbox', 'bullet', 'h3', 'h2', 'h1', 'paragraph'])[page_id % 6 + 1] AS kind, 3 AS n_spans FROM (SELECT *, rtrim(url, '/') || '/api' AS u FROM pages)""",
}

QUERIES = (
    cosine_top1, centroid_mean, centroid_update, leader_clusters, fuzzy_vocab_match, vocab_correction, pcm_mix_clip, resample_linear, downmix_shift, feature_normalise, chunk_to_budget, mel_features,
    shard_grouping, speakers_end_to_end, catalog_problems, catalog_parity, text_helpers,
)
