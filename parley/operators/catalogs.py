"""Model files, message catalogs and small selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T


def model_files(files: DataFrame, preferred: str = "q4_k_m") -> DataFrame:
    """repo, base and shards of the model file to take from each repository (repo, path): safe .gguf paths without projectors,
    grouped by base name; the base that holds the preferred quantisation, else the first by name."""
    base = T.without_shard_suffix(F.regexp_replace("path", r"\.gguf$", ""))
    usable = files.where(F.endswith("path", F.lit(".gguf")) & T.is_safe_path(F.col("path")) & ~F.contains(F.lower("path"), F.lit("mmproj")))
    groups = usable.withColumn("base", base).groupBy("repo", "base").agg(F.array_sort(F.collect_list("path")).alias("shards"))
    order = F.struct((~F.contains(F.lower("base"), F.lit(preferred))).alias("other"), "base", "shards")
    return groups.groupBy("repo").agg(F.min(order).alias("first")).select("repo", "first.base", "first.shards")


def catalog_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of two catalogs (key, text) that differ: missing on a side, or other placeholders or tags."""

    def marks(text: str) -> Column:
        return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\{?[^{}]+\}?\}|</?[A-Za-z0-9]+>"), F.lit(0))))

    both = left.select("key", F.col("text").alias("a")).join(right.select("key", F.col("text").alias("b")), "key", "full")
    problem = F.when(F.col("b").isNull(), "missing right").when(F.col("a").isNull(), "missing left").when(marks("a") != marks("b"), "other marks")
    return both.select("key", problem.alias("problem")).where(F.col("problem").isNotNull())


# Endings of keys that name a plural form, what a placeholder and a tag look like, forms that a locale must have.
PLURAL = r"_(zero|one|two|few|many|other)$"
PLACEHOLDER = r"\{\{\s*([\w.]+)[^}]*\}\}"
TAG = r"</?(\w+)\s*/?>"
FORMS = {"pl": ("one", "few", "many", "other")}


def _depth(document: Column) -> Column:
    """Levels of nesting of a JSON document, from its brackets outside of strings; 0 for what isn't JSON."""
    brackets = F.regexp_replace(F.regexp_replace(document, r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]{}]++", "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, bracket: Column) -> Column:
        now = at["now"] + F.when(bracket.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    most = F.aggregate(F.array_remove(F.split(brackets, ""), ""), zero, step)["most"]
    return F.when(F.try_parse_json(document).isNotNull(), most).otherwise(0)


def nested_texts(documents: DataFrame, column: str = "document") -> DataFrame:
    """The texts of nested JSON documents: their other columns, key (names joined by dots; places of arrays count as names) and
    text. What is neither text nor nested is left out, and so is what isn't JSON. All documents go through one step for each
    level of nesting, which is counted first; what isn't nested any more passes on."""
    others = [c for c in documents.columns if c != column]
    spark = documents.sparkSession
    level = documents.select(*others, F.lit("").alias("key"), F.try_parse_json(column).alias("node"))
    kind = F.schema_of_variant("node")
    for _ in range(documents.agg(F.max(_depth(F.col(column)))).first()[0] or 0):
        nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
        rows = level.where("node is not null").withColumn("_nested", nested)
        inside = spark.sql("SELECT t.*, e.pos AS _pos, e.key AS _name, e.value AS _value FROM {rows} t, LATERAL variant_explode_outer(t.node) e", rows=rows)
        name = F.coalesce("_name", F.col("_pos").cast("string"))
        longer = F.when(F.col("key") == "", name).otherwise(F.concat_ws(".", "key", name))
        level = inside.select(*others, F.when(F.col("_nested"), longer).otherwise(F.col("key")).alias("key"), F.when(F.col("_nested"), F.col("_value")).otherwise(F.col("node")).alias("node"))
    return level.where(kind == "STRING").select(*others, "key", F.try_variant_get("node", "$", "string").alias("text"))


def catalog_problems(documents: DataFrame, source: str = "en", forms: dict[str, tuple[str, ...]] = FORMS) -> DataFrame:
    """What is wrong with the catalogs (locale, namespace, document: nested JSON) next to those of the source locale: locale,
    namespace, key, problem and detail. A catalog can be dealt over several documents.

    Keys of plural forms are one key. A namespace can be missing, or have no source; a key can be missing or extra, a text empty;
    placeholders (but for ``count``) or tags can differ, whichever form they stand in; plural forms can be missing where
    the source has any. A key meets those of all locales in one group, so texts are read once."""
    texts = nested_texts(documents.select("locale", "namespace", "document")).withColumn("base", F.regexp_replace("key", PLURAL, ""))
    form = F.nullif(F.regexp_extract("key", PLURAL, 1), F.lit(""))

    def marks(pattern: str) -> Column:
        return F.array_sort(F.array_remove(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))))), "count"))

    blank = F.collect_list(F.when(T.is_blank(F.col("text")), F.col("key")))
    keys = texts.groupBy("locale", "namespace", "base").agg(marks(PLACEHOLDER).alias("placeholders"), marks(TAG).alias("tags"), F.array_sort(F.collect_set(form)).alias("forms"), blank.alias("blank"))
    held = documents.select("locale", "namespace").distinct()
    ours = held.where(F.col("locale") == source).select("namespace")
    theirs = held.where(F.col("locale") != source)
    every = theirs.agg(F.collect_set("locale").alias("locales"))  # one row
    gone = ours.crossJoin(F.broadcast(every)).select(F.explode("locales").alias("locale"), "namespace").join(theirs, ["locale", "namespace"], "left_anti")
    none = F.lit(None).cast("string")

    def told(rows: DataFrame, problem: Column | str, key: Column = none, detail: Column = none) -> DataFrame:
        return rows.select("locale", "namespace", key.alias("key"), (F.lit(problem) if isinstance(problem, str) else problem).alias("problem"), detail.alias("detail"))

    both = theirs.join(ours, "namespace", "left_semi").groupBy("namespace").agg(F.collect_set("locale").alias("others"))
    sides = keys.groupBy("namespace", "base").agg(F.collect_list(F.struct("locale", "placeholders", "tags", "forms", "blank")).alias("sides"))
    pairs = sides.join(both, "namespace").select("namespace", "base", "sides", F.explode("others").alias("locale"))

    def side(locale: Column) -> Column:
        return F.try_element_at(F.filter("sides", lambda s: s["locale"] == locale), F.lit(1))

    pairs = pairs.select("locale", "namespace", "base", side(F.lit(source)).alias("a"), side(F.col("locale")).alias("b")).where("a is not null or b is not null")
    table = F.create_map(*[x for name, needed in forms.items() for x in (F.lit(name), F.array(*map(F.lit, needed)))])
    lacking = F.when(F.size("a.forms") > 0, F.array_join(F.array_except(F.try_element_at(table, F.col("locale")), F.col("b.forms")), ", "))
    matched = F.col("a").isNotNull() & F.col("b").isNotNull()
    problems = F.array_compact(F.array(
        F.when(F.col("b").isNull(), F.struct(F.lit("missing").alias("problem"), none.alias("detail"))), F.when(F.col("a").isNull(), F.struct(F.lit("extra").alias("problem"), none.alias("detail"))),
        F.when(matched & (F.col("a.placeholders") != F.col("b.placeholders")), F.struct(F.lit("placeholders").alias("problem"), none.alias("detail"))),
        F.when(matched & (F.col("a.tags") != F.col("b.tags")), F.struct(F.lit("tags").alias("problem"), none.alias("detail"))),
        F.when(matched & (F.length(lacking) > 0), F.struct(F.lit("plural forms").alias("problem"), lacking.alias("detail"))),
    ))
    compared = pairs.select("locale", "namespace", F.col("base").alias("key"), F.inline(problems))
    empty = pairs.select("locale", "namespace", F.explode("b.blank").alias("key"), F.lit("empty").alias("problem"), none.alias("detail"))
    parts = [told(gone, "missing namespace"), told(theirs.join(ours, "namespace", "left_anti"), "namespace without source"), empty, compared]
    return reduce(DataFrame.unionByName, parts)


def first_existing(candidates: DataFrame) -> DataFrame:
    """The first folder by rank for each key of (key, rank, folder, present)."""
    return candidates.where("present").groupBy("key").agg(F.min_by("folder", "rank").alias("folder"))


def vocabulary_of(lines: DataFrame) -> DataFrame:
    """piece and id of ``<piece> <id>`` lines (value)."""
    parts = lines.select(F.regexp_extract("value", r"^(.*) (\d+)\s*$", 1).alias("piece"), F.try_to_number(F.regexp_extract("value", r"^(.*) (\d+)\s*$", 2), F.lit("999999999")).cast("long").alias("id"))
    return parts.where("id is not null")
