"""The given tables in the roles of the data model: entities, layers and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions import similarity
from kindred.operators import blocks, scoring

#: Layers of the suppliers' tokens.
LAYERS = ("code", "component", "resource", "metadata", "library")
#: Values of a column that are numbered on the driver, and parts that are broadcast, at most.
VALUES, PARTS = 1 << 16, 1 << 21
#: Lines in one task, about: so few that sorting them by supplier needs no disk.
LINES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as apps: parts are code, brands components, types resources, flags metadata, sizes library."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_linestatus").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    each = {
        "code": F.concat(F.lit("part:"), F.col("l_partkey").cast("string")), "component": F.concat(F.lit("brand:"), "p_brand"), "resource": F.concat(F.lit("type:"), "p_type"),
        "metadata": F.concat(F.lit("flag:"), "l_returnflag", "l_linestatus"), "library": F.concat(F.lit("size:"), F.col("p_size").cast("string")),
    }
    wide = F.array(*(F.struct(F.lit(k).alias("layer"), v.alias("token")) for k, v in each.items()))
    return lines.select(F.col("l_suppkey").alias("app_id"), F.explode(wide).alias("x")).select("app_id", "x.layer", "x.token").distinct()


SUPPLIER_TOKENS = """
tok AS (
  SELECT DISTINCT l_suppkey AS app_id, layer, token FROM lineitem JOIN part ON l_partkey = p_partkey,
    LATERAL (VALUES ('code', 'part:' || l_partkey), ('component', 'brand:' || p_brand), ('resource', 'type:' || p_type),
      ('metadata', 'flag:' || l_returnflag || l_linestatus), ('library', 'size:' || p_size)) v(layer, token))"""


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, pos, word) of documents: runs of anything but spaces and line feeds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    return docs.select(F.col("doc_id").alias("app_id"), F.posexplode(F.split("t", "[ \n]+")).alias("pos", "word")).where("word <> ''")


DOCUMENT_WORDS = r"""
words AS (
  SELECT app_id, pos, word FROM (
    SELECT doc_id AS app_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word
    FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[ \n]+') AS w FROM documents))
  WHERE word <> '')"""


def document_shingles(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """(app_id, layer, token): distinct k-word shingles; documents of fewer words have none."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("app_id"), F.filter(F.split(F.lower("text"), "[ \n]+"), lambda w: w != "").alias("w"))
    every = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice(F.col("w"), i, k), " "))
    return docs.where(F.size("w") >= k).select("app_id", F.lit("code").alias("layer"), F.explode(F.array_distinct(every)).alias("token"))


def document_sets(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """(app_id, set): the hashes of document_shingles with one row for each document; only ids that come twice are moved."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("app_id"), F.filter(F.split(F.lower("text"), "[ \n]+"), lambda w: w != "").alias("w")).where(F.size("w") >= k)
    every = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.xxhash64(F.lit("code"), F.array_join(F.slice(F.col("w"), i, k), " ")))
    sets = docs.select("app_id", F.array_distinct(every).alias("set"))
    if not docs.where("app_id is not null").groupBy("app_id").count().where("count > 1").head(1):
        return sets
    return sets.groupBy("app_id").agg(F.array_distinct(F.flatten(F.collect_list("set"))).alias("set"))


DOCUMENT_SHINGLES = (
    DOCUMENT_WORDS
    + """,
sh AS (
  SELECT DISTINCT app_id, 'code' AS layer, word || ' ' || w2 || ' ' || w3 AS token FROM (
    SELECT app_id, word, lead(word, 1) OVER w AS w2, lead(word, 2) OVER w AS w3 FROM words WINDOW w AS (PARTITION BY app_id ORDER BY pos))
  WHERE w3 IS NOT NULL)"""
)


def _numbered(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with the values of a column as small numbers, equal ones alike, if it has at most VALUES of them; nulls stay."""
    values = sorted(r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().limit(VALUES + 1).collect())
    if len(values) > VALUES:
        return rows
    numbers = rows.sparkSession.createDataFrame(list(enumerate(values)), f"_n int, _v {rows.schema[column].dataType.simpleString()}")
    return rows.join(F.broadcast(numbers), F.col(column) == F.col("_v"), "left").withColumn(column, F.col("_n")).drop("_n", "_v")


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(app_id, l_partkey, metadata) of the lines with a part, the flags as numbers if they are few, and in how many tasks they are dealt out: of LINES or so, whatever the session's partitions."""
    lines = table(spark, sf_dir, "lineitem").where("l_partkey is not null").select(F.col("l_suppkey").alias("app_id"), "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("metadata"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // LINES))
    return _numbered(lines, "metadata"), tasks


def _parts(spark: SparkSession, sf_dir: str, layers: tuple[str, ...]) -> tuple[DataFrame, bool]:
    """(p_partkey, a column for each of the layers that follow from the part), and whether so few parts are broadcast; few values are numbers."""
    named = {"component": "p_brand", "resource": "p_type", "library": "p_size"}
    wanted = [x for x in layers if x in named]
    parts = table(spark, sf_dir, "part").select("p_partkey", *(F.col(named[x]).alias(x) for x in wanted))
    small = parts.count() <= PARTS
    for column in wanted:
        parts = _numbered(parts, column)
    return parts, small


def _of_known_parts(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Lines with their part as code and what follows from it, less those whose part is unknown."""
    known = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "inner" if len(parts.columns) > 1 else "left_semi")
    return known.drop("p_partkey").withColumnRenamed("l_partkey", "code")


def supplier_sets(spark: SparkSession, sf_dir: str, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """(app_id, the set of each layer): supplier_tokens with one row for each supplier, tokens without their layer's prefix, or their numbers.

    Lines are dealt out as they are: sets of the few lines that a supplier has
    in one task are larger than those.  Up to PARTS parts are broadcast to
    where the lines have come to, so that lines move once and without what
    follows from their part.
    """
    lines, tasks = _lines(spark, sf_dir)
    parts, small = _parts(spark, sf_dir, layers)
    known = _of_known_parts(lines.repartition(tasks, "app_id"), F.broadcast(parts)) if small else _of_known_parts(lines, parts).repartition(tasks, "app_id")
    return known.groupBy("app_id").agg(*(blocks.set_of(F.col(x), F.col(x).isNull()).alias(x) for x in layers))


def supplier_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, both, x, y): scoring.idf_sums of the suppliers of one nation, over all layers."""
    lines, tasks = _lines(spark, sf_dir)
    parts, small = _parts(spark, sf_dir, LAYERS)
    rest = [x for x in LAYERS if x != "code"]
    if any(x.schema[c].dataType.simpleString() != "int" for x, c in ((lines, "metadata"), *((parts, c) for c in parts.columns[1:]))):
        return scoring.idf_sums(supplier_tokens(spark, sf_dir), supplier_pairs(spark, sf_dir))
    # A null supplier counts once in a part's frequency, as in SQL.
    if small:
        # The test of the flags keeps the frequencies and the sets on one exchange of the lines.
        moved = lines.where("app_id is not null").repartition(tasks, "app_id")
        once = moved.groupBy("app_id", "l_partkey").agg(F.max("metadata").alias("flags")).select(F.col("l_partkey").alias("of"), "flags")
        once = once.union(lines.where("app_id is null").select("l_partkey", F.lit(None).cast("int")).distinct())
        once = once.groupBy("of").agg(F.count(F.lit(1)).cast("int").alias("df"), F.max("flags").alias("flags")).where("df > 0 or flags >= 0")
        counted = parts.join(once.select("of", "df"), F.col("p_partkey") == F.col("of")).drop("of")
        dealt = _of_known_parts(moved, F.broadcast(counted))
    else:
        mine = Window.partitionBy("code")
        counted = _of_known_parts(lines, parts).withColumn("df", F.size(F.collect_set("app_id").over(mine)) + F.max(F.col("app_id").isNull().cast("int")).over(mine))
        dealt = counted.where("app_id is not null").repartition(tasks, "app_id")
    sets = dealt.groupBy("app_id").agg(F.array_sort(F.collect_set(F.struct("code", "df"))).alias("code"), *(F.array_sort(F.collect_set(x)).alias(x) for x in rest))
    # The frequencies of the numbered tokens, and the number of suppliers as one more; the sum over `code` keeps both branches on one exchange.
    named = lambda i: lambda v: F.struct(F.lit(i).alias("i"), v.alias("v"))
    one = F.array(F.struct(F.lit(len(rest)).alias("i"), F.lit(0).alias("v")))
    met = sets.select(F.size("code").alias("n"), F.explode(F.flatten(F.array(*(F.transform(x, named(i)) for i, x in enumerate(rest)), one))).alias("x"))
    nobody = _of_known_parts(lines.where("app_id is null"), F.broadcast(parts) if small else parts).select(F.lit(0).alias("n"), F.explode(F.array(*(named(i)(F.col(x)) for i, x in enumerate(rest)))).alias("x")).where("x.v is not null").distinct()
    found = met.union(nobody).groupBy("x").agg(F.count(F.lit(1)).cast("int").alias("df"), F.sum("n").alias("n"))
    table_of = lambda i: F.map_from_entries(F.collect_list(F.when(F.col("x.i") == i, F.struct("x.v", "df")))).alias(f"df_{i}")
    docs = F.coalesce(F.max(F.when(F.col("x.i") == len(rest), F.col("df"))), F.lit(0)).alias("docs")
    rows = sets.join(F.broadcast(found.where("n >= 0").agg(*(table_of(i) for i in range(len(rest))), docs)))  # one row, of bounded size
    weigh = lambda df: similarity.idf(F.col("docs"), df)
    weight_of = lambda i: lambda v: weigh(F.element_at(f"df_{i}", v))
    known = [F.transform("code", lambda v: v["code"]).alias("code"), F.transform("code", lambda v: weigh(v["df"])).alias("code_w")]
    for i, x in enumerate(rest):
        known += [F.col(x), F.transform(x, weight_of(i)).alias(f"{x}_w")]
    return blocks.group_weights(rows.select("app_id", *known), supplier_members(spark, sf_dir), list(LAYERS))


def supplier_layers(spark: SparkSession, sf_dir: str) -> list[str]:
    """The layers that any supplier has: every line with a part has them all, so that some lines tell, or else all."""
    lines, parts = table(spark, sf_dir, "lineitem").select("l_partkey"), table(spark, sf_dir, "part").select("p_partkey")
    met = lambda some: bool(some.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").head(1))
    return list(LAYERS) if met(lines.limit(100)) or met(lines) else []


def supplier_members(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    """(app_id, grp, more): suppliers by nation; supplier_pairs are the pairs inside."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("app_id"), F.col("s_nationkey").alias("grp"), *(v.alias(k) for k, v in more.items()))


def supplier_counts(spark: SparkSession, sf_dir: str, layers: tuple[str, ...] = LAYERS, **carry: Column) -> DataFrame:
    """blocks.group_counts of the suppliers of one nation."""
    return blocks.group_counts(supplier_sets(spark, sf_dir, layers), supplier_members(spark, sf_dir, **carry), list(layers), carry=tuple(carry))


def supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): suppliers of one nation, smaller key first."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    left, right = s.select(F.col("s_suppkey").alias("a"), "s_nationkey"), s.select(F.col("s_suppkey").alias("b"), "s_nationkey")
    return left.join(right, "s_nationkey").where("a < b").select("a", "b")


SUPPLIER_PAIRS = "prs AS (SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey)"
