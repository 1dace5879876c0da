"""The star-schema tables in the shapes that the operators take."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.vector import in_blocks
from ..session import ship

#: Items that one automaton looks for.
MOST_ITEMS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def active(df: DataFrame) -> DataFrame:
    """Rows that aren't marked as deleted."""
    return df.where("isDelete = 0")


def by_id(df: DataFrame, key: int, id_col: str = "id") -> DataFrame:
    """The active row with a key, or none."""
    return active(df).where(F.col(id_col) == key)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.greatest(F.lit(0), F.floor("c_acctbal").cast("int")).alias("salary"),
        F.col("c_mktsegment").alias("direction"), F.lit(0).alias("isDelete"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    names = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.struct(
        F.concat(F.col("p_brand"), F.lit("-"), n.cast("string")).alias("optionName"), F.when(n < 4, (key + n) % 2 == 0).alias("trueAnswer")))
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_name").alias("levelName"), F.col("p_type").alias("direction"), F.floor("p_retailprice").cast("int").alias("targetSalary"),
        F.when(size % 10 == 0, 999).when(size % 5 == 0, 99).otherwise(0).alias("priority"), F.when(size < 15, "easy").when(size < 35, "medium").otherwise("hard").alias("difficulty"),
        F.when(key % 10 == 0, "PRESET").otherwise("AI").alias("source"), F.to_json(names).alias("options"), F.when(key % 97 == 0, 1).otherwise(0).alias("isDelete"))


ROW_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows of Parquet files with their place (a long) in the table: files by name, rows as they lie in them."""
    files = sorted(r[0] for r in rows.select("_metadata.file_path").distinct().collect())
    places = rows.sparkSession.createDataFrame([(f, n << 40) for n, f in enumerate(files)], "_file string, _first long")
    at = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return at.join(F.broadcast(places), "_file").withColumn(name, F.col("_first") + F.col("_row")).drop("_file", "_first", "_row")  # places: a row per file


def user_levels(spark: SparkSession, sf_dir: str, place: str | None = None) -> DataFrame:
    """Answers; `ord` is a struct that orders them totally; `place` names a column of their places in the table, if it is wanted."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if place:
        lines = numbered(lines, place)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("userId"), F.col("l_partkey").alias("levelId"), (F.col("l_quantity").cast("int") * 2).alias("score"),
        F.col("l_shipdate").alias("createTime"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("isDelete"), F.struct(*ROW_ORDER).alias("ord"), *([place] if place else []))


def option_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, true_set, user_set) per order."""
    picked = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("user_set"))
    truth = F.filter(F.sequence(F.lit(1), F.lit(7)), lambda n: (n + F.col("l_orderkey")) % 2 == 0)
    return picked.select(F.col("l_orderkey").alias("o_orderkey"), truth.alias("true_set"), "user_set")


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as knowledge sources: chunk_id is the document's id."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.lit("file_name").alias("source_key"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_value"),
                    F.col("source"), "text")


def manifest_fixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(previous manifest, current sources, failed keys) that exercise each outcome of a comparison."""
    d = knowledge(spark, sf_dir).withColumnRenamed("chunk_id", "ord")
    chunks = F.greatest(F.lit(1), F.ceil((F.length("text") - 100) / 400)).cast("int")
    changed = F.when(F.col("ord") % 13 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text"))
    previous = d.where("ord % 17 <> 0").select("source_key", "source_value", changed.alias("fingerprint"), chunks.alias("chunk_count"), "ord")
    current = d.where("ord % 19 <> 0 AND ord % 23 <> 0").select("source_key", "source_value", T.fingerprint(F.col("text")).alias("fingerprint"), chunks.alias("chunk_count"), "ord", "text")
    return previous, current, d.where("ord % 23 = 0").select("source_key", "source_value")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, rewrites): rewrites are the halves of the text."""
    b = table(spark, sf_dir, "benchmark")
    words = F.split("text", " ")
    half = F.floor(F.size(words) / 2).cast("int")
    halves = F.array(F.array_join(F.slice(words, F.lit(1), F.greatest(half, F.lit(1))), " "), F.array_join(F.slice(words, half + 1, F.size(words)), " "))
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), halves.alias("rewrites"))


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents (doc_id, body) and the items (item_id, text) that they contain, character by character.

    One automaton of all items reads each document once; very many items take several, a pass over the documents each.
    An empty item is contained in none.
    """
    ship(docs.sparkSession)

    def of(held: list) -> DataFrame:
        texts: dict[str, list[int]] = {}
        for r in held:
            texts.setdefault(r["text"], []).append(r["item_id"])
        shared = docs.sparkSession.sparkContext.broadcast(texts)  # MOST_ITEMS at most

        def find(batches):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for t, ids in shared.value.items():
                automaton.add_word(t, ids)
            automaton.make_automaton()
            for batch in batches:
                found: list[tuple[int, int]] = []
                for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                    if shared.value and body:
                        found += [(doc, i) for i in sorted({i for _, ids in automaton.iter(body) for i in ids})]
                yield pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["doc_id", "item_id"])

        return docs.select("doc_id", "body").mapInArrow(find, "doc_id long, item_id long")

    return reduce(DataFrame.unionByName, map(of, in_blocks(items.where("text <> ''").select("item_id", "text"), ["item_id"], MOST_ITEMS)))


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, query, expected): the documents that contain the item's text, those of odd ids by a longer address, else one that isn't indexed."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    found = containing(d, b).groupBy("item_id").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))
    name = lambda x: F.concat(F.lit("doc/"), x.cast("string"))
    named = F.transform("docs", lambda x: F.when(x % 2 == 1, F.concat(F.lit("https://www.kb.example/"), name(x), F.lit("/"))).otherwise(name(x)))
    absent = F.array(F.concat(F.lit("doc/absent-"), F.col("item_id").cast("string")))
    return b.join(found, "item_id", "left").select(F.col("item_id").alias("case_id"), F.col("text").alias("query"), F.coalesce(named, absent).alias("expected"))


def append_rows(path: str, rows: DataFrame, key: str) -> DataFrame:
    """Appends rows with new keys to the table at a path, and returns what was added.  Keys follow the largest one there; they are
    unique, not gapless, as no task knows how many rows another has."""
    spark = rows.sparkSession
    try:
        base = spark.read.parquet(path).agg(F.max(key)).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        base = 0
    rows.withColumn(key, F.monotonically_increasing_id() + F.lit(base + 1)).write.mode("append").parquet(path)
    return spark.read.parquet(path).where(F.col(key) > base)
