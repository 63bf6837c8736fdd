"""Benchmark items inside documents: size-partitioned MinHash containment search, in DataFrame operations only.

Items are partitioned by their number of distinct shingles (powers of two). An item's sketch is its shingles
with the least hash values (bottom-m MinHash); documents are tested for members of the sketch over their
whole set, not over a sketch of their own, so a short item is found in a text of any length. m belongs to
the partition: among so many shingles of an item with containment of at least the threshold, one at least
is in the document, so the search misses nothing. Candidates are then verified by the exact share of the
item's shingles that the document has.

A shingle is WIDTH words (lower case, separated by space and \\t..\\r); an item of fewer words is one shingle of
that width, which documents are searched for too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.shared import written

WIDTH = 5
CONTAINMENT = 0.75


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _runs(words: Column, width: Column | int, make) -> Column:
    """make(words, i) for the first word i of every run of `width` words; nothing if there are fewer."""
    last = F.size(words) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: make(words, i)))


def _shingle(width: int):
    return lambda words, i: F.concat_ws(" ", F.slice(words, i + 1, width))


def _hashed(width: int):
    return lambda words, i: F.xxhash64(*[F.get(words, i + j) for j in range(width)], F.lit(width))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda's argument is not copied into its body."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _documents(docs: DataFrame, widths: list[int], kind) -> DataFrame:
    """(doc_id, key): the runs of the given widths in every text, made by kind(width)."""
    def runs(words):
        return F.flatten(F.array_compact(F.array(*[_runs(words, w, kind(w)) for w in widths])))

    return docs.select("doc_id", F.explode(_let(_words("text"), runs)).alias("key"))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each document that has at least that share of an
    item's distinct shingles.

    Null texts, and texts without words, hold nothing and are held by nothing; so are rows with a null id. Rows that
    repeat a document's or an item's id count as one text set. Other columns are ignored. Whether the sketches and the
    candidates are broadcast is left to Spark, which knows the sizes of these written tables.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    listed = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))

    def own(words):
        width = F.least(F.size(words), F.lit(WIDTH))
        runs = _runs(words, width, lambda w, i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, width)).alias("key"), width.alias("width")))
        return F.when(width > 0, runs)

    shingles = written(
        listed.select("item_id", F.explode(_let(_words("text"), own)).alias("s")).select("item_id", "s.key", "s.width").distinct(),
        "items",
    )
    # Of one item at most: its own words, so the arrays are as long as the item's text.
    sets = shingles.groupBy("item_id").agg(F.collect_list(F.struct("key", "width")).alias("set"), F.count(F.lit(1)).alias("n_item"))
    upper = F.pow(F.lit(2), F.ceil(F.log2("n_item"))).cast("bigint")
    length = (upper - F.ceil(upper * F.lit(containment)) + 1).cast("int")

    def hashed(s):
        words = F.split(s["key"], " ")
        options = [F.when(s["width"] == w, F.xxhash64(*[F.get(words, F.lit(j)) for j in range(w)], F.lit(w))) for w in range(1, WIDTH + 1)]
        return F.coalesce(*options)

    sketches = written(
        sets.withColumn("m", length)
        .select("item_id", F.explode(F.slice(F.array_sort(F.transform("set", hashed)), F.lit(1), F.col("m"))).alias("key")),
        "sketches",
    )
    # At most WIDTH values: the widths that items have.
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect())
    if not widths:
        widths = [WIDTH]
    candidates = written(_documents(texts, widths, _hashed).join(sketches, "key").select("doc_id", "item_id").distinct(), "candidates")

    full = texts.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    shared = (
        _documents(full, widths, _shingle).distinct()
        .join(shingles.select("item_id", "key"), "key")
        .join(candidates, ["doc_id", "item_id"], "left_semi")
        .groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    )
    sizes = shingles.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    return (
        shared.join(sizes, "item_id")
        .where(F.col("n_shared") >= F.col("n_item") * F.lit(containment))
        .select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )


ORACLE = """
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+') FROM benchmark
), each AS (
  SELECT side, id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM words WHERE id IS NOT NULL
), runs AS (
  SELECT side, id, count(*) OVER (PARTITION BY side, id) AS n,
    w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
  FROM each WHERE w <> '' WINDOW o AS (PARTITION BY side, id ORDER BY i)
), widths AS (SELECT unnest([1, 2, 3, 4, 5]) AS width), shingles AS (
  SELECT DISTINCT side, id, n, width, CASE width WHEN 1 THEN w1 WHEN 2 THEN w1 || ' ' || w2 WHEN 3 THEN w1 || ' ' || w2 || ' ' || w3
    WHEN 4 THEN w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 ELSE w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 END AS s
  FROM runs, widths WHERE side = 'd' OR width = least(n, 5)
), items AS (SELECT id, width, s FROM shingles WHERE side = 'i' AND s IS NOT NULL),
sizes AS (SELECT id, count(*) AS n_item FROM items GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM items i JOIN shingles d ON d.side = 'd' AND d.s = i.s AND d.width = i.width JOIN sizes z ON z.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.75 * any_value(n_item)
"""
