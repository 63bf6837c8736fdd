"""Secrets in texts, found once per content: an incremental ledger of blobs, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its text. The ledger, two tables in a folder,
holds which (blob, rule, rule version) were scanned and what was found. A run scans only what the ledger
has not seen, appends it, and joins the findings of all its blobs back to the paths. Findings are
appended before the marks that they are there, so a run that breaks off leaves work to be redone, never work
that is skipped; findings written twice count once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyloom.llm.shared import new_folder, written


class Rule(NamedTuple):
    """Leftmost matches of `pattern` that do not overlap; those whose `group` has fewer than `least`
    characters are dropped. A change of a rule must raise its version."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


# Runs of one class are matched from their least length on: a run that is too short is a failed match as a whole.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
#: Kinds beyond the base: forms of tokens and key headers that their makers publish.
ADDED = (
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----"),
    Rule("forge", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("chat", 1, r"\bxox[abprs]-[0-9]{8,}-[A-Za-z0-9-]{10,}"),
    # From the start of a run of its signs, each run taken whole: a match that fails is not tried again within it.
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
)
RULES = BASE + ADDED
_SEEN = "blob string, kind string, version int"
_FOUND = "blob string, kind string, version int, start bigint, end bigint"


def _name(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def _ledger(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _matches(rule: Rule) -> Column:
    """The matches of a rule in `text` as (kind, version, pieces, hits), null if there are none. The text between the
    matches and the matches take turns, so their lengths give the positions."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all("text", pattern, F.lit(0))
    found = F.struct(
        F.lit(rule.kind).alias("kind"),
        F.lit(rule.version).alias("version"),
        F.arrays_zip(F.split("text", rule.pattern, -1).alias("piece"), hits.alias("hit")).alias("parts"),
    )
    return F.when(F.array_contains("todo", _name(rule)) & F.col("text").rlike(rule.pattern), found)


def _findings(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, kind, version, start, end) in code points, end exclusive, of (blob, text, todo)."""
    each = (
        blobs.select("blob", F.explode(F.array_compact(F.array(*map(_matches, rules)))).alias("r"))
        .select("blob", "r.kind", "r.version", F.posexplode("r.parts").alias("at", "part"))
        .where("part.hit IS NOT NULL")
        .select("blob", "kind", "version", "at", "part.hit", F.length("part.piece").alias("before"), F.length("part.hit").alias("size"))
    )
    order = Window.partitionBy("blob", "kind", "version").orderBy("at")
    end = F.sum(F.col("before") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = F.lit(True)
    for rule in rules:
        if rule.group or rule.least > 1:
            long = F.length(F.regexp_extract("hit", rule.pattern, rule.group)) >= rule.least
            kept = kept & ((F.col("kind") != rule.kind) | long)
    return (
        each.withColumn("end", end).where(kept)
        .select("blob", "kind", "version", (F.col("end") - F.col("size")).cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))
    )


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, version, start, end): findings in all of `versions` (path, text), old and new.

    Brings the ledger in the folder `ledger` up to date first. A null text is an empty one.
    """
    spark = versions.sparkSession
    names = F.array(*[F.lit(_name(r)) for r in rules])
    texts = versions.select(F.coalesce("text", F.lit("")).alias("text")).select(F.sha2("text", 256).alias("blob"), "text")
    seen = _ledger(spark, f"{ledger}/seen", _SEEN)
    if seen is None:
        todo = texts.withColumn("todo", names)
    else:
        known = seen.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("known"))
        todo = (
            texts.join(written(known, "known"), "blob", "left")
            .select("blob", "text", F.array_except(names, F.coalesce("known", F.array().cast("array<string>"))).alias("todo"))
            .where(F.size("todo") > 0)
        )
    # Copies of a content are dropped before it is scanned, first within each task.
    unseen = todo.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    fresh = new_folder(spark, "scan")
    unseen.select("blob", "text", "todo").write.parquet(fresh)
    unseen = spark.read.parquet(fresh)
    _findings(unseen, rules).write.mode("append").parquet(f"{ledger}/found")
    done = unseen.select("blob", F.explode("todo").alias("rule"))
    done.select("blob", F.split_part("rule", F.lit("@"), F.lit(1)).alias("kind"), F.split_part("rule", F.lit("@"), F.lit(2)).cast("int").alias("version")).write.mode("append").parquet(f"{ledger}/seen")
    current = F.array(*[F.lit(_name(r)) for r in rules])
    return spark.read.schema(_FOUND).parquet(f"{ledger}/found").where(F.array_contains(current, F.concat_ws("@", "kind", "version"))).distinct()


def secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of `docs`.

    base_sha256 is of kind:start:end of the base kinds by start, then kind; spans has the added kinds too.
    Without a ledger folder, a new one in the shared folder is used. A null text is an empty one;
    rows that repeat an id are returned each; other columns are ignored.
    """
    spark = docs.sparkSession
    found = scan(docs.select(F.col(text_col).cast("string").alias("text")), ledger or new_folder(spark, "ledger"), rules)
    rank = F.lit(len(rules))
    for i, rule in reversed(list(enumerate(rules))):
        rank = F.when(F.col("kind") == rule.kind, i).otherwise(rank)
    spans = found.withColumn("span", F.struct("start", rank.alias("rank"), "kind", "end"))
    base = {r.kind for r in BASE}
    sums = spans.groupBy("blob").agg(
        *[F.sum((F.col("kind") == k).cast("bigint")).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.array_sort(F.collect_list(F.when(F.col("kind").isin(*base), F.col("span")))).alias("base"),
        F.array_sort(F.collect_list("span")).alias("all"),
    )
    told = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    summary = written(
        sums.select("blob", "n_assign", "n_access", "n_hex", told("base").alias("base"), told("all").alias("spans")), "summary"
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("blob"))
    zero = F.lit(0).cast("bigint")
    return rows.join(summary, "blob", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
