"""Scans: repository streams, directories, mapped tables, JSONL shards with identity, finalized shards, frozen files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import columns as C

from .storage import file_system

#: Permissive licenses, markers of scrubbed personal data, shard names that are complete.
LICENSES = ("mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "cc0-1.0", "zlib")
PII = ("<NAME>", "<EMAIL>", "<KEY>", "<PASSWORD>")
FINAL_SHARDS = r"^triples_ast_\d+\.jsonl$|^triples_(?:exec|phrased|stack)\.jsonl$"
PAIR_SHARDS = r"^qa_pairs_\d+\.jsonl$"


def repo_stream(rows: DataFrame, min_file_ts: int = 0) -> DataFrame:
    """Repositories with nested files, flattened to kept Python files with their provenance."""
    files = rows.select("repo_path", "commit_id", F.col("github_metadata.repo_created_at").alias("repo_created"), F.explode("files").alias("f"))
    ts = F.coalesce(F.col("f.file_timestamp"), F.lit(0))
    kept = files.where((F.lower("f.language") == "python") & F.lower("f.license_type").isin("permissive", *LICENSES) & ((ts == 0) | (ts >= min_file_ts)) & ~C.contains_any("f.content", PII))
    return kept.select(F.col("repo_path").alias("repo"), F.col("f.file_path").alias("path"), F.col("f.content").alias("content"), "commit_id", F.col("f.file_timestamp").alias("file_ts"), "repo_created")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """*.py under a folder; names repo__owner__path give repo and path; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(path)
    parts = F.split(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.py$", ""), "__")
    named = F.size(parts) >= 3
    return files.select(
        F.when(named, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise("local").alias("repo"),
        F.when(named, F.concat(F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "/"), F.lit(".py"))).otherwise(F.element_at(F.split("path", "/"), -1)).alias("path"),
        F.expr("make_valid_utf8(cast(content AS string))").alias("content"),
    )


def mapped(rows: DataFrame, names: dict[str, str], skip: int = 0, order: str | None = None, by: str | None = None) -> DataFrame:
    """A table under our names ({ours: theirs}), without the first `skip` rows in an order (of distinct values), of the whole or of each value of `by`.

    Only the last row to skip is looked for: at most `skip` rows of a task and value travel to it, and no row is ranked beyond it.
    """
    out = rows
    if skip:
        source = F.col(by) if by else F.lit(0)
        slim = rows.select(source.alias("_by"), F.col(order).alias("_order"))
        firsts = slim.withColumn("_n", F.row_number().over(Window.partitionBy("_by").orderBy("_order"))).where(F.col("_n") <= skip)
        last = firsts.groupBy("_by").agg(F.max("_order").alias("_last"))
        out = rows.join(last, source.eqNullSafe(F.col("_by"))).where(F.col(order) > F.col("_last"))
    return out.select(*[F.col(theirs).alias(ours) for ours, theirs in names.items()])


def jsonl(spark: SparkSession, path: str, glob: str = "*.jsonl*") -> DataFrame:
    """Lines with identity: shard is the rank of the file's name, line counts from 0. Compression goes by suffix.

    Files are read in splits of bytes (a compressed one is one split); a line belongs to the split it starts in. Lines are counted for each
    split first, and a split's lines begin at the sum of those before it in the file, so no task holds a whole file. Files of one name in
    several folders share a shard.
    """
    text = spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), "value")
    splits = lines.groupBy("_path", "file", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first"))
    shards = splits.select("file").distinct().withColumn("shard", (F.row_number().over(Window.orderBy("file")) - 1).cast("long"))  # one row a file
    splits = splits.join(shards, "file").select("_path", "_split", "_before", "shard")
    placed = lines.join(splits, ["_path", "_split"]).withColumn("line", F.col("_at") + F.col("_before"))
    return placed.where("value <> ''").select("file", "shard", "line", "value")


def wanted_lines(lines: DataFrame, wanted: DataFrame, schema: str) -> DataFrame:
    """Only lines that a manifest names are parsed: the semi-join comes before from_json."""
    kept = lines.join(wanted.select("shard", "line"), ["shard", "line"], "left_semi")
    return kept.select("shard", "line", F.from_json("value", schema).alias("j")).select("shard", "line", "j.*")


def receipts(lines: DataFrame) -> DataFrame:
    """Without bookkeeping rows, those with a key that begins with _."""
    return lines.where(~F.exists(F.json_object_keys("value"), lambda k: F.startswith(k, F.lit("_"))))


def names_in(spark: SparkSession, path: str) -> list[str]:
    system, target = file_system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(target))


def finalized(spark: SparkSession, path: str, pattern: str = FINAL_SHARDS) -> list[str]:
    """Names of complete shards; raw, usage and unknown files stay out, and none at all is an error."""
    import re

    found = [n for n in names_in(spark, path) if re.match(pattern, n)]
    if not found:
        raise FileNotFoundError(f"no finalized shard in {path}")
    return found


def paired_shards(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Pair shards with their metadata shards; one without the other is an error."""
    names = set(names_in(spark, path))
    pairs = [(n, n.replace("qa_pairs_", "qa_pairs_meta_")) for n in finalized(spark, path, PAIR_SHARDS)]
    if lost := [m for _, m in pairs if m not in names]:
        raise FileNotFoundError(f"metadata is missing: {lost}")
    return pairs


def frozen(spark: SparkSession, path: str, sha256: str, rows: int, reader=None) -> DataFrame:
    """A frozen file, read only if its SHA-256 and row count are what they should be."""
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if digest != sha256:
        raise ValueError(f"{path} has changed: {digest}")
    out = (reader or spark.read.json)(path)
    if (n := out.count()) != rows:
        raise ValueError(f"{path} has {n} rows, not {rows}")
    return out
