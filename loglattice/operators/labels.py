"""Labels of templates: requests for a labeller, its answers, a rule-based default, and the join onto templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions.text import dir_name

LABELS = "array<struct<pattern_id:string,semantic_id:string,description:string>>"


def label_requests(templates: DataFrame, samples: DataFrame, batch_size: int | None = None) -> DataFrame:
    """A text block for each template (pattern_id, raw_pattern) with its samples (pattern_id, rank, content);
    with `batch_size`, batch_id spreads the blocks over requests of about that many."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda s: F.concat(F.lit("  - "), s["content"]))
    shown = samples.groupBy("pattern_id").agg(lines.alias("lines"))
    head = F.format_string('Pattern %s: "%s"', "pattern_id", F.regexp_replace("raw_pattern", r'([\\"])', r"\\$1"))
    body = F.when(F.size("lines") > 0, F.concat(F.lit("\nSamples:\n"), F.array_join("lines", "\n"))).otherwise(F.lit(""))
    out = templates.select("pattern_id", "raw_pattern").join(shown, "pattern_id", "left").select("pattern_id", F.concat(head, body).alias("request"))
    if batch_size:
        batches = max(1, -(-templates.count() // batch_size))
        out = out.withColumn("batch_id", F.pmod(F.xxhash64("pattern_id"), F.lit(batches)))
    return out


def parse_label_responses(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (pattern_id, semantic_id, description) from texts (response), and the texts that are no JSON array of them."""
    text = F.regexp_replace("response", r"(?U)^\s+|\s+\z", "")
    whole = F.when(text.startswith("[") & text.endswith("]"), F.concat(F.lit("["), text, F.lit("]")))
    parsed = F.from_json(whole, f"array<{LABELS}>", {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    held = df.withColumn("__labels", F.when(F.size(parsed) == 1, F.get(parsed, F.lit(0))))
    return held.select(F.explode("__labels").alias("x")).select("x.*"), held.where("__labels is null").drop("__labels")


def default_labels(templates: DataFrame) -> DataFrame:
    """Labels by rule: the words of a template as a name of at most 30 characters."""
    words = F.filter(F.split(F.lower(F.regexp_replace("raw_pattern", "[^A-Za-z]+", " ")), " "), lambda w: w != "")
    name = F.rtrim(F.substring(F.array_join(words, "-"), 1, 30), F.lit("-"))
    return templates.select("pattern_id", F.when(name == "", "pattern").otherwise(name).alias("semantic_id"), F.concat(F.lit("Lines like: "), F.translate("raw_pattern", "\n", " ")).alias("description"))


def apply_labels(templates: DataFrame, labels: DataFrame, order_col: str | None = None) -> DataFrame:
    """Templates that have a label, with semantic_id, description and dir_name (unique). Of several labels of a template
    the last by `order_col` counts, or else the greatest. Templates are numbered by count, then text."""
    last = F.max_by(F.struct("semantic_id", "description"), order_col) if order_col else F.max(F.struct("semantic_id", "description"))
    chosen = labels.groupBy("pattern_id").agg(last.alias("label")).select("pattern_id", "label.*")
    return with_dir_names(templates.join(chosen, "pattern_id"), F.struct(-F.col("count"), F.col("raw_pattern")))


def with_dir_names(labelled: DataFrame, order: Column) -> DataFrame:
    """Adds dir_name, unique among the rows (pattern_id, semantic_id, ...): name, name-2, name-3 ... in the given order.
    A made name that is another row's own is skipped. The table of labels is one row a template."""
    clean = labelled.withColumn("base", dir_name(F.col("semantic_id"))).withColumn("__order", order)
    rank = F.row_number().over(Window.partitionBy("base").orderBy("__order"))
    ranked = clean.withColumn("rank", rank)
    own = ranked.where("rank = 1").select(F.col("base").alias("taken"))
    # numbers that are other rows' own names, for each base
    numbered = own.select(F.regexp_extract("taken", r"^(.+)-([0-9]+)\z", 1).alias("base"), F.regexp_extract("taken", r"^(.+)-([0-9]+)\z", 2).try_cast("int").alias("number"), "taken")
    skipped = numbered.where("number >= 2 and taken = concat(base, '-', number)").groupBy("base").agg(F.array_sort(F.collect_set("number")).alias("skipped"))
    held = ranked.join(skipped, "base", "left")
    # the rank-th free number: those taken below it push it up, in ascending order
    number = F.aggregate(F.coalesce("skipped", F.array().cast("array<int>")), F.col("rank"), lambda at, gone: F.when(gone <= at, at + 1).otherwise(at))
    name = F.when(F.col("rank") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), number.cast("string")))
    return held.withColumn("dir_name", name).drop("base", "rank", "skipped", "__order")


