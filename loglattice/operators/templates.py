"""Message templates: discovery by grouping lines of one shape, and matching by hash joins.

Discovery does not depend on the order of lines. Lines with the same number of tokens and the same leading
tokens (those with a digit count as wildcards) have one shape; within a shape a position is literal if all its
lines agree there. Lines of a shape with too few literals are told apart by twice as many leading tokens, until
their shapes are similar enough or all tokens are used. Where more than a bounded number of tokens follow the same
leading ones, that position is a wildcard. A shape that another one covers, by wildcards in place of literals,
joins it if they share enough tokens.

Matching looks lines up in an index of templates by a rare literal each. Beyond a bounded number of templates, and for
shapes that cover others, "same number of tokens, each equal or a wildcard" is an equi join: templates with wildcards
at the same positions share a mask, and a line matches one of them if its other tokens, as one key, are the template's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions.text import WILDCARD, template_tokens
from loglattice.plans.stages import materialise


def _depth(depth: int, n: Column) -> Column:
    """Leading tokens that make the path, as many as a tree of that depth would look at."""
    return F.greatest(F.least(n - 1, F.lit(depth - 3)), F.lit(0))


def with_tokens(df: DataFrame, delimiters: str = "|=,", content: str = "content") -> DataFrame:
    return df.withColumn("tokens", template_tokens(F.col(content), delimiters)).withColumn("n", F.size("tokens"))


def _with_path(df: DataFrame, depth: int, delimiters: str) -> DataFrame:
    tokens = with_tokens(df.select("content"), delimiters)
    return tokens.withColumn("path", F.transform(F.slice("tokens", 1, _depth(depth, F.col("n"))), lambda t: F.when(t.rlike("[0-9]"), WILDCARD).otherwise(t)))


def shapes(df: DataFrame, depth: int = 30, delimiters: str = "|=,") -> DataFrame:
    """n, path, tokens and count of each shape of lines (content), in one reading of the lines."""
    return _by_path(_with_path(df, depth, delimiters))


#: Bytes of a token in one number (see _numbers).
_NUMBER_BYTES = 7


def _numbers(token: Column) -> Column:
    """A token as numbers of 7 bytes each, with a 1 before them and with fewer in the last one: (part, number). Tokens are
    equal if their numbers are, and of two that differ some number of a part that both have does."""
    digits = 2 * _NUMBER_BYTES
    number = lambda k: F.conv(F.concat(F.lit("1"), F.substring(F.hex(token), k * digits + 1, F.lit(digits))), 16, 10).cast("long")
    parts = F.sequence(F.lit(0), F.coalesce(F.floor(F.octet_length(token) / _NUMBER_BYTES).cast("int"), F.lit(0)))
    return F.transform(parts, lambda k: F.struct(k.alias("part"), number(k).alias("number")))


def _token(numbers: Column) -> Column:
    """The token of its numbers, in the order of their parts."""
    return F.unhex(F.array_join(F.transform(numbers, lambda x: F.substring(F.hex(x), 2, 2 * _NUMBER_BYTES)), "")).cast("string")


def _by_path(tokens: DataFrame, lines: Column | None = None) -> DataFrame:
    """Rows of one n and path as one shape; `lines` is how many lines a row stands for.

    Tokens are compared as numbers: sums and bounds of numbers are kept in a hash table of what shapes there are, while
    bounds of strings would have every task sort all tokens of its lines."""
    lines = F.lit(1) if lines is None else lines
    # place 0 stands for the line itself; else only places that can differ within a shape: wildcards of the path
    # and what is beyond it
    open_at = F.filter(F.sequence(F.lit(0), F.col("n")), lambda i: (i == 0) | (i > F.size("path")) | (F.get("path", i - 1) == WILDCARD))
    placed = F.flatten(F.transform(open_at, lambda i: F.transform(_numbers(F.get("tokens", i - 1)), lambda x: F.struct(i.alias("at"), x["part"].alias("part"), x["number"].alias("number")))))
    opened = tokens.select("n", "path", lines.cast("long").alias("lines"), F.explode(placed).alias("x"))
    parts = opened.groupBy("n", "path", "x.at", "x.part").agg(F.min("x.number").alias("low"), F.max("x.number").alias("high"), F.sum("lines").alias("lines"))
    numbers = F.transform(F.array_sort(F.collect_list(F.struct("part", "low"))), lambda x: x["low"])
    same = parts.groupBy("n", "path", "at").agg(F.bool_and(F.coalesce(F.col("low") == F.col("high"), F.lit(False))).alias("same"), numbers.alias("numbers"), F.max("lines").alias("lines"))
    spot = F.struct("at", F.when(F.col("same"), _token(F.col("numbers"))).otherwise(WILDCARD).alias("token"))
    filled = same.groupBy("n", "path").agg(F.max(F.when(F.col("at") == 0, F.col("lines"))).alias("count"), F.map_from_entries(F.collect_list(F.when(F.col("at") > 0, spot))).alias("spots"))
    template = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.coalesce(F.element_at("spots", i), F.get("path", i - 1)))
    return filled.select("n", "path", template.alias("tokens"), "count")


SHAPES = "n int, path array<string>, tokens array<string>, count long"


def line_shapes(df: DataFrame, delimiters: str = "|=,") -> DataFrame:
    """The finest shapes of lines (content): all tokens but the last are the path. Every other shape is made of whole ones
    of these, so they are all that is ever needed of lines that were read."""
    return _by_path(_with_path(df, 1 << 30, delimiters))


def merge_shapes(one: DataFrame, two: DataFrame) -> DataFrame:
    """The shapes of the lines of both: counts are added, places that differ are wildcards. The order and the cut of the
    lines make no difference."""
    both = one.unionByName(two)
    return _by_path(both, F.col("count"))


def _at_depth(fine: DataFrame, depth: int) -> DataFrame:
    """The shapes of a depth from the finest ones."""
    return _by_path(fine.withColumn("path", F.slice("path", F.lit(1), _depth(depth, F.col("n")))), F.col("count"))


def discover_from_shapes(
    fine: DataFrame, sim_th: float = 0.4, depth: int = 30, absorb: bool = True, min_count: int = 2, max_children: int = 100
) -> DataFrame:
    """The templates that discover_templates finds in the lines that `fine` (line_shapes, merged) is made of."""
    found = materialise(_at_depth(fine, depth))
    kept = []
    while True:
        low = materialise(found.where(_unlike(sim_th) & (F.size("path") < F.col("n") - 1)).select("n", "path"))
        if low.isEmpty():
            break
        kept.append(found.join(low, ["n", "path"], "left_anti").select(*found.columns))
        cut = fine.withColumn("fine", F.col("path")).withColumn("path", F.slice("path", F.lit(1), _depth(depth, F.col("n"))))
        fine = materialise(cut.join(low, ["n", "path"], "left_semi").select("n", F.col("fine").alias("path"), "tokens", "count"))
        depth *= 2
        found = materialise(_at_depth(fine, depth))
    for part in kept:
        found = found.unionByName(part)
    return _templates(_narrowed(found, max_children), sim_th, absorb, min_count)


def _unlike(sim_th: float) -> Column:
    return F.size(F.filter("tokens", lambda t: t != WILDCARD)) < sim_th * F.col("n")


def _told_apart(df: DataFrame, sim_th: float, depth: int, delimiters: str) -> DataFrame:
    """Shapes of which those with too few literals are cut by longer paths; only their lines are read again."""
    found = materialise(shapes(df, depth, delimiters))
    kept = []
    lines = df
    while True:
        low = found.where(_unlike(sim_th) & (F.size("path") < F.col("n") - 1))
        if low.isEmpty():
            break
        kept.append(found.join(low.select("n", "path"), ["n", "path"], "left_anti").select(*found.columns))
        lines = materialise(_with_path(lines, depth, delimiters).join(low.select("n", "path"), ["n", "path"], "left_semi").select(F.array_join("tokens", " ").alias("content")))
        depth *= 2
        found = materialise(shapes(lines, depth, delimiters))
    for part in kept:
        found = found.unionByName(part)
    return found


def _narrowed(found: DataFrame, max_children: int) -> DataFrame:
    """Shapes in which at most `max_children` tokens follow the same leading ones: where there are more, the place is a
    wildcard, and shapes that are then alike are one."""
    while (found.groupBy("n").count().agg(F.max("count")).first()[0] or 0) > max_children:
        places = found.select("n", "path", F.posexplode("path").alias("at", "token")).withColumn("before", F.slice("path", F.lit(1), F.col("at")))
        crowded = places.where(F.col("token") != WILDCARD).groupBy("n", "at", "before").agg(F.count_distinct("token").alias("children")).where(F.col("children") > max_children)
        first = materialise(places.where(F.col("token") != WILDCARD).join(crowded, ["n", "at", "before"], "left_semi").groupBy("n", "path").agg(F.min("at").alias("at")))
        if first.isEmpty():
            break
        widened = lambda column: F.transform(column, lambda t, i: F.when(i == F.col("at"), WILDCARD).otherwise(t))
        moved = found.join(first, ["n", "path"], "left").select("n", F.when(F.col("at").isNull(), F.col("path")).otherwise(widened("path")).alias("path"), F.when(F.col("at").isNull(), F.col("tokens")).otherwise(widened("tokens")).alias("tokens"), "count")
        moved = materialise(moved)
        counts = moved.groupBy("n", "path").agg(F.sum("count").alias("count"))
        found = materialise(_by_path(moved).drop("count").join(counts, ["n", "path"]))
    return found


def _keyed(templates: DataFrame) -> DataFrame:
    """Adds mask (positions of wildcards, from 0) and key (the other tokens)."""
    mask = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get("tokens", i) == WILDCARD)
    return templates.withColumn("mask", mask).withColumn("key", _key(F.col("tokens"), F.col("mask")))


def _key(tokens: Column, mask: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t, i: F.when(F.array_contains(mask, i), "\u0002").otherwise(t)), "\u0001")


def _covering(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """All pairs of a row of `lines` (n, tokens, ...) and a template (n, tokens, mask, key, ...) that covers it."""
    masks = templates.groupBy("n").agg(F.collect_set("mask").alias("masks"))
    asked = lines.join(masks, "n").withColumn("mask", F.explode("masks")).drop("masks").withColumn("key", _key(F.col("tokens"), F.col("mask")))
    return asked.join(templates.drop("tokens"), ["n", "mask", "key"])


def _absorbed(found: DataFrame, sim_th: float) -> DataFrame:
    """Shapes that others cover join the most literal of these that is not covered itself."""
    found = materialise(found)
    keyed = _keyed(found)
    literals = F.size(F.filter("tokens", lambda t: t != WILDCARD))
    wide = keyed.select("n", "tokens", "mask", "key", F.array_join("tokens", " ").alias("by"), literals.alias("shared"))
    # wildcards of the covered shape must be wildcards of the other: its own count as plain tokens
    pairs = _covering(keyed.select("n", "tokens"), wide).where((F.col("by") != F.array_join("tokens", " ")) & (F.col("shared") >= sim_th * F.col("n")))
    pairs = materialise(pairs)
    covered = pairs.select("n", "tokens").distinct()
    best = pairs.join(covered.select("n", F.array_join("tokens", " ").alias("by")), ["n", "by"], "left_anti")
    target = best.groupBy("n", "tokens").agg(F.min_by("by", F.struct(-F.col("shared"), F.col("by"))).alias("by"))
    moved = found.join(target, ["n", "tokens"], "left").withColumn("tokens", F.coalesce(F.split("by", " ", -1), "tokens"))
    return moved.groupBy("n", "tokens").agg(F.sum("count").alias("count"))


def discover_templates(
    df: DataFrame, sim_th: float = 0.4, depth: int = 30, delimiters: str = "|=,", absorb: bool = True, min_count: int = 2, max_children: int = 100
) -> DataFrame:
    """Templates of lines (content): pattern_id (a hash of the template), raw_pattern, tokens, n, count, low_similarity.
    Those of fewer than min_count lines are left out; min_count 1 keeps all."""
    return _templates(_narrowed(_told_apart(df.select("content"), sim_th, depth, delimiters), max_children), sim_th, absorb, min_count)


def _templates(found: DataFrame, sim_th: float, absorb: bool, min_count: int) -> DataFrame:
    found = found.groupBy("n", "tokens").agg(F.sum("count").alias("count"))
    if absorb:
        found = _absorbed(found, sim_th)
    text = F.array_join("tokens", " ")
    return found.where(F.col("count") >= min_count).select(F.sha2(text, 256).alias("pattern_id"), text.alias("raw_pattern"), "tokens", "n", "count", _unlike(sim_th).alias("low_similarity"))


#: Templates, and characters of them, that every task may hold; where there are more, lines and templates are joined.
INDEX_TEMPLATES, INDEX_CHARS = 200_000, 32_000_000


class TemplateIndex:
    """Templates by the literal of theirs (position and token) that the fewest of their length have. A line looks its own
    tokens up and compares what it finds, so its tries do not grow with the number of templates or of masks."""

    def __init__(self, templates: list[tuple[list[str], Any]]):
        """`templates` (tokens, what to give back) in the order in which they are preferred."""
        seen = Counter((len(tokens), k, t) for tokens, _ in templates for k, t in enumerate(tokens) if t != WILDCARD)
        self.anchored: dict[int, dict[int, dict[str, list]]] = {}
        self.open: dict[int, list] = {}
        for rank, (tokens, value) in enumerate(templates):
            n, literals = len(tokens), [(k, t) for k, t in enumerate(tokens) if t != WILDCARD]
            if not literals:
                self.open.setdefault(n, []).append((rank, [], value))
                continue
            at, token = min(literals, key=lambda x: seen[n, *x])
            self.anchored.setdefault(n, {}).setdefault(at, {}).setdefault(token, []).append((rank, literals, value))

    def covering(self, tokens: list[str]) -> Iterator[tuple[int, Any]]:
        """Rank and value of every template that covers the line, each anchor's in order."""
        for at, held in self.anchored.get(len(tokens), {}).items():
            for rank, literals, value in held.get(tokens[at], ()):
                if all(tokens[k] == t for k, t in literals):
                    yield rank, value
        for rank, _, value in self.open.get(len(tokens), ()):
            yield rank, value

    def first(self, tokens: list[str]) -> Any:
        return min(self.covering(tokens), default=(0, None), key=lambda x: x[0])[1]


def match_templates(df: DataFrame, templates: DataFrame, keys: list[str], mode: str = "first", order_col: str | None = None, delimiters: str = "|=,") -> DataFrame:
    """Lines (content, and `keys` that name each line) with pattern_id and raw_pattern, null where none matches.

    mode "first": one template a line, the first by `order_col` of `templates`, or else the one with the most
    literal tokens, ties by text. mode "all": a row for every template that matches; other lines are left out, and of
    their columns only `keys` and content come.

    While templates are few enough for an index in every task (by a check of their number and size), lines are not
    moved at all. Beyond that they are joined to the templates, by keys, masks and tokens."""
    tokens = F.split("raw_pattern", " ", -1)
    ready = templates.withColumn("tokens", tokens).withColumn("n", F.size("tokens"))
    literals = F.size(F.filter("tokens", lambda t: t != WILDCARD))
    rank = F.struct(F.col(order_col).alias("rank"), "raw_pattern") if order_col else F.struct((-literals).alias("rank"), "raw_pattern")
    chosen = ready.select("n", "tokens", "pattern_id", "raw_pattern", rank.alias("rank"))
    count, size = chosen.agg(F.count("*"), F.sum(F.length("raw_pattern"))).first()
    if count > INDEX_TEMPLATES or (size or 0) > INDEX_CHARS:
        return _matched_by_joins(df, _keyed(chosen), keys, mode, delimiters)
    index = TemplateIndex([(r.tokens, (r.pattern_id, r.raw_pattern)) for r in chosen.orderBy("rank", "pattern_id").collect()])
    shared = df.sparkSession.sparkContext.broadcast(index)
    columns = [*keys, "content"] if mode == "all" else df.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    lines = df.select(row, template_tokens(F.col("content"), delimiters).alias("tokens"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            held = [t or [] for t in batch.column("tokens").to_pylist()]
            rows = batch.column("row")
            if mode == "all":
                pairs = [(k, value) for k, t in enumerate(held) for _, value in index.covering(t)]
                rows, found = rows.take(pa.array([k for k, _ in pairs], pa.int64())), [value for _, value in pairs]
            else:
                found = [index.first(t) or (None, None) for t in held]
            yield pa.RecordBatch.from_arrays([rows, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], ["row", "pattern_id", "raw_pattern"])

    matched = lines.mapInArrow(match, f"row {lines.schema['row'].dataType.simpleString()}, pattern_id string, raw_pattern string")
    return matched.select("row.*", "pattern_id", "raw_pattern")


def _matched_by_joins(df: DataFrame, chosen: DataFrame, keys: list[str], mode: str, delimiters: str) -> DataFrame:
    """A line meets the masks of its number of tokens, and the templates by an equi join; its best try is found on keys
    alone and then joined to the line."""
    found = _covering(with_tokens(df.select(*keys, "content"), delimiters), chosen)
    if mode == "all":
        return found.select(*keys, "content", "pattern_id", "raw_pattern")
    best = found.groupBy(*keys).agg(F.min(F.struct("rank", "pattern_id", "raw_pattern")).alias("best"))
    return df.join(best.select(*keys, "best.pattern_id", "best.raw_pattern"), keys, "left").select(*[F.col(f"`{c}`") for c in df.columns], "pattern_id", "raw_pattern")


def with_labels(matched: DataFrame) -> DataFrame:
    """Adds labels: pattern and pattern_id of matched lines, an empty map for others."""
    found = F.create_map(F.lit("pattern"), F.col("raw_pattern"), F.lit("pattern_id"), F.col("pattern_id"))
    return matched.withColumn("labels", F.when(F.col("pattern_id").isNotNull(), found).otherwise(F.create_map().cast("map<string,string>")))


#: Lines of a file that are counted as one before the first lines of a template are chosen.
FIRST_LINES = 100_000


def first_lines(named: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k lines of each pattern_id with their rank; `keys` order the lines, the last one is a line number.

    Lines are counted by stretches of FIRST_LINES, in hash tables. Only lines of the stretches that hold a template's
    first k are ranked, so no task sorts all lines that it reads. `named` is read twice. The stretches are a table, of which
    the size is known, so that lines are not moved to meet them while they are few."""
    *names, line = keys
    held = named.withColumn("__stretch", F.expr(f"`{line}` div {FIRST_LINES}"))
    counts = held.groupBy("pattern_id", *names, "__stretch").agg(F.count("*").alias("n"))
    order = Window.partitionBy("pattern_id").orderBy(*names, "__stretch")
    # a stretch has a line at least
    few = counts.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = materialise(few.withColumn("before", before).where(F.col("before") < k).select("pattern_id", *names, "__stretch")).alias("chosen")
    same = [F.col(f"held.{c}").eqNullSafe(F.col(f"chosen.{c}")) for c in ("pattern_id", *names, "__stretch")]
    near = held.alias("held").join(chosen, same, "left_semi").drop("__stretch")
    rank = F.row_number().over(Window.partitionBy("pattern_id").orderBy(*keys))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def template_samples(df: DataFrame, templates: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The first k lines, in the order of `keys` (the last one a line number), of each template on its own: pattern_id,
    raw_pattern, rank, content. Lines are chosen by their keys; only those that are left are joined to their texts."""
    named = materialise(match_templates(df, templates, keys, mode="all").select(*keys, "pattern_id", "raw_pattern"))
    return df.select(*keys, "content").join(materialise(first_lines(named, keys, k)), keys).select("pattern_id", "raw_pattern", "rank", "content")


def template_quality(entries: DataFrame, templates: DataFrame) -> DataFrame:
    """One row of checks: templates, entries, ratio, and whether 1 <= templates < entries."""
    found = templates.agg(F.count("*").alias("templates"), F.coalesce(F.sum("count"), F.lit(0)).alias("covered"))
    return entries.agg(F.count("*").alias("entries")).join(found).select(
        "entries", "templates", "covered", (F.col("templates") / F.col("entries")).alias("ratio"), ((F.col("templates") >= 1) & (F.col("templates") < F.col("entries"))).alias("good")
    )


def template_accuracy(matched: DataFrame, truth: str = "EventTemplate") -> DataFrame:
    """One row: entries, correct and accuracy. An entry is correct if the entries of its template (pattern_id) are just
    those of its true one (the column `truth`)."""
    both = matched.groupBy("pattern_id", truth).agg(F.count("*").alias("n"))
    found, real = (both.groupBy(c).agg(F.sum("n").alias(f"of_{c}")) for c in ("pattern_id", truth))
    joined = both.where("pattern_id is not null").join(found, "pattern_id").join(real, truth)
    correct = joined.where((F.col("n") == F.col("of_pattern_id")) & (F.col("n") == F.col(f"of_{truth}"))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("correct"))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries")).join(correct).select("entries", "correct", (F.col("correct") / F.col("entries")).alias("accuracy"))
