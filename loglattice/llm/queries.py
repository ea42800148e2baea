"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, exact, language, packing, periodic, quality, simhash, substrings, token_files, toolcalls, topk, toxicity
from .common import crc_bucket, shared_dir, table
from .tokens import default_tokenizer


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items for every document, windows of 10 words."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit(F.col("spans"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows by inner product for every vector whose vec_id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), query_step=50, k=5)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stay when runs of 13 words that an earlier document has are removed."""
    found = substrings.find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=13)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned where crc32(doc_id) mod 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, "toxic", crc_bucket("doc_id", 5) > 0)
    return toxicity.score(docs, model).select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_TURN = {"type": "object", "properties": {"turn": {"type": "integer"}, "limit": {"type": "integer"}, "text": {"type": "string"}}, "required": ["limit", "text", "turn"], "additionalProperties": False}
TOOLS = {
    "search": _TURN,
    "lookup": {**_TURN, "properties": {**_TURN["properties"], "limit": {"type": "integer", "maximum": 5}}},
}


def op4_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a call, every assistant turn as the result of the call one turn before. A call depends on
    the one two turns before it; in conversations whose id ends in 3, every eighth turn on the one two turns after."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    turn = F.col("turn")
    late = F.col("conv_id") % 10 == 3
    limit = F.when(turn % 7 == 3, F.lit('"many"')).otherwise(turn.cast("string"))
    call = lambda at: F.concat(F.lit("call-"), at.cast("string"))
    calls = turns.where("role = 'user'").select(
        "conv_id",
        call(turn).alias("call_id"),
        turn.alias("position"),
        F.when(turn % 3 == 0, "search").when(turn % 3 == 1, "lookup").otherwise("guess").alias("name"),
        F.concat(F.lit('{"turn": '), turn.cast("string"), F.lit(', "limit": '), limit, F.lit(", "), F.expr("substring(to_json(struct(text)), 2)")).alias("arguments"),
        F.when(late, F.when(turn % 8 == 0, F.array(call(turn + 2))).otherwise(F.array())).when(turn >= 2, F.array(call(turn - 2))).otherwise(F.array()).cast("array<string>").alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", call(turn - 1).alias("call_id"), turn.alias("position"), F.col("text").alias("content"))
    linked = toolcalls.link_tool_calls(calls, results, TOOLS)
    return linked.select("conv_id", "call_id", "position", F.coalesce("level", F.lit(-1)).alias("level"), "status", "valid", "errors", F.sha2("canonical", 256).alias("canonical_sha256"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned where crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    fold = crc_bucket("doc_id", 4)
    found = language.identify(docs, language.sample(docs, (fold >= 0) & (fold != 2)))
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles and the components of links within 4 bits."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), words=4, radius=4)
    return groups.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' token ids as files of shuffled planes and describes what is read back."""
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, default_tokenizer(), end_id=0)
    return token_files.read_token_files(spark, path)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_tokenizer(), end_id=2, capacity=1024)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learned where crc32(doc_id) mod 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    fold = crc_bucket("doc_id", 3)
    model = quality.train(docs, labels, "quality", (fold >= 0) & (fold != 1))
    found = quality.score(docs, model).select("row.doc_id", "score")
    return found.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    found = exact.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _with_periods(docs: DataFrame) -> DataFrame:
    """In every tenth document by crc32(doc_id) the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n, g = F.size("words"), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")
    periodic = F.array_join(F.transform("words", lambda w, i: F.when(i >= F.col("a"), F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))).otherwise(w)), " ")
    placed = docs.select("doc_id", "text", words.alias("words")).withColumn("a", F.when(n > 0, a)).withColumn("p", p)
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of 12 words or more in every document, a tenth of which is made periodic."""
    found = periodic.find_runs(_with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS start, -r.period AS period)))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    digest = F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256)
    return found.withColumn("best", best).select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        digest.alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of 2 to 5 words that occur 100 times."""
    return collocations.mine_collocations(table(spark, sf_dir, "documents"), min_count=100, max_words=5, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_substrings": op2_substrings,
    "op3_toxicity": op3_toxicity,
    "op4_toolcalls": op4_toolcalls,
    "op5_language": op5_language,
    "op6_simhash": op6_simhash,
    "op7_token_files": op7_token_files,
    "op8_packing": op8_packing,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
    "op11_exact": op11_exact,
    "op12_periodic": op12_periodic,
    "op13_collocations": op13_collocations,
}

#: DuckDB SQL over the same tables.
ORACLES: dict[str, str] = {
    "op13_collocations": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
        s AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
        g AS (SELECT lang, w, i, unnest(range(1, least(len(w) - i + 1, 5) + 1)) AS k FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p)),
        f AS (SELECT lang, list_slice(w, i, i + k - 1) AS x, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
        d AS (SELECT DISTINCT lang, x, f FROM (SELECT lang, list_slice(x, 1, len(x) - 1) AS x, f FROM f UNION ALL SELECT lang, list_slice(x, 2, len(x)) AS x, f FROM f)),
        c AS (SELECT lang, x, f AS a, unnest(range(1, len(x))) AS cut FROM f ANTI JOIN d USING (lang, x, f) WHERE len(x) > 1),
        e AS (
            SELECT c.lang, array_to_string(c.x, ' ') AS phrase, a, cut, l.f AS l, r.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
            FROM c JOIN f l ON l.lang = c.lang AND l.x = list_slice(c.x, 1, cut) JOIN f r ON r.lang = c.lang AND r.x = list_slice(c.x, cut + 1, len(c.x)) JOIN s ON s.lang = c.lang
        ),
        b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM b
        QUALIFY rank <= 2000
    """,
    "op11_exact": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t)
    """,
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS w FROM embeddings
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        ) SELECT * FROM r WHERE rank <= 5
    """,
    "op4_toolcalls": """
        WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
        c AS (
            SELECT conv_id, turn, 'call-' || turn AS call_id, text,
                CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'guess' END AS name,
                CASE WHEN conv_id % 10 = 3 THEN CASE WHEN turn % 8 = 0 THEN turn + 2 END WHEN turn >= 2 THEN turn - 2 END AS needs
            FROM t WHERE role = 'user'
        ), d AS (SELECT c.*, p.turn AS needed FROM c LEFT JOIN c p ON c.conv_id = p.conv_id AND c.needs = p.turn),
        r AS (SELECT conv_id, turn, 'call-' || (turn - 1) AS call_id, text FROM t WHERE role = 'assistant'),
        l AS (
            SELECT coalesce(d.conv_id, r.conv_id) AS conv_id, coalesce(d.call_id, r.call_id) AS call_id, coalesce(d.turn, r.turn) AS position,
                d.turn, d.name, d.text, d.needs, d.needed, r.turn AS answered, r.text AS content
            FROM d FULL OUTER JOIN r ON d.conv_id = r.conv_id AND d.call_id = r.call_id
        ), v AS (
            SELECT conv_id, turn, 0 AS level FROM d WHERE needed IS NULL
            UNION ALL SELECT d.conv_id, d.turn, v.level + 1 FROM d JOIN v ON d.conv_id = v.conv_id AND d.needed = v.turn
        ), e AS (
            SELECT *, concat_ws('; ',
                CASE WHEN name = 'guess' THEN 'name: unknown tool' WHEN turn % 7 = 3 THEN 'limit: not of type integer' WHEN name = 'lookup' AND turn > 5 THEN 'limit: above 5' END,
                CASE WHEN needs IS NOT NULL AND needed IS NULL THEN 'depends_on: call-' || needs || ' is unknown' END) AS errors
            FROM l LEFT JOIN v USING (conv_id, turn)
        )
        SELECT conv_id, call_id, position, CAST(coalesce(level, -1) AS INTEGER) AS level,
            CASE WHEN turn IS NULL THEN 'no_call' WHEN answered IS NULL THEN 'no_result' ELSE 'linked' END AS status,
            turn IS NOT NULL AND errors = '' AS valid, errors,
            sha256('{"arguments":' || CASE WHEN turn IS NULL THEN 'null' ELSE '{"limit":' || CASE WHEN turn % 7 = 3 THEN '"many"' ELSE CAST(turn AS VARCHAR) END
                || ',"text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '}' END || ',"call_id":"' || call_id || '","name":'
                || CASE WHEN turn IS NULL THEN 'null' ELSE '"' || name || '"' END || ',"result":' || CASE WHEN answered IS NULL THEN 'null' ELSE CAST(to_json(content) AS VARCHAR) END || '}') AS canonical_sha256
        FROM e
    """,
    "op2_substrings": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents),
        g AS (SELECT doc_id, i, array_to_string(x[i:i + 12], ' ') AS k FROM (SELECT doc_id, x, unnest(range(1, len(x) - 11)) AS i FROM w)),
        f AS (SELECT k, min(doc_id) AS first_doc FROM g GROUP BY k),
        d AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM g JOIN f USING (k) WHERE first_doc < doc_id)),
        s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(x) AS word, unnest(range(1, len(x) + 1)) AS pos FROM w) ANTI JOIN d USING (doc_id, pos) GROUP BY doc_id)
        SELECT w.doc_id, len(x) AS n_words, len(x) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)
    """,
    "op9_decontaminate": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x FROM benchmark WHERE item_id IS NOT NULL),
        i AS (SELECT DISTINCT item_id, m, array_to_string(x[p:p + m - 1], ' ') AS k FROM (SELECT item_id, x, least(len(x), 10) AS m, unnest(range(1, len(x) - least(len(x), 10) + 2)) AS p FROM b WHERE len(x) > 0)),
        l AS (SELECT DISTINCT m FROM i),
        g AS (SELECT doc_id, m, p, array_to_string(x[p:p + m - 1], ' ') AS k FROM (SELECT doc_id, x, m, unnest(range(1, len(x) - m + 2)) AS p FROM w, l WHERE len(x) >= m)),
        h AS (SELECT doc_id, item_id, m, p FROM g JOIN i USING (m, k)),
        n AS (SELECT doc_id, count(DISTINCT p + j) AS n_hit FROM (SELECT doc_id, p, unnest(range(0, m)) AS j FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
        SELECT w.doc_id, len(x) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
}
