"""States, n-grams, runs, motifs and other sequence features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import lexicon as X
from corpusloom.functions import states as ST
from corpusloom.functions.dialect import DUCK, SPARK
from corpusloom.operators import sequences as Q
from corpusloom.queries import query
from corpusloom.sources.tables import spread, table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


TOK = f"(SELECT doc_id, lang, source, {DUCK.found(repr_ := "coalesce(text, '')", X.TOK_MARKOV)} AS tokens FROM documents)"
TOK_SPIKE = f"(SELECT doc_id, {DUCK.found(repr_, X.TOK_SPIKE)} AS tokens FROM documents)"


def zipped(s: str, n: int) -> str:
    """Structs of n neighbours; a lambda over them needs no other list."""
    return "list_zip(" + ", ".join(f"{s}[{k + 1}:greatest(0, len({s}) - {n - 1 - k})]" for k in range(n)) + ")"


def seq_sql(view: str) -> str:
    """doc_id and the sequence ``s`` of a view."""
    per = {"shape": ST.shape, "coarse": ST.coarse, "posish": ST.posish, "true_pos": ST.true_pos}
    if view in per:
        return f"(SELECT doc_id, {DUCK.each('tokens', 't', per[view](DUCK, 't'))} AS s FROM {TOK})"
    if view == "motif":
        pairs = f"list_filter(list_transform({zipped('s', 2)}, lambda z: {ST.motif(DUCK, 'z[1]', 'z[2]')}), lambda m: m IS NOT NULL)"
        return f"(SELECT doc_id, CASE WHEN len(m) = 0 THEN ['NO_MOTIF'] ELSE m END AS s FROM (SELECT doc_id, {pairs} AS m FROM {seq_sql('coarse')}))"
    sem = f"list_filter({DUCK.each('tokens', 't', ST.semantic(DUCK, 't'))}, lambda m: m IS NOT NULL)"
    return f"(SELECT doc_id, CASE WHEN len(m) = 0 THEN ['NO_SEMANTIC_PATTERN'] ELSE m END AS s FROM (SELECT doc_id, {sem} AS m FROM {TOK}))"


def _state_counts(view: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Q.state_counts(Q.with_states(docs(spark, sf_dir), (view,)), view)

    run.__name__ = {"shape": "shape_states", "coarse": "coarse_states", "posish": "posish_states", "true_pos": "true_pos_fallback", "motif": "motifs", "semantic": "semantic_patterns"}[view]
    query(f"SELECT doc_id, state, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(s) AS state FROM {seq_sql(view)}) GROUP BY ALL")(run)


for _view in ST.VIEWS:
    _state_counts(_view)


def _spike(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return Q.with_states(docs(spark, sf_dir), (view,), X.TOK_SPIKE)


@query(f"SELECT doc_id, state, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest({DUCK.each('tokens', 't', ST.token_type(DUCK, 't'))}) AS state FROM {TOK_SPIKE}) GROUP BY ALL")
def token_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.state_counts(_spike(spark, sf_dir, "token_type"), "token_type")


@query(f"""
WITH s AS (SELECT doc_id, {DUCK.each('tokens', 't', ST.posish_wide(DUCK, 't'))} AS s FROM {TOK_SPIKE})
SELECT gram, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM (
  SELECT doc_id, unnest(list_concat(list_transform(s, lambda t: 'posish::1=' || t), list_transform({zipped('s', 2)}, lambda z: 'posish::2=' || z[1] || '|' || z[2]))) AS gram FROM s) GROUP BY 1""")
def posish_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spike(spark, sf_dir, "posish_wide")
    found = Q.exploded(rows, ("doc_id",), F.concat(Q.grams("posish_wide", 1), Q.grams("posish_wide", 2)), "g")
    per_doc = found.groupBy("doc_id", "g").agg(F.count("*").alias("n"))
    every = per_doc.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    return every.select(F.concat(F.lit("posish::"), F.length("g").cast("string"), F.lit("="), F.when(F.length("g") == 1, Q.spelled(F.col("g"), 1)).otherwise(Q.spelled(F.col("g"), 2))).alias("gram"), "n", "docs")


@query(f"""
WITH s AS (SELECT doc_id, {ST.char_shapes(DUCK, "coalesce(text, '')")} AS s FROM documents)
SELECT gram, count(*)::BIGINT AS n FROM (SELECT unnest(list_concat(regexp_extract_all(s, '...'), list_concat(regexp_extract_all(substr(s, 2), '...'), regexp_extract_all(substr(s, 3), '...')))) AS gram FROM s) GROUP BY 1""")
def char_shape_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape letters are ASCII, so a trigram is three bytes of the shape string."""
    rows = docs(spark, sf_dir).select(F.expr(ST.char_shapes(SPARK, "coalesce(text, '')")).alias("s"))
    # three splits into triples, shifted by 0, 1 and 2, hold every trigram once
    grams = [F.expr(f"regexp_extract_all(substring(s, {k}), '...', 0)") for k in (1, 2, 3)]
    return Q.exploded(rows, (), F.concat(*grams), "gram").groupBy("gram").agg(F.count("*").alias("n"))


_LEX = f"(SELECT doc_id, {DUCK.each(DUCK.found(repr_, X.TOK_WORD), 't', 'lower(t)')} AS w FROM documents)"


@query(f"""
SELECT gram, df, n FROM (SELECT gram, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS n
  FROM (SELECT doc_id, unnest(list_transform({zipped('w', 2)}, lambda z: z[1] || '|' || z[2])) AS gram FROM {_LEX}) GROUP BY 1)
ORDER BY df DESC, gram LIMIT 200""")
def lexical_bigrams_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", Q.words().alias("w"))
    per_doc = Q.exploded(rows, ("doc_id",), Q.word_bigrams("w"), "g").groupBy("doc_id", "g").agg(F.count("*").alias("n"))
    every = per_doc.groupBy(F.translate("g", ST.WAITS, "|").alias("gram")).agg(F.count("*").alias("df"), F.sum("n").alias("n"))
    return every.orderBy(F.desc("df"), "gram").limit(200)


@query(f"SELECT gram, count(*)::BIGINT AS n FROM (SELECT unnest(list_transform({zipped('s', 3)}, lambda z: z[1] || '|' || z[3])) AS gram FROM {seq_sql('coarse')}) GROUP BY 1")
def skip_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.with_states(docs(spark, sf_dir), ("coarse",))
    per = Q.exploded(rows, (), Q.grams("coarse", 3), "g").groupBy("g").agg(F.count("*").alias("n"))
    name = F.concat_ws("|", ST.spelled(F.substring("g", 1, 1)), ST.spelled(F.substring("g", 3, 1)))
    return per.groupBy(name.alias("gram")).agg(F.sum("n").alias("n"))


@query(f"""
WITH t AS (SELECT doc_id, unnest(s) AS state, generate_subscripts(s, 1) AS pos FROM {seq_sql('shape')}),
f AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM t),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f),
r AS (SELECT doc_id, run, any_value(state) AS state, count(*) AS length FROM g GROUP BY ALL)
SELECT state, length::BIGINT AS length, count(*)::BIGINT AS n FROM r GROUP BY ALL""")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.exploded(Q.with_states(docs(spark, sf_dir), ("shape",)), (), Q.runs("shape"), "r")
    per = rows.groupBy(F.substring("r", 1, 1).alias("s"), F.length("r").cast("long").alias("length")).agg(F.count("*").alias("n"))
    return per.select(ST.spelled(F.col("s")).alias("state"), "length", "n")


@query(f"SELECT view, context, next, count(*)::BIGINT AS n FROM (SELECT 'shape' AS view, unnest(list_transform({zipped('s', 2)}, lambda z: {{'context': z[1], 'next': z[2]}}), recursive := true) FROM {seq_sql('shape')}) GROUP BY ALL")
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.with_states(docs(spark, sf_dir), ("shape",))
    return Q.told(Q.transitions(rows, ("shape",)).groupBy("gram").agg(F.count("*").alias("n"))).select("view", "context", "next", "n")


@query(f"""
WITH s AS {seq_sql('posish')},
g AS (SELECT doc_id, 2 AS ord, unnest(list_transform({zipped('s', 2)}, lambda z: z[1] || '_' || z[2])) AS gram, unnest(range(1, len(s))) AS pos FROM s
  UNION ALL SELECT doc_id, 3, unnest(list_transform({zipped('s', 3)}, lambda z: z[1] || '_' || z[2] || '_' || z[3])), unnest(range(1, len(s) - 1)) FROM s),
c AS (SELECT doc_id, ord, gram, count(*)::BIGINT AS n, min(pos) AS first FROM g GROUP BY 1, 2, 3)
SELECT doc_id, ord, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY n DESC, first) AS place FROM c) WHERE place <= 48""")
def topk_seq_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.top_ngrams(Q.with_states(docs(spark, sf_dir), ("posish",)), "posish")


_CONV = """(SELECT conv_id, list(role ORDER BY turn) AS roles,
  list(CASE WHEN length(text) < 100 THEN 'S' WHEN length(text) < 250 THEN 'M' ELSE 'L' END ORDER BY turn) AS sizes FROM conversations GROUP BY 1)"""


@query(f"""
WITH a AS (SELECT list_transform(range(1, len(roles) + 1), lambda i: roles[i] || ':' || sizes[i]) AS s, len(roles) AS n FROM {_CONV})
SELECT gram, count(*)::BIGINT AS n FROM (SELECT unnest(list_concat(list_transform(s, lambda x: '1=' || x), list_transform(range(1, len(s)), lambda i: '2=' || s[i] || '|' || s[i + 1]))) AS gram FROM a) GROUP BY 1""")
def aligned_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grams over two aligned sequences, role and size of each turn; a turn looks at the next, so no conversation is gathered."""
    n = F.length("text")
    step = F.concat("role", F.lit(":"), F.when(n < 100, "S").when(n < 250, "M").otherwise("L"))
    after = F.lead("s").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", step.alias("s")).withColumn("after", after)
    grams = F.array(F.concat(F.lit("1="), "s"), F.concat(F.lit("2="), "s", F.lit("|"), "after"))
    return Q.exploded(rows, (), grams, "gram").groupBy("gram").agg(F.count("*").alias("n"))


_EV = "(SELECT user_id, list(event_type ORDER BY ts, event_id) AS s FROM events GROUP BY 1)"


@query(f"""
WITH w AS (SELECT unnest([2, 3, 4]) AS width),
c AS (SELECT width, unnest(list_transform(range(1, len(s) - width + 2), lambda i: width || '::' || ((i - 1) // width) || '=' || array_to_string(s[i:i + width - 1], '|'))) AS gram FROM {_EV} CROSS JOIN w)
SELECT gram, count(*)::BIGINT AS n FROM c GROUP BY 1""")
def presence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window n-grams of 2 to 4 events, with the chunk that the (overlapping) start falls in; an event looks at the three after it."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    later = [F.lead("event_type", k).over(w).alias(f"e{k}") for k in range(4)]
    rows = table(spark, sf_dir, "events").select(F.row_number().over(w).alias("i"), *later)
    whole = lambda k: F.concat(F.lit(f"{k}::"), F.floor((F.col("i") - 1) / k).cast("string"), F.lit("="), *(x for j in range(k) for x in (F.lit("|" if j else ""), F.col(f"e{j}"))))
    return Q.exploded(rows, (), F.array(*map(whole, (2, 3, 4))), "gram").groupBy("gram").agg(F.count("*").alias("n"))


@query(f"""
SELECT gram, count(*)::BIGINT AS n FROM (SELECT unnest(list_concat(list_transform(s, lambda x: 'concept=' || x),
  list_transform({zipped('s', 2)}, lambda z: 'concept2=' || z[1] || '|' || z[2]), list_transform({zipped('s', 3)}, lambda z: 'concept3=' || z[1] || '|' || z[2] || '|' || z[3]))) AS gram
FROM {seq_sql('semantic')}) GROUP BY 1""")
def concept_lane_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.with_states(docs(spark, sf_dir), ("semantic",))
    per = Q.exploded(rows, (), F.concat(*(Q.grams("semantic", n) for n in (1, 2, 3))), "g").groupBy("g").agg(F.count("*").alias("n"))
    size = F.length("g")
    name = F.concat_ws("|", *(F.when(size > k, ST.spelled(F.substring("g", k + 1, 1))) for k in range(3)))
    lane = F.concat(F.lit("concept"), F.when(size > 1, size.cast("string")).otherwise(""), F.lit("="))
    return per.select(F.concat(lane, name).alias("gram"), "n")


@query("""
SELECT event_type, next_type, count(*)::BIGINT AS n, round(avg(epoch_us(nx) - epoch_us(ts)) / 1e6, 3) AS mean_gap_s
FROM (SELECT *, lead(event_type) OVER w AS next_type, lead(ts) OVER w AS nx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE next_type IS NOT NULL GROUP BY ALL""")
def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_type", "ts", F.lead("event_type").over(w).alias("next_type"), F.lead("ts").over(w).alias("nx")).filter("next_type is not null")
    return rows.groupBy("event_type", "next_type").agg(F.count("*").alias("n"), F.round(F.avg(F.unix_micros("nx") - F.unix_micros("ts")) / 1e6, 3).alias("mean_gap_s"))
