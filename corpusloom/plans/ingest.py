"""Raw rows to documents: labels, ids, candidate texts, selection, and sequences of enriched rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import coerce as CO
from corpusloom.functions import lexicon as X
from corpusloom.functions import text as T
from corpusloom.functions.dialect import DUCK, SPARK, Dialect, listed
from corpusloom.operators.ordinals import numbered
from corpusloom.plans.documents import SPOKEN, _evidence, spoken
from corpusloom.plans.sequences import seq_sql
from corpusloom.plans.text import chosen
from corpusloom.queries import query
from corpusloom.sources.tables import table

_RAW = ("1", "0", " AI ", "human", "Generated", "", "01", "-0", "maybe", "True", "human-authored", "0.5", "+1", None, "machine", "HUMAN_WRITTEN", "2", "ai_generated")


def _raw(q: Dialect) -> dict[str, str]:
    """Rows as sources give them, from the documents by doc_id: labels in many spellings, some blank fields."""
    cases = " ".join(f"WHEN {k} THEN {'NULL' if v is None else q.lit(v)}" for k, v in enumerate(_RAW))
    return {
        "doc_id": "doc_id", "lang": "lang", "source": "source", "raw": f"CASE doc_id % {len(_RAW)} {cases} END",
        "source_type": "CASE doc_id % 5 WHEN 0 THEN 'ai_generated' WHEN 1 THEN 'Human_Written ' WHEN 2 THEN '' ELSE NULL END",
        "grounding_status": "CASE WHEN doc_id % 7 < 5 THEN 'grounded' ELSE 'pending' END", "key": f"doc_id {'DIV' if q is SPARK else '//'} 2",
        "text": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE text END", "normalized_text": "CASE WHEN doc_id % 4 = 0 AND doc_id % 3 = 0 THEN concat('  ', text, ' ') ELSE '  ' END",
        "content": "CASE WHEN doc_id % 8 = 4 THEN text END", "title": "concat(' title ', cast(doc_id AS varchar(20)), ' ')",
        "doc_type": "CASE doc_id % 6 WHEN 0 THEN 'news_article' WHEN 1 THEN 'sec_filing' WHEN 2 THEN 'blog' ELSE NULL END",
    }


RAW = f"(SELECT {listed(_raw(DUCK))} FROM documents)"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(table(spark, sf_dir, "documents"), _raw(SPARK))


def _labels(q: Dialect) -> dict[str, str]:
    return {
        "doc_id": "doc_id", "numeric_label": CO.numeric_label(q, "raw"), "text_label": CO.text_label(q, "raw"), "harsh_label": CO.harsh_label(q, "raw"),
        "parsed_type": CO.source_type(q, "raw"), "label": f"cast({CO.label(q, 'raw', 'source_type')} AS int)",
    }


@query(f"SELECT {listed(_labels(DUCK))} FROM {RAW}")
def label_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ways to read a label."""
    return chosen(raw(spark, sf_dir), _labels(SPARK))


def _coerced(q: Dialect) -> dict[str, str]:
    return {
        "doc_id": "doc_id", "label": "label", "source_type": "CASE WHEN label = 1 THEN 'ai_generated' ELSE 'human_written' END", "dataset": "coalesce(source, 'unknown')",
        "domain": "'unknown'", "doc_type": "coalesce(doc_type, 'unknown')", "corpus_role": "'supervised'",
    }


def coerced(rows: DataFrame) -> DataFrame:
    """Labelled rows only, the source type by the label, defaults for what is missing."""
    return chosen(rows.withColumn("label", F.expr(CO.label(SPARK, "raw", "source_type"))).filter("label is not null"), _coerced(SPARK))


@query(f"SELECT {listed(_coerced(DUCK))} FROM (SELECT *, {CO.label(DUCK, 'raw', 'source_type')} AS label FROM {RAW}) WHERE label IS NOT NULL")
def coerced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coerced(raw(spark, sf_dir))


_FIELDS = ("text", "normalized_text", "content")


@query(f"SELECT doc_id, sha256({CO.candidate_text(_FIELDS, 'title', False)}) AS as_is, sha256({CO.candidate_text(_FIELDS, 'title', True)}) AS stripped FROM {RAW}")
def candidate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first field with text, else the title."""
    pick = lambda strip: F.sha2(F.expr(CO.candidate_text(_FIELDS, "title", strip)), 256)
    return raw(spark, sf_dir).select("doc_id", pick(False).alias("as_is"), pick(True).alias("stripped"))


@query(f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, lang, {T.collapse(DUCK, 'text')} AS text FROM documents),
c AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, {T.collapse(DUCK, 'text')} AS text FROM conversations WHERE {T.collapse(DUCK, 'text')} <> ''),
e AS (SELECT 'documents' AS dataset, 'doc_' || coalesce(lang, 'none') || '_' || lpad(i::VARCHAR, 6, '0') AS doc_id, i, text FROM d WHERE text <> ''
  UNION ALL SELECT 'conversations', 'chat_' || lpad(i::VARCHAR, 6, '0'), i, text FROM c)
SELECT dataset, doc_id, sha256(text) AS text_hash, length(text)::BIGINT AS text_length, 'pending' AS grounding_status FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY i) AS p FROM e) WHERE p <= 400""")
def normalized_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources with ids by position, as a plan of rows, each source capped in arrival order.

    In the first an empty text takes a position, in the second it doesn't.
    """
    text = F.expr(T.collapse(SPARK, "text"))
    d = numbered(table(spark, sf_dir, "documents").select("doc_id", "lang", text.alias("text")), ["doc_id"]).filter("text <> ''")
    c = numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text")).filter("text <> ''"), ["conv_id", "turn"])
    pad = F.lpad(F.col("ordinal").cast("string"), 6, "0")
    d = d.select(F.lit("documents").alias("dataset"), F.concat(F.lit("doc_"), F.coalesce("lang", F.lit("none")), F.lit("_"), pad).alias("doc_id"), "ordinal", "text")
    c = c.select(F.lit("conversations").alias("dataset"), F.concat(F.lit("chat_"), pad).alias("doc_id"), "ordinal", "text")
    place = F.row_number().over(W.partitionBy("dataset").orderBy("ordinal"))  # at most 400 rows of a source leave a task
    capped = d.unionByName(c).select("dataset", "doc_id", "ordinal", F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("text_length")).withColumn("p", place).filter("p <= 400")
    return capped.select("dataset", "doc_id", "text_hash", "text_length", F.lit("pending").alias("grounding_status"))


@query(f"""
SELECT key, doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS p FROM (SELECT *, {CO.label(DUCK, 'raw', 'source_type')}::INT AS label FROM {RAW}) WHERE label IS NOT NULL AND grounding_status = 'grounded') WHERE p = 1""")
def grounded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a label that are grounded, the first of each key, as a grouped minimum."""
    rows = raw(spark, sf_dir).withColumn("label", F.expr(f"cast({CO.label(SPARK, 'raw', 'source_type')} AS int)")).filter("label is not null and grounding_status = 'grounded'")
    first = rows.groupBy("key").agg(F.min(F.struct("doc_id", "label")).alias("r"))
    return first.select("key", "r.doc_id", "r.label")


@query(f"SELECT source, count(*)::BIGINT AS n FROM {RAW} WHERE source IN ('src0', 'src3', 'src5') AND trim(coalesce(text, '')) <> '' GROUP BY 1")
def allow_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of listed datasets that have text."""
    return raw(spark, sf_dir).filter(F.col("source").isin("src0", "src3", "src5") & (F.trim(F.coalesce("text", F.lit(""))) != "")).groupBy("source").agg(F.count("*").alias("n"))


_PROBE = f"SELECT s.doc_id, doc_type, {CO.label(DUCK, 'raw', 'source_type')} AS label, named_anchors, evidence_markers, date_anchors, number_anchors FROM (SELECT {listed(_evidence(DUCK))} FROM {SPOKEN}) s JOIN {RAW} r ON r.doc_id = s.doc_id"


@query(f"""
SELECT coalesce(doc_type, 'unknown') AS doc_type, count(*)::BIGINT AS n,
  count(*) FILTER (label = 0 AND doc_type IN {DUCK.words(X.PROBE_TYPES)} AND named_anchors >= 2 AND evidence_markers + date_anchors + number_anchors >= 1)::BIGINT AS false_positive_probes,
  count(*) FILTER (label = 1 AND evidence_markers <= 1 AND named_anchors <= 1)::BIGINT AS low_evidence_probes FROM ({_PROBE}) GROUP BY 1""")
def probe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a model may take for the other class: well anchored human reports, generated texts without evidence."""
    e = chosen(spoken(spark, sf_dir), _evidence(SPARK))
    rows = e.join(raw(spark, sf_dir).select("doc_id", "doc_type", F.expr(CO.label(SPARK, "raw", "source_type")).alias("label")), "doc_id")
    human = (F.col("label") == 0) & F.col("doc_type").isin(*X.PROBE_TYPES.split()) & (F.col("named_anchors") >= 2) & (F.col("evidence_markers") + F.col("date_anchors") + F.col("number_anchors") >= 1)
    machine = (F.col("label") == 1) & (F.col("evidence_markers") <= 1) & (F.col("named_anchors") <= 1)
    return rows.groupBy(F.coalesce("doc_type", F.lit("unknown")).alias("doc_type")).agg(F.count("*").alias("n"), F.count_if(human).alias("false_positive_probes"), F.count_if(machine).alias("low_evidence_probes"))


def _enriched(q: Dialect) -> dict[str, str]:
    """Enriched rows, from the documents by doc_id: terms, relations, lexical names and parts of speech, some null or of no value."""
    one = {"t": "['Process', 'none', 'Human', ' ', 'no_sumo_mapping']", "r": "['=', 'unknown', '+']", "l": "['noun.act', 'NULL', 'verb.motion']", "p": "['n', 'v', 'no_mapping', 'a']"}
    arr = lambda x: f"array({x[1:-1]})" if q is SPARK else x
    part = lambda x, m: f"CASE doc_id % {m} WHEN 0 THEN NULL WHEN 1 THEN {arr('[' + x[1:-1].split(', ')[1] + ']')} ELSE {arr(x)} END"
    return {"doc_id": "doc_id", "text": "text", "terms": part(one["t"], 3), "relations": part(one["r"], 4), "lexnames": part(one["l"], 5), "poses": part(one["p"], 6)}


def _valid(q: Dialect, xs: str, prefix: str) -> str:
    kept = q.where(f"coalesce({xs}, {'array()' if q is SPARK else '[]::VARCHAR[]'})", "x", f"trim(x) <> '' AND lower(trim(x)) NOT IN {q.words(X.NULL_WORDS)}")
    return q.each(kept, "y", f"concat('{prefix}', y)")


def row_sequence(q: Dialect) -> str:
    """The semantic sequence of an enriched row; a term of no value leaves a mark, others go."""
    null_words = q.words(X.NULL_WORDS)
    empty = "array()" if q is SPARK else "[]::VARCHAR[]"
    terms = q.each(f"coalesce(terms, {empty})", "x", f"CASE WHEN trim(x) <> '' AND lower(trim(x)) NOT IN {null_words} THEN concat('SUMO::', x) ELSE 'NO_SUMO_MAPPING' END")
    parts = [terms, _valid(q, "relations", "SUMO_REL::"), _valid(q, "lexnames", "WORDNET_LEX::"), _valid(q, "poses", "WORDNET_POS::")]
    joined = f"concat({', '.join(parts)})" if q is SPARK else f"list_concat(list_concat({parts[0]}, {parts[1]}), list_concat({parts[2]}, {parts[3]}))"
    return f"CASE WHEN {q.size(joined)} = 0 THEN 'NO_SEMANTIC_PATTERN' ELSE {'array_join' if q is SPARK else 'array_to_string'}({joined}, '|') END"


_BARE = "coalesce({s}(terms), 0) + coalesce({s}(relations), 0) + coalesce({s}(lexnames), 0) + coalesce({s}(poses), 0) = 0"


@query(f"SELECT e.doc_id, CASE WHEN {_BARE.format(s='len')} THEN array_to_string(s.s, '|') ELSE {row_sequence(DUCK)} END AS sequence FROM (SELECT {listed(_enriched(DUCK))} FROM documents) e JOIN {seq_sql('semantic')} s ON s.doc_id = e.doc_id")
def enriched_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence that the enrichment gives, or for rows without any that of the text's own patterns."""
    from corpusloom.functions import states as ST
    from corpusloom.operators import sequences as Q

    rows = Q.with_states(chosen(table(spark, sf_dir, "documents"), _enriched(SPARK)), ("semantic",))
    own = F.array_join(F.transform(F.filter(F.split("semantic", ""), lambda c: c != ""), lambda c: ST.spelled(c)), "|")
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    bare = size("terms") + size("relations") + size("lexnames") + size("poses") == 0
    return rows.select("doc_id", F.when(bare, own).otherwise(F.expr(row_sequence(SPARK))).alias("sequence"))


@query(f"""
SELECT lemma, count(*)::BIGINT AS n, count(*) FILTER (numeric)::BIGINT AS numbers, count(*) FILTER (exact)::BIGINT AS specific FROM (
  SELECT {CO.lemma(DUCK, 't')} AS lemma, {CO.numeric(DUCK, 't')} AS numeric, {CO.numeric(DUCK, 't')} AND {CO.numeric_specific(DUCK, 't')} AS exact
  FROM (SELECT lower(unnest({DUCK.found("coalesce(text, '')", X.TOK_LEXICAL)})) AS t FROM documents)) GROUP BY 1""")
def lemma_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by their lemma, and which are numbers, and specific ones."""
    from corpusloom.operators import sequences as Q

    found = Q.exploded(table(spark, sf_dir, "documents"), (), Q.tokens(pattern=X.TOK_LEXICAL), "w").select(F.lower("w").alias("t"))
    per = found.groupBy("t").agg(F.count("*").alias("n"))  # rules run once for each distinct token
    number = F.expr(CO.numeric(SPARK, "t"))
    ruled = per.select(F.expr(CO.lemma(SPARK, "t")).alias("lemma"), "n", number.alias("numeric"), (number & F.expr(CO.numeric_specific(SPARK, "t"))).alias("exact"))
    return ruled.groupBy("lemma").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("numeric"), F.col("n")).otherwise(0)).alias("numbers"), F.sum(F.when(F.col("exact"), F.col("n")).otherwise(0)).alias("specific"))


@query(f"""
WITH p AS (SELECT doc_id, {T.text_hash(DUCK, 'text')} AS h FROM documents WHERE doc_id % 2 = 0), f AS (SELECT doc_id, lang, {T.text_hash(DUCK, 'text')} AS h FROM documents WHERE doc_id % 2 = 1)
SELECT lang, count(*)::BIGINT AS fallback FROM f WHERE h NOT IN (SELECT h FROM p) GROUP BY 1""")
def fallback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a second source whose text the first, chosen one does not have: an anti join by hash."""
    h = table(spark, sf_dir, "documents").select("doc_id", "lang", F.expr(T.text_hash(SPARK, "text")).alias("h"))
    return h.filter("doc_id % 2 = 1").join(h.filter("doc_id % 2 = 0").select("h"), "h", "left_anti").groupBy("lang").agg(F.count("*").alias("fallback"))
