"""Document structure, evidence, phrase forms, chunks and what is summed up from chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import lexicon as X
from corpusloom.functions import text as T
from corpusloom.functions.dialect import DUCK, SPARK, Dialect, listed
from corpusloom.operators import chunking as C
from corpusloom.plans.sequences import docs, repr_
from corpusloom.plans.text import chosen
from corpusloom.queries import query
from corpusloom.sources.tables import table


def _sentences(q: Dialect, x: str) -> str:
    """Sentences end after a mark and white space; the cut is marked by a control character, as look-behind isn't portable."""
    marked = q.sub(x, r"([.!?])\s+", "$1\x01" if q is SPARK else "\\1\x01")
    cut = f"split({marked}, '\x01')" if q is SPARK else f"string_split({marked}, '\x01')"
    return q.where(cut, "s", "trim(s) <> ''")


def _spoken(q: Dialect) -> str:
    """Documents with claims, evidence, anchors and phrases spoken before and after them, by doc_id: the tables' own prose has none."""
    said = (
        (3, 0, "Organizations need an AI platform, and agentic tools in a changing landscape. "), (4, 1, "Teams will see innovation and better outcomes in their workflow. "),
        (5, 2, "According to a 2021 study by Acme Holdings, onboarding improved 12.5% in Q3 versus the baseline. "), (7, 3, "The company said it plans many important changes. It must grow. "),
        (6, 4, "Customers of NASA and Jane Doe reported 3,400 cases on 4 March 2020, a source of evidence. "), (8, 5, "Some generic support may help various stakeholders through the process. "),
    )
    each = ", ".join(f"CASE WHEN doc_id % {m} = {r} THEN '{x}' ELSE '' END" for m, r, x in said)
    return f"concat({each}, coalesce(text, ''))"


SPOKEN = f"(SELECT doc_id, {_spoken(DUCK)} AS text, source FROM documents)"


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).withColumn("text", F.expr(_spoken(SPARK)))


def _evidence(q: Dialect) -> dict[str, str]:
    text = T.plain(q, repr_)
    claims = q.size(q.where(_sentences(q, text), "s", q.like("s", X.CLAIM)))
    evidence = q.count(f"lower({text})", X.EVIDENCE)
    toks = q.found(f"lower({text})", "[a-z']+")
    abstract = q.size(q.where(toks, "w", f"w IN {q.words(X.ABSTRACT_TOKENS)}"))
    gap = f"CASE WHEN {claims} > 0 THEN greatest(0.0, ({q.double(claims)} - {evidence}) / greatest(1, {claims})) ELSE 0.0 END"
    return {
        "doc_id": "doc_id", "claim_evidence_gap": f"round({q.double(gap)}, 6)", "claim_sentences": f"cast({claims} AS bigint)", "evidence_markers": f"cast({evidence} AS bigint)",
        "named_anchors": f"cast({q.count(text, X.NAMED_ANCHOR)} AS bigint)", "date_anchors": f"cast({q.count(text, X.DATE)} AS bigint)",
        "number_anchors": f"cast({q.count(text, X.NUMBER)} AS bigint)", "abstract_ratio": f"round({q.double(abstract)} / greatest(1, {q.size(toks)}), 6)",
    }


@query(f"SELECT {listed(_evidence(DUCK))} FROM {SPOKEN}")
def evidence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spoken(spark, sf_dir), _evidence(SPARK))


@query(f"""
SELECT source, count(*)::BIGINT AS n, round(avg(claim_evidence_gap), 6) AS mean_gap, min(evidence_markers) AS min_markers, max(number_anchors) AS max_numbers, count(*) FILTER (named_anchors >= 2 AND evidence_markers + date_anchors + number_anchors >= 1)::BIGINT AS anchored
FROM (SELECT {listed(_evidence(DUCK))} FROM {SPOKEN}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY 1""")
def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chosen(spoken(spark, sf_dir), {"source": "source"} | _evidence(SPARK))
    anchored = (F.col("named_anchors") >= 2) & (F.col("evidence_markers") + F.col("date_anchors") + F.col("number_anchors") >= 1)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("claim_evidence_gap"), 6).alias("mean_gap"), F.min("evidence_markers").alias("min_markers"), F.max("number_anchors").alias("max_numbers"), F.count_if(anchored).alias("anchored"))


def _article(q: Dialect) -> str:
    """Documents with headings, lines that only look like them, blank lines and paragraphs, by doc_id: the tables hold next to none."""
    t, third = "coalesce(text, '')", f"(length(coalesce(text, '')) {'DIV' if q is SPARK else '//'} 3)"
    cut = [f"substr({t}, 1, {third})", f"substr({t}, {third} + 1, {third})", f"substr({t}, 2 * {third} + 1)"]
    broken = lambda x: f"replace({x}, '. ', concat('.', chr(10), chr(10)))"
    line = lambda *xs: ", chr(10), ".join(xs)
    shapes = [
        broken(t),
        f"concat({line("'Introduction'", broken(cut[0]), "''", "'2. Methods of Study'", broken(cut[1]), "'Discussion'", "'   '", broken(cut[2]))})",
        f"concat({line("'Human notes'", "''", broken(cut[0]), "''", "'A. Results And Outlook'", "''", cut[1] + ", " + cut[2])})",
        f"concat({line("'1.1 Only A Heading'", "'3 4 5'", "'B.  Another   Heading'", broken(t))})",
    ]
    return "CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(shapes)) + " END"


ARTICLES = f"(SELECT doc_id, {_article(DUCK)} AS text FROM documents)"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.expr(_article(SPARK)).alias("text"))


_PAGES = r"(SELECT page_id AS doc_id, concat(CASE WHEN page_id % 3 = 0 THEN concat('Abstract', chr(10)) ELSE '' END, regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g')) AS text FROM pages)"


def _page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as texts: every tag ends a line. A third begin with a heading, as the table has none."""
    head = F.when(F.col("page_id") % 3 == 0, "Abstract\n").otherwise("")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(head, F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", "\n")).alias("text"))


def _paragraphs_sql(source: str) -> str:
    """Table expressions up to p, the paragraphs."""
    return f"""
a AS (SELECT doc_id, {C.normalised(DUCK, 'text')} AS whole FROM {source} x),
l0 AS (SELECT doc_id, unnest(l) AS value, unnest(range(0, len(l))) AS line FROM (SELECT doc_id, string_split(whole, chr(10)) AS l FROM a)),
l1 AS (SELECT *, {C.is_heading(DUCK, 'value')} AS h0, {C.words(DUCK, 'value')} AS words, length(value) AS n,
  length(value) - length(regexp_replace(value, '^{T.SOME_SPACE}', '')) AS lead, length(regexp_replace(value, '{T.SOME_SPACE}$', '')) AS used FROM l0),
l2 AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(words) OVER (PARTITION BY doc_id) AS total,
  count(*) FILTER (NOT h0 AND words > 0) OVER (PARTITION BY doc_id) AS body FROM l1),
l3 AS (SELECT *, h0 AND body > 0 AS h FROM l2),
l4 AS (SELECT *, count(*) FILTER (h) OVER w AS section, count(*) FILTER (h OR words = 0) OVER w AS run,
  CASE WHEN body = 0 THEN 'document' ELSE coalesce(last_value(CASE WHEN h THEN {T.collapse(DUCK, 'value')} END IGNORE NULLS) OVER w, 'front matter') END AS name
  FROM l3 WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)),
pp AS (SELECT doc_id, run, min(section) AS section, min(name) AS heading, min(start + lead)::BIGINT AS char_start, max(start + used)::BIGINT AS char_end, sum(words)::BIGINT AS words, min(total) AS total
  FROM l4 WHERE NOT h AND words > 0 GROUP BY doc_id, run),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY char_start) AS paragraph FROM pp)"""


@query(f"SELECT doc_id, count(*) FILTER (value <> '')::BIGINT AS lines, count(*) FILTER ({C.is_heading(DUCK, 'value')})::BIGINT AS headings FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM {ARTICLES}) GROUP BY 1")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).select("doc_id", F.explode_outer(F.split("text", "\n")).alias("value"))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("value") != "").alias("lines"), F.count_if(F.expr(C.is_heading(SPARK, "value"))).alias("headings"))


_SECTIONS = "SELECT doc_id, section::BIGINT AS section, min(heading) AS heading, min(char_start) AS char_start, max(char_end) AS char_end, sum(words)::BIGINT AS words FROM p GROUP BY ALL"


@query(f"WITH {_paragraphs_sql(ARTICLES)} {_SECTIONS}")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sections(articles(spark, sf_dir))


@query(f"WITH {_paragraphs_sql(_PAGES)} {_SECTIONS}")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sections(_page_text(spark, sf_dir))


@query(f"WITH {_paragraphs_sql(ARTICLES)} SELECT doc_id, paragraph, heading, char_start, char_end, words FROM p")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines with text, cut at blank lines and headings, with their section's name."""
    return C.paragraphs(articles(spark, sf_dir)).select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "heading", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "words")


_CHUNKS = f"""(WITH RECURSIVE {_paragraphs_sql(ARTICLES)},
d AS (SELECT doc_id, min(total) AS total, list(words ORDER BY paragraph) AS ws, list(section ORDER BY paragraph) AS ss FROM p GROUP BY 1),
m AS (SELECT *, least(900, greatest(320, ceil(total / 48)))::BIGINT AS most FROM d WHERE total >= 40),
g AS (SELECT *, least(most, greatest(180, ceil(most * 0.58)))::BIGINT AS target FROM m),
r AS (SELECT doc_id, ws, ss, most, target, 1 AS i, 0::BIGINT AS buf, 0 AS n, 1 AS first, []::STRUCT(first INT, last INT, words BIGINT, kind VARCHAR, piece INT)[] AS out FROM g
  UNION ALL
  SELECT doc_id, ws, ss, most, target, i + 1, CASE WHEN shut THEN 0 ELSE nbuf END, CASE WHEN shut THEN 0 WHEN fresh THEN 1 ELSE n + 1 END, CASE WHEN shut THEN i + 1 ELSE nfirst END,
    list_concat(out, CASE WHEN n > 0 AND (i > len(ws) OR w >= most OR over) THEN [{{'first': first, 'last': i - 1, 'words': buf, 'kind': CASE WHEN i - 1 > first THEN 'paragraph_merge' ELSE 'paragraph' END, 'piece': 0}}] ELSE [] END,
      CASE WHEN i > len(ws) THEN [] WHEN w >= most THEN list_transform(range(0, ceil(w / most)::INT), lambda k: {{'first': i, 'last': i, 'words': least(most, w - k * most), 'kind': 'long_paragraph_split', 'piece': k}})
        WHEN nbuf >= target THEN [{{'first': nfirst, 'last': i, 'words': nbuf, 'kind': CASE WHEN i > nfirst THEN 'paragraph_merge' ELSE 'paragraph' END, 'piece': 0}}] ELSE [] END)
  FROM (SELECT *, CASE WHEN fresh THEN w ELSE buf + w END AS nbuf, CASE WHEN fresh THEN i ELSE first END AS nfirst, i > len(ws) OR w >= most OR CASE WHEN fresh THEN w ELSE buf + w END >= target AS shut
    FROM (SELECT *, over OR n = 0 AS fresh FROM (SELECT *, coalesce(ws[i], 0) AS w, n > 0 AND i <= len(ws) AND (buf + ws[i] > most OR ss[i] <> ss[i - 1]) AS over FROM r WHERE i <= len(ws) + 1)))),
o AS (SELECT doc_id, out, most FROM r WHERE i = len(ws) + 2),
c AS (SELECT doc_id, most, k::BIGINT AS chunk_index, len(out)::BIGINT AS chunk_total, out[k] AS c FROM (SELECT *, unnest(range(1, least(48, len(out)) + 1)) AS k FROM o)),
t AS (SELECT c.*, x.heading, x.char_start, y.char_end, substr(whole, x.char_start + 1, y.char_end - x.char_start) AS body FROM c JOIN p x ON x.doc_id = c.doc_id AND x.paragraph = c.c.first JOIN p y ON y.doc_id = c.doc_id AND y.paragraph = c.c.last JOIN a ON a.doc_id = c.doc_id),
u AS (SELECT *, CASE WHEN c.kind = 'long_paragraph_split' THEN regexp_extract_all(body, '(?:{T.SOME_TEXT}[{X.SPACE}]*){{1,' || most || '}}') END AS pieces FROM t),
v AS (SELECT *, CASE WHEN pieces IS NOT NULL THEN char_start + coalesce(list_sum(list_transform(pieces[1:c.piece], lambda x: length(x))), 0) ELSE char_start END AS begins,
  CASE WHEN pieces IS NOT NULL THEN regexp_replace(pieces[c.piece + 1], '{T.SOME_SPACE}$', '') ELSE regexp_replace(body, '{X.PARAGRAPH_GAP}', chr(10) || chr(10), 'g') END AS text FROM u)
SELECT doc_id, chunk_index, chunk_total, c.kind AS kind, heading, c.first::BIGINT AS paragraph_start, c.last::BIGINT AS paragraph_end, begins::BIGINT AS char_start,
  CASE WHEN pieces IS NOT NULL THEN begins + length(text) ELSE char_end END::BIGINT AS char_end, c.words::BIGINT AS words, CASE WHEN c.words >= 80 THEN 'high' WHEN c.words >= 45 THEN 'medium' ELSE 'low' END AS reliability, text FROM v)"""


@query(f"SELECT * EXCLUDE (text), sha256(text) AS text_hash FROM {_CHUNKS}")
def chunks_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by section, with headings, paragraphs, offsets and reliability; the text by its hash."""
    return C.chunks(articles(spark, sf_dir)).withColumn("text_hash", F.sha2("text", 256)).drop("text")


_GROUPS = f"""
z AS (SELECT doc_id, section, sum(words) AS body, min(heading) AS own, min(paragraph) AS opens FROM p GROUP BY ALL),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section) = 1 OR lower(own) = 'references' OR body >= 80 AS begins FROM z),
x AS (SELECT *, count(*) FILTER (begins) OVER w AS grp, last_value(CASE WHEN begins THEN own END IGNORE NULLS) OVER w AS heading FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY section ROWS UNBOUNDED PRECEDING)),
q AS (SELECT p.doc_id, grp, x.heading, paragraph, words + CASE WHEN NOT begins AND paragraph = opens THEN {C.words(DUCK, 'own')} ELSE 0 END AS words FROM p JOIN x ON x.doc_id = p.doc_id AND x.section = p.section)"""


@query(f"WITH {_paragraphs_sql(ARTICLES)},{_GROUPS} SELECT doc_id, grp::BIGINT AS section, min(heading) AS heading, count(*)::BIGINT AS paragraphs, sum(words)::BIGINT AS words FROM q GROUP BY doc_id, grp")
def calibration_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections for calibration: short ones join the one before."""
    got = C.calibration_sections(articles(spark, sf_dir)).groupBy("doc_id", "group").agg(F.min("group_heading").alias("heading"), F.count("*").alias("paragraphs"), F.sum("words").cast("long").alias("words"))
    return got.withColumnRenamed("group", "section")


_CALIBRATION = f"""WITH RECURSIVE {_paragraphs_sql(ARTICLES)},{_GROUPS},
d AS (SELECT doc_id, list(words ORDER BY paragraph) AS ws, list(grp ORDER BY paragraph) AS gs, list(heading ORDER BY paragraph) AS hs,
  list(CASE WHEN heading IN ('front matter', 'document') THEN 0 ELSE {C.words(DUCK, 'heading')} END ORDER BY paragraph) AS heads FROM q GROUP BY 1),
r AS (SELECT doc_id, ws, gs, hs, heads, 1 AS i, 0::BIGINT AS buf, 0 AS n, []::STRUCT(words BIGINT, kind VARCHAR, heading VARCHAR)[] AS out FROM d
  UNION ALL SELECT doc_id, ws, gs, hs, heads, i + 1, CASE WHEN i > len(ws) OR w >= 320 THEN 0 WHEN over OR n = 0 THEN w ELSE buf + w END, CASE WHEN i > len(ws) OR w >= 320 THEN 0 WHEN over OR n = 0 THEN 1 ELSE n + 1 END,
    list_concat(out, CASE WHEN n > 0 AND (i > len(ws) OR w >= 320 OR over) THEN [{{'words': buf + heads[i - 1], 'kind': 'article_section_merge', 'heading': hs[i - 1]}}] ELSE [] END,
      CASE WHEN i <= len(ws) AND w >= 320 THEN list_transform(range(0, ceil(w / 320)::INT), lambda k: {{'words': least(320, w - k * 320), 'kind': 'article_long_paragraph', 'heading': hs[i]}}) ELSE [] END)
  FROM (SELECT *, coalesce(ws[i], 0) AS w, n > 0 AND i <= len(ws) AND (buf + ws[i] + n > 320 OR gs[i] <> gs[i - 1]) AS over FROM r WHERE i <= len(ws) + 1)),
k AS (SELECT doc_id, list_filter(out, lambda c: c.words >= 100) AS out FROM r WHERE i = len(ws) + 2)
SELECT doc_id, j::BIGINT AS chunk_index, len(out)::BIGINT AS chunk_total, (out[j]).heading AS heading, (out[j]).kind AS kind, (out[j]).words::BIGINT AS words FROM (SELECT *, unnest(range(1, len(out) + 1)) AS j FROM k)"""


@query(_CALIBRATION)
def calibration_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.calibration_chunks(articles(spark, sf_dir))


@query("""
WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT * FROM t WHERE role = 'user' AND next_role = 'assistant')
SELECT conv_id, turn, side, sha256(text) AS question_hash, substr(body, 1, 180) AS preview, length(body)::BIGINT AS chars
FROM (SELECT conv_id, turn, text, unnest(['human', 'ai']) AS side, unnest([text, next_text]) AS body FROM q) WHERE coalesce(trim(body), '') <> ''""")
def unpivot_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question and its answer become two rows, for sides that have text."""
    w = W.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    sides = F.array(F.struct(F.lit("human").alias("side"), F.col("text").alias("body")), F.struct(F.lit("ai").alias("side"), F.col("next_text").alias("body")))
    rows = t.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.sha2("text", 256).alias("question_hash"), F.inline(sides)).filter("trim(body) <> ''")
    return rows.select("conv_id", "turn", "side", "question_hash", F.substring("body", 1, 180).alias("preview"), F.length("body").cast("long").alias("chars"))


def _phrase(q: Dialect, family: str) -> str:
    """Whole-phrase containment: word boundaries where a phrase begins or ends with a word character."""
    low = f"lower({T.plain(q, repr_)})"
    alternatives = []
    for p in X.PHRASES[family]:
        esc = "".join("\\" + c if c in ".%-" else c for c in p)
        alternatives.append((r"\b" if p[0].isalnum() else "") + esc + (r"\b" if p[-1].isalnum() else ""))
    return q.like(low, "|".join(alternatives))


def _forms(q: Dialect) -> tuple[dict[str, str], dict[str, str]]:
    """Flags by family of phrases, and what is derived from them."""
    has = {k: _phrase(q, k) for k in X.PHRASES}
    has["measurable"] = f"({has['measurable']} OR {has['metric']})"
    pick = lambda rules: "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules) + ")"
    concepts = pick([("MarketChange", "market_change"), ("Organization", "org_need"), ("AISolution", "ai_solution"), ("AbstractBusinessOutcome", "abstract_benefit"), ("GenericAudience", "generic_audience"), ("SpecificWorkflow", "workflow")])
    logic = pick([("ChangingLandscapeClaim", "market_change"), ("OrganizationNeedClaim", "org_need"), ("AISolutionClaim", "ai_solution"), ("AbstractBenefitClaim", "abstract_benefit"), ("GenericAudienceBenefitClaim", "generic_audience AND abstract_benefit"), ("MeasurableClaim", "measurable"), ("MeasuredPerformanceClaim", "metric AND timeframe AND workflow")])
    propositions = pick([("Organization needs ScalableSolution", "org_need"), ("TechnologySystem enables AbstractBusinessOutcome", "ai_solution AND abstract_benefit"), ("AbstractBusinessOutcome benefits GenericAudience", "ai_solution AND abstract_benefit")])
    ground = [("metric", "metric"), ("baseline", "baseline"), ("timeframe", "timeframe"), ("specific_workflow", "workflow"), ("specific_audience", "specific_audience"), ("evidence_source", "evidence_source")]
    missing = pick([(n, f"NOT {c}") for n, c in ground] + [("audience_boundary", "NOT specific_audience")])
    return has, {"concepts": concepts, "logic": logic, "propositions": propositions, "missing": missing, "grounded": pick(ground)}


def _forms_sql() -> str:
    has, derived = _forms(DUCK)
    return f"SELECT doc_id, {listed(derived)} FROM (SELECT doc_id, {listed(has)} FROM {SPOKEN})"


@query(_forms_sql())
def phrase_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts, logic, propositions, missing bindings and groundings by families of phrases."""
    has, derived = _forms(SPARK)
    flags = spoken(spark, sf_dir).select("doc_id", *(F.expr(v).alias(k) for k, v in has.items()))
    return flags.select("doc_id", *(F.expr(v).alias(k) for k, v in derived.items()))


@query(f"""
WITH f AS ({_forms_sql()})
SELECT doc_id, len(missing_) ::BIGINT AS n_missing, list_contains(logic_, 'MeasurableClaim') AS measurable,
  len(list_filter(range(1, len(concepts_)), lambda i: concepts_[i:i + 1] = ['GenericAudience', 'SpecificWorkflow'])) > 0 AS motif_found,
  CASE WHEN len(logic_) >= 4 THEN 'dense' WHEN len(logic_) >= 1 THEN 'some' ELSE 'none' END AS density
FROM (SELECT doc_id, string_split(missing, '|') AS missing_, list_filter(string_split(logic, '|'), lambda x: x <> '') AS logic_, string_split(concepts, '|') AS concepts_ FROM f)""")
def motif_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contiguous pattern within the concept sequence, and summaries of the other parts."""
    f = phrase_forms(spark, sf_dir)
    logic = F.filter(F.split("logic", r"\|"), lambda x: x != "")
    found = F.expr("exists(sequence(1, size(split(concepts, '\\\\|'))), i -> slice(split(concepts, '\\\\|'), i, 2) = array('GenericAudience', 'SpecificWorkflow'))")
    return f.select("doc_id", F.size(F.split("missing", r"\|")).cast("long").alias("n_missing"), F.array_contains(logic, "MeasurableClaim").alias("measurable"), found.alias("motif_found"), F.when(F.size(logic) >= 4, "dense").when(F.size(logic) >= 1, "some").otherwise("none").alias("density"))
