"""Documents, embeddings, vector search and prompt texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from storegrain.catalog import query
from storegrain.catalog.quality import FACTORS, HEADS, LEVEL, heads
from storegrain.catalog.statistics import CUBE, LAST_TURNS, STATS_TEXT, TOPS, text_sql
from storegrain.catalog.views import REQUESTS_SQL, rounded, stores, table, uniform_sql, view, with_stores
from storegrain.functions import risk
from storegrain.functions.columns import draw
from storegrain.operators import reports, requests, search, stats
from storegrain.operators.joins import attach
from storegrain.operators.ranking import top_k
from storegrain.session import stage, staging_path

DOCUMENT_TEXT = """store_name || ' | 업종: ' || category_large || ' | 세부: ' || category_mid || ' | 위치: ' || sgg_name || ' ' || adong_name
  || coalesce(' | 상태: ' || CASE biz_status_cd WHEN '01' THEN '영업중' WHEN '02' THEN '휴업' WHEN '03' THEN '폐업' END, '')"""


@query("store_documents", with_stores(f"SELECT 'store_' || biz_id AS id, {DOCUMENT_TEXT} AS text FROM stores"))
def store_documents(spark, folder):
    return search.store_documents(stores(spark, folder)).select("id", "text")


@query("store_metadata", with_stores("""
SELECT 'store_' || biz_id AS id, category_large AS category, category_mid AS sub_category, adong_name AS district, sgg_name AS sgg,
  CASE biz_status_cd WHEN '01' THEN '영업중' WHEN '02' THEN '휴업' WHEN '03' THEN '폐업' END AS status,
  CASE WHEN biz_status_cd IS NULL THEN 4 ELSE 5 END AS n_entries FROM stores"""))
def store_metadata(spark, folder):
    docs = search.store_documents(stores(spark, folder))
    keys = ["category", "sub_category", "district", "sgg", "status"]
    return docs.select("id", *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in keys], F.size("metadata").alias("n_entries"))


def index(spark, folder) -> DataFrame:
    """Embedded store documents, written as the search index."""
    docs = search.store_documents(stores(spark, folder)).select("id", "text")
    embedded = search.embed_with_model(docs, search.fit_text_embedder(docs))
    return stage(embedded, "index")


@query("embed_documents")
def embed_documents(spark, folder):
    return index(spark, folder).select("id", F.size("embedding").alias("dimensions"), "embedding")


@query("embed_with_function", """SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents""")
def embed_with_function(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    embedded = search.embed_with(docs, lambda texts: [[float(len(t)), 1.0] for t in texts])
    return embedded.select("doc_id", F.col("embedding")[0].cast("bigint").alias("n_chars"))


@query("embed_failures", """
SELECT count(*) FILTER (length(text) % 7 > 0) AS n_embedded, count(*) FILTER (length(text) % 7 = 0) AS n_failed, true AS all_failed_retried FROM documents""")
def embed_failures(spark, folder):
    """An embedder that refuses any batch with a text whose length is divisible by seven: only those texts fail in the end."""
    def embedder(texts):
        if any(len(t) % 7 == 0 for t in texts):
            raise ValueError("length")
        return [[float(len(t)), 1.0] for t in texts]

    docs = table(spark, folder, "documents").select("doc_id", "text")
    counts = search.embed_counts(stage(search.embed_or_explain(docs, embedder), "embedded"))
    return counts.select("n_embedded", "n_failed", (F.col("n_retried") >= F.col("n_failed")).alias("all_failed_retried"))


@query("doc_count", with_stores("SELECT count(*) AS n_docs FROM stores"))
def doc_count(spark, folder):
    """Documents in the search index: those with a vector."""
    return index(spark, folder).filter("embedding is not null").agg(F.count("*").alias("n_docs"))


@query("stored_index", """
SELECT count(*) AS n_docs, count(*) FILTER (vec_id % 50 = 0) * 5 AS n_exact, true AS enough FROM embeddings WHERE embedding IS NOT NULL""")
def stored_index(spark, folder):
    """An index that lasts: built with the even ids, the odd ones added (twice, as by a retry), asked for every vector whose id is divisible by 50."""
    docs = table(spark, folder, "embeddings").select("vec_id", "embedding")
    path, even = staging_path(spark, "stored-index"), F.col("vec_id") % 2 == 0
    known = search.StoredIndex(spark, path, "vec_id").reset(docs.filter(even))
    for _ in range(2):
        known.add(docs.filter(~even), "odd")
    asked = docs.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    again = search.StoredIndex(spark, path, "vec_id")
    found = search.recall(again.search(asked, 5), search.nearest(docs, asked, 5, doc_id="vec_id"), "vec_id")
    n_docs = again.count().first()[0]
    return found.select(F.lit(n_docs).cast("long").alias("n_docs"), "n_exact", (F.col("recall") >= 0.9).alias("enough"))


def centroids(spark, folder) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    rows = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy("label").agg(F.transform(ordered, lambda p: p["x"]).alias("embedding")).select(
        F.col("label").cast("bigint").alias("query_id"), "embedding")


@query("cosine_topk", """
WITH means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (
    SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
queries AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY i) AS q FROM means GROUP BY 1)
SELECT query_id, vec_id, round(similarity, 4) AS similarity, rank FROM (
  SELECT query_id, vec_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank
  FROM (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS similarity FROM embeddings, queries))
WHERE rank <= 5""")
def cosine_topk(spark, folder):
    docs = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return rounded(search.nearest(docs, centroids(spark, folder), 5, doc_id="vec_id"), 4, "similarity")


@query("ann_topk")
def ann_topk(spark, folder):
    """Neighbours of every vector whose id is divisible by 50."""
    docs = table(spark, folder, "embeddings").select("vec_id", "embedding")
    asked = docs.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return search.nearest_approx(search.fit_index(docs, doc_id="vec_id"), docs, asked, 5, doc_id="vec_id")


@query("ann_centroids")
def ann_centroids(spark, folder):
    """Neighbours of the mean of each label."""
    docs = table(spark, folder, "embeddings").select("vec_id", "embedding")
    model = search.fit_index(docs, doc_id="vec_id")
    return search.nearest_approx(model, docs, stage(centroids(spark, folder), "centroids"), 5, doc_id="vec_id")


@query("ann_recall", """SELECT count(*) * 5 AS n_exact, TRUE AS enough FROM embeddings WHERE vec_id % 50 = 0 AND embedding IS NOT NULL""")
def ann_recall(spark, folder):
    """Recall of the index against exact search, for every vector whose id is divisible by 50."""
    docs = table(spark, folder, "embeddings").select("vec_id", "embedding")
    asked = docs.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    found = search.nearest_approx(search.fit_index(docs, doc_id="vec_id"), docs, asked, 5, doc_id="vec_id")
    exact = search.nearest(docs, asked, 5, doc_id="vec_id")
    return search.recall(found, exact, "vec_id").select("n_exact", (F.col("recall") >= 0.9).alias("enough"))


def contexts(spark, folder) -> DataFrame:
    """Search results for each distinct pair of district and category among the requests."""
    docs = search.store_documents(stores(spark, folder)).select("id", "text")
    model = search.fit_text_embedder(docs)
    asked = view(spark, folder, REQUESTS_SQL).select(
        F.concat_ws(" ", "district", "business_category").alias("query_id")).distinct()
    asked = stage(search.embed_with_model(asked.withColumn("text", F.col("query_id")), model), "questions")
    found = stage(search.nearest(stage(search.embed_with_model(docs, model), "index"), asked, 5), "found")
    return search.search_context(found, docs)


@query("search_context")
def search_context(spark, folder):
    return contexts(spark, folder)


def predicted(spark, folder) -> DataFrame:
    """Store rows with drawn predictions in their final form, and the number of their founder's conversation."""
    rows = heads(spark, folder).withColumns({
        "survival_3yr": draw("biz_id", "h5"), "monthly_profit": draw("biz_id", "h6") * 1e6,
        "conv_id": F.regexp_extract("store_name", "[0-9]+$", 0).cast("bigint")})
    out = requests.postprocess(rows.withColumnsRenamed({"category_large": "business_category", "category_mid": "business_sub_category"}))
    return out.withColumnRenamed("adong_name", "district")


def with_statistics(spark, folder, rows: DataFrame) -> DataFrame:
    """Rows beside the statistics text, top lists included, of their category and district."""
    counted = stores(spark, folder)
    texts = reports.stats_text(stats.stats_cube(counted), stats.scope_tops(counted)).filter("level = 0")
    pair = stage(texts.select(F.to_json(F.struct("category", "district")).alias("_pair"), "stats_text"), "texts")
    rows = rows.withColumn("_pair", F.to_json(F.struct(F.col("business_category").alias("category"), "district")))
    return attach(rows, pair, "_pair").drop("_pair")


def java_number(value: str, digits: int) -> str:
    """DuckDB text of a number as Java prints it: halves of the shortest decimal form are rounded up."""
    return f"printf('%.{digits}f', CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(30, 20)), {digits}) AS DOUBLE))"


def share_sql(value: str) -> str:
    whole = f"{value} * 100"
    return java_number(f"CASE WHEN {whole} - floor({whole}) = 0.25 THEN {whole} - 0.01e0 ELSE {whole} END", 1) + " || '%'"


def bullets_sql(value: str, empty: str) -> str:
    return f"'- ' || CASE WHEN {value} = '' THEN '{empty}' ELSE replace({value}, '; ', chr(10) || '- ') END"


PREDICTED = f"""SELECT biz_id, category_large AS business_category, category_mid AS business_sub_category, adong_name AS district, age,
  experience_years, has_related_experience, initial_investment, monthly_rent, nearby_competitor_count,
  CAST(regexp_extract(store_name, '[0-9]+$') AS BIGINT) AS conv_id,
  round(survival_1yr, 4) AS survival_1yr, round({uniform_sql('biz_id', 'h5')}, 4) AS survival_3yr,
  CAST(floor(monthly_revenue) AS BIGINT) AS monthly_revenue, CAST(floor({uniform_sql('biz_id', 'h6')} * 1e6) AS BIGINT) AS monthly_profit,
  round(risk_score, 4) AS risk_score, {LEVEL} AS risk_level, CAST(greatest(1, trunc(break_even_months)) AS BIGINT) AS break_even_months,
  {FACTORS} AS factors FROM heads"""
ADVICE = f"""concat_ws('; ', CASE WHEN contains(factors, '{risk.RENT_FACTOR}') THEN '{risk.RENT_ADVICE}' END,
  CASE WHEN contains(factors, '{risk.EXPERIENCE_FACTOR}') THEN '{risk.EXPERIENCE_ADVICE}' END)"""
SCORED = dict(heads=HEADS, predicted=PREDICTED, cube=CUBE, tops=TOPS, texts=STATS_TEXT,
              scored="""SELECT predicted.*, stats_text FROM predicted
  LEFT JOIN texts ON texts.level = 0 AND texts.category = business_category AND texts.district = predicted.district""")
RISK_SQL = f"risk_level || ' (' || {java_number('risk_score', 2)} || ')'"


@query("rule_report", with_stores(f"""
SELECT biz_id, concat_ws(chr(10) || chr(10), concat_ws(chr(10),
  'One-year survival ' || {share_sql('survival_1yr')} || '. ' || CASE WHEN survival_1yr >= 0.7 THEN 'Prospects are good.'
    WHEN survival_1yr >= 0.5 THEN 'Prospects are fair; prepare carefully.' ELSE 'Prospects are weak; review the risks first.' END,
  'Expected revenue ' || {text_sql('monthly_revenue')} || ' and profit ' || {text_sql('monthly_profit')}
    || ' per month; break-even after ' || break_even_months || ' months.',
  'Risk ' || {RISK_SQL}, {bullets_sql('factors', 'none noted')}, 'Advice', {bullets_sql(ADVICE, risk.DEFAULT_ADVICE)}), stats_text) AS report
FROM scored""", **SCORED))
def rule_report(spark, folder):
    return reports.rule_report(with_statistics(spark, folder, predicted(spark, folder))).select("biz_id", "report")


def money_sql(name: str) -> str:
    return text_sql(f"CAST(round(coalesce({name}, 0)) AS BIGINT)")


BUSINESS = f"""'Business: ' || business_category || ' / ' || business_sub_category || ', district ' || district || ', investment '
  || {money_sql('initial_investment')}"""
FORECAST = f"'Forecast: one-year survival ' || {share_sql('survival_1yr')} || ', risk ' || {RISK_SQL}"
PERSON = """'Applicant: age ' || age || ', experience ' || experience_years || ' years, related experience '
  || CASE WHEN has_related_experience = 1 THEN 'yes' ELSE 'no' END"""
FINANCES = f"""'Three-year survival ' || {share_sql('survival_3yr')} || ', revenue ' || {money_sql('monthly_revenue')} || ', profit '
  || {money_sql('monthly_profit')} || ', break-even ' || break_even_months || ' months, rent ' || {money_sql('monthly_rent')}
  || ', factors: ' || factors"""
RIVALS = "'Competitors nearby: ' || nearby_competitor_count"
PROMPT_PARTS = {
    "report": [PERSON, BUSINESS, FORECAST, FINANCES], "strategy": [BUSINESS, FORECAST, PERSON],
    "question": [BUSINESS, FORECAST], "competitors": [BUSINESS, RIVALS, FORECAST]}


def prompts_sql(source: str, cases: str = "NULL") -> str:
    """All four prompts of the rows of ``source``; a history and a question only in the prompt of that kind."""
    gap = "chr(10) || chr(10)"
    return " UNION ALL ".join(f"""SELECT biz_id, '{kind}' AS kind, concat_ws({gap}, '{reports.TASKS[kind]}', {', '.join(parts)},
  'Statistics' || chr(10) || stats_text, 'Similar cases' || chr(10) || {cases}
  {", 'Earlier turns' || chr(10) || history, 'Question' || chr(10) || 'Is ' || district || ' a good place?'" if kind == 'question' else ''}) AS prompt
FROM {source}""" for kind, parts in PROMPT_PARTS.items())


def asked(spark, folder) -> DataFrame:
    """Scored rows with their statistics, the last turns of the founder's conversation and a question."""
    rows = with_statistics(spark, folder, predicted(spark, folder))
    rows = attach(rows, reports.last_turns(table(spark, folder, "conversations")), "conv_id")
    return rows.withColumn("question", F.concat(F.lit("Is "), "district", F.lit(" a good place?")))


ASKED = """SELECT scored.*, history FROM scored LEFT JOIN history USING (conv_id)"""


@query("prompt_text", with_stores(prompts_sql("asked"), **SCORED, history=LAST_TURNS, asked=ASKED))
def prompt_text(spark, folder):
    """All four kinds, with statistics and, for questions, the last turns of the founder's conversation."""
    return reports.all_prompts(asked(spark, folder), "biz_id")


@query("prompt_cases", with_stores(prompts_sql("with_cases", "context"), **SCORED, history=LAST_TURNS, asked=ASKED, found="""
  SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, d.vec_id,
      list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity
    FROM embeddings q JOIN embeddings d ON q.vec_id % 50 = 0 WHERE q.vec_id <> d.vec_id)""",
    cases=f"""SELECT CAST(query_id AS VARCHAR) AS biz_id, string_agg('Case ' || rank || ' (similarity ' || {java_number('similarity', 2)} || ')'
    || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
  FROM found JOIN documents ON doc_id = vec_id WHERE rank <= 3 GROUP BY 1""",
    with_cases="SELECT asked.*, context FROM asked JOIN cases USING (biz_id)"))
def prompt_cases(spark, folder):
    """Prompts with search results: each vector whose id is divisible by 50 asks for the store of that number; its three nearest documents are the cases."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    questions = vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    # One result more than wanted: a vector finds itself.
    found = search.nearest(vectors, questions, 4, doc_id="vec_id").filter("vec_id <> query_id")
    found = top_k(found.drop("rank"), ["query_id"], [F.round("similarity", 9).desc(), F.col("vec_id")], 3)
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    cases = search.search_context(stage(found, "found"), documents, doc_id="vec_id")
    rows = asked(spark, folder).join(cases.select(F.col("query_id").cast("string").alias("biz_id"), "context"), "biz_id")
    return reports.all_prompts(rows, "biz_id")
