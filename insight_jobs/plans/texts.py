"""Queries of the text rules over derived questions and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import ground
from .registry import query, table

#: Questions of every class; {} is a part's name.
QUESTIONS = [
    "Compare {} and the other one", "What is better, {} or tin?", "Why did {} fail?", "What caused the loss of {}?", "How does {} work in this chapter?", "Walk me through the use of {}",
    "Tell me about {}", "Give me all topics on {} ", "Who wrote {}?", "How many pages are on {}?", "Evaluate the design of {}", "What are the limitations of {}?", "What is {}?", "Describe the {}", "hello",
    "thanks", "And the author of it?", "more details", "yes please", "Explain it further", "Who is the reviewer of {}?", "What year was {} published and also who is the editor and what is the isbn of this book?",
    "Show me a bar chart of {}", "use bar instead of scatter", "train a random forest to predict p_size from {}", "which model should we use for {}?", "can we train a model on {}?", "Show correlation between p_size and p_retailprice",
    "rows where p_size greater than 10", "export the filtered data", "List columns", "summary of {} and furthermore the list of all tables and both figures and plates?", "group similar {}", "forecast revenue of {}",
    "predict p_retailprice using {}", "classify the p_type from {}", "  What about THIS one ", "top features for {}", "What is the preface? And what is the foreword of {}?", "please list every figure and table 2 and figure 3 of the {} for me",
]


def pick(items, key):
    return F.get(F.array(*[F.lit(s) for s in items]), F.pmod(key, F.lit(len(items))).cast("int"))


def questions(spark, d):
    text = F.replace(pick(QUESTIONS, F.col("p_partkey")), F.lit("{}"), F.col("p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), text.alias("text"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def picked(items, key: str) -> str:
    return f"{listed(items)}[({key} % {len(items)} + 1)::INT]"


QUESTIONS_SQL = f"(SELECT p_partkey AS question_id, replace({picked(QUESTIONS, 'p_partkey')}, '{{}}', p_name) AS text FROM part)"


def rx(col: str, patterns) -> str:
    return f"regexp_matches({col}, {quoted(patterns if isinstance(patterns, str) else rules.any_of(patterns))})"


def has(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {quoted(w)})" for w in words) + ")"


def cases(col: str, classes: dict, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {rx(col, p)} THEN '{k}'" for k, p in classes.items()) + f" ELSE '{otherwise}' END"


T = "lower(trim(text))"


@query(f"SELECT question_id, {cases(T, rules.QUERY_CLASSES, 'ANALYTICAL')} AS query_class FROM {QUESTIONS_SQL}")
def classify_query(spark, d):
    return questions(spark, d).select("question_id", rules.classify_query(F.col("text")).alias("query_class"))


def of_sql(col: str, settings: dict, place: int, default: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v[place]}" for k, v in settings.items()) + f" ELSE {settings[default][place]} END"


@query(f"SELECT question_id, query_class, {of_sql('query_class', rules.STRATEGIES, 0, 'ANALYTICAL')} AS max_tokens, ({of_sql('query_class', rules.STRATEGIES, 1, 'ANALYTICAL')})::DOUBLE AS temperature, {of_sql('query_class', rules.STRATEGIES, 2, 'ANALYTICAL')} AS cite_pages FROM (SELECT question_id, {cases(T, rules.QUERY_CLASSES, 'ANALYTICAL')} AS query_class FROM {QUESTIONS_SQL})")
def answer_strategy(spark, d):
    return rules.answer_strategy(classify_query(spark, d))


@query(f"SELECT question_id, {cases(T, rules.QUERY_TYPES, 'general')} AS query_type FROM {QUESTIONS_SQL}")
def query_type(spark, d):
    return questions(spark, d).select("question_id", rules.query_type(F.col("text")).alias("query_type"))


@query(f"SELECT question_id, query_type, {of_sql('query_type', rules.BUDGETS, 0, 'general')} AS initial_k, {of_sql('query_type', rules.BUDGETS, 1, 'general')} AS expand_k, {of_sql('query_type', rules.BUDGETS, 2, 'general')} AS max_k FROM (SELECT question_id, {cases(T, rules.QUERY_TYPES, 'general')} AS query_type FROM {QUESTIONS_SQL})")
def retrieval_budget(spark, d):
    return rules.retrieval_budget(query_type(spark, d))


N_WORDS = "len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"
STARTS = "(" + " OR ".join(f"starts_with(t, {quoted(s)})" for s in rules.STARTERS) + ")"


@query(f"SELECT question_id, question_id % 3 <> 0 AND (regexp_extract(t, '^\\S+') IN ({', '.join(map(quoted, rules.PRONOUNS))}) OR {rx('t', rules.PRONOUN_ANYWHERE)} OR (NOT {rx('t', rules.SELF_CONTAINED)} AND ({N_WORDS.format(c='t')} <= 4 OR {has('t', rules.PHRASES)} OR {STARTS}))) AS needs_rewriting FROM (SELECT *, {T} AS t FROM {QUESTIONS_SQL})")
def needs_rewriting(spark, d):
    return questions(spark, d).select("question_id", rules.needs_rewriting(F.col("text"), F.col("question_id") % 3 != 0).alias("needs_rewriting"))


@query("SELECT question_id, CASE " + " ".join(f"WHEN contains(lower(text), '{a}') AND NOT contains(lower(text), '{b}') THEN rtrim(regexp_replace(text, '\\?+$', '')) || ' (also known as {b})?'" for a, b in rules.EXPANSIONS.items()) + f" ELSE text END AS expanded FROM {QUESTIONS_SQL}")
def expand_terms(spark, d):
    return questions(spark, d).select("question_id", rules.expand_terms(F.col("text")).alias("expanded"))


@query(f"SELECT question_id, {N_WORDS.format(c='t')} >= 8 AND NOT {rx('t', rules.SINGLE_INTENT)} AND ({rx('t', rules.DECOMPOSE)} OR length(t) - length(replace(t, '?', '')) >= 2) AS needs_decomposition FROM (SELECT *, {T} AS t FROM {QUESTIONS_SQL})")
def needs_decomposition(spark, d):
    return questions(spark, d).select("question_id", rules.needs_decomposition(F.col("text")).alias("needs_decomposition"))


@query(f"SELECT question_id, CASE WHEN regexp_matches(trim(text), {quoted('(?i)' + rules.VAGUE)}) THEN 'vague' WHEN regexp_matches(trim(text), {quoted('(?i)' + rules.CONFIRM)}) THEN 'confirmation' ELSE 'none' END AS followup_kind FROM {QUESTIONS_SQL}")
def followup_kind(spark, d):
    return questions(spark, d).select("question_id", rules.followup_kind(F.col("text")).alias("followup_kind"))


def _intents_sql() -> str:
    i = {k: has("t", w) for k, w in rules.INTENTS.items()}
    filters = f"(NOT {has('t', rules.NOT_A_FILTER)} AND ({i['filter']} OR ({has('t', rules.WEAK_FILTER)} AND {rx('t', rules.COMPARISON)})))"
    inner = f"SELECT *, {i['chart']} AS c0, {i['correlation']} AS wants_correlation, {i['chart_change']} AS wants_chart_change, {i['model']} AS m0, {i['analysis']} AS wants_analysis, ({i['recommendation']} OR {rx('t', rules.RECOMMENDATION_PATTERNS)}) AND NOT (NOT {rx('t', rules.FEASIBILITY)} AND {has('t', rules.EXPLICIT_TRAIN)}) AS wants_recommendation, {i['feature_importance']} AS wants_feature_importance, {filters} AS f0, {i['export']} AS e0, {i['columns']} AS wants_columns FROM (SELECT question_id, lower(text) AS t FROM {QUESTIONS_SQL})"
    return f"SELECT question_id, (c0 AND NOT wants_correlation) OR wants_chart_change AS wants_chart, wants_chart_change, m0 AND NOT wants_chart_change AND NOT wants_recommendation AS wants_model, wants_analysis, wants_recommendation, wants_feature_importance, wants_correlation, f0 AND NOT c0 AS wants_filter, e0 AND NOT (m0 AND NOT wants_chart_change) AND NOT ((c0 AND NOT wants_correlation) OR wants_chart_change) AS wants_export, wants_columns FROM ({inner})"


@query(_intents_sql())
def table_question_intents(spark, d):
    return rules.table_question_intents(questions(spark, d)).drop("text")


@query(f"SELECT question_id, list_filter({listed(['p_partkey', 'p_size', 'p_retailprice', 'p_type'])}, lambda c: contains(lower(text), c)) AS columns FROM {QUESTIONS_SQL}")
def mentioned_columns(spark, d):
    return rules.mentioned_columns(questions(spark, d), ["p_partkey", "p_size", "p_retailprice", "p_type"]).drop("text")


KINDS_SQL = f"(SELECT *, CASE question_id % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'number' END AS target_kind, (question_id % 20)::BIGINT AS target_unique FROM {QUESTIONS_SQL})"


@query(f"SELECT question_id, CASE WHEN {has('lower(text)', rules.CLUSTERING_WORDS)} THEN 'clustering' WHEN {has('lower(text)', rules.REGRESSION_WORDS)} THEN 'regression' WHEN {has('lower(text)', rules.CLASSIFICATION_WORDS)} THEN 'classification' WHEN target_kind IS NULL OR target_kind = 'string' OR target_unique <= 10 THEN 'classification' ELSE 'regression' END AS task FROM {KINDS_SQL}")
def detect_task(spark, d):
    kind = F.when(F.col("question_id") % 3 == 0, "string").when(F.col("question_id") % 3 == 1, "number")
    return rules.detect_task(questions(spark, d).withColumn("target_kind", kind).withColumn("target_unique", F.col("question_id") % 20)).select("question_id", "task")


PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _target_sql() -> str:
    norm = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9\\s]', '', 'g'))"
    found = "list_concat(" + ", ".join(f"regexp_extract_all(q, {quoted(p)}, 1)" for p in rules.TARGET_PATTERNS) + ")"
    split = lambda c: f"list_distinct(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"
    normal = {c: "".join(x for x in c if x.isalnum()) for c in PART_COLUMNS}
    known = "CASE " + " ".join(f"WHEN {has(norm('text'), w)} THEN '{next(c for c in PART_COLUMNS if k in normal[c] or normal[c] in k)}'" for k, w in rules.KNOWN_TARGETS.items() if any(k in normal[c] or normal[c] in k for c in PART_COLUMNS)) + " END"
    named = next(c for n in rules.TARGET_NAMES for c in PART_COLUMNS if n in normal[c])
    return (
        f"WITH c AS (SELECT unnest({listed(PART_COLUMNS)}) AS name, unnest({listed(normal[c] for c in PART_COLUMNS)}) AS cn, unnest(range({len(PART_COLUMNS)})) AS place), "
        f"q AS (SELECT question_id, text, lower(text) AS q FROM {QUESTIONS_SQL}), "
        f"m AS (SELECT question_id, unnest({found}) AS m, unnest(range(len({found}))) AS i FROM q), "
        f"p AS (SELECT question_id, {norm('trim(m)')} AS p, i FROM m WHERE length({norm('trim(m)')}) > 1), "
        f"s AS (SELECT question_id, name, place, i, CASE WHEN p = cn THEN 1.0 WHEN contains(cn, p) OR contains(p, cn) THEN 0.8 WHEN o >= 0.5 THEN 0.5 + o * 0.2 ELSE 0 END AS score FROM (SELECT *, len(list_intersect({split('p')}, {split('cn')})) / greatest(len({split('p')}), len({split('cn')})) AS o FROM p, c)), "
        "b AS (SELECT question_id, arg_max(struct_pack(name := name, score := score), struct_pack(s := score, i := -i, p := -place)) AS b FROM s GROUP BY 1), "
        f"k AS (SELECT q.question_id, b.b.name AS bn, coalesce(b.b.score, 0) AS bs, {known} AS kn FROM q LEFT JOIN b USING (question_id)) "
        f"SELECT question_id, CASE WHEN bs >= 0.6 THEN bn ELSE coalesce(kn, '{named}') END AS target, CASE WHEN bs = 1 THEN 'exact' WHEN bs >= 0.6 THEN 'fuzzy' WHEN kn IS NOT NULL THEN 'known' ELSE '{'last_column' if named == PART_COLUMNS[-1] else 'heuristic'}' END AS method FROM k"
    )


@query(_target_sql())
def detect_target(spark, d):
    return rules.detect_target(questions(spark, d), PART_COLUMNS, {}).select("question_id", "target", "method")


#: Answers with citations, names, captions, numbers and Markdown; {} is the turn's whole text.
ANSWERS = [
    "See Page 4 and page 12 for more.\n\n# Head\n- one\n* two\n3. three {}", "It is on (Page 3) and (page xii). Written by Anna Maria Lopez and The Big Dog. {}", "Figure 2 shows {}", "Table 1: {}", "{}", "## Sub head\n1) first 42.5\n2) second -17\n### Small\ntext Page 5", "Source: {}", "About the author: John Smith, Jane Doe Roe, John Smith. Page 7. {}",
]


def answers(spark, d):
    text = F.replace(pick(ANSWERS, F.col("conv_id") + F.col("turn")), F.lit("{}"), F.col("text"))
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), text.alias("text"))


ANSWERS_SQL = f"(SELECT conv_id * 1000 + turn AS answer_id, replace({picked(ANSWERS, '(conv_id + turn)')}, '{{}}', text) AS text FROM conversations)".replace("\\n", "\n")


@query(f"SELECT answer_id, regexp_extract_all(text, {quoted(rules.CITED)}, 1) AS pages FROM {ANSWERS_SQL}")
def cited_pages(spark, d):
    return answers(spark, d).select("answer_id", rules.cited_pages(F.col("text")).alias("pages"))


def _strip_sql() -> str:
    out = "text"
    for page in rules.TOC_PAGES:
        out = f"trim(regexp_replace({out}, {quoted(rules.PAGE_CITATION.format(page=page))}, '', 'g'))"
    out = f"trim(regexp_replace(trim(regexp_replace({out}, {quoted(rules.SPACES)}, ' ', 'g')), {quoted(rules.EMPTY_BRACKETS)}, '', 'g'))"
    toc = listed(rules.TOC_PAGES)
    return f"SELECT answer_id, CASE WHEN len(p) > 1 AND list_has_any(p, {toc}) AND len(list_filter(p, lambda x: NOT list_contains({toc}, x))) > 0 THEN {out} ELSE text END AS text FROM (SELECT *, regexp_extract_all(text, {quoted(rules.CITED)}, 1) AS p FROM {ANSWERS_SQL})"


@query(_strip_sql())
def strip_toc_citations(spark, d):
    return answers(spark, d).select("answer_id", rules.strip_toc_citations(F.col("text")).alias("text"))


@query(
    f"WITH r AS (SELECT answer_id, list_filter(regexp_extract_all(text, {quoted(rules.NAME_RUN)}, 1), lambda x: NOT list_has_any(regexp_split_to_array(x, '\\s+'), {listed(rules.NOT_A_NAME)})) AS l FROM {ANSWERS_SQL}) "
    "SELECT answer_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:2] AS names FROM r"
)
def person_names(spark, d):
    return answers(spark, d).select("answer_id", rules.person_names(F.col("text")).alias("names"))


@query(f"SELECT answer_id, {rx('lower(trim(text))', rules.CAPTIONS)} AS is_caption FROM {ANSWERS_SQL}")
def is_caption(spark, d):
    return answers(spark, d).select("answer_id", rules.is_caption(F.col("text")).alias("is_caption"))


@query(f"SELECT answer_id, len(list_filter(regexp_extract_all(text, '[-+]?\\d*\\.?\\d+'), lambda n: abs(try_cast(n AS DOUBLE) - 42) <= 0.6)) > 0 AS found FROM {ANSWERS_SQL}")
def contains_number(spark, d):
    return answers(spark, d).select("answer_id", rules.contains_number(F.col("text"), F.lit(42.0), F.lit(0.6)).alias("found"))


@query(
    f"WITH l AS (SELECT answer_id, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS raw, unnest(range(len(regexp_split_to_array(text, '\\r\\n|\\r|\\n')))) AS position FROM {ANSWERS_SQL}), "
    "t AS (SELECT answer_id, position, trim(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')) AS t FROM l), "
    "k AS (SELECT *, CASE WHEN starts_with(t, '### ') THEN 'h3' WHEN starts_with(t, '## ') THEN 'h2' WHEN starts_with(t, '# ') THEN 'h1' WHEN regexp_matches(t, '^[-*•]\\s+') THEN 'bullet' WHEN regexp_matches(t, '^\\d+[.)]\\s+') THEN 'numbered' ELSE 'para' END AS kind FROM t WHERE t <> '') "
    "SELECT answer_id, position::INT AS position, kind, CASE WHEN kind IN ('h1','h2','h3') THEN trim(regexp_replace(t, '^#{1,3} ', '')) WHEN kind = 'bullet' THEN regexp_replace(t, '^[-*•]\\s+', '') WHEN kind = 'numbered' THEN regexp_replace(t, '^\\d+[.)]\\s+', '') ELSE t END AS text, CASE WHEN kind = 'numbered' THEN try_cast(regexp_extract(t, '^(\\d+)', 1) AS BIGINT) END AS num FROM k"
)
def markdown_blocks(spark, d):
    return rules.markdown_blocks(answers(spark, d), "answer_id", "text")


NUMBER_SQL = "CASE WHEN {c} IS NULL THEN '' WHEN {c} = floor({c}) AND abs({c}) < 1e9 THEN {c}::BIGINT::VARCHAR WHEN abs({c}) >= 1e6 THEN format('{{:.2e}}', {c}) WHEN abs({c}) >= 100 THEN format('{{:.1f}}', {c}) ELSE format('{{:.3g}}', {c}) END"


@query(f"SELECT l_orderkey, l_linenumber, {NUMBER_SQL.format(c='l_extendedprice')} AS price, {NUMBER_SQL.format(c='l_discount')} AS discount, {NUMBER_SQL.format(c='(l_tax / 100000)')} AS small FROM lineitem")
def format_number(spark, d):
    small = rules.format_number(F.col("l_tax") / 100_000)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.format_number(F.col("l_extendedprice")).alias("price"), rules.format_number(F.col("l_discount")).alias("discount"), small.alias("small"))


PAIRS_SQL = "(SELECT conv_id * 1000 + turn AS answer_id, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context, role FROM conversations)"


def answer_pairs(spark, d):
    """Assistant turns with the turn before as their context."""
    from pyspark.sql.window import Window

    rows = table(spark, d, "conversations").withColumn("context", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "text", F.coalesce("context", F.lit("")).alias("context"))


def _sentences_sql() -> str:
    kept = f"regexp_replace(text, {quoted(ground.ABBREVIATION)}, '\\1' || chr(1), 'g')"
    cut = f"string_split(regexp_replace({kept}, '([.!?])\\s+([A-Z])', '\\1' || chr(2) || '\\2', 'g'), chr(2))"
    cut = f"string_split(regexp_replace(array_to_string({cut}, chr(2)), '([.!?])\\s+([A-Z])', '\\1' || chr(2) || '\\2', 'g'), chr(2))"
    return f"list_filter(list_transform({cut}, lambda s: trim(replace(s, chr(1), '.'))), lambda s: {N_WORDS.format(c='s')} >= {ground.LEAST_WORDS})"


ASSISTANT_SQL = f"(SELECT answer_id, text, coalesce(context, '') AS context FROM {PAIRS_SQL} WHERE role = 'assistant')"
WORDS_SQL = "list_filter(list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))), lambda w: NOT list_contains({stop}, w))"
SENTENCES_CTE = f"WITH s AS (SELECT answer_id, context, unnest({_sentences_sql()}) AS sentence, unnest(range(len({_sentences_sql()}))) AS position FROM {ASSISTANT_SQL}), w AS (SELECT *, {WORDS_SQL.format(c='sentence', stop=listed(ground.ANSWER_STOP))} AS sw, {WORDS_SQL.format(c='context', stop=listed(ground.ANSWER_STOP))} AS cw FROM s), r AS (SELECT answer_id, position::INT AS position, sentence, CASE WHEN len(sw) = 0 THEN 0.5 ELSE len(list_intersect(sw, cw)) / len(sw) END AS score FROM w), x AS (SELECT *, CASE WHEN score >= 0.45 THEN 'supported' WHEN score >= 0.15 THEN 'uncertain' ELSE 'unsupported' END AS label FROM r) "


@query(SENTENCES_CTE + "SELECT answer_id, position, sentence FROM r")
def split_sentences(spark, d):
    return answer_pairs(spark, d).select("answer_id", F.posexplode(ground.split_sentences(F.col("text"))).alias("position", "sentence"))


@query(SENTENCES_CTE + "SELECT answer_id, position, sentence, round(score, 4) AS score, label FROM x")
def sentence_support(spark, d):
    return ground.sentence_support(answer_pairs(spark, d)).withColumn("score", F.round("score", 4))


@query(SENTENCES_CTE + f", a AS (SELECT answer_id, round(avg(score), 3) AS o, count(*) AS n, count(*) FILTER (label = 'supported') AS sup, count(*) FILTER (label = 'unsupported') AS uns FROM x GROUP BY 1) SELECT b.answer_id, coalesce(o, 1.0) AS overall_score, CASE WHEN coalesce(o, 1.0) >= 0.55 THEN 'faithful' WHEN coalesce(o, 1.0) >= 0.3 THEN 'partial' ELSE 'unfaithful' END AS label, coalesce(sup, 0) AS supported_count, coalesce(uns, 0) AS unsupported_count, coalesce(n, 0) AS total_sentences FROM {ASSISTANT_SQL} b LEFT JOIN a USING (answer_id)")
def faithfulness(spark, d):
    return ground.faithfulness(answer_pairs(spark, d))
