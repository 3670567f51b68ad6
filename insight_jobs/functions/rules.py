"""Text rules over columns of questions and answers: regular expressions and keyword lists as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, keywords and settings that must be what they are for the same results.

QUERY_CLASSES = {
    "COMPARATIVE": [r"(compare|contrast|difference between|similarities between)", r"(vs\.?|versus)", r"(how does .{1,40} differ from)", r"(better|worse|advantage|disadvantage|pros and cons)", r"(which is (better|more|less|faster|slower|stronger|weaker))"],
    "CAUSAL": [r"^(why (did|does|is|are|was|were))", r"(what (caused|led to|resulted in|triggered|influenced))", r"(reason(s)? (for|behind|why))", r"(impact|effect|consequence|implication|outcome) of", r"(how did .{1,40} (lead to|cause|result in|affect))"],
    "PROCEDURAL": [r"(how (do|does|can|to|did) .{1,40} (work|function|operate|run|implement))", r"(steps? (to|for|in|of)|process of|procedure for)", r"(how (is|was|are|were) .{1,40} (done|implemented|built|trained|created))", r"(walk me through|guide me through|explain the process)"],
    "SUMMARY": [r"(summarize|summarise|summary|overview|outline|synopsis)", r"(main (points|findings|contributions|ideas|results|themes))", r"(key (ideas|concepts|takeaways|insights|contributions|findings))", r"(tell me about|what is this (paper|document|book|chapter) about)", r"(what (happened|is discussed|is covered|is presented))", r"(what .{0,40} (are|is) (covered|discussed|included|presented) in (this|the))", r"((covered|discussed|included|presented|addressed) in (this|the) (book|document|paper|chapter))", r"(list (all|every|the) .{0,30}|give me (a list|all) .{0,30})"],
    "FACTOID": [r"^(who (is|are|was|were|wrote|created|developed|invented|founded))", r"^(when (was|is|did|were|did))", r"^(where (is|was|are|were|did))", r"^(what (year|date|number|name|title|version))", r"(how many|how much|what is the (number|count|total|size|value|accuracy|score|rate|percentage|ratio))", r"^(which (one|paper|model|method|year|author|chapter|section))", r"^what is the (accuracy|score|f1|precision|recall|loss|error|result|output|performance)"],
    "ANALYTICAL": [r"(analyse|analyze|evaluate|assess|critique|examine|investigate)", r"(how (effective|efficient|accurate|reliable|valid|significant))", r"(what are the (implications|limitations|strengths|weaknesses))", r"(discuss|elaborate|explain (how|why|the relationship))", r"(methodology|approach|framework|architecture|design)"],
    "DEFINITIONAL": [r"^(what is|what are|define|definition of|meaning of)", r"^(explain (what|the concept|the term|the idea))", r"(what does .{1,30} mean)", r"(what (is meant|do you mean) by)", r"^(describe (the|a|an))", r"(explain (what|how) .{1,40} (is|are|works?|means?|does))", r"^(can you (explain|describe|define|tell me what))"],
    "CONVERSATIONAL": [r"^(hi|hello|hey|thanks|thank you|ok|okay|sure|yes|no|great|awesome|nice|cool|got it|understood)(\s|$|!|\?)", r"^(good (morning|afternoon|evening|day))", r"^(what do you think|do you have an opinion|your opinion)", r"^(is (it|this|that) (true|correct|right|accurate|possible))(\?|$)"],
}
#: class: max_tokens, temperature, cite
STRATEGIES = {"FACTOID": (600, 0.1, True), "COMPARATIVE": (800, 0.1, True), "CAUSAL": (600, 0.1, True), "DEFINITIONAL": (400, 0.1, True), "ANALYTICAL": (1100, 0.2, True), "SUMMARY": (1200, 0.2, False), "PROCEDURAL": (600, 0.1, True), "CONVERSATIONAL": (200, 0.3, False)}
QUERY_TYPES = {
    "summary": [r"(summarize|summarise|overview|summary|outline)", r"(main (points|findings|contributions|results|ideas))", r"(tell me about|what is this (paper|document|book) about)", r"(key (ideas|concepts|takeaways|insights|contributions|findings))", r"(what are the (contributions|findings|results|implications))"],
    "analytical": [r"(compare|contrast|difference|similarities|versus|vs\.)", r"(analyse|analyze|evaluate|assess|examine|discuss)", r"(why|how does|explain|what causes|what led to)", r"(methodology|approach|framework|model|algorithm)"],
    "factoid": [r"^(who is|who are|who was|who were|who wrote|who created|who developed)", r"^(when (was|is|did|were)|what year|what date)", r"^(where (is|was|are|were|did))", r"^(which (one|paper|model|method|year|author))", r"^(name the|give me the name|what is the name|who is the author)", r"(how many|how much|what (number|count|total|percentage))"],
}
#: type: initial, expanded, most
BUDGETS = {"factoid": (3, 4, 4), "general": (4, 6, 8), "analytical": (5, 8, 12), "summary": (6, 10, 14)}
PRONOUNS = ["he", "she", "they", "it", "his", "her", "their", "its", "him", "them", "this", "that", "these", "those"]
PRONOUN_ANYWHERE = r"\b(it|this|that|he|she|they|his|her|their|him|them)\b"
PHRASES = ["the same", "the above", "the previous", "the latter", "the former", "mentioned", "said", "discussed", "that one", "the one", "first one", "second one", "third one", "last one", "what about", "how about", "and the", "what else", "more about", "tell me more", "explain more", "elaborate", "go on", "continue", "and also", "also tell"]
STARTERS = ["what about", "how about", "and ", "but ", "also ", "so ", "then ", "now ", "why ", "when ", "where ", "who ", "which ", "can you", "could you"]
SELF_CONTAINED = [r"who (is|are|was) the author", r"who wrote", r"what is the title", r"when was (it|this|the book) published", r"what year", r"isbn", r"publisher", r"copyright"]
EXPANSIONS = {"reviewer": "technical reviewer", "editor": "technical editor", "author": "author", "foreword": "foreword writer", "preface": "preface author", "publisher": "publisher"}
DECOMPOSE = ["compare", "contrast", "difference between", "similarities between", "vs", "versus", "how does .{1,30} differ", "what is the difference", "and also", "as well as", "in addition", "furthermore", "both .{1,30} and", "list .{1,30} and", "firstly", "secondly", "thirdly", "finally", "what are .{1,30} and (how|why|when)", r"\?\s+and\s+", r"\?\s+also\s+", r"\?\s+what\s+", "section .{1,10} and section", "chapter .{1,10} and chapter", "table .{1,10} and (figure|table)"]
SINGLE_INTENT = [r"^(what|who|where|when|why|how) (is|are|was|were|did|does) .{1,60}\?$", r"^(explain|describe|summarize|define) .{1,60}$", r"^(list|show|give me) .{1,60}$"]
VAGUE = r"^(i want |give me |show me |tell me |can you |please )?(more|more detail|more details|in more detail|in detail|detailed|elaborate|explain more|explain further|go deeper|expand|expand on that|dig deeper|be more specific|more information|more info|more analysis|more breakdown|break it down|further analysis|deeper analysis|what else|more about that|more about this|tell me more|go on|continue)[.!?]?$"
CONFIRM = r"^(yes|yeah|sure|ok|okay|go ahead|do it|proceed|sounds good|please do|absolutely|yep|yup|do that|let's do it|let's go|go for it|please|do so|that sounds good|yes please|yes do it|sounds great)[.!?!]*$"
ALWAYS_ANSWER = [r"^(hi|hello|hey|thanks|thank you)", r"what (is this|are you|can you)", r"how (do|can|should) (i|you|we)", r"(summarize|summarise|overview|what is the document about)", r"(list|show|give me).{0,20}(page|chapter|section|topic)"]
INTENTS = {
    "chart": ["chart", "plot", "graph", "histogram", "bar", "pie", "scatter", "heatmap", "box", "line", "distribution", "visuali", "show me", "display", "draw", "correlation matrix", "learning curve", "roc curve", " roc", "roc ", "auc", "confusion matrix", "feature importance", "feature_importance", "precision recall", "residual", "calibration curve", "decision boundary", "cluster plot", "elbow", "pairplot", "pair plot", "violin", "swarm", "dendrogram", "dendogram", "wordcloud", "word cloud"],
    "chart_change": ["not scatter", "use bar", "use line", "change to", "instead of scatter", "make it a bar", "bar instead", "line instead", "bar chart instead", "no scatter"],
    "model": ["train", "classif", "predict", "regression", "cluster", "random forest", "xgboost", "svm", "logistic", "decision tree", "machine learning", "ml model", "build a model", "pkl", "naive bayes", "gradient boost", "linear regression", "kmeans", "k-means", "fit a", "run a"],
    "analysis": ["analys", "overview", "summary", "summarize", "summarise", "describe", "tell me about", "tell me", "explain", "what is in", "explore", "statistic", "stat ", "stats", "insight", "profile", "eda", "data quality", "about the dataset", "about this dataset", "about the data", "about this data", "about the csv", "explain the", "explain me", "what does this", "what do we have", "give me an idea", "understand the", "information about", "info about", "what kind of", "what type of", "dataset look", "data look", "how is the data"],
    "recommendation": ["which model", "what model", "best model", "recommend a model", "suggest a model", "which algorithm", "what algorithm", "which classifier", "which regressor", "works best", "should i use", "what should i train", "which one to use", "what kind of model", "what type of model", "what models can", "which models can", "what models should", "which models would", "suitable model", "appropriate model", "good model for", "can we build a model", "what can we predict", "is it possible to", "can we predict", "can we train", "could we train", "should we train", "what can we train", "what type of model can", "what kind of model can", "what model can we", "what can we do", "what can i do", "what to do with", "we can do with", "i can do with", "what analysis", "how to analyze", "what to analyze", "what can be done", "what kind of analysis", "what insights", "what patterns"],
    "feature_importance": ["feature importance", "feature_importance", "important features", "which features", "top features", "feature weights", "feature scores"],
    "correlation": ["correlation heatmap", "heatmap", "correlation matrix", "feature correlation", "corr matrix", "corr heatmap", "give me correlation", "show correlation", "show me correlation", "show the correlation", "correlation of the", "correlation of this", "correlation of our", "correlations in", "correlations of", "get correlation", "correlation between", "correlation analysis", "correlation plot", "plot correlation", "visualize correlation", "visualise correlation", "what is the correlation", "find the correlation", "check the correlation", "calculate the correlation", "compute the correlation"],
    "filter": ["filter", "where ", "rows where", "records where", "only rows", "only records", "only patients", "only customers", "only female", "only male", "only the", "show only", "patients with", "customers with", "employees with", "entries where", "greater than", "less than", "equal to", "more than", "over ", "under ", "above ", "below ", "missing values", "null values", "has nulls", "not null", "between ", "in range", "top ", "bottom ", "rows with", "records with"],
    "export": ["export", "download", "save", "save as csv", "export as csv", "download csv", "get the data", "export the filtered", "export the cleaned", "export result", "save result"],
    "columns": ["list column", "show column", "what column", "all column", "column name", "columns?", "list all"],
}
RECOMMENDATION_PATTERNS = [r"\b(what|which)\b.{0,40}\bmodel\b.{0,30}\b(can|should|would|could|to|for|works?|is|are)\b", r"\b(can|could|should|would|shall|might)\s+(we|i|you)\s+(train|build|fit|use)\b"]
WEAK_FILTER = ["show", "find", "get", "list", "display", "select"]
COMPARISON = r"(\bwhere\b|\bwith\b|\bgreater\b|\bless\b|\bover\b|\bunder\b|\babove\b|\bbelow\b|\bmissing\b|\bnull\b|\btop\s+\d|\bbottom\s+\d|\bfirst\s+\d|\blast\s+\d|\b==\b|\b>=\b|\b<=\b|\b!=\b)"
NOT_A_FILTER = ["correlation", "correlat", "distribution", "histogram", "heatmap", "scatter", "average", "mean ", "median", "std dev", "standard deviation", "regression", "classification", "cluster", "model", "train", "predict", "analysis", "analyse", "analyze", "overview", "summary", "summarize"]
FEASIBILITY = r"\b(can|could|should|would|shall|might)\s+(we|i|you)\s+train\b|\bwe\s+(can|could|should|would)\s+train\b|\bwhat\s+(type|kind|sort)\s+of\b.{0,60}\btrain\b"
EXPLICIT_TRAIN = ["train a", "train the", "train different", "train all", "fit a", "fit the", "build and compare", "build the model", "build all", "run a model", "evaluate model", "compare model", "compare different", "which one performs best", "test different", "try different", "let's train", "start training", "go ahead and train"]
CAPTIONS = [r"^(fig(ure)?\.?\s*\d+)", r"^(table\.?\s*\d+)", r"^(photo|image|picture|plate)", r"^(author|about the author)", r"^(source|courtesy)"]
CITED = r"[Pp]age\s+(\d+|[ivxlcdmIVXLCDM]+)"
TOC_PAGES = ["3", "4", "5", "6"]
NAME_RUN = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b"
NOT_A_NAME = ["The", "This", "Deep", "Learning", "Python", "Applications"]
CLASSIFICATION_WORDS = ["classif", "predict class", "predict category", "predict label", "is it", "will it", "churn", "fraud", "spam", "disease", "survival", "default", "diagnosis", "sentiment"]
REGRESSION_WORDS = ["regress", "predict price", "predict cost", "predict value", "predict salary", "predict score", "forecast", "estimate", "how much", "how many", "revenue", "sales"]
CLUSTERING_WORDS = ["cluster", "segment", "group", "find groups", "find segments", "similar", "kmeans", "k-means", "unsupervised"]
TARGET_PATTERNS = [
    r"predict(?:ing)?\s+([a-zA-Z_][a-zA-Z0-9_\s]{1,30}?)(?:\s+using|\s+from|\s+based|$|[,.])",
    r"classif(?:y|ying|ication)\s+(?:the\s+)?([a-zA-Z_][a-zA-Z0-9_\s]{1,25}?)(?:\s+using|\s+from|\s+based|$|[,.])",
    r"(?:target|label|output|dependent variable)\s+(?:is|column|variable|:)?\s*['\"]?([a-zA-Z_][a-zA-Z0-9_\s]{1,25}?)['\"]?(?:\s|$|[,.])",
    r"model\s+(?:for|to predict|to classify)\s+([a-zA-Z_][a-zA-Z0-9_\s]{1,25}?)(?:\s+using|\s+from|\s+based|$|[,.])",
    r"([a-zA-Z_][a-zA-Z0-9_\s]{1,25}?)\s+(?:prediction|classification|forecast|detection|recognition)",
    r"forecast(?:ing)?\s+([a-zA-Z_][a-zA-Z0-9_\s]{1,25}?)(?:\s+using|\s+from|\s+based|$|[,.])",
    r"detect(?:ing)?\s+([a-zA-Z_][a-zA-Z0-9_\s]{1,25}?)(?:\s+using|\s+from|\s+based|$|[,.])",
]
KNOWN_TARGETS = {"survived": ["survived", "survival"], "species": ["species", "iris", "flower"], "churn": ["churn", "churned", "attrition"], "diagnosis": ["diagnosis", "diagnose", "disease", "condition"], "default": ["default", "loan default", "credit default"], "fraud": ["fraud", "fraudulent", "is_fraud"], "sentiment": ["sentiment", "opinion", "review"], "income": ["income", ">50k", "salary class"], "target": ["target"], "label": ["label", "class", "category"], "outcome": ["outcome", "result", "output"], "approved": ["approved", "approval", "accepted"], "price": ["price", "cost", "value", "sale price", "house price"], "medv": ["medv", "house value", "median value"], "charges": ["charges", "insurance cost", "medical charges"], "mpg": ["mpg", "fuel efficiency", "miles per gallon"]}
TARGET_NAMES = ["target", "label", "class", "y", "output", "result", "outcome", "response"]
#: A citation of a page (its number goes in), and brackets that nothing is left in.
PAGE_CITATION = r"\(?\s*[Pp]age\s+{page}\s*(?:and\s+)?\.?\s*\)?"
SPACES, EMPTY_BRACKETS = r"\s{2,}", r"\(\s*\)"

# End of the fixed values.


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def matches(text: Column, patterns: list[str] | str) -> Column:
    return text.rlike("(?U)" + (patterns if isinstance(patterns, str) else any_of(patterns)))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether one of the words is a substring."""
    return text.rlike("|".join(f"\\Q{w}\\E" for w in words))


def plain(q: Column) -> Column:
    return F.lower(F.trim(q))


def first_match(text: Column, classes: dict[str, list[str]], otherwise: str) -> Column:
    out = None
    for label, patterns in classes.items():
        out = F.when(matches(text, patterns), label) if out is None else out.when(matches(text, patterns), label)
    return out.otherwise(otherwise)


def classify_query(q: Column) -> Column:
    """The question's class; without a match ANALYTICAL."""
    return first_match(plain(q), QUERY_CLASSES, "ANALYTICAL")


def query_type(q: Column) -> Column:
    return first_match(plain(q), QUERY_TYPES, "general")


def of_key(key: Column, table: dict, place: int, default: str) -> Column:
    """A setting by key, from one of the small tables above."""
    out = None
    for k, row in table.items():
        out = F.when(key == k, F.lit(row[place])) if out is None else out.when(key == k, F.lit(row[place]))
    return out.otherwise(F.lit(table[default][place]))


def answer_strategy(classes: DataFrame, column: str = "query_class") -> DataFrame:
    return classes.select("*", *[of_key(F.col(column), STRATEGIES, k, "ANALYTICAL").alias(n) for k, n in enumerate(("max_tokens", "temperature", "cite_pages"))])


def retrieval_budget(types: DataFrame, column: str = "query_type") -> DataFrame:
    return types.select("*", *[of_key(F.col(column), BUDGETS, k, "general").alias(n) for k, n in enumerate(("initial_k", "expand_k", "max_k"))])


def n_words(q: Column) -> Column:
    return F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))


def needs_rewriting(q: Column, has_history: Column) -> Column:
    """Whether a question leans on the turns before: pronouns first, then self-contained exceptions, then the rest."""
    t = plain(q)
    first = F.regexp_extract(t, r"^\S+", 0)
    pronoun = first.isin(PRONOUNS) | matches(t, PRONOUN_ANYWHERE)
    rest = (n_words(t) <= 4) | contains_any(t, PHRASES) | t.rlike("^(?:" + "|".join(f"\\Q{s}\\E" for s in STARTERS) + ")")
    return F.coalesce(has_history & (pronoun | (~matches(t, SELF_CONTAINED) & rest)), F.lit(False))


def expand_terms(q: Column) -> Column:
    """Append the full form of the first short term found without it."""
    t, out = F.lower(q), None
    for short, full in EXPANSIONS.items():
        hit = t.contains(short) & ~t.contains(full)
        text = F.concat(F.rtrim(F.regexp_replace(q, r"\?+$", "")), F.lit(f" (also known as {full})?"))
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out.otherwise(q)


def needs_decomposition(q: Column) -> Column:
    t = plain(q)
    many = (F.length(t) - F.length(F.translate(t, "?", ""))) >= 2
    return F.coalesce((n_words(t) >= 8) & ~matches(t, SINGLE_INTENT) & (matches(t, DECOMPOSE) | many), F.lit(False))


def followup_kind(q: Column) -> Column:
    t = F.trim(q)
    return F.when(t.rlike("(?i)" + VAGUE), "vague").when(t.rlike("(?i)" + CONFIRM), "confirmation").otherwise("none")


def is_filter(t: Column) -> Column:
    return ~contains_any(t, NOT_A_FILTER) & (contains_any(t, INTENTS["filter"]) | (contains_any(t, WEAK_FILTER) & matches(t, COMPARISON)))


def table_question_intents(questions: DataFrame, text: str = "text") -> DataFrame:
    """Add a boolean column wants_<intent> for each intent, with the overrides between them."""
    t = F.lower(F.col(text))
    has = {k: contains_any(t, words) for k, words in INTENTS.items()}
    change, correlation = has["chart_change"], has["correlation"]
    chart = (has["chart"] & ~correlation) | change
    explicit = ~matches(t, FEASIBILITY) & contains_any(t, EXPLICIT_TRAIN)
    recommend = (has["recommendation"] | matches(t, RECOMMENDATION_PATTERNS)) & ~explicit
    model = has["model"] & ~change
    flags = {
        "chart": chart, "chart_change": change, "model": model & ~recommend, "analysis": has["analysis"], "recommendation": recommend,
        "feature_importance": has["feature_importance"], "correlation": correlation, "filter": is_filter(t) & ~has["chart"],
        "export": has["export"] & ~model & ~chart, "columns": has["columns"],
    }
    return questions.select("*", *[F.coalesce(c, F.lit(False)).alias(f"wants_{k}") for k, c in flags.items()])


def cited_pages(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit("(?U)" + CITED), 1)


def strip_toc_citations(answer: Column) -> Column:
    """Remove citations of contents pages where others are cited too."""
    pages = cited_pages(answer)
    toc = F.array(*[F.lit(p) for p in TOC_PAGES])
    mixed = (F.size(pages) > 1) & F.arrays_overlap(pages, toc) & (F.size(F.array_except(pages, toc)) > 0)
    out = answer
    for page in TOC_PAGES:
        out = F.trim(F.regexp_replace(out, PAGE_CITATION.format(page=page), ""))
    out = F.trim(F.regexp_replace(out, SPACES, " "))
    return F.when(mixed, F.trim(F.regexp_replace(out, EMPTY_BRACKETS, ""))).otherwise(answer)


def person_names(text: Column) -> Column:
    """The first two distinct runs of capitalised words that hold no stop word."""
    runs = F.regexp_extract_all(text, F.lit(NAME_RUN), 1)
    stop = F.array(*[F.lit(w) for w in NOT_A_NAME])
    return F.slice(F.array_distinct(F.filter(runs, lambda r: ~F.arrays_overlap(F.split(r, r"\s+"), stop))), 1, 2)


def is_caption(text: Column) -> Column:
    return matches(plain(text), CAPTIONS)


def contains_number(text: Column, value: Column, tolerance: Column) -> Column:
    numbers = F.regexp_extract_all(text, F.lit(r"[-+]?\d*\.?\d+"), 0)
    return F.coalesce(F.exists(numbers, lambda n: F.abs(n.try_cast("double") - value) <= tolerance), F.lit(False))


def markdown_blocks(answers: DataFrame, key: str, text: str) -> DataFrame:
    """key, position, kind, text, num of each non-blank line."""
    lines = answers.select(key, F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("line_no", "raw")).withColumn("t", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))).where("t <> ''")
    kind = F.when(F.col("t").startswith("### "), "h3").when(F.col("t").startswith("## "), "h2").when(F.col("t").startswith("# "), "h1").when(F.col("t").rlike(r"^[-*•]\s+"), "bullet").when(F.col("t").rlike(r"^\d+[.)]\s+"), "numbered").otherwise("para")
    body = F.when(F.col("kind").isin("h1", "h2", "h3"), F.trim(F.regexp_replace("t", r"^#{1,3} ", ""))).when(F.col("kind") == "bullet", F.regexp_replace("t", r"^[-*•]\s+", "")).when(F.col("kind") == "numbered", F.regexp_replace("t", r"^\d+[.)]\s+", "")).otherwise(F.col("t"))
    num = F.when(F.col("kind") == "numbered", F.regexp_extract("t", r"^(\d+)", 1).try_cast("long"))
    return lines.withColumn("kind", kind).select(key, F.col("line_no").alias("position"), "kind", body.alias("text"), num.alias("num"))


def _short_number(v: pd.Series) -> pd.Series:
    """Numbers that aren't whole, by Python's own rounding of a double's exact value, which the JVM's formats don't have."""
    return v.map(lambda x: f"{x:.2e}" if abs(x) >= 1e6 else f"{x:.1f}" if abs(x) >= 100 else f"{x:.3g}", na_action="ignore")


def format_number(v: Column) -> Column:
    """Text of a number for a table cell: whole numbers plain, large ones with an exponent, others with three digits."""
    x = v.cast("double")
    return F.when(v.isNull(), "").when((x == F.floor(x)) & (F.abs(x) < 1e9), x.cast("long").cast("string")).otherwise(F.pandas_udf(_short_number, "string")(x))


def mentioned_columns(questions: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """Add the columns, in schema order, whose name a question holds."""
    names = F.array(*[F.lit(c) for c in columns])
    return questions.withColumn("columns", F.filter(names, lambda c: F.lower(F.col(text)).contains(F.lower(c))))


def normal_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""))


def detect_task(questions: DataFrame, text: str = "text", kind: str = "target_kind", n_unique: str = "target_unique") -> DataFrame:
    """Add task; kind and n_unique describe the question's target, null without one."""
    t = F.lower(F.col(text))
    inferred = F.when(F.col(kind).isNull(), "classification").when((F.col(kind) == "string") | (F.col(n_unique) <= 10), "classification").otherwise("regression")
    return questions.withColumn("task", F.when(contains_any(t, CLUSTERING_WORDS), "clustering").when(contains_any(t, REGRESSION_WORDS), "regression").when(contains_any(t, CLASSIFICATION_WORDS), "classification").otherwise(inferred))


def detect_target(questions: DataFrame, columns: list[str], n_unique: dict[str, int], accept: float = 0.6, text: str = "text") -> DataFrame:
    """Add target and method: phrase in the question, known data sets, column names, two-valued columns, last column.

    columns and n_unique are a table's metadata; the questions stay a distributed table without any join.
    """
    q = F.lower(F.col(text))
    found = F.concat(*[F.regexp_extract_all(q, F.lit(p), 1) for p in TARGET_PATTERNS])
    phrases = F.array_distinct(F.filter(F.transform(found, lambda m: normal_name(F.trim(m))), lambda m: F.length(m) > 1))
    names = F.array(*[F.struct(F.lit(c).alias("name"), normal_name(F.lit(c)).alias("norm"), F.lit(-k).alias("place")) for k, c in enumerate(columns)])
    split = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))

    def score(phrase: Column, col: Column) -> Column:
        a, b = split(phrase), split(col["norm"])
        overlap = F.try_divide(F.size(F.array_intersect(a, b)), F.greatest(F.size(a), F.size(b)))
        return F.when(phrase == col["norm"], 1.0).when(col["norm"].contains(phrase) | phrase.contains(col["norm"]), 0.8).when(overlap >= 0.5, 0.5 + overlap * 0.2).otherwise(0.0)

    pairs = F.flatten(F.transform(phrases, lambda p, i: F.transform(names, lambda c: F.struct(score(p, c).alias("score"), (-i).alias("phrase"), c["place"].alias("place"), c["name"].alias("name")))))
    best = F.array_max(pairs)
    normal = {c: "".join(x for x in c.lower() if x.isascii() and (x.isalnum() or x.isspace())).strip() for c in columns}
    known = None
    for key, words in KNOWN_TARGETS.items():
        column = next((c for c in columns if key in normal[c] or normal[c] in key), None)
        if column:
            hit = contains_any(normal_name(F.col(text)), words)
            known = F.when(hit, column) if known is None else known.when(hit, column)
    named = next((c for n in TARGET_NAMES for c in columns if n in normal[c]), None)
    two = [c for c in columns if n_unique.get(c) == 2]
    fallback = named or (two[-1] if two else columns[-1])
    taken = F.coalesce(best["score"] >= accept, F.lit(False))
    known = known if known is not None else F.lit(None).cast("string")
    out = questions.withColumn("_best", best).withColumn("_taken", taken).withColumn("_known", known)
    target = F.when(F.col("_taken"), F.col("_best.name")).otherwise(F.coalesce("_known", F.lit(fallback)))
    method = F.when(F.col("_taken"), F.when(F.col("_best.score") == 1.0, "exact").otherwise("fuzzy")).when(F.col("_known").isNotNull(), "known").otherwise("last_column" if fallback == columns[-1] else "heuristic")
    return out.withColumn("target", target).withColumn("method", method).drop("_best", "_taken", "_known")
