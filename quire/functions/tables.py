"""Word lists, weights, patterns and thresholds that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Block extraction.
MIN_BLOCK_AREA = 10.0
OCR_CHARS = 50
EQUATION_CHARS = "∑∫∂∇αβγδεζηθλμπρσφψω=±×÷→∞"
EQUATION_SHARE = 0.05

# Layout classes.
MATH_CHARS = "∑∫∂∇αβγδεζηθλμπρσφψω±×÷→↔⇒⊕⊗∈∉⊂⊆∪∩≤≥≠≈∞"
TEXT_CLASSES = ("paragraph", "title", "abstract", "list", "caption", "reference", "algorithm", "header", "footer")
FIGURE_CLASSES = ("figure", "image", "chart", "diagram")
TABLE_CLASSES = ("table",)
NOISE_CLASSES = ("header", "footer")
SPECIFICITY = {
    "caption": 10, "equation": 10, "reference": 10, "algorithm": 10, "abstract": 9, "header": 8, "footer": 8,
    "table": 7, "figure": 7, "title": 6, "list": 5, "paragraph": 3, "unknown": 0,
}

# Patterns of the layout rules. Java's \w is an ASCII class, and engines differ on \b beside
# letters with accents, so edges of words are spelt out.
CAPTION = r"(?i)^(fig(?:ure)?\.?\s*\d+|table\s*\d+|tab\.?\s*\d+|algorithm\s*\d+)"
TABLE_CAPTION = r"(?i)^(table|tab\.?)\s*\d+"
SECTION_NUMBER = r"^([IVX]{1,6}[.)]\s|\d{1,2}(\.\d{1,2}){0,2}[.)]\s|\d{1,2}(\.\d{1,2}){0,2}\s)"
REFERENCE_BRACKET = r"^\s*\[\d[\d,\s]*\]"
_EDGE = r"[^\p{L}\p{N}_]"
REFERENCE_NUMBERED = (
    r"(?i)^\d{1,3}\.\s+(?:[A-Z][a-z]+,\s[A-Z]"
    rf"|(?:.*{_EDGE})?et\s+al(?:{_EDGE}|$)|(?:.*{_EDGE})?(?:19|20)\d{{2}}[,.\s]"
    r"|(?:.*" + _EDGE + r")?(?:arxiv|proceedings|journal|conference|workshop|preprint|transactions|acl|emnlp|naacl|iclr|icml|neurips|nips|cvpr|iccv|eccv)"
    rf"(?:{_EDGE}|$))"
)
BULLET = r"^(\s*[-•◦▪▸*]\s+|\s*\d+[)]\s+)"
ABSTRACT = r"(?i)^abstract[\s\-—:]*$"
PAGE_NUMBER = r"^\s*\d{1,4}\s*$"
TABLE_ROW = r"\S+[ \t]{2,}\S+[ \t]{2,}\S+"
NUMERIC_TOKEN = r"^[\d.%±\-]+$"
SECTION_TITLE = r"^\s*(\d+[\.\d]*\.?\s+)?[A-Z][\p{L}\p{N}_\s\-&:]{2,60}$"
TYPED_REFERENCE = r"(?i)(?<![\p{L}\p{N}_])(fig(?:ure)?s?|tab(?:le)?s?)\.?\s*(\d+)"

# Roles and the graph.
ROLES = ("Definition", "Method", "Result", "Observation", "Dataset")
ROLE_RULES = (
    ("Method", "Result", "produces"),
    ("Method", "Observation", "produces"),
    ("Definition", "Method", "used_in"),
    ("Definition", "Result", "defines"),
    ("Definition", "Observation", "defines"),
    ("Dataset", "Result", "evaluated_on"),
    ("Dataset", "Method", "evaluated_by"),
    ("Result", "Observation", "supports"),
)
ROLE_EDGES, DEFINITION_EDGES, CO_SECTION_EDGES = 3, 5, 3
LINK_THRESHOLD, LINKS_PER_CAPTION, REFERENCE_WEIGHT = 0.30, 3, 0.7

# Retrieval.
RELATION_WEIGHTS = {"produces": 1.0, "used_in": 1.0, "evaluated_on": 1.0, "evaluated_by": 1.0, "defines": 0.9, "co_section": 0.5, "refers_to": 0.4, "contains": 0.3}
OTHER_RELATION = 0.5
INTENT_OUT = {
    "method": ("produces", "used_in", "refers_to"),
    "dataset": ("evaluated_on", "evaluated_by"),
    "result": ("refers_to",),
    "definition": ("defines", "used_in", "co_section"),
    "observation": ("produces", "refers_to"),
    "figure": ("refers_to",),
    "general": ("produces", "refers_to", "evaluated_on"),
}
INTENT_IN = {"result": ("produces", "evaluated_on"), "dataset": ("evaluated_by",), "observation": ("produces",)}
INTENT_PATTERNS = {
    "method": (r"\bmethod\b", r"\bapproach\b", r"\balgorithm\b", r"\btechnique\b", r"\barchitecture\b", r"\bmodel\b", r"\bpipeline\b", r"\bframework\b",
               r"\bhow (does|do|did|is)\b", r"\bpropose[ds]?\b", r"\btrain(ing)?\b"),
    "dataset": (r"\bdataset\b", r"\bbenchmark\b", r"\bcorpus\b", r"\bused (for|in)\b", r"\bevaluat\w+\b", r"\bbaseline\b", r"\bexperiment\b",
                r"\btrain(ing)? (set|data)\b"),
    "result": (r"\bresult\b", r"\bperformance\b", r"\baccuracy\b", r"\bscore\b", r"\bimprove\w*\b", r"\boutperform\w*\b", r"\bf1\b", r"\bbleu\b",
               r"\bprecision\b", r"\brecall\b", r"\bmetric\b"),
    "definition": (r"\bdefin\w+\b", r"\bterm\b", r"\bnotion\b", r"\bconcept\b", r"\bmeaning\b", r"\bwhat is\b", r"\bwhat are\b", r"\bformally\b",
                   r"\bdenot\w+\b", r"\brefer[s]? to\b"),
    "figure": (r"\bfigure\b", r"\bfig\b", r"\btable\b", r"\bplot\b", r"\bdiagram\b", r"\bvisuali[sz]\w*\b", r"\billustrat\w*\b", r"\bshown? in\b"),
    "observation": (r"\bobservation\b", r"\bfinding[s]?\b", r"\breport[s]?\b", r"\bdiscover\w*\b", r"\bobserv\w+\b",
                    r"\bwhat (does|do|did).{0,20}(report|show|find|note)\b"),
}
#: The variant with rank-decayed bonus knows other words for two intents, and their order differs.
INTENT_PATTERNS_V3 = {
    "method": INTENT_PATTERNS["method"],
    "dataset": (r"\bdataset\b", r"\bbenchmark\b", r"\bcorpus\b", r"\bevaluat\w+\b", r"\bbaseline\b", r"\bexperiment\b", r"\btrain(ing)? (set|data)\b"),
    "result": INTENT_PATTERNS["result"],
    "definition": INTENT_PATTERNS["definition"],
    "observation": (r"\bobservation\b", r"\bfinding[s]?\b", r"\bnotice[d]?\b", r"\breport[s]?\b", r"\bshow[s]?\b", r"\bindicate[s]?\b", r"\bsuggest[s]?\b",
                    r"\bevidence\b", r"\binsight[s]?\b"),
    "figure": INTENT_PATTERNS["figure"],
}
ALPHA, SEED_BONUS, MIN_GRAPH_SCORE, MAX_EXPANSION, WEAK_INTENT = 0.60, 0.08, 0.10, 4, 0.15
TOP_K, EXPAND_K, FINAL_K, OVERFETCH = 5, 3, 10, 6
ALPHA_V3, BONUS_V3, DECAY_V3, RESCUE_ROLE, RESCUE_K = 0.7, 0.15, 0.6, "Observation", 3
INDEX_CHARS, INDEX_MIN_CHARS, EXACT_ROWS, MAX_LISTS, PROBES = 400, 5, 500, 16, 4
LIST_ROWS = 8192  # rows that the lists of a stored index are fitted on

# Prompts and evaluation.
ROLE_PRIORITY = ("Result", "Method", "Dataset", "Definition", "Observation", "N/A")
PRIORITY_RELATIONS = ("produces", "evaluated_on", "refers_to", "used_in", "evaluated_by")
PASSAGES, PASSAGE_CHARS, PROMPT_EDGES = 6, 350, 12
EVAL_QUERIES = (
    ("What method or approach does this paper propose?", ("Method",), "method_retrieval"),
    ("What are the main results and performance metrics?", ("Result",), "result_retrieval"),
    ("What datasets or benchmarks were used for evaluation?", ("Dataset",), "dataset_retrieval"),
    ("What are the key definitions and terminology?", ("Definition",), "definition_retrieval"),
    ("What observations or findings are reported?", ("Observation",), "observation_retrieval"),
    ("How does the model training procedure work?", ("Method",), "training_method"),
    ("What figures and tables are referenced in the paper?", ("Result", "Observation"), "figure_table_reference"),
    ("What is the baseline comparison for the proposed approach?", ("Result", "Method"), "baseline_comparison"),
)
ROLE_QUERIES = {
    "Method": "What method or approach does this paper propose?",
    "Result": "What are the main results and performance metrics?",
    "Dataset": "What datasets or benchmarks were used?",
    "Definition": "What are the key definitions in this paper?",
    "Observation": "What observations or findings does the paper report?",
}


def rule_table(spark: SparkSession) -> DataFrame:
    """The role rules as rows; eight, so it is always broadcast."""
    rows = [(k, s, t, r, DEFINITION_EDGES if s == "Definition" else ROLE_EDGES) for k, (s, t, r) in enumerate(ROLE_RULES)]
    return spark.createDataFrame(rows, "rule_no int, src_role string, tgt_role string, relation string, cap int")


def intent_relations(spark: SparkSession) -> DataFrame:
    """(intent, direction, relation, multiplier): what each intent follows; 0 is out, 1 is in."""
    rows = [(i, d, r, RELATION_WEIGHTS.get(r, OTHER_RELATION)) for d, table in enumerate((INTENT_OUT, INTENT_IN)) for i, rs in table.items() for r in rs]
    return spark.createDataFrame(rows, "intent string, direction int, relation string, multiplier double")
