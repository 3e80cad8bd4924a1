"""Word lists, patterns and constants that results must agree on.

Everything here is data. Callers may pass their own lists through ``TextRules``.
"""

from dataclasses import dataclass

# Token, sentence and punctuation patterns (Java regex syntax).
TOKEN_PATTERN = r"[一-鿿]|[A-Za-z]+(?:'[A-Za-z]+)?|\p{Nd}+(?:\.\p{Nd}+)?"
SENTENCE_BREAK = r"(?U)(?<=[。！？!?；;.])\s*"
PARAGRAPH_BREAK = r"(?U)\n\s*\n|\n"
PUNCTUATION = "[，,。.!！?？；;：:、]"
COMMAS = "[，,、]"
PERIODS = "[。.!]"
QUESTIONS = "[?？]"
EXCLAMATIONS = "[!！]"
PRONOUNS = r"(?U)\b(i|we|you|he|she|they|我|我们|你|他们)\b"
NUMERALS = r"(?U)\d+"
ADVERBS = r"(?U)\b\w+ly\b"
NUMBERS = r"(?U)\d+(?:\.\d+)?"
CAPITALISED = r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"

# Phrase lists.
TEMPLATE_PHRASES = (
    "综上所述", "总而言之", "值得注意的是", "不可忽视的是", "随着", "具有重要意义", "提供了新的思路", "在一定程度上",
    "一方面", "另一方面", "不仅", "而且", "未来研究", "进一步探索", "可以看出", "由此可见", "总的来说", "显著提升", "有助于",
)
TEMPLATE_PATTERN = "为.*?提供参考"
TRANSITION_PHRASES = ("首先", "其次", "再次", "最后", "因此", "然而", "同时", "此外", "一方面", "另一方面", "总之")
DOMAIN_TERMS = (
    "模型", "算法", "数据", "实验", "政策", "研究", "系统", "效率", "风险", "指标", "framework", "model", "data", "study",
)

# Ordered phrase replacements and adverbs dropped by the rewriting rules.
PHRASE_REPLACEMENTS = (
    ("综上所述", ""),
    ("总而言之", ""),
    ("值得注意的是", "需要注意的是"),
    ("不可忽视的是", "需要看到"),
    ("具有重要意义", "有意义"),
    ("显著提升", "提升"),
    ("进一步探索", "继续研究"),
    ("It is worth noting that", ""),
    ("significantly improves", "improves"),
)
DROPPED_ADVERBS = ("非常", "显著", "极其", "不断", "充分", "clearly", "significantly", "notably")

# Unified corpus schema and the column synonyms accepted on input.
DOCUMENT_COLUMNS = ("id", "text", "label", "type", "source", "topic")
CORPUS_COLUMNS = ("id", "text", "label", "source_dataset", "language", "domain", "generator", "attack_type", "split")
METADATA_COLUMNS = CORPUS_COLUMNS + ("type", "source", "topic")
CAP_GROUP = ("source_dataset", "domain", "generator", "attack_type", "label")
SUMMARY_FIELDS = ("source_dataset", "language", "domain", "generator", "attack_type", "label", "split")
TEXT_SYNONYMS = ("text", "content", "article", "document", "essay", "response", "generation", "output", "decoded", "completion", "body")
LABEL_SYNONYMS = ("label", "is_ai", "generated", "is_generated", "ai_generated", "machine_generated")
SPLIT_SYNONYMS = ("split", "set", "subset", "partition")
DOMAIN_SYNONYMS = ("domain", "topic", "category", "source", "genre")
GENERATOR_SYNONYMS = ("generator", "model", "model_name", "source_model", "llm", "engine")
ATTACK_SYNONYMS = ("attack_type", "attack", "perturbation", "transformation")
EXTERNAL_TEXT = ("text", "content", "input", "document", "response")
EXTERNAL_LABEL = ("label", "is_ai", "class", "target")
EXTERNAL_GENERATOR = ("generator", "model")
EXTERNAL_DOMAIN = ("domain", "category", "source")

# Ordered category rules, first hit wins.
DOMAIN_RULES = (
    ("essay", ("essay", "student", "school", "sst")),
    ("creative_writing", ("creative", "story", "fiction", "poem")),
    ("news", ("news", "article", "journalism")),
    ("wiki", ("wiki", "wikipedia")),
    ("arxiv", ("arxiv", "paper", "abstract", "academic")),
    ("qa", ("qa", "q&a", "question", "answer")),
    ("reddit", ("reddit", "social", "comment", "forum")),
)
DOMAIN_PATH_RULES = (
    ("essay", ("essay",)),
    ("arxiv", ("peerread",)),
    ("creative_writing", ("fiction", "creative", "story")),
    ("news", ("news",)),
    ("qa", ("wikihow",)),
    ("wiki", ("wiki",)),
    ("arxiv", ("arxiv", "abstract")),
    ("reddit", ("reddit",)),
    ("qa", ("qa", "question")),
)
GENERATOR_RULES = (
    ("human", ("human", "real", "reference")),
    ("chatgpt", ("chatgpt",)),
    ("gpt3.5", ("gpt-3.5", "gpt3.5", "turbo", "gpt_3_5")),
    ("gpt4", ("gpt-4", "gpt4")),
    ("davinci", ("davinci",)),
    ("cohere", ("cohere",)),
    ("llama", ("llama",)),
    ("mistral", ("mistral", "mixtral")),
    ("claude", ("claude",)),
)
GENERATOR_PATH_RULES = (
    ("chatgpt", ("chatgpt",)),
    ("davinci", ("davinci",)),
    ("gpt4", ("gpt4", "gpt-4")),
    ("gpt3.5", ("gpt3.5", "gpt-3.5", "turbo")),
    ("cohere", ("cohere",)),
    ("llama", ("llama",)),
    ("mistral", ("mistral",)),
    ("claude", ("claude",)),
)
ATTACK_RULES = (
    ("none", ("none", "original", "clean", "no_attack", "human")),
    ("paraphrase", ("paraphrase", "rewrite", "rephrase")),
    ("synonym", ("synonym", "substitution")),
    ("misspelling", ("misspelling", "typo")),
    ("homoglyph", ("homoglyph",)),
    ("whitespace", ("whitespace", "spacing")),
    ("mixed", ("mixed", "combo", "combined")),
)
SPLIT_RULES = (
    ("train", ("train", "training")),
    ("dev", ("dev", "valid", "validation", "val")),
    ("test", ("test", "eval", "evaluation")),
    ("external_test", ("external_test", "external", "ood", "attack")),
)
SPLIT_PATH_RULES = (("train", ("train",)), ("dev", ("val", "dev")), ("test", ("test",)))
HUMAN_PATH_WORDS = ("human", "reference", "real")
MACHINE_PATH_WORDS = ("ai", "generated", "chatgpt", "gpt", "llama", "mistral", "claude", "davinci", "cohere")

# Sequence features.
LOSS_STATISTICS = (
    "ppl", "loss_mean", "loss_std", "loss_cv", "loss_min", "loss_max", "loss_range", "loss_skewness", "loss_kurtosis",
    "top_10_percent_loss_mean", "bottom_10_percent_loss_mean", "token_count_used",
)
SCALE_METRICS = (
    "ppl", "loss_mean", "loss_std", "loss_cv", "loss_range", "loss_skewness", "loss_kurtosis",
    "top_10_percent_loss_mean", "bottom_10_percent_loss_mean",
)
STATE_COUNTS = (3, 5, 7)
SEQUENCE_MARKERS = ("loss_sequence", "token_losses", "token_loss_sequence", "losses_json")
RIDGE = 1e-3
MIN_STEPS = 20
TINY = 1e-12
SMALL = 1e-8

# Reasons shown with a score, in the order they are tried, and the fallback.
EVIDENCE_TEMPLATE = "many set phrases"
EVIDENCE_SENTENCES = "sentences of nearly the same length"
EVIDENCE_LOSS = "an even surprise from token to token"
EVIDENCE_COMPRESSION = "a text that packs unusually well"
EVIDENCE_PAIR = "the two language models disagree about the text"
EVIDENCE_FEATURE = " stands out"
EVIDENCE_NONE = "no single strong sign; the classifier weighs many small ones"


@dataclass(frozen=True)
class TextRules:
    """Phrase lists used by the document features; replace any of them per corpus."""

    template_phrases: tuple = TEMPLATE_PHRASES
    template_pattern: str = TEMPLATE_PATTERN
    transition_phrases: tuple = TRANSITION_PHRASES
    domain_terms: tuple = DOMAIN_TERMS
    phrase_replacements: tuple = PHRASE_REPLACEMENTS
    dropped_adverbs: tuple = DROPPED_ADVERBS
