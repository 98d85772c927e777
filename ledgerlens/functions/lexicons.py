"""Fixed values.

Everything in this module is data, not logic. Values that must equal the
analysed workload's behaviour are stated plainly, in natural order, each under
a comment marking it as a fixed value. Tables marked "own" are this project's
own small word tables (the original relied on external libraries for them).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: EDGAR submission handling
# ---------------------------------------------------------------------------

# Document types that never carry readable text.
SKIP_TYPES = (
    "GRAPHIC", "ZIP", "EXCEL", "PDF", "JSON", "XML",
    "XBRL", "IDEA", "SCHEMA", "CAL", "DEF", "LAB", "PRE",
)

# XBRL auxiliary documents: this prefix, or exactly one of these types.
XBRL_AUX_PREFIX = "EX-101."
XBRL_AUX_EXACT = ("EX-101", "101")

# Exhibit prefixes that are always kept.
KEEP_PREFIXES = ("EX-10", "EX-99")

# Header lines that mark where a readable filing starts (leading-gunk cut).
GUNK_MARKERS = (
    "UNITED STATES",
    "SECURITIES AND EXCHANGE COMMISSION",
    "FORM 8-K",
    "FORM 10-K",
    "FORM 10-Q",
    "SCHEDULE 14A",
    "DEFINITIVE PROXY STATEMENT",
    "CURRENT REPORT",
)

# Tag names whose presence marks a body as HTML.
HTML_HINT_TAGS = ("html", "body", "div", "p", "br", "table", "tr", "td", "font")

# Preferred document types for the chunk corpus (exact, case-sensitive).
PREFERRED_TYPES = ("10-K", "10-Q", "8-K", "S-1", "S-3", "S-4", "424B5", "424B2", "424B3", "DEF 14A")

# Banner written before each kept section of a clean filing.
SECTION_BANNER_PREFIX = "----- DOCUMENT TYPE: "
SECTION_BANNER_SUFFIX = " -----"
UNKNOWN_TYPE = "UNKNOWN"

# Clean-text sink name suffix.
CLEAN_SUFFIX = "_clean.txt"

# ---------------------------------------------------------------------------
# FIXED VALUES: chunking
# ---------------------------------------------------------------------------
MIN_CHUNK_CHARS = 450
TARGET_CHUNK_CHARS = 1100
MAX_CHUNK_CHARS = 1600
MIN_CLEANED_CHARS = 1000
TABLE_MIN_CHARS = 200
TABLE_DIGIT_RATIO = 0.18

# ---------------------------------------------------------------------------
# FIXED VALUES: finance token stop set (general list, then domain extras)
# ---------------------------------------------------------------------------
BASE_STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are",
    "aren't", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both",
    "but", "by", "can't", "cannot", "could", "couldn't", "did", "didn't", "do", "does", "doesn't",
    "doing", "don't", "down", "during", "each", "few", "for", "from", "further", "had", "hadn't",
    "has", "hasn't", "have", "haven't", "having", "he", "he'd", "he'll", "he's", "her", "here",
    "here's", "hers", "herself", "him", "himself", "his", "how", "how's", "i", "i'd", "i'll",
    "i'm", "i've", "if", "in", "into", "is", "isn't", "it", "it's", "its", "itself", "let's", "me",
    "more", "most", "mustn't", "my", "myself", "no", "nor", "not", "of", "off", "on", "once",
    "only", "or", "other", "ought", "our", "ours", "ourselves", "out", "over", "own", "same",
    "shan't", "she", "she'd", "she'll", "she's", "should", "shouldn't", "so", "some", "such",
    "than", "that", "that's", "the", "their", "theirs", "them", "themselves", "then", "there",
    "there's", "these", "they", "they'd", "they'll", "they're", "they've", "this", "those",
    "through", "to", "too", "under", "until", "up", "very", "was", "wasn't", "we", "we'd", "we'll",
    "we're", "we've", "were", "weren't", "what", "what's", "when", "when's", "where", "where's",
    "which", "while", "who", "who's", "whom", "why", "why's", "with", "won't", "would", "wouldn't",
    "you", "you'd", "you'll", "you're", "you've", "your", "yours", "yourself", "yourselves",
)

FIN_EXTRA_STOPWORDS = (
    "section", "herein", "hereby", "thereof", "exhibit", "prospectus", "form",
    "llc", "inc", "corporation", "company", "issuer", "tender", "exchange",
    "may", "shall", "pursuant", "filing", "statement", "table", "contents",
    "security", "securities", "notes", "debentures", "shares", "rate", "interest",
    "benchmark", "maturity", "coupon", "floating", "fixed", "redemption",
    "rule", "holders", "offering", "registrant", "corporate", "document",
)

FIN_MIN_TOKEN_LEN = 4  # tokens must be longer than 3 characters

# ---------------------------------------------------------------------------
# FIXED VALUES: English stop-word list of the speech preprocessing (the
# widely published NLTK English list); "not" and "no" are kept as words.
# ---------------------------------------------------------------------------
ENGLISH_STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
)
KEEP_NEGATIONS = ("not", "no")
MIN_WORD_LEN = 3

# ASCII punctuation deleted by the speech preprocessing.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# ---------------------------------------------------------------------------
# FIXED VALUES: analyst exclusion list applied after phrase detection
# (47 entries as written; "upon" appears twice).
# ---------------------------------------------------------------------------
EXCLUSION_LIST = (
    "january", "february", "march",
    "april", "may", "june",
    "july", "august", "september",
    "october", "november", "december",
    "html", "available_httpswwwsecgovnewspressrelease",
    "nonyous", "still", "mdash",
    "using", "ass", "although",
    "pdf", "really", "conclusion",
    "conference", "percent", "sept",
    "specific", "upon", "generally",
    "likely", "through", "currently",
    "across", "upon", "indeed",
    "increasingly", "toward", "truly",
    "always", "far", "effectively",
    "thus", "ago", "york",
    "never", "simply", "perhaps",
)

# ---------------------------------------------------------------------------
# FIXED VALUES: model and report parameters
# ---------------------------------------------------------------------------
PHRASE_MIN_COUNT = 5
PHRASE_THRESHOLD = 100.0
DICT_NO_BELOW = 15
DICT_NO_ABOVE = 0.4
DICT_KEEP_N = 80000
LDA_K = 9
LDA_CHUNKSIZE = 4000
LDA_PASSES = 20
LDA_SEED = 100
COHERENCE_WINDOW = 110
COHERENCE_TOPN = 20
EPSILON = 1e-12
TOP_WORDS_REPORT = 15
TOPIC_SUMMARY_TOPICS = 8
TOPIC_SUMMARY_TERMS = 8
SUM_WEIGHT_MIN = 0.01
SPEECH_DATE_AFTER = "1997-10-01"
NO_TOPICS_TEXT = "No topics parsed."
UNKNOWN_TEXT = "Unknown"

# Tuning grid of the LDA search (k range, document priors, word priors, corpus shares).
GRID_K = tuple(range(2, 21))
GRID_ALPHA = (0.01, 0.31, 0.61, 0.91, "symmetric", "asymmetric")
GRID_BETA = (0.01, 0.31, 0.61, 0.91, "symmetric")
GRID_CORPORA = (("75% Corpus", 0.75), ("100% Corpus", 1.0))

# ---------------------------------------------------------------------------
# Own tables (not from the analysed workload): contraction expansion, noun
# lemma exceptions, theme lexicon.
# ---------------------------------------------------------------------------
CONTRACTIONS = {
    "ain't": "are not", "aren't": "are not", "can't": "cannot", "couldn't": "could not",
    "didn't": "did not", "doesn't": "does not", "don't": "do not", "hadn't": "had not",
    "hasn't": "has not", "haven't": "have not", "he's": "he is", "i'd": "i would",
    "i'll": "i will", "i'm": "i am", "i've": "i have", "isn't": "is not", "it's": "it is",
    "let's": "let us", "shouldn't": "should not", "that's": "that is", "there's": "there is",
    "they're": "they are", "they've": "they have", "wasn't": "was not", "we're": "we are",
    "we've": "we have", "weren't": "were not", "won't": "will not", "wouldn't": "would not",
    "you're": "you are", "you've": "you have", "y'all": "you all",
}

LEMMA_EXCEPTIONS = {
    "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth",
    "mice": "mouse", "geese": "goose", "analyses": "analysis", "crises": "crisis",
    "criteria": "criterion", "phenomena": "phenomenon", "indices": "index",
}
# Plural endings that are left alone by the suffix rule.
LEMMA_KEEP_ENDINGS = ("ss", "us", "is", "ous", "ics")

THEMES = {
    "Financial Performance": (
        "revenue", "revenues", "income", "profit", "earnings", "margin", "sales", "cash",
        "growth", "net", "operating", "billion", "million", "tax", "costs",
    ),
    "Management / Leadership": (
        "management", "executive", "board", "director", "directors", "officer", "chief",
        "leadership", "president", "chairman", "committee",
    ),
    "Risk / Compliance": (
        "risk", "risks", "compliance", "regulation", "regulatory", "legal", "litigation",
        "audit", "control", "controls", "enforcement", "investigation",
    ),
    "Market / Operations": (
        "market", "markets", "customers", "services", "products", "operations", "supply",
        "competition", "demand", "pricing", "trade",
    ),
}

# ---------------------------------------------------------------------------
# FIXED VALUES: derived test views (filing forms and exhibit types by key)
# ---------------------------------------------------------------------------
VIEW_FORMS = ("8-K", "10-K", "10-Q", "DEFA14A", "10-K/A")
VIEW_EXHIBIT_99 = "EX-99.1"
VIEW_EXHIBIT_10 = "EX-10.1"
VIEW_AUX_TYPES = ("GRAPHIC", "EX-101.INS", "XML", "EX-104")
