"""Fixed values that results depend on.

FIXED VALUES — these must stay exactly as written for results to agree with the original
pipeline and with the DuckDB oracle. Listed plainly, in natural order.
"""

# --- FIXED VALUES: English stopword list (the public NLTK English list, 179 words) ---
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don don't should should've now d ll m o re ve y ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't "
    "ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't "
    "weren weren't won won't wouldn wouldn't"
).split()

# --- FIXED VALUES: domain stopwords added by the original text pipeline ---
DOMAIN_STOPWORDS = (
    "may could result mine coal finance price risk u company financial mineral adverse "
    "adversely affect effect include"
).split()

STOPWORDS = tuple(sorted(set(ENGLISH_STOPWORDS) | set(DOMAIN_STOPWORDS)))

# --- FIXED VALUES: text rules ---
TOKEN_MIN_LEN = 3           # shortest token kept by the tokenizer
TOKEN_MAX_LEN = 15          # longest token kept by the tokenizer
SENTENCE_MIN_TOKENS = 5     # sentences with fewer whitespace tokens are dropped
SHORT_SECTION_CHARS = 32    # an extracted section shorter than this is flagged
SHORT_PARAGRAPH_WORDS = 128 # paragraphs of at most this many words feed topic discovery
NULL_TOPIC = -1             # tag used when no topic passes the threshold
TOP_K_TERMS = 8             # rarest terms kept per document in the uniqueness score

# --- FIXED VALUES: heading patterns for risk-factor section extraction (case-insensitive) ---
SECTION_START_PATTERNS = (r"item 1a ?risk factors", r"item 1a ?risk factors \(.*?\)")
SECTION_END_PATTERNS = (
    r"item 1b ?unresolved staff comments",
    r"item 2 ?properties",
    r"item 2 ?properties \(.*?\)",
    r"item 2 description of properties",
)

# --- FIXED VALUES: passive-voice surface pattern (auxiliary + optional adverb + participle) ---
PASSIVE_AUX = ("is", "are", "was", "were", "be", "been", "being")

# --- FIXED VALUES: tagger defaults of the original predictors ---
MAXSIM_MATCH_DEFAULT = 0.9
MAXSIM_TAG_DEFAULT = 2.0
TFIDF_TAG_DEFAULT = 0.3
TFIDF_ARGMAX_TAG_DEFAULT = 0.1
DENSE_TAG_DEFAULT = 0.3
SIMILAR_TOP_K = 20
SIMILAR_THRESH = 0.6
CLASSIFIER_THRESH = 0.5
ACTION_POS_MIN = 0.2

# One Arrow batch of texts for a Python worker: rows and bytes at most.
BATCH_ROWS, BATCH_BYTES = 2048, "8m"
